"""Expressions over SQL text, names and free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import values as V

COLUMN_REF = r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)"
QUOTED_REF = r"`([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)`"


def infer_layer(table: Column) -> Column:
    known = [F.when(table.startswith(prefix), layer) for prefix, layer in V.LAYER_PREFIXES]
    return F.coalesce(*known, F.lit("unknown"))


def hash_sql(sql: Column) -> Column:
    """Digest of the statement without surrounding white space and case."""
    return F.sha2(F.lower(F.regexp_replace(sql, r"^\s+|\s+$", "")), 256)


def type_sensitive(expression: Column) -> Column:
    text = F.lower(F.coalesce(expression, F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(p) for p in V.TYPE_SENSITIVE])


def _refs(text: Column, pattern: str) -> Column:
    """Every (table, column) the pattern finds, as an array of structs."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(
        whole,
        lambda m: F.struct(
            F.regexp_extract(m, pattern, 1).alias("table"), F.regexp_extract(m, pattern, 2).alias("column")
        ),
    )


def column_refs(text: Column) -> Column:
    return _refs(F.coalesce(text, F.lit("")), COLUMN_REF)


def quoted_refs(text: Column) -> Column:
    return _refs(F.coalesce(text, F.lit("")), QUOTED_REF)


def tokenize(text: Column) -> Column:
    """Lower-case alphanumeric words of two or more characters."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: F.length(w) > 1)


def truncate_text(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def transform_shape(expression: Column, alias: Column, n_tables: Column | None = None) -> Column:
    """Transform type of a projection text (``expr AS alias``), first rule wins.

    An expression without a column is a constant, whatever it calls; a CASE or
    COALESCE over two or more base tables is ambiguous whatever its shape; then
    come aggregates, windows, bare columns and the rest.  String literals are
    blanked first, so what they say counts for nothing.
    """
    body = F.regexp_replace(F.trim(expression), r"'(?:[^']|'')*'", "''")
    low = F.lower(body)
    # What is left after numbers, called names and reserved words are taken out is a column.
    typed = r"\binterval\s+(?:''|\d+)\s+[a-z]+|\b(?:date|time|timestamp|interval)\s+''|\bas\s+[a-z]\w*"
    names = F.regexp_replace(F.regexp_replace(low, typed, " "), r"\b\d+(\.\d+)?\b|\b[a-z_]\w*\s*(?=\()", " ")
    names = F.regexp_replace(names, r"(?<!\.)\b(" + "|".join(V.RESERVED) + r")\b(?!\.)", " ")
    constant = ~names.rlike(r"[a-z_]")
    many = (n_tables >= 2) if n_tables is not None else F.lit(False)
    ambiguous = low.rlike(r"\bcase\b|\bcoalesce\s*\(") & many
    aggregate = low.rlike(r"\b(" + "|".join(V.AGGREGATES) + r")\s*\(")
    window = low.rlike(r"\bover\s*\(")
    bare = body.rlike(r"^([A-Za-z_]\w*\.)?[A-Za-z_]\w*$")
    name = F.regexp_extract(body, r"([A-Za-z_]\w*)$", 1)
    return (
        F.when(constant, "CONSTANT")
        .when(ambiguous, "AMBIGUOUS")
        .when(aggregate, "AGGREGATE")
        .when(window, "WINDOW")
        .when(bare & (name == alias), "PASSTHROUGH")
        .when(bare, "RENAME")
        .otherwise("TRANSFORM")
    )
