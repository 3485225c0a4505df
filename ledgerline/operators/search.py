"""Text search over columns and datasets.

A query is a parameter, so a search is one projection of the searched table: no
join and no limit before scoring.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V
from ledgerline.functions.text import infer_layer, quoted_refs


def query_terms(query: str) -> list[str]:
    """Lower-case alphanumeric words of two or more characters."""
    return [t for t in re.split(r"[^a-z0-9]+", (query or "").lower()) if len(t) > 1]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _hits(text: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: text.contains(t))


def score_column(terms: list[str], description: Column, column: Column, dataset: Column) -> tuple[Column, Column]:
    """(score 0..3, reason); the first rule that fits decides."""
    text, name, table = (F.lower(F.coalesce(c, F.lit(""))) for c in (description, column, dataset))
    in_text = [text.contains(t) for t in terms]
    in_name = [name.contains(t) | F.lit(t).contains(name) for t in terms]
    in_table = [table.contains(t) for t in terms]
    starts = [t[:4] for t in terms if len(t) >= 4]
    partial = _any([name.contains(s) for s in starts]) if starts else F.lit(False)
    rules = [
        (reduce(lambda a, b: a & b, in_text), 3, F.lit("description has all terms")),
        (_any(in_text), 2, F.concat(F.lit("description has "), F.array_join(_hits(text, terms), ", "))),
        (_any(in_name), 2, F.concat(F.lit("column name matches "), name)),
        (_any(in_table), 1, F.concat(F.lit("table name has "), F.array_join(_hits(table, terms), ", "))),
        (partial, 1, F.lit("column name has a term's start")),
    ]
    score = reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])).otherwise(0)
    reason = reduce(lambda c, r: c.when(r[0], r[2]), rules[1:], F.when(rules[0][0], rules[0][2])).otherwise("no match")
    return score, reason


def score_columns(columns: DataFrame, query: str, layer: str = "") -> DataFrame:
    """All matching columns with score and reason."""
    terms = query_terms(query)
    if not terms:
        raise ValueError("empty query")
    if layer and layer not in V.LAYER_WORDS:
        raise ValueError(f"unknown layer {layer!r}")
    score, reason = score_column(terms, F.col("semantic_description"), F.col("column_name"), F.col("dataset_name"))
    scored = columns.withColumns(
        {"score": score, "reason": reason, "layer": infer_layer(F.col("dataset_name")), "confidence": F.coalesce("confidence", F.lit(0.0))}
    ).where(F.col("score") > 0)
    return scored.where(F.col("layer") == layer) if layer else scored


def search_columns(columns: DataFrame, query: str, layer: str = "", k: int = 20) -> DataFrame:
    """Best ``k`` columns: score, then confidence, then names."""
    return (
        score_columns(columns, query, layer)
        .orderBy(F.col("score").desc(), F.col("confidence").desc(), "dataset_name", "column_name")
        .limit(max(1, int(k)))
    )


def score_datasets(datasets: DataFrame, query: str) -> DataFrame:
    """Datasets whose name holds at least one term, with the number of terms."""
    terms = query_terms(query)
    if not terms:
        raise ValueError("empty query")
    name = F.lower("name")
    hits = reduce(lambda a, b: a + b, [name.contains(t).cast("int") for t in terms])
    return datasets.withColumn("hits", hits).where(F.col("hits") > 0)


def search_datasets(datasets: DataFrame, query: str, k: int = 10) -> DataFrame:
    return score_datasets(datasets, query).orderBy(F.col("hits").desc(), "name").limit(k)


def preferred_layers(query: str) -> list[str]:
    """Layers in the order the query's words suggest, facts first by default."""
    low = (query or "").lower()
    named = [layer for layer, words in V.LAYER_WORDS.items() if any(w in low for w in words)]
    default = ["layer_2", "layer_1", "layer_0"]
    return [l for l in default if l in named] + [l for l in default if l not in named]


def layer_preference(matches: DataFrame, query: str) -> DataFrame:
    """Add ``layer_rank``: a named layer first, then the others."""
    order = preferred_layers(query)
    rank = reduce(lambda c, p: c.when(F.col("layer") == p[1], p[0]), enumerate(order), F.when(F.lit(False), -1))
    return matches.withColumn("layer_rank", rank.otherwise(len(order)))


def harvest_refs(texts: DataFrame, text_col: str, known_tables: list[str]) -> DataFrame:
    """References in free text: back-quoted ``table.column`` and bare known tables.

    One row per text and distinct reference; a bare table has NULL as column.
    """
    others = [c for c in texts.columns if c != text_col]
    quoted = texts.select(*others, F.explode(quoted_refs(F.col(text_col))).alias("r")).select(
        *others, F.col("r.table").alias("table"), F.col("r.column").alias("column")
    )
    # One pass over the text: its words meet the known names in a join, however many there are.
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"([a-z0-9_]+)")))
    known = texts.sparkSession.createDataFrame([(t.lower(), t) for t in known_tables], "_word string, table string")
    named = texts.select(*others, F.explode(words).alias("_word")).join(known, "_word").drop("_word")
    found = quoted.unionByName(named.withColumn("column", F.lit(None).cast("string"))).distinct()
    return found.withColumn("layer", F.when(F.lower("table").isin([t.lower() for t in known_tables]), infer_layer(F.col("table"))).otherwise(""))


def describe_sources(columns: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated text per (table, column), any case; a text already there stays."""
    texts = curated.select(
        F.lower("dataset_name").alias("_t"), F.lower("column_name").alias("_c"), F.col("description").alias("_text")
    )
    joined = columns.withColumns({"_t": F.lower("dataset_name"), "_c": F.lower("column_name")}).join(texts, ["_t", "_c"], "left")
    own = F.when(F.col("semantic_description") != "", F.col("semantic_description"))
    return joined.withColumn("semantic_description", F.coalesce(own, "_text", F.lit(""))).drop("_t", "_c", "_text")
