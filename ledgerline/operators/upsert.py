"""Insert-or-update of a whole batch as one join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def keep_old(old: Column, new: Column) -> Column:
    return old


def latest(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row per key, the one with the largest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def upsert(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    rules: dict[str, Rule] | None = None,
    on_insert: dict[str, Rule] | None = None,
) -> DataFrame:
    """``old``, one row per key, after the batch ``new``.

    A key that the batch repeats takes one of its rows: the one with the largest
    ``computed_at`` if the batch has that column, equal ones by the largest row.
    A matched row takes each column's new value unless ``rules`` says otherwise;
    rules see the old row as ``o.<column>`` and the new one as ``n.<column>``.
    ``on_insert`` does the same for rows that are only in ``new``.
    """
    rules, on_insert = rules or {}, on_insert or {}
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("o"), F.lit(True).alias("_in_old"))
    ranked = sorted(rest, key=lambda c: c != "computed_at")  # computed_at first, and every column once
    n = new.groupBy(*keys).agg(F.max(F.struct(*ranked)).alias("n")).withColumn("_in_new", F.lit(True))
    joined = o.join(n, keys, "full_outer")

    def value(name: str) -> Column:
        before, after = F.col(f"o.{name}"), F.col(f"n.{name}")
        matched = rules[name](before, after) if name in rules else after
        inserted = on_insert[name](before, after) if name in on_insert else after
        return (
            F.when(F.col("_in_new").isNull(), before)
            .when(F.col("_in_old").isNull(), inserted)
            .otherwise(matched)
            .alias(name)
        )

    return joined.select(*[F.col(c) if c in keys else value(c) for c in old.columns])
