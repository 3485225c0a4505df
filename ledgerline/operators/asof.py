"""As-of joins with optional back-fill from the earliest known row.

The facts are never sorted by time.  Their distinct (key, time) pairs are resolved
against the dimension, and the answer is looked up by equality.  With day-grained
times the pairs are few whatever the number of facts, and adaptive execution can
broadcast them by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.scale import lookup_left_join, running_last


def _resolve_pairs(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_ts: str,
    right_ts: str,
    right_cols: list[str],
    tie: str | None,
) -> DataFrame:
    """One row per distinct (key, time) of ``left``: as-of hit, earliest hit."""
    payload = F.struct(*right_cols)
    # One right row per (key, time); equal times are settled by the tie column.
    dims = (
        right.where(F.col(right_key).isNotNull() & F.col(right_ts).isNotNull())
        .groupBy(F.col(right_key).alias("_k"), F.col(right_ts).alias("_t"))
        .agg(F.max_by(payload, F.col(tie) if tie else payload).alias("_payload"))
        .withColumn("_side", F.lit(0))
    )
    pairs = (
        left.where(F.col(left_key).isNotNull() & F.col(left_ts).isNotNull())
        .select(F.col(left_key).alias("_k"), F.col(left_ts).alias("_t"))
        .distinct()
        .withColumn("_side", F.lit(1))
    )
    # Side 0 sorts first, so an equal time counts as "at or before".
    timeline = dims.unionByName(pairs, allowMissingColumns=True)
    resolved = running_last(timeline, ["_k"], ["_t", "_side"], "_payload", "_asof", first_out="_first")
    return resolved.where(F.col("_side") == 1).select("_k", "_t", "_asof", "_first")


def _attach(left: DataFrame, resolved: DataFrame, left_key: str, left_ts: str) -> DataFrame:
    """Answers looked up by (key, time); the number of pairs picks the join."""
    return lookup_left_join(
        left,
        resolved.withColumnsRenamed({"_k": left_key, "_t": left_ts}),
        [left_key, left_ts],
        ["_asof", "_first"],
    )


def asof_left_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_ts: str,
    right_ts: str,
    right_cols: dict[str, str],
    tie: str | None = None
) -> DataFrame:
    """Latest ``right`` row of the same key at or before each left row.

    ``right_cols`` maps right columns to output names; unmatched left rows keep
    NULLs.  Rows of ``right`` that share key and time are settled by the largest
    ``tie`` (by the largest payload if none is named).
    """
    resolved = _resolve_pairs(left, right, left_key, right_key, left_ts, right_ts, list(right_cols), tie)
    joined = _attach(left, resolved, left_key, left_ts)
    return joined.select(*left.columns, *[F.col("_asof")[c].alias(o) for c, o in right_cols.items()])


def pick_rate(currency: Column, asof_rate: Column, first_rate: Column, base: str, dtype: str) -> Column:
    """1 for the base currency, else the as-of rate, else the earliest rate."""
    return (
        F.when(currency == base, F.lit(1).cast(dtype)).when(asof_rate.isNotNull(), asof_rate).otherwise(first_rate)
    )


def asof_backfill(
    tx: DataFrame,
    rates: DataFrame,
    key: str,
    rate_key: str,
    tx_date: str,
    rate_date: str,
    rate: str,
    source: str,
    base_key: str,
    tie: str | None = None
) -> DataFrame:
    """Add ``fx_rate_used`` and ``fx_rate_source`` to every transaction.

    Base-currency rows get rate 1 and no source; rows older than the first rate
    of their currency get that first rate, tagged with the suffix ``_BACKFILL``;
    a currency without rates gets NULL for both.
    """
    dtype = rates.schema[rate].dataType.simpleString()
    resolved = _resolve_pairs(tx, rates, key, rate_key, tx_date, rate_date, [rate, source], tie)
    joined = _attach(tx, resolved, key, tx_date)
    asof, first = F.col("_asof"), F.col("_first")
    label = (
        F.when(F.col(key) == base_key, F.lit(None).cast("string"))
        .when(asof[rate].isNotNull(), asof[source])
        .otherwise(F.concat(first[source], F.lit("_BACKFILL")))
    )
    return joined.select(
        *tx.columns,
        pick_rate(F.col(key), asof[rate], first[rate], base_key, dtype).alias("fx_rate_used"),
        label.alias("fx_rate_source"),
    )
