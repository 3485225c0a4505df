"""Building blocks of joins and ordered look-backs.

``lookup_left_join``  many rows against one row per key
``running_last``      "latest value so far" over an ordered key, split by range
``semi_naive``        all rows that steps lead to, level by level

Joins are left to adaptive execution: it broadcasts a side once its bytes are
known and cuts partitions that hot or NULL keys fill, on either side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerline.session import pin, scratch_path


def lookup_left_join(left: DataFrame, lookup: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``left`` left-joined to a lookup with one row per key; ``cols`` are added."""
    joined = left.join(lookup.select(*keys, F.struct(*cols).alias("_hit")), keys, "left")
    return joined.select(*left.columns, *[F.col("_hit")[c].alias(c) for c in cols])


def running_last(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    out: str,
    strict: bool = False,
    first_out: str | None = None,
) -> DataFrame:
    """Per key, the last non-NULL ``value`` up to each row in ``order``.

    ``strict`` excludes the row itself (a lag that skips NULLs); ``first_out``
    adds the key's first non-NULL value.  Rows are range-partitioned on
    ``keys + order``, so a hot key spans many partitions; what a partition needs
    from the earlier ones is one value per (key, partition), at most
    ``keys + partitions`` rows.  The range-partitioned frame is pinned because
    its partition id must not change on recomputation.
    """
    ranged = pin(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    stop = -1 if strict else Window.currentRow
    keep = [*df.columns, out] + ([first_out] if first_out else [])
    seen = F.col(value).isNotNull()
    pos = F.struct(*order)
    ends = ranged.groupBy("_part", *keys).agg(
        F.max_by(value, F.when(seen, pos)).alias("_tail"),
        F.min_by(value, F.when(seen, pos)).alias("_head"),
    )
    by_part = Window.partitionBy(*keys).orderBy("_part")
    ends = ends.withColumn(
        "_carry", F.last("_tail", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn(
        "_first",
        F.first("_head", ignorenulls=True).over(
            by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
    local = ranged.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    joined = local.join(ends.select("_part", *keys, "_carry", "_first"), ["_part", *keys], "left")
    result = joined.withColumn(out, F.coalesce("_local", "_carry"))
    if first_out:
        result = result.withColumn(first_out, F.col("_first"))
    return result.select(*keep)


def bucketed(df: DataFrame, key: list[str], buckets: int) -> tuple[DataFrame, int]:
    """Write a frame that is dealt by ``key`` to the shared folder, and read it so that joins by ``key`` leave it in place; its rows."""
    spark, rows = df.sparkSession, Observation()
    name = f"bucketed_{uuid.uuid4().hex}"
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.bucketBy(buckets, *key).option("path", scratch_path(spark, "bucketed")).saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and so does what was read of them
    return kept, rows.get["n"]


#: Parts of what a closure has seen that stay as they are before any two are put together.
LOOSE = 4


def semi_naive(
    first: DataFrame, step: Callable[[DataFrame, int], DataFrame], key: list[str], levels: int | None = None
) -> DataFrame:
    """``first`` and all rows that ``step`` leads to from them, the first found row of each ``key``.

    ``step(rows, k)`` expands the rows that level k - 1 found; a level is what
    was not seen before, so the closure ends by itself, cycles or not.  With
    ``levels`` it ends there.

    Every level is a table of its own, bucketed by ``key``: a new one is compared
    with those before by anti joins that move only the new rows (merges, never
    broadcasts: nothing that was found goes to the driver), and what was
    seen is not written again, but for joining small parts to larger ones, where
    a row's part at least grows by half each time.  Bytes written thus grow with
    the rows found, not with levels times rows.  Keys must not be NULL.
    """
    spark = first.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts: list[tuple[DataFrame, int]] = []
    level = 0

    def unseen(rows: DataFrame) -> tuple[DataFrame, int]:
        rows = rows.repartition(spread, *key).dropDuplicates(key)
        for part, _ in parts:
            rows = rows.join(part.select(*key).hint("merge"), key, "left_anti")
        return bucketed(rows.select(*first.columns), key, spread)

    found, n = unseen(first)
    while n:
        parts.append((found, n))
        while len(parts) > LOOSE and 2 * parts[-1][1] >= parts[-2][1]:
            (late, _), (early, _) = parts.pop(), parts.pop()
            parts.append(bucketed(early.unionByName(late).repartition(spread, *key), key, spread))
        if levels is not None and level >= levels:
            break
        level += 1
        found, n = unseen(step(found, level))
    return reduce(lambda a, b: a.unionByName(b), [p for p, _ in parts] or [found])
