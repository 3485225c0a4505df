"""Global percent rank without funnelling the table through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.scale import lookup_left_join
from ledgerline.session import pin


def percent_rank_global(
    df: DataFrame, order_col: str, out_col: str
) -> DataFrame:
    """``PERCENT_RANK() OVER (ORDER BY order_col)`` over the whole frame.

    Equal to the window function (NULLs rank last), but computed on the distinct
    values: they are counted map-side, range-partitioned, ranked inside their
    partition and shifted by the rows of the lower partitions.  The offsets are
    one row per partition.  A value shared by very many rows is one distinct row
    here and a hot key of the lookup join at the end.  ``df`` is read twice, so a
    frame that is costly to compute should be pinned or written first.
    """
    value = F.col(order_col)
    blank = F.lit(0).cast(df.schema[order_col].dataType)
    rows = df.withColumn("_isnull", value.isNull()).withColumn("_v", F.coalesce(value, blank))
    counts = rows.groupBy("_isnull", "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = pin(counts.repartitionByRange("_isnull", "_v").withColumn("_part", F.spark_partition_id()))

    before = Window.unboundedPreceding, -1
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("_rows"))
    # One row per partition, so this unpartitioned window is small by construction.
    shift = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(*before)), F.lit(0))
    inside = Window.partitionBy("_part").orderBy("_isnull", "_v").rowsBetween(*before)
    placed = (
        ranged.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(totals.select("_part", shift.alias("_shift")), "_part")
        .withColumn("_lower", F.col("_inside") + F.col("_shift"))
    )
    n = ranged.agg(F.sum("_n")).scalar()
    ranked = placed.withColumn("_all", n).select(
        "_isnull",
        "_v",
        F.when(F.col("_all") > 1, F.col("_lower") / (F.col("_all") - 1).cast("double")).otherwise(F.lit(0.0)).alias(out_col),
    )
    joined = lookup_left_join(rows, ranked, ["_isnull", "_v"], [out_col])
    return joined.select(*df.columns, out_col)
