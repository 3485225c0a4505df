"""Mix sources to target weights by systematic sampling.

Every document of a source is due ``target / source size`` copies.  Documents
stand in one line per source; the running sum of copies, moved by one random
offset per source, crosses an integer boundary once per emitted copy.  So a
source's number of copies is exact to one, and because the line is ordered by
size, its number of words is near the target too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Packed, stored, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0

_ROW = (1 << 33) - 1


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per source: source_size, target, offset.

    Targets divide ``share`` of all words by weight; none is above ``limit``
    times its source, what is cut off goes to the others by weight.  Levels are
    found in closed form: a source is full when the total at its own full level
    stays below what is to be shared.  The windows here see one row per source.
    """
    everything = Window.partitionBy()
    by_level = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    kinds = kinds.withColumn("weight", weight)
    kinds = kinds.withColumns({"cap": limit * F.col("source_size"), "level": limit * F.col("source_size") / F.col("weight")})
    kinds = kinds.withColumns(
        {
            "all_size": F.sum("source_size").over(everything),
            "all_weight": F.sum("weight").over(everything),
            "cap_below": F.sum("cap").over(by_level),
            "weight_below": F.sum("weight").over(by_level),
        }
    )
    reach = F.col("cap_below") + F.col("level") * (F.col("all_weight") - F.col("weight_below"))
    kinds = kinds.withColumn("full", reach <= share * F.col("all_size"))
    full_cap = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    full_weight = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(everything)
    water = (share * F.col("all_size") - full_cap) / F.nullif(F.col("all_weight") - full_weight, F.lit(0.0))
    kinds = kinds.withColumn("water", water)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return kinds.select("source", "source_size", target.alias("target"))


def _offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) drawn from the seed and the source's name."""
    name = F.concat(F.lit(seed), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix_sources(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: str = "mix",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0, 1, ... per row).

    Null texts and texts without words have size 0; a null source is a source
    of its own, last in order.  Repeated rows are separate documents, and equal
    rows may swap their copies.  The same input gives the same copies.  An
    empty table gives an empty result.  Columns named like a result are
    replaced.

    The line is cut by range into partitions (ties by a hash of the id, so
    equal sizes spread); each row knows its place in its partition, and a small
    table of (source, partition) counts adds what stands before.  No source is
    ever in one task.
    """
    made = ["size", "source_size", "target", "copies"]
    packed = Packed(docs, made if keep_text else [*made, "text"])
    docs = docs.select(packed.row, "doc_id", "source", word_count(F.col("text")).alias("size"))
    names = [F.col("_row"), F.col("source"), F.col("size")]
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    line = ["source", "size", "_mark", "doc_id"]
    place = F.monotonically_increasing_id()
    lined = docs.select(*names, "doc_id", mark.alias("_mark")).repartitionByRange(*line).sortWithinPartitions(*line)
    lined = lined.withColumn("_place", place).select(
        *names, F.shiftright("_place", 33).alias("_part"), F.col("_place").bitwiseAND(_ROW).alias("_at")
    )
    lined = stored(lined, "mix-line")
    parts = lined.groupBy("source", "_part").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first"), F.sum("size").alias("size")
    )
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(parts, weights, share, limit)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    parts = parts.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source"))
    parts = parts.selectExpr("p.source _source", "p._part _p", "_before - _first _shift", "t.source_size", "t.target")
    joined = lined.join(parts, F.expr("source <=> _source AND _part = _p"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = F.col("_at") + F.col("_shift")
    offset = _offset(F.col("source"), seed)
    copies = F.floor((upto + 1) * rate + offset) - F.floor(upto * rate + offset)
    return joined.select(*packed.unpacked(), "size", "source_size", "target", copies.alias("copies"))
