"""Event log: one JSON object per line, columns are the union of all event kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import pin

# Every field is read as text first, so one odd value cannot void its line.
FIELDS = [
    "ts", "level", "event", "stage", "stage_name", "run_id", "status", "duration_ms", "output_row_count", "output_table",
    "check_name", "passed", "expected", "actual", "rows_checked", "rows_failed", "target_table", "source_tables",
    "depends_on_stages", "transform_type", "derived_columns", "catalog_hits", "catalog_misses", "failed_stage",
    "exit_code",
]
LONGS = ["duration_ms", "output_row_count", "rows_checked", "rows_failed", "catalog_hits", "catalog_misses", "exit_code"]
_RAW = ", ".join(f"{f} string" for f in FIELDS) + ", _corrupt_record string"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed events of a frame of text lines; other columns are carried along.

    White space around a line is no part of it.  Blank lines, broken JSON, text
    after the object and lines that are not objects are dropped.
    """
    others = [c for c in lines.columns if c != column]
    strict = {"allowSingleQuotes": "false"}
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", **strict}
    stripped = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    # In brackets, a line is one element of a list, or the list cannot be read.
    listed = F.from_json(F.concat(F.lit("["), "_line", F.lit("]")), "array<string>", strict)
    parsed = (
        lines.withColumn("_line", stripped)
        .where(F.col("_line").startswith("{") & F.col("_line").endswith("}") & (F.size(listed) == 1))
        .withColumn("_e", F.from_json("_line", _RAW, options))
        .where(F.col("_e._corrupt_record").isNull())
    )
    return parsed.select(*others, *[typed_field(f).alias(f) for f in FIELDS])


def typed_field(name: str) -> Column:
    text = F.col(f"_e.{name}")
    if name in LONGS:
        return text.try_cast("bigint")
    if name == "passed":
        return text.try_cast("boolean")
    return text


def read_event_log(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """Events of one or many log files.

    ``log_file`` names the file; ``pos`` orders lines by time, then file, then place
    in the file (start of the split, then the row within it), so it does not
    depend on how files are packed into tasks.  ``runs`` reads the named runs
    only: of a log made by ``append_events``, just the folders whose range of
    runs can hold one of them.
    """
    if runs is None:
        files = spark.read.option("recursiveFileLookup", "true").text(path)
    else:
        files = spark.read.text(path).where(
            reduce(lambda x, y: x | y, [(F.col(FIRST_RUN) <= _bound(r)) & (F.col(LAST_RUN) >= _bound(r)) for r in runs], F.lit(False))
        )
    lines = files.select(
        "value",
        F.col("_metadata.file_path").alias("log_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    events = parse_lines(lines).withColumn("pos", F.struct("ts", "log_file", "_block", "_row")).drop("_block", "_row")
    return events if runs is None else events.where(F.col("run_id").isin(runs))


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """Log files and their modification times; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("log_file"), F.col("modificationTime").alias("modified_at"))
    )


def latest_log(spark: SparkSession, path: str) -> DataFrame:
    """The newest log file."""
    return log_files(spark, path).agg(F.max_by("log_file", F.struct("modified_at", "log_file")).alias("log_file"))


#: Folder levels of a log: the range of runs of the files below.  The mark keeps a run's name text, whatever it looks like.
FIRST_RUN, LAST_RUN = "run_from", "run_to"


def _bound(run) -> Column:
    return F.concat(F.lit("r-"), run if isinstance(run, Column) else F.lit(run))


def append_events(events: DataFrame, path: str) -> None:
    """Append event rows as JSON lines, many runs a file; NULL fields are left out.

    Rows are dealt by ranges of run and time, in partitions that adaptive
    execution packs to size: a small append is one file, and a hot run is cut
    over several.  Each file lies in a folder named by the first and the last run
    in it, so reading one run opens only the files that can hold it.  Rows
    without a run come first.
    """
    dealt = events.repartitionByRange("run_id", "ts").sortWithinPartitions("run_id", "ts")
    # Pinned: the ranges are read off the rows that are then written.
    dealt = pin(dealt.withColumn("_part", F.spark_partition_id()))
    run = _bound(F.coalesce("run_id", F.lit("")))
    ranges = dealt.groupBy("_part").agg(F.min(run).alias(FIRST_RUN), F.max(run).alias(LAST_RUN))
    placed = dealt.join(F.broadcast(ranges), "_part").drop("_part")  # a row a partition
    placed.write.mode("append").partitionBy(FIRST_RUN, LAST_RUN).json(path)


def compact_log(spark: SparkSession, path: str, target: str) -> None:
    """Write the events of a log of many small appends anew, packed to size, into the empty folder ``target``."""
    append_events(read_event_log(spark, path).select(*FIELDS), target)


# Keys of a lineage manifest event.
MANIFEST_KEYS = ["stage", "run_id", "ts", "target_table", "source_tables", "depends_on_stages", "transform_type", "derived_columns"]


def coerce_manifest(events: DataFrame) -> DataFrame:
    """``transform_start`` events that carry a whole manifest, typed.

    Events without a required key, or whose lists or map have another shape,
    are dropped.
    """
    def listed(name: str) -> Column:
        return F.when(F.trim(name).startswith("["), F.from_json(F.col(name), "array<string>"))

    complete = events.where(F.col("event") == "transform_start")
    for key in MANIFEST_KEYS:
        complete = complete.where(F.col(key).isNotNull())
    typed = complete.select(
        "stage",
        "run_id",
        "ts",
        "target_table",
        listed("source_tables").alias("source_tables"),
        listed("depends_on_stages").alias("depends_on_stages"),
        "transform_type",
        F.when(
            F.trim("derived_columns").startswith("{"), F.from_json(F.col("derived_columns"), "map<string,string>")
        ).alias("derived_columns"),
    )
    return typed.where(
        F.col("source_tables").isNotNull()
        & F.col("depends_on_stages").isNotNull()
        & F.col("derived_columns").isNotNull()
    )


def coerce_metrics(events: DataFrame) -> DataFrame:
    """``stage_complete`` events with a row count and a duration."""
    return events.where(
        (F.col("event") == "stage_complete")
        & F.col("stage").isNotNull()
        & F.col("run_id").isNotNull()
        & F.col("output_row_count").isNotNull()
        & F.col("duration_ms").isNotNull()
    ).select("stage", "run_id", F.coalesce("ts", F.lit("")).alias("ts"), "output_row_count", "duration_ms")


def manifests_without_metrics(manifests: DataFrame, metrics: DataFrame) -> DataFrame:
    """Manifests whose stage never reported completion in the same run."""
    done = metrics.select("run_id", "stage").distinct()
    return manifests.join(done, ["run_id", "stage"], "left_anti")
