"""Landing zone: partitions with manifests, validated before anything is promoted.

Layout: ``{root}/{sor}/{entity}/business_date=D/`` holding ``data.parquet`` (one
file, or a folder of part files) and ``_manifest.json``.  Only the manifests, one
small control file per expected feed, are read by the driver; data files are
hashed and counted by the executors.
"""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import values as V

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("sor", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("business_date", T.StringType()),
        T.StructField("row_count", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("produced_at", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def partition_dir(root: str, sor: str, entity: str, business_date: str) -> str:
    return f"{root.rstrip('/')}/{sor}/{entity}/business_date={business_date}"


def resolve_partition(spark: SparkSession, root: str, sor: str, entity: str, as_of: str = "") -> str | None:
    """Directory of the business date, of the latest one if none is named, or None."""
    names = [n for n in _names(spark, f"{root.rstrip('/')}/{sor}/{entity}") if n.startswith("business_date=")]
    if as_of:
        return partition_dir(root, sor, entity, as_of) if f"business_date={as_of}" in names else None
    return f"{root.rstrip('/')}/{sor}/{entity}/{names[-1]}" if names else None


def scan_parquet_partition(spark: SparkSession, directory: str) -> DataFrame:
    """Data of one partition; the partition column is not read back as data."""
    return spark.read.parquet(f"{directory}/data.parquet")


def _data_paths(directories: list[str]) -> list[str]:
    return [f"{d}/data.parquet" for d in directories]


def file_digests(spark: SparkSession, directories: list[str]) -> DataFrame:
    """sha256 of the data of each partition directory.

    One file gives its own digest; several part files give the digest of their
    sorted digests.  Each file is read whole by one task, so feeds should keep
    files under 2 GB, as ``export_landing`` does.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(_data_paths(directories))
        .select(
            F.regexp_extract("path", r"/([^/]+)/[^/]+/business_date=[^/]+/", 1).alias("sor"),
            F.regexp_extract("path", r"/([^/]+)/business_date=[^/]+/", 1).alias("entity"),
            F.sha2("content", 256).alias("digest"),
        )
    )
    several = F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), "\n"), 256)
    return files.groupBy("sor", "entity").agg(
        F.when(F.count(F.lit(1)) == 1, F.first("digest")).otherwise(several).alias("actual_sha256"),
        F.count(F.lit(1)).alias("files"),
    )


def read_manifests(
    spark: SparkSession, root: str, expected: list[tuple[str, str, str]], as_of: str = ""
) -> DataFrame:
    """One row per expected feed: its directory, file presence and parsed manifest."""
    rows = []
    for sor, entity, table in expected:
        directory = resolve_partition(spark, root, sor, entity, as_of)
        names = _names(spark, directory) if directory else []
        text = _read_text(spark, f"{directory}/_manifest.json") if "_manifest.json" in names else None
        rows.append((sor, entity, table, directory, "data.parquet" in names, text, _manifest_keys(text)))
    raw = spark.createDataFrame(
        rows,
        "sor string, entity string, src_table string, directory string, has_data boolean, manifest_text string, keys array<string>",
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return raw.withColumn("m", F.from_json("manifest_text", MANIFEST_SCHEMA, options))


def _manifest_keys(text: str | None) -> list[str] | None:
    """Keys of a manifest that is one whole JSON object, else None."""
    try:
        found = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return list(found) if isinstance(found, dict) else None


def validate_manifest(
    spark: SparkSession, root: str, expected: list[tuple[str, str, str]], as_of: str, checksums: bool = True
) -> DataFrame:
    """One row per expected feed: passed, and the first rule that failed."""
    found = read_manifests(spark, root, expected, as_of)
    directories = [d for (d,) in found.where("directory IS NOT NULL AND has_data").select("directory").collect()]
    if checksums and directories:
        found = found.join(file_digests(spark, directories), ["sor", "entity"], "left")
    else:
        found = found.withColumn("actual_sha256", F.lit(None).cast("string"))

    m = F.col("m")
    wanted = F.array(*[F.lit(k) for k in sorted(V.MANIFEST_KEYS)])
    missing = F.array_except(wanted, F.coalesce("keys", F.array().cast("array<string>")))

    def differs(field: str, want: Column) -> Column:
        return F.concat(
            F.lit(f"manifest {field}="), F.coalesce(m[field], F.lit("null")), F.lit(" != expected "), want
        )

    rules = [
        (F.col("directory").isNull(), F.lit("landing partition not found")),
        (F.col("manifest_text").isNull(), F.lit("_manifest.json missing")),
        (~F.col("has_data"), F.lit("data.parquet missing")),
        (F.col("keys").isNull(), F.lit("_manifest.json invalid JSON")),
        (F.size(missing) > 0, F.concat(F.lit("manifest missing keys: "), F.array_join(missing, ", "))),
        (~m["sor"].eqNullSafe(F.col("sor")), differs("sor", F.col("sor"))),
        (~m["entity"].eqNullSafe(F.col("entity")), differs("entity", F.col("entity"))),
    ]
    if as_of:
        rules.append((~m["business_date"].eqNullSafe(F.lit(as_of)), differs("business_date", F.lit(as_of))))
    if checksums:
        rules.append((~m["sha256"].eqNullSafe(F.col("actual_sha256")), F.lit("sha256 mismatch")))
    reason = reduce(lambda chain, rule: chain.when(*rule), rules[1:], F.when(*rules[0])).otherwise("")
    return found.select(
        "sor", "entity", "src_table", "directory", F.col("m.row_count").alias("row_count"), reason.alias("reason")
    ).withColumn("passed", F.col("reason") == "")


def checksum_files(spark: SparkSession, root: str, expected: list[tuple[str, str, str]], as_of: str) -> DataFrame:
    """Manifest digest against the digest of the data files."""
    found = read_manifests(spark, root, expected, as_of)
    directories = [d for (d,) in found.where("directory IS NOT NULL AND has_data").select("directory").collect()]
    return found.join(file_digests(spark, directories), ["sor", "entity"], "left").select(
        "sor",
        "entity",
        F.col("m.sha256").alias("expected"),
        F.col("actual_sha256").alias("actual"),
        F.coalesce(F.col("m.sha256") == F.col("actual_sha256"), F.lit(False)).alias("passed"),
    )


def reconcile_row_counts(spark: SparkSession, checked: DataFrame) -> DataFrame:
    """Rows found per feed against the manifest's row count (parquet footers only)."""
    feeds = checked.where("directory IS NOT NULL").select("sor", "entity", "directory").collect()
    counts = [
        scan_parquet_partition(spark, d)
        .agg(F.count(F.lit(1)).alias("actual"))
        .select(F.lit(s).alias("sor"), F.lit(e).alias("entity"), "actual")
        for s, e, d in feeds
    ]
    none = checked.limit(0).select("sor", "entity", F.lit(0).cast("bigint").alias("actual"))
    actual = reduce(lambda a, b: a.unionByName(b), counts, none)
    return checked.join(actual, ["sor", "entity"], "left").select(
        "sor",
        "entity",
        F.coalesce(F.expr("try_cast(row_count AS bigint)"), F.lit(-1)).alias("expected"),
        "actual",
    ).withColumn("passed", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def gate_all_or_nothing(checks: DataFrame) -> DataFrame:
    """One row: may anything be promoted at all."""
    return checks.agg(
        F.count(F.lit(1)).alias("feeds"),
        F.count_if(~F.col("passed")).alias("failures"),
        F.bool_and("passed").alias("promote"),
    )


def promote_full_refresh(raw: DataFrame, target_schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Rows of the raw copy in the shape of the source table it refills.

    A column that the raw copy lacks gets its value of ``defaults``, else NULL.
    """
    from ledgerline.sources.tables import align_columns

    missing = {c: F.lit(v) for c, v in (defaults or {}).items() if c not in raw.columns}
    return align_columns(raw.withColumns(missing) if missing else raw, target_schema)


def ingest(
    spark: SparkSession,
    root: str,
    as_of: str,
    target_root: str,
    expected: list[tuple[str, str, str]] | None = None,
    target_schemas: dict[str, T.StructType] | None = None,
    defaults: dict[str, dict] | None = None,
) -> DataFrame:
    """Validate every feed, then refill every source table, or change nothing.

    Returns the validation rows.  A feed that fails its manifest, checksum or row
    count stops the promotion of all of them.  All tables are written aside
    first and then swapped in by renames, so a failing write changes no table.
    ``target_schemas`` and ``defaults`` (column values) go by source table; a
    table that exists keeps its own schema unless told otherwise.
    """
    from ledgerline.sources.tables import path_exists, replace_table, swap_tables

    expected = expected or V.FEEDS
    checked = validate_manifest(spark, root, expected, as_of).cache()
    try:
        if not gate_all_or_nothing(checked).first()["promote"]:
            return spark.createDataFrame(checked.collect(), checked.schema)
        counts = reconcile_row_counts(spark, checked)
        verdict = checked.drop("passed", "reason").join(
            counts.select("sor", "entity", "passed", "expected", "actual"), ["sor", "entity"]
        ).withColumn(
            "reason",
            F.when(F.col("passed"), "").otherwise(
                F.concat(
                    F.lit("row_count mismatch: parquet has "), F.col("actual").cast("string"),
                    F.lit(", manifest claims "), F.col("expected").cast("string"),
                )
            ),
        ).drop("expected", "actual").select(*checked.columns)
        rows = verdict.collect()
        if all(r["passed"] for r in rows):
            swaps = {}
            for r in rows:
                raw = scan_parquet_partition(spark, r["directory"])
                path = f"{target_root.rstrip('/')}/{r['src_table']}"
                own = spark.read.parquet(path).schema if path_exists(spark, path) else raw.schema
                schema = (target_schemas or {}).get(r["src_table"], own)
                swaps[path] = f"{path}__new"
                replace_table(promote_full_refresh(raw, schema, (defaults or {}).get(r["src_table"])), swaps[path])
            swap_tables(spark, swaps)
        return spark.createDataFrame(rows, checked.schema)
    finally:
        checked.unpersist()


def business_date_of(df: DataFrame, date_col: str | None, override: str | None = None) -> str:
    """The override, else the largest value of the date column, else today."""
    if override:
        return override
    last = df.agg(F.max(F.to_date(date_col)).alias("d")).first()["d"] if date_col else None
    return (last or dt.date.today()).isoformat()


def export_landing(
    df: DataFrame,
    root: str,
    sor: str,
    entity: str,
    date_col: str | None = None,
    override: str | None = None,
    records_per_file: int = 1_000_000,
) -> DataFrame:
    """Write a partition with its manifest and return the manifest row."""
    spark = df.sparkSession
    business_date = business_date_of(df, date_col, override)
    directory = partition_dir(root, sor, entity, business_date)
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("maxRecordsPerFile", records_per_file)
        .parquet(f"{directory}/data.parquet")
    )
    rows = scan_parquet_partition(spark, directory).count()
    digest = file_digests(spark, [directory]).first()["actual_sha256"]
    manifest = {
        "sor": sor,
        "entity": entity,
        "business_date": business_date,
        "row_count": rows,
        "sha256": digest,
        "produced_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"),
        "schema_version": "1.0",
    }
    _write_text(spark, f"{directory}/_manifest.json", json.dumps(manifest, indent=2))
    return spark.createDataFrame(
        [tuple(manifest.values())],
        "sor string, entity string, business_date string, row_count bigint, sha256 string, "
        "produced_at string, schema_version string",
    )
