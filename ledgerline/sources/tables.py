"""Tables: CSV scan, replacement, partition overwrite, shape, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; an empty string is NULL.  The schema is given, never inferred."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Create or replace a parquet table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def overwrite_partition(df: DataFrame, path: str, part_col: str) -> None:
    """Replace the slices present in ``df``; all other slices stay untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part_col).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def swap_tables(spark: SparkSession, swaps: dict[str, str]) -> None:
    """Put each written table (value) in the place of another (key) by renames.

    Earlier tables stand aside until all new ones are in place, and come back if
    a rename fails.
    """
    moved: list[tuple[str, str]] = []

    def rename(source: str, target: str) -> None:
        fs = spark._jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration())
        if not path_exists(spark, source) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), spark._jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"cannot rename {source} to {target}")
        moved.append((source, target))

    def remove(path: str) -> None:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)

    for path in swaps:
        remove(f"{path}__old")
    try:
        for path, new in swaps.items():
            if path_exists(spark, path):
                rename(path, f"{path}__old")
            rename(new, path)
    except Exception:
        for source, target in moved[::-1]:
            rename(target, source)
        raise
    for path in swaps:
        remove(f"{path}__old")
        spark.catalog.refreshByPath(path)


def ensure_table_shape(spark: SparkSession, path: str, schema: T.StructType, required: str) -> str:
    """Make ``path`` a table with at least the ``required`` column.

    Returns ``created`` (nothing there), ``replaced`` (a legacy table without the
    column is dropped) or ``kept``.
    """
    empty = spark.createDataFrame([], schema)
    if not path_exists(spark, path):
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return "created"
    if required in spark.read.parquet(path).columns:
        return "kept"
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return "replaced"


def align_columns(df: DataFrame, target: T.StructType) -> DataFrame:
    """``df`` with exactly the target's columns: extras dropped, missing ones NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def table_presence(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row per expected table: does it exist, how many rows has it."""
    parts = []
    for name, df in tables.items():
        if df is None:
            part = spark.range(1).select(
                F.lit(name).alias("table_name"), F.lit(False).alias("present"), F.lit(0).cast("bigint").alias("row_count")
            )
        else:
            part = df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), F.lit(True).alias("present"), "row_count"
            )
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def catalog_table(spark: SparkSession, name: str) -> DataFrame | None:
    """The session catalog's table, or None."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def schema_listing(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns and types of the given tables, in column order."""
    rows = [
        (name, i, field, dtype) for name, df in tables.items() for i, (field, dtype) in enumerate(df.dtypes, start=1)
    ]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
