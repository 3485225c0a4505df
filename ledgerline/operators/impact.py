"""What a column change would break, by fixed rules over the downstream chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import type_sensitive
from ledgerline.operators.graph import downstream_chain, readers_of_table
from ledgerline.operators.scale import lookup_left_join

# The regulatory table and columns.
CRITICAL_TABLE = "fct_customer_risk_profile"
CRITICAL_COLUMNS = ["risk_score", "risk_tier"]


def severity(table: Column, column: Column) -> Column:
    """The highest level that applies."""
    critical = (table == CRITICAL_TABLE) | F.coalesce(column.isin(CRITICAL_COLUMNS), F.lit(False))
    return F.when(critical, "CRITICAL").when(table.startswith("stg_"), "HIGH").otherwise("LOW")


def severity_rank(level: Column) -> Column:
    return F.when(level == "CRITICAL", 0).when(level == "HIGH", 1).otherwise(2)


def impact_report(
    columns: DataFrame,
    edges: DataFrame,
    processes: DataFrame,
    changes: DataFrame,
    max_hops: int = 10
) -> DataFrame:
    """Affected columns and processes of each change (table, column, change_type).

    RENAME breaks direct readers, DROP the whole chain to its end, TYPE_CHANGE the
    chain but for columns that pass the value through.  RENAME and DROP also list
    the processes that read the table and name the column in their ``sql_text``,
    with NULL as affected column.  ``total_affected`` counts a change's rows.
    """
    changes = changes.select(
        F.concat_ws("::", "table", "column").alias("start"), F.col("table").alias("changed_table"),
        F.col("column").alias("changed_column"), F.upper("change_type").alias("change_type"),
    ).distinct()
    derives = edges.where(F.col("label") == "DERIVES_FROM")
    chain = downstream_chain(derives, changes.select("start"), None)
    paired = chain.join(changes, "start")
    kept = paired.where((F.col("change_type") != "RENAME") | (F.col("hops") == 1))
    detail = columns.select(
        F.col("pk").alias("descendant"), F.col("dataset_name").alias("affected_table"),
        F.col("column_name").alias("affected_column"), "transform_type", "expression",
    )
    named = lookup_left_join(
        kept, detail, ["descendant"], ["affected_table", "affected_column", "transform_type", "expression"],
    ).where(F.col("affected_table").isNotNull())
    through = F.col("transform_type").isin("PASSTHROUGH", "RENAME")
    breaking = named.where((F.col("change_type") != "TYPE_CHANGE") | ~F.coalesce(through, F.lit(False)))
    reason = (
        F.when(F.col("change_type") == "DROP", "source column dropped")
        .when(F.col("change_type") == "RENAME", "reads the old name")
        .when(F.col("transform_type") == "AMBIGUOUS", "ambiguous sources")
        .when(type_sensitive(F.col("expression")), "type-sensitive expression")
        .otherwise("type-sensitivity unverified")
    )
    none = F.lit(None).cast("string")
    by_column = breaking.select(
        "changed_table", "changed_column", "change_type", "affected_table", "affected_column", none.alias("stage"),
        none.alias("run_id"), severity(F.col("affected_table"), F.col("affected_column")).alias("severity"), "expression",
        reason.alias("reason"),
    )
    readers = readers_of_table(edges, processes).withColumnRenamed("dataset_name", "changed_table")
    # A process is hit if its SQL has the column's name as a word; without its SQL, reading the table has to do.
    words = F.regexp_extract_all(F.lower("sql_text"), F.lit(r"([a-z_][a-z0-9_]*)"))
    if "sql_text" not in readers.columns:
        readers = readers.withColumn("sql_text", F.lit(None).cast("string"))
    by_process = readers.join(changes.where(F.col("change_type") != "TYPE_CHANGE").drop("start"), "changed_table").where(
        F.coalesce(F.array_contains(words, F.lower("changed_column")), F.lit(True))
    ).select(
        "changed_table", "changed_column", "change_type", F.col("target_table").alias("affected_table"),
        none.alias("affected_column"), "stage", "run_id",
        F.when((F.col("target_table") == CRITICAL_TABLE) | F.col("target_table").startswith("stg_"), "HIGH").otherwise("LOW").alias("severity"),
        none.alias("expression"), F.when(F.col("sql_text").isNull(), "process reads the table").otherwise("process reads the column").alias("reason"),
    )
    report = by_column.unionByName(by_process)
    change = ["changed_table", "changed_column", "change_type"]
    totals = report.groupBy(*change).agg(F.count(F.lit(1)).alias("total_affected"))
    return report.join(totals, change)


def sort_report(report: DataFrame) -> DataFrame:
    """Most severe first, then by table and column."""
    return report.orderBy(severity_rank(F.col("severity")), "affected_table", "affected_column", "stage", "run_id")
