"""One business date from landing to the checked fact."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import quality
from ledgerline.plans.risk import fct_risk_profile
from ledgerline.plans.staging import stg_customers, stg_fx, stg_transactions
from ledgerline.sources.landing import gate_all_or_nothing, ingest
from ledgerline.sources.tables import overwrite_partition, read_table, replace_table

SOURCES = ["src_branch", "src_customer", "src_account", "src_transaction", "src_fx_rate"]
FACT = "fct_customer_risk_profile"


def table_path(warehouse: str, table: str) -> str:
    return f"{warehouse.rstrip('/')}/{table}"


def build_staging(spark: SparkSession, warehouse: str, as_of: dt.date) -> None:
    """Rebuild the three staging tables; each is written once and read back."""
    src = {name: read_table(spark, table_path(warehouse, name)) for name in SOURCES}
    replace_table(stg_fx(src["src_fx_rate"]), table_path(warehouse, "stg_fx_resolved"))
    fx = read_table(spark, table_path(warehouse, "stg_fx_resolved"))
    replace_table(stg_transactions(src["src_transaction"], fx), table_path(warehouse, "stg_transaction_normalized"))
    replace_table(
        stg_customers(src["src_customer"], src["src_branch"], as_of), table_path(warehouse, "stg_customer_enriched")
    )


def build_fact(spark: SparkSession, warehouse: str, as_of: dt.date) -> None:
    """Write the business date's slice of the fact; other dates stay."""
    fact = fct_risk_profile(
        read_table(spark, table_path(warehouse, "stg_transaction_normalized")),
        read_table(spark, table_path(warehouse, "stg_customer_enriched")),
        read_table(spark, table_path(warehouse, "src_account")),
        as_of,
    )
    overwrite_partition(fact, table_path(warehouse, FACT), "as_of_date")


def check_outputs(spark: SparkSession, warehouse: str, as_of: dt.date) -> DataFrame:
    """The fifteen checks of one business date."""
    def read(name: str) -> DataFrame:
        return read_table(spark, table_path(warehouse, name))

    return quality.union_checks(
        quality.staging_checks(
            read("stg_transaction_normalized"), read("src_transaction"), read("stg_customer_enriched"), read("src_customer")
        ),
        quality.fact_checks(read(FACT), read("src_customer"), as_of),
    )


def run_business_date(spark: SparkSession, landing_root: str, warehouse: str, as_of: dt.date) -> DataFrame:
    """Ingest, stage, build and check one date; returns the check rows.

    Nothing is changed when a feed fails validation: its rows come back instead.
    """
    feeds = ingest(spark, landing_root, as_of.isoformat(), warehouse)
    if not gate_all_or_nothing(feeds).first()["promote"]:
        return feeds.select(
            F.concat_ws("_", F.lit("ingest"), "sor", "entity").alias("check_name"), F.lit("valid").alias("expected"),
            F.col("reason").alias("actual"), F.lit(1).cast("bigint").alias("rows_checked"),
            F.when(F.col("passed"), 0).otherwise(1).cast("bigint").alias("rows_failed"), "passed",
        )
    sources = [
        quality.non_empty(read_table(spark, table_path(warehouse, name)), f"{name}_nonempty") for name in SOURCES
    ]
    present = quality.union_checks(*sources)
    if not quality.gate(present).first()["passed"]:
        return present
    build_staging(spark, warehouse, as_of)
    build_fact(spark, warehouse, as_of)
    return check_outputs(spark, warehouse, as_of)
