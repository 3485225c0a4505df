"""Customer risk fact of one business date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.rank import percent_rank_global
from ledgerline.session import pin

FACT_COLUMNS = [
    "customer_id", "as_of_date", "full_name", "age", "is_us_person", "kyc_status", "kyc_stale_flag",
    "branch_region", "total_txn_volume_usd_90d", "txn_count_90d", "international_txn_ratio",
    "avg_txn_amount_usd", "reversal_rate", "volume_percentile", "risk_score", "risk_tier",
    "reference_date", "computed_at",
]

PARTIALS = ["total_txn_count", "intl_txn_count", "reversal_txn_count", "txn_count_90d", "volume_90d", "kept_sum", "kept_count"]


def reference_date(stg_txn: DataFrame, as_of: dt.date) -> Column:
    """Scalar: the last transaction day, but not after ``as_of``."""
    return stg_txn.agg(F.least(F.max("txn_date"), F.lit(as_of)).alias("reference_date")).scalar()


def account_partials(txns: DataFrame, ref: Column, key: str = "account_id", bounded: bool = False) -> DataFrame:
    """Filtered counts and sums per key, in one map-side combined pass.

    The 90-day window has no upper bound unless ``bounded``; reversals count as
    0 in the volume and are left out of the 90-day count and the average.
    """
    if bounded:
        txns = txns.where(F.col("txn_date") <= ref)
    txns = txns.withColumn("_recent", S.within_days(F.col("txn_date"), ref))
    recent = F.col("_recent")
    kept = F.col("is_reversal") == F.lit(False)
    net = F.col("net_amount_usd")
    return txns.groupBy(key).agg(
        F.count("txn_id").alias("total_txn_count"),
        F.count_if("is_international").alias("intl_txn_count"),
        F.count_if("is_reversal").alias("reversal_txn_count"),
        F.count_if(kept & recent).alias("txn_count_90d"),
        F.sum(F.when(recent, net)).alias("volume_90d"),
        F.sum(F.when(kept, net)).alias("kept_sum"),
        F.count(F.when(kept, net)).alias("kept_count"),
    )


def filtered_aggs(
    customers: DataFrame, txns: DataFrame, accounts: DataFrame, ref: Column, bounded: bool = False
) -> DataFrame:
    """One row per customer, customers without transactions included.

    Transactions shrink to one row per account before the first join, so a
    customer or account that owns a third of them never meets a join as raw rows;
    both joins then see one row per key.
    """
    per_account = account_partials(txns, ref, bounded=bounded)
    owned = per_account.join(accounts.select("account_id", "customer_id"), "account_id", "inner")
    per_customer = owned.groupBy("customer_id").agg(*[F.sum(c).alias(c) for c in PARTIALS])
    counts = ["total_txn_count", "intl_txn_count", "reversal_txn_count", "txn_count_90d"]
    return (
        customers.join(per_customer, "customer_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
        .withColumn("total_txn_volume_usd_90d", F.coalesce(F.col("volume_90d").cast("double"), F.lit(0.0)))
        .withColumn(
            "avg_txn_amount_usd",
            F.coalesce(F.try_divide(F.col("kept_sum").cast("double"), F.col("kept_count")), F.lit(0.0)),
        )
    )


def fct_risk_profile(
    stg_txn: DataFrame,
    stg_cust: DataFrame,
    src_account: DataFrame,
    as_of: dt.date,
    bounded: bool = False,
    dates: DataFrame | None = None,
) -> DataFrame:
    """18-column fact, one row per customer of the business date.

    ``dates`` may name a cheaper frame that holds every transaction's txn_date.
    """
    ref = reference_date(stg_txn if dates is None else dates, as_of)
    base = filtered_aggs(stg_cust, stg_txn, src_account, ref, bounded)
    rated = base.withColumn(
        "international_txn_ratio", S.safe_ratio(F.col("intl_txn_count"), F.col("total_txn_count"))
    ).withColumn("reversal_rate", S.safe_ratio(F.col("reversal_txn_count"), F.col("total_txn_count"))).withColumn("reference_date", ref)
    # One row per customer by now; pinned because ranking reads it twice, and with its date so that no scan is left.
    ranked = percent_rank_global(pin(rated), "total_txn_volume_usd_90d", "volume_percentile")
    score = S.risk_score(
        F.col("international_txn_ratio"), F.col("kyc_stale_flag"), F.col("volume_percentile"), F.col("reversal_rate")
    )
    return (
        ranked.withColumn("as_of_date", F.lit(as_of))
        .withColumn("risk_score", score)
        .withColumn("risk_tier", S.risk_tier(F.col("risk_score")))
        .withColumn("computed_at", F.current_timestamp())
        .select(*FACT_COLUMNS)
    )
