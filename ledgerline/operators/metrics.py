"""Health metrics published after each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions import values as V


def fx_coverage(fx: DataFrame) -> DataFrame:
    return fx.groupBy("from_currency").agg(
        F.count(F.lit(1)).alias("rate_rows"),
        F.min("rate_date").alias("first_date"),
        F.max("rate_date").alias("last_date"),
    )


def first_by_order(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Per key, the listed columns of the earliest row."""
    picked = df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r"), F.min(order).alias(f"first_{order}"))
    return picked.select(key, *[F.col("_r")[c].alias(f"first_{c}") for c in cols], f"first_{order}")


def fx_misses(stg_txn: DataFrame, base: str = "USD") -> DataFrame:
    """Back-filled transactions per currency and day."""
    return (
        stg_txn.where(S.has_backfill_suffix(F.col("fx_rate_source")) & (F.col("original_currency") != base))
        .groupBy("original_currency", "txn_date")
        .agg(F.count(F.lit(1)).alias("miss_count"))
    )


def backfill_summary(stg_txn: DataFrame, base: str = "USD") -> DataFrame:
    missed = S.has_backfill_suffix(F.col("fx_rate_source")) & (F.col("original_currency") != base)
    return stg_txn.agg(
        F.count(F.lit(1)).alias("rows_checked"), F.count_if(missed).alias("rows_backfilled")
    ).withColumn("backfill_pct", S.pct(F.col("rows_backfilled"), F.col("rows_checked")))


def reversal_summary(stg_txn: DataFrame) -> DataFrame:
    return stg_txn.agg(
        F.count_if("is_reversal").alias("reversal_count"), F.count(F.lit(1)).alias("total_count")
    ).withColumn("reversal_pct", S.pct(F.col("reversal_count"), F.col("total_count")))


def intl_ratio(stg_txn: DataFrame, key: str = "original_currency") -> DataFrame:
    return (
        stg_txn.groupBy(key)
        .agg(F.count(F.lit(1)).alias("total_txns"), F.count_if("is_international").alias("international_txns"))
        .withColumn("international_pct", S.pct(F.col("international_txns"), F.col("total_txns")))
    )


def kyc_stale_ratio(stg_cust: DataFrame) -> DataFrame:
    return stg_cust.agg(
        F.count_if("kyc_stale_flag").alias("stale_count"), F.count(F.lit(1)).alias("total_count")
    ).select(
        "*",
        S.pct(F.col("stale_count"), F.col("total_count")).alias("stale_pct"),
        F.round(F.lit(V.WARN_STALE_KYC * 100), 4).alias("threshold_pct"),
        (S.safe_ratio(F.col("stale_count"), F.col("total_count")) > V.WARN_STALE_KYC).alias("warn"),
    )


def status_breakdown(stg_cust: DataFrame) -> DataFrame:
    return stg_cust.groupBy("kyc_status").agg(F.count(F.lit(1)).alias("n"))


def null_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("unmapped"))


def tier_distribution(fact: DataFrame) -> DataFrame:
    tier = F.col("risk_tier")
    return fact.agg(
        F.count_if(tier == "HIGH").alias("high_n"),
        F.count_if(tier == "MEDIUM").alias("medium_n"),
        F.count_if(tier == "LOW").alias("low_n"),
        F.count(F.lit(1)).alias("total_n"),
    ).select(
        "*",
        F.round(S.safe_ratio(F.col("high_n"), F.col("total_n")), 6).alias("pct_high"),
        (S.safe_ratio(F.col("high_n"), F.col("total_n")) > V.WARN_HIGH_TIER).alias("warn"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()
