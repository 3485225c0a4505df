"""Staging tables: FX lookup, USD-normalised transactions, enriched customers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.asof import asof_backfill
from ledgerline.operators.scale import lookup_left_join


def stg_fx(src_fx_rate: DataFrame, base: str = "USD") -> DataFrame:
    """Rates into the base currency.  Not sorted: nothing downstream needs it."""
    return src_fx_rate.where(F.col("to_currency") == base).select(
        "rate_date", "from_currency", "to_currency", "rate", "rate_source"
    )


def stg_transactions(
    src_transaction: DataFrame, fx: DataFrame, base: str = "USD"
) -> DataFrame:
    """Every transaction with its USD amount, net of reversals, and the rate used."""
    rated = asof_backfill(
        src_transaction, fx, "currency", "from_currency", "txn_date", "rate_date", "rate", "rate_source", base,
    )
    reversal = S.is_flag(F.col("reversal_flag"))
    gross = S.usd_amount(F.col("amount"), F.col("fx_rate_used"))
    return rated.select(
        "txn_id",
        "account_id",
        "txn_date",
        "txn_timestamp",
        "txn_type",
        "channel",
        "status",
        gross.alias("amount_usd"),
        reversal.alias("is_reversal"),
        S.is_international(F.col("counterparty_bank_bic")).alias("is_international"),
        S.zero_if(reversal, gross).alias("net_amount_usd"),
        F.col("currency").alias("original_currency"),
        "fx_rate_used",
        "fx_rate_source",
    )


def stg_customers(
    src_customer: DataFrame, src_branch: DataFrame, as_of: dt.date
) -> DataFrame:
    """Customers with age, US-person and KYC flags and their branch's region.

    Branches are counted to pick the join; a branch with very many customers is a
    hot key of the lookup.
    """
    at = F.lit(as_of)
    branches = src_branch.select("branch_id", F.col("region").alias("branch_region"))
    joined = lookup_left_join(
        src_customer, branches, ["branch_id"], ["branch_region"]
    )
    return joined.select(
        "customer_id",
        "kyc_status",
        "kyc_reviewed_at",
        "onboarded_date",
        "branch_id",
        S.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        S.age_years(F.col("dob"), at).alias("age"),
        S.is_us_person(F.col("citizenship"), F.col("country_of_birth")).alias("is_us_person"),
        S.days_since(F.col("kyc_reviewed_at"), at).alias("kyc_days_since_review"),
        S.stale_flag(F.col("kyc_reviewed_at"), F.col("kyc_status"), at).alias("kyc_stale_flag"),
        "branch_region",
    )
