"""Scalar expressions of the staging and scoring steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import values as V


def is_flag(flag: Column, yes: str = "Y") -> Column:
    return flag == yes


def is_international(bic: Column) -> Column:
    """A known counterparty bank outside the US."""
    return bic.isNotNull() & ~bic.like("US%")


def has_backfill_suffix(source: Column) -> Column:
    # The underscore of LIKE stands for any one character.
    return source.like("%_BACKFILL")


def full_name(first: Column, last: Column) -> Column:
    """NULL when either part is NULL."""
    return F.concat(first, F.lit(" "), last)


def age_years(born: Column, at: Column) -> Column:
    """Completed years: a birthday counts from its month and day, leap days included."""
    not_yet = F.date_format(at, "MMdd") < F.date_format(born, "MMdd")
    return (F.year(at) - F.year(born) - not_yet.cast("int")).cast("int")


def is_us_person(citizenship: Column, birth_country: Column) -> Column:
    return (citizenship == "US") | (birth_country == "US")


def days_since(ts: Column, at: Column) -> Column:
    """Whole days from a timestamp's date to ``at``; NULL stays NULL."""
    return F.datediff(at, F.to_date(ts)).cast("bigint")


def stale_flag(reviewed_at: Column, status: Column, at: Column, limit: int = 365) -> Column:
    overdue = reviewed_at.isNotNull() & (days_since(reviewed_at, at) > limit)
    return overdue | (status == "EXPIRED")


def usd_amount(amount: Column, rate: Column) -> Column:
    return F.round(amount * rate, 2)


def zero_if(flag: Column, value: Column) -> Column:
    """0 where the flag is true, NULL where the value is NULL; keeps the value's type."""
    return F.when(flag & value.isNotNull(), F.lit(0)).otherwise(value)


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def pct(part: Column, whole: Column, digits: int = 4) -> Column:
    """Percentage rounded to ``digits``; 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part.cast("double") / whole * 100, digits))


def within_days(day: Column, ref: Column, days: int = 90) -> Column:
    return day >= F.date_sub(ref, days)


def risk_score(intl_ratio: Column, stale: Column, volume_pct: Column, reversal: Column) -> Column:
    return (
        F.lit(V.WEIGHT_INTERNATIONAL) * intl_ratio
        + F.lit(V.WEIGHT_STALE_KYC) * F.when(stale, 1.0).otherwise(0.0)
        + F.lit(V.WEIGHT_VOLUME) * volume_pct
        + F.lit(V.WEIGHT_REVERSAL) * reversal
    )


def risk_tier(score: Column) -> Column:
    """Strict bounds; a NULL score is LOW."""
    return F.when(score > V.TIER_HIGH, "HIGH").when(score > V.TIER_MEDIUM, "MEDIUM").otherwise("LOW")
