"""Data-quality checks as result rows, and the gate over them.

All checks of one table share a single aggregate: a check is one or a few of its
columns, and the one-row result is unpivoted to check rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_COLUMNS = ["check_name", "expected", "actual", "rows_checked", "rows_failed", "passed"]


@dataclass
class Check:
    """A row fails where ``bad`` is true; a NULL verdict does not fail."""

    name: str
    bad: Column
    expected: str = "0"
    actual: str = "{bad}"


def not_null(name: str, *columns: str) -> Check:
    return Check(name, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def non_negative(name: str, column: str) -> Check:
    return Check(name, F.col(column) < 0)


def in_range(name: str, column: str, low, high) -> Check:
    return Check(name, (F.col(column) < low) | (F.col(column) > high))


def zero_when(name: str, flag: str, column: str) -> Check:
    return Check(name, F.col(flag) & (F.col(column) != 0))


def in_domain(name: str, column: str, allowed: list) -> Check:
    return Check(name, ~F.col(column).isin(allowed))


@dataclass
class Rows:
    """A verdict on the table's row count, which ``source`` may be counted for."""

    name: str
    source: DataFrame
    exact: bool  # else the table may also have more rows than its source


@dataclass
class Values:
    """The column's distinct values must be exactly ``expected``."""

    name: str
    column: str
    expected: list[str]


def fused_checks(df: DataFrame, checks: list[Check | Rows | Values]) -> DataFrame:
    """All ``checks`` on one table from a single aggregate, one row per check.

    The table is read once whatever is asked of it; a source it is compared with
    adds one count.  Of a checked column only the expected values are named, the
    others are counted, so the result stays small for millions of values.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("_n")], []
    sources: dict[str, Column] = {}
    total = F.col("_n")
    for i, check in enumerate(checks):
        if isinstance(check, Check):
            bad = F.col(f"_c{i}")
            aggregates.append(F.count_if(check.bad).alias(f"_c{i}"))
            before, after = check.actual.split("{bad}")
            actual = F.concat(F.lit(before), bad.cast("string"), F.lit(after))
            rows.append((check.name, F.lit(check.expected), actual, total, bad, bad == 0))
        elif isinstance(check, Rows):
            sources[f"_s{i}"] = _count(check.source)
            source = F.col(f"_s{i}")
            failed = F.abs(source - total) if check.exact else F.greatest(F.lit(0).cast("bigint"), source - total)
            expected = F.concat(F.lit("" if check.exact else ">= "), source.cast("string"))
            rows.append((check.name, expected, total.cast("string"), source, failed, failed == 0))
        else:
            want = sorted(check.expected)
            cell = F.col(check.column)
            aggregates += [F.bool_or(cell == v).alias(f"_v{i}_{k}") for k, v in enumerate(want)]
            # NULL is a value of its own among the others.
            aggregates.append(F.count_distinct(F.when(~cell.isin(want), cell)).alias(f"_o{i}"))
            aggregates.append(F.bool_or(cell.isNull()).alias(f"_z{i}"))
            other = F.col(f"_o{i}") + F.when(F.col(f"_z{i}"), 1).otherwise(0)
            found = F.array_compact(F.array(*[F.when(F.col(f"_v{i}_{k}"), F.lit(v)) for k, v in enumerate(want)]))
            ok = (F.size(found) == len(want)) & (other == 0)
            more = F.when(other > 0, F.concat(F.lit(" +"), other.cast("string"), F.lit(" other"))).otherwise("")
            actual = F.concat(F.array_join(found, ","), more)
            rows.append((check.name, F.lit(",".join(want)), actual, total, F.when(ok, 0).otherwise(1).cast("bigint"), ok))
    # First the counts, then the rows: an expression is worked out where its inputs have names.
    counted = df.agg(*aggregates).withColumns(sources)
    listed = F.array(*[F.struct(*[v.alias(c) for v, c in zip((F.lit(r[0]), *r[1:]), RESULT_COLUMNS, strict=True)]) for r in rows])
    return counted.select(F.explode(listed).alias("r")).select("r.*")


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Counting checks: one scan, one row per check."""
    return fused_checks(df, checks)


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def no_silent_drops(staged: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """The staged table must not have fewer rows than its source."""
    return fused_checks(staged, [Rows(name, source, exact=False)])


def row_parity(staged: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """Both tables must have the same number of rows."""
    return fused_checks(staged, [Rows(name, source, exact=True)])


def value_set(df: DataFrame, column: str, expected: list[str], name: str) -> DataFrame:
    """The column's distinct values must be exactly ``expected``."""
    return fused_checks(df, [Values(name, column, expected)])


def non_empty(df: DataFrame, name: str) -> DataFrame:
    n = F.col("_n")
    return df.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(name).alias("check_name"),
        F.lit("> 0").alias("expected"),
        n.cast("string").alias("actual"),
        n.alias("rows_checked"),
        F.when(n > 0, 0).otherwise(1).cast("bigint").alias("rows_failed"),
        (n > 0).alias("passed"),
    )


def unique_key(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Key values that occur more than once; keys with a NULL are not compared."""
    no_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    groups = df.where(no_null).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"), F.count_if(F.col("_n") > 1).alias("_bad")
    ).select(*_verdict(name))


def foreign_key(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Child rows without a parent; a NULL reference is allowed.

    The child is counted per key first, so a hot parent is one row in the join.
    """
    refs = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = parent.select(F.col(parent_key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    joined = refs.join(known, "_k", "left")
    return joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("_bad"),
    ).select(*_verdict(name))


def _verdict(name: str) -> list[Column]:
    bad = F.col("_bad")
    return [
        F.lit(name).alias("check_name"),
        F.lit("0").alias("expected"),
        bad.cast("string").alias("actual"),
        F.col("_rows").alias("rows_checked"),
        bad.alias("rows_failed"),
        (bad == 0).alias("passed"),
    ]


def union_checks(*results: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), results)


def gate(results: DataFrame) -> DataFrame:
    """One row: totals, the failed names (one per check), the overall verdict."""
    failed = F.when(~F.col("passed"), F.col("check_name"))
    return results.agg(
        F.count(F.lit(1)).alias("checks_total"),
        F.count(failed).alias("checks_failed"),
        F.array_join(F.array_sort(F.collect_list(failed)), ",").alias("failed_checks"),
        F.bool_and("passed").alias("passed"),
    )


def staging_checks(stg_txn: DataFrame, src_txn: DataFrame, stg_cust: DataFrame, src_cust: DataFrame) -> DataFrame:
    """The ten checks on the staging tables."""
    return union_checks(
        fused_checks(
            stg_txn,
            [
                not_null("stg_txn_amount_usd_not_null", "amount_usd"),
                not_null("stg_txn_net_amount_usd_not_null", "net_amount_usd"),
                non_negative("stg_txn_amount_usd_nonneg", "amount_usd"),
                zero_when("stg_txn_reversal_net_zero", "is_reversal", "net_amount_usd"),
                Rows("stg_txn_no_silent_drops", src_txn, exact=False),
            ],
        ),
        fused_checks(
            stg_cust,
            [
                not_null("stg_cust_full_name_not_null", "full_name"),
                not_null("stg_cust_age_not_null", "age"),
                not_null("stg_cust_branch_region_not_null", "branch_region"),
                in_range("stg_cust_age_18_120", "age", 18, 120),
                Rows("stg_cust_one_to_one_with_src", src_cust, exact=True),
            ],
        ),
    )


def fact_checks(fact: DataFrame, src_cust: DataFrame, as_of) -> DataFrame:
    """The five checks on one business date of the fact."""
    day = fact.where(F.col("as_of_date") == F.lit(as_of))
    score = in_range("L2_DQ_01", "risk_score", 0.0, 1.0)
    score.expected, score.actual = "risk_score in [0,1]", "{bad} rows out of range"
    nulls = not_null("L2_DQ_02", "risk_score", "risk_tier", "volume_percentile")
    nulls.expected, nulls.actual = "0 NULLs in (risk_score, risk_tier, volume_percentile)", "{bad} NULL rows"
    volume = non_negative("L2_DQ_05", "total_txn_volume_usd_90d")
    volume.expected, volume.actual = "total_txn_volume_usd_90d >= 0", "{bad} negative rows"
    parity = Rows("L2_DQ_03", src_cust, exact=True)
    tiers = Values("L2_DQ_04", "risk_tier", ["HIGH", "LOW", "MEDIUM"])
    return fused_checks(day, [score, nulls, parity, tiers, volume])
