"""Joins, aggregations, windows, sorts, pipeline tables, checks and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import metrics as M
from ledgerline.operators import quality as D
from ledgerline.operators import runs as R
from ledgerline.operators.asof import asof_backfill, asof_left_join
from ledgerline.operators.fingerprint import table_fingerprint
from ledgerline.operators.graph import count_by_label, first_seen_dedup
from ledgerline.operators.rank import percent_rank_global
from ledgerline.operators.scale import lookup_left_join
from ledgerline.plans import risk
from ledgerline.plans.staging import stg_fx
from ledgerline.queries import query
from ledgerline.queries import standins as st

# --------------------------------------------------------------------------
# Joins
# --------------------------------------------------------------------------

# Sign-ups quote rates for the key in their props; all other events are priced.
QUOTES = """
ev AS (SELECT *, json_extract_string(props, '$.k') k FROM events),
tx AS (SELECT * FROM ev WHERE event_type <> 'signup'),
quotes AS (SELECT k, ts, value rate, 'U' || user_id source FROM ev WHERE event_type = 'signup'),
hit AS (SELECT tx.*, q.rate asof_rate, q.source asof_source FROM tx ASOF LEFT JOIN quotes q ON tx.k = q.k AND tx.ts >= q.ts)"""


def _quotes(t):
    ev = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    quotes = ev.where("event_type = 'signup'").selectExpr("k", "ts", "value AS rate", "concat('U', user_id) AS source")
    return ev.where("event_type <> 'signup'"), quotes


@query("asof_left_join", f"WITH {QUOTES} SELECT event_id, k, asof_rate AS rate, asof_source AS source FROM hit")
def _(t):
    tx, quotes = _quotes(t)
    return asof_left_join(tx, quotes, "k", "k", "ts", "ts", {"rate": "rate", "source": "source"}).select("event_id", "k", "rate", "source")


@query(
    "asof_backfill",
    f"""WITH {QUOTES}
    SELECT event_id, 1::DOUBLE AS fx_rate_used, NULL AS fx_rate_source FROM tx WHERE k = '7'
    UNION ALL SELECT event_id, asof_rate, asof_source FROM hit WHERE k <> '7' AND asof_source IS NOT NULL
    UNION ALL SELECT event_id, rate, source || '_BACKFILL' FROM hit LEFT JOIN quotes q
      ON q.k = hit.k AND NOT EXISTS (SELECT 1 FROM quotes e WHERE e.k = q.k AND e.ts < q.ts) WHERE hit.k <> '7' AND asof_source IS NULL""",
)
def _(t):
    tx, quotes = _quotes(t)
    return asof_backfill(tx, quotes, "k", "k", "ts", "ts", "rate", "source", "7").select("event_id", "fx_rate_used", "fx_rate_source")


@query("left_join_using", st.with_bank("SELECT customer_id, branch_id, region FROM src_customer LEFT JOIN src_branch USING (branch_id)"))
def _(t):
    branches = st.src_branch(t).select("branch_id", "region")
    joined = lookup_left_join(st.src_customer(t), branches, ["branch_id"], ["region"])
    return joined.select("customer_id", "branch_id", "region")


@query("inner_join_eq", st.with_bank("SELECT t.txn_id, a.customer_id FROM src_transaction t JOIN src_account a ON a.account_id = t.account_id"))
def _(t):
    accounts = st.src_account(t).withColumn("known", F.lit(True))
    joined = lookup_left_join(
        st.src_transaction(t).select("txn_id", "account_id"), accounts, ["account_id"], ["customer_id", "known"]
    )
    return joined.where("known").select("txn_id", "customer_id")


@query(
    "cross_join_scalar",
    st.with_bank("SELECT customer_id, reference_date FROM src_customer CROSS JOIN (SELECT LEAST(MAX(txn_date), DATE '2001-06-30') reference_date FROM src_transaction)"),
)
def _(t):
    # One value, so a scalar subquery in place of a join.
    return st.src_customer(t).select("customer_id", risk.reference_date(st.src_transaction(t), st.AS_OF).alias("reference_date"))


@query(
    "left_join_ghost",
    st.with_bank(
        """SELECT c.customer_id, COUNT(t.txn_id) AS txns FROM src_customer c LEFT JOIN (SELECT a.customer_id, t.txn_id FROM src_transaction t
        JOIN src_account a ON a.account_id = t.account_id) t ON t.customer_id = c.customer_id GROUP BY c.customer_id"""
    ),
)
def _(t):
    per_account = st.src_transaction(t).groupBy("account_id").agg(F.count("txn_id").alias("n"))
    per_customer = per_account.join(st.src_account(t), "account_id").groupBy("customer_id").agg(F.sum("n").alias("n"))
    return st.src_customer(t).join(per_customer, "customer_id", "left").select("customer_id", F.coalesce("n", F.lit(0)).alias("txns"))


# --------------------------------------------------------------------------
# Aggregations
# --------------------------------------------------------------------------


@query(
    "group_count_min_max",
    st.with_staged("SELECT from_currency, COUNT(*) AS rate_rows, MIN(rate_date) AS first_date, MAX(rate_date) AS last_date FROM stg_fx GROUP BY from_currency"),
)
def _(t):
    return M.fx_coverage(stg_fx(st.src_fx_rate(t)))


@query(
    "first_by_order",
    st.with_staged(
        "SELECT from_currency, CAST(rate AS DOUBLE) AS first_rate, rate_source AS first_rate_source, rate_date AS first_rate_date FROM opening"
    ),
)
def _(t):
    picked = M.first_by_order(stg_fx(st.src_fx_rate(t)), "from_currency", "rate_date", ["rate", "rate_source"])
    return picked.withColumn("first_rate", F.col("first_rate").cast("double"))


MISSES = "FROM stg_txn WHERE fx_rate_source LIKE '%_BACKFILL' AND original_currency <> 'USD'"


@query("count_group_having_like", st.with_staged(f"SELECT original_currency, txn_date, COUNT(*) AS miss_count {MISSES} GROUP BY 1, 2 ORDER BY miss_count DESC, 1, 2"))
def _(t):
    return M.fx_misses(st.staged_txn(t)).orderBy(F.col("miss_count").desc(), "original_currency", "txn_date")


@query(
    "backfill_summary",
    st.with_staged(
        """SELECT COUNT(*) AS rows_checked, COUNT(*) FILTER (WHERE fx_rate_source LIKE '%_BACKFILL' AND original_currency <> 'USD') AS rows_backfilled,
        ROUND(COUNT(*) FILTER (WHERE fx_rate_source LIKE '%_BACKFILL' AND original_currency <> 'USD')::DOUBLE / COUNT(*) * 100, 4) AS backfill_pct FROM stg_txn"""
    ),
)
def _(t):
    return M.backfill_summary(st.staged_txn(t))


REVERSALS = """SELECT COUNT(*) FILTER (WHERE is_reversal) AS reversal_count, COUNT(*) AS total_count,
    ROUND(COUNT(*) FILTER (WHERE is_reversal)::DOUBLE / COUNT(*) * 100, 4) AS reversal_pct FROM stg_txn"""


@query("conditional_sum", st.with_staged(REVERSALS))
def _(t):
    return M.reversal_summary(st.staged_txn(t))


INTL = """SELECT original_currency, COUNT(*) AS total_txns, COUNT(*) FILTER (WHERE is_international) AS international_txns,
    ROUND(COUNT(*) FILTER (WHERE is_international)::DOUBLE / COUNT(*) * 100, 4) AS international_pct FROM stg_txn GROUP BY 1"""


@query("intl_ratio_by_currency", st.with_staged(INTL))
def _(t):
    return M.intl_ratio(st.staged_txn(t))


KYC = """SELECT COUNT(*) FILTER (WHERE kyc_stale_flag) AS stale_count, COUNT(*) AS total_count,
    ROUND(COUNT(*) FILTER (WHERE kyc_stale_flag)::DOUBLE / COUNT(*) * 100, 4) AS stale_pct, 20.0::DOUBLE AS threshold_pct,
    COUNT(*) FILTER (WHERE kyc_stale_flag)::DOUBLE / COUNT(*) > 0.20 AS warn FROM stg_cust"""


@query("kyc_stale_ratio", st.with_staged(KYC))
def _(t):
    return M.kyc_stale_ratio(st.staged_cust(t))


@query("status_breakdown", st.with_staged("SELECT kyc_status, COUNT(*) AS n FROM stg_cust GROUP BY 1"))
def _(t):
    return M.status_breakdown(st.staged_cust(t))


@query("null_count", st.with_staged("SELECT COUNT(*) FILTER (WHERE branch_region IS NULL) AS unmapped FROM stg_cust"))
def _(t):
    return M.null_count(st.staged_cust(t), "branch_region")


@query(
    "filtered_aggs",
    st.with_fact(
        """SELECT customer_id, all_n AS total_txn_count, all_foreign_n AS intl_txn_count, all_back_n AS reversal_txn_count, txn_count_90d,
        total_txn_volume_usd_90d, avg_txn_amount_usd FROM activity"""
    ),
)
def _(t):
    txns = st.staged_txn(t)
    return risk.filtered_aggs(st.staged_cust(t), txns, st.src_account(t), risk.reference_date(st.src_transaction(t), st.AS_OF)).select(
        "customer_id", "total_txn_count", "intl_txn_count", "reversal_txn_count", "txn_count_90d",
        "total_txn_volume_usd_90d", "avg_txn_amount_usd",
    )


@query("global_max", "SELECT MAX(CAST(l_shipdate AS DATE)) AS last_date FROM lineitem")
def _(t):
    return t.lineitem.agg(F.max(F.to_date("l_shipdate")).alias("last_date"))


@query("min_reference_date", st.with_fact("SELECT MIN(reference_date) AS reference_date FROM fact WHERE as_of_date = DATE '2001-06-30'"))
def _(t):
    return st.fact(t).where(F.col("as_of_date") == F.lit(st.AS_OF)).agg(F.min("reference_date").alias("reference_date"))


TIERS = """SELECT COUNT(*) FILTER (WHERE risk_tier = 'HIGH') AS high_n, COUNT(*) FILTER (WHERE risk_tier = 'MEDIUM') AS medium_n,
    COUNT(*) FILTER (WHERE risk_tier = 'LOW') AS low_n, COUNT(*) AS total_n,
    ROUND(COUNT(*) FILTER (WHERE risk_tier = 'HIGH')::DOUBLE / COUNT(*), 6) AS pct_high,
    COUNT(*) FILTER (WHERE risk_tier = 'HIGH')::DOUBLE / COUNT(*) > 0.30 AS warn FROM fact"""


@query("tier_distribution", st.with_fact(TIERS))
def _(t):
    return M.tier_distribution(st.fact(t))


@query("distinct_tiers", st.with_fact("SELECT DISTINCT risk_tier FROM fact ORDER BY 1"))
def _(t):
    return M.distinct_values(st.fact(t), "risk_tier").orderBy("risk_tier")


@query(
    "count_nodes",
    "SELECT x AS label, (SELECT COUNT(*) FROM part) * (x = 'Column')::INT + (SELECT COUNT(*) FROM supplier) * (x = 'Process')::INT "
    "+ (SELECT COUNT(*) FROM nation) * (x = 'DataSet')::INT AS n FROM (SELECT unnest(['DataSet', 'Column', 'Process', 'Owner', 'Tag']) x)",
)
def _(t):
    from ledgerline.functions.values import NODE_LABELS

    nodes = (
        t.part.select(F.lit("Column").alias("label"))
        .unionByName(t.supplier.select(F.lit("Process").alias("label")))
        .unionByName(t.nation.select(F.lit("DataSet").alias("label")))
    )
    return count_by_label(nodes, NODE_LABELS)


@query(
    "count_edges",
    st.with_graph(
        """SELECT x AS label, COUNT(e.label) AS n FROM (SELECT unnest(['INPUT_TO', 'PRODUCES', 'DERIVES_FROM', 'DEPENDS_ON', 'OWNED_BY', 'CLASSIFIED_AS']) x)
        LEFT JOIN (SELECT label FROM derives UNION ALL SELECT label FROM struct_edges) e ON e.label = x GROUP BY x"""
    ),
)
def _(t):
    from ledgerline.functions.values import EDGE_LABELS

    return count_by_label(st.derives_edges(t).unionByName(st.structural_edges(t)), EDGE_LABELS)


@query(
    "table_fingerprint",
    """WITH h AS (SELECT sha256(concat_ws('|', COALESCE(CAST(c_custkey AS VARCHAR), '_NULL_'), COALESCE(c_name, '_NULL_'),
        COALESCE(CAST(c_nationkey AS VARCHAR), '_NULL_'), COALESCE(CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR), '_NULL_'),
        COALESCE(c_mktsegment, '_NULL_'))) h FROM customer),
      w AS (SELECT ('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT a, ('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT b,
        ('0x' || substr(h, 33, 16))::UBIGINT::HUGEINT c, ('0x' || substr(h, 49, 16))::UBIGINT::HUGEINT d FROM h)
    SELECT sha256(COUNT(*) || ':' || SUM(a) % 18446744073709551616 || ':' || SUM(b) % 18446744073709551616 || ':'
      || SUM(c) % 18446744073709551616 || ':' || SUM(d) % 18446744073709551616) AS fingerprint FROM w""",
)
def _(t):
    return table_fingerprint(t.customer.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)")), exclude=())


# --------------------------------------------------------------------------
# Windows
# --------------------------------------------------------------------------


@query("percent_rank_global", "SELECT o_orderkey, PERCENT_RANK() OVER (ORDER BY o_totalprice) AS pr FROM orders")
def _(t):
    return percent_rank_global(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "pr").select("o_orderkey", "pr")


@query(
    "first_seen_dedup",
    """SELECT l_suppkey, l_partkey, l_linenumber, l_orderkey FROM lineitem
    QUALIFY ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_linenumber, l_orderkey) = 1""",
)
def _(t):
    return first_seen_dedup(t.lineitem.select("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey"), ["l_suppkey", "l_partkey"], "l_linenumber")


@query(
    "last_event_wins",
    st.with_log(
        """SELECT run_id, stage, ts, status, duration_ms, output_row_count FROM log WHERE event = 'stage_complete'
        QUALIFY ROW_NUMBER() OVER (PARTITION BY run_id, stage ORDER BY ts DESC, event_id DESC) = 1"""
    ),
)
def _(t):
    return R.last_event_wins(st.written_log(t)).select("run_id", "stage", "ts", "status", "duration_ms", "output_row_count")


# --------------------------------------------------------------------------
# Sorts and limits
# --------------------------------------------------------------------------


@query("sort_multi", st.with_staged("SELECT from_currency, rate_date, CAST(rate AS DOUBLE) rate FROM stg_fx ORDER BY from_currency, rate_date"))
def _(t):
    return stg_fx(st.src_fx_rate(t)).select("from_currency", "rate_date", F.col("rate").cast("double").alias("rate")).orderBy("from_currency", "rate_date")


@query(
    "runs_latest_first",
    st.with_log("SELECT run_id, MAX(ts) AS modified_at FROM log GROUP BY run_id ORDER BY modified_at DESC, run_id"),
)
def _(t):
    return R.runs_latest_first(st.log_events(t).groupBy("run_id").agg(F.max("ts").alias("modified_at")))


# --------------------------------------------------------------------------
# Pipeline tables
# --------------------------------------------------------------------------


@query("stg_fx", st.with_staged("SELECT rate_date, from_currency, to_currency, CAST(rate AS DOUBLE) rate, rate_source FROM stg_fx"))
def _(t):
    return stg_fx(st.src_fx_rate(t)).withColumn("rate", F.col("rate").cast("double"))


MONEY = ["amount_usd", "net_amount_usd", "fx_rate_used"]


@query(
    "stg_transactions",
    st.with_staged(
        """SELECT * REPLACE (CAST(amount_usd AS DOUBLE) AS amount_usd, CAST(net_amount_usd AS DOUBLE) AS net_amount_usd,
        CAST(fx_rate_used AS DOUBLE) AS fx_rate_used) FROM stg_txn"""
    ),
)
def _(t):
    return st.staged_txn(t).withColumns({c: F.col(c).cast("double") for c in MONEY})


@query("stg_customers", st.with_staged("SELECT * FROM stg_cust"))
def _(t):
    return st.staged_cust(t)


@query("fct_risk_profile", st.with_fact("SELECT * FROM fact"))
def _(t):
    return st.fact(t)


@query("fx_coverage", st.with_staged("SELECT from_currency, COUNT(*) AS rate_rows, MIN(rate_date) AS first_date, MAX(rate_date) AS last_date FROM stg_fx GROUP BY 1"))
def _(t):
    return M.fx_coverage(stg_fx(st.src_fx_rate(t)))


@query("fx_misses", st.with_staged(f"SELECT original_currency, txn_date, COUNT(*) AS miss_count {MISSES} GROUP BY 1, 2"))
def _(t):
    return M.fx_misses(st.staged_txn(t))


@query("reversal_summary", st.with_staged(REVERSALS))
def _(t):
    return M.reversal_summary(st.staged_txn(t))


@query("intl_ratio", st.with_staged(INTL))
def _(t):
    return M.intl_ratio(st.staged_txn(t))


@query("kyc_summary", st.with_staged(KYC))
def _(t):
    return M.kyc_stale_ratio(st.staged_cust(t))


SUMMARY = """
last_stage AS (SELECT * FROM log WHERE event = 'stage_complete' QUALIFY ROW_NUMBER() OVER (PARTITION BY run_id, stage ORDER BY ts DESC, event_id DESC) = 1),
per_stage AS (SELECT run_id, COUNT(*) stage_count, bool_and(COALESCE(status, 'ok') = 'ok') all_ok, string_agg(stage, ',' ORDER BY stage) stages FROM last_stage GROUP BY 1),
per_run AS (
  SELECT run_id, max_by(ts, ts) FILTER (WHERE event = 'pipeline_start') started_at,
    arg_max_null(duration_ms, ts) FILTER (WHERE event = 'pipeline_complete') duration_ms,
    arg_max_null(status, ts) FILTER (WHERE event = 'pipeline_complete') st,
    COUNT(*) FILTER (WHERE event = 'data_quality_check') dq_total, COUNT(*) FILTER (WHERE event = 'data_quality_check' AND passed) dq_passed
  FROM log GROUP BY 1),
summary AS (
  SELECT r.run_id, started_at, duration_ms, COALESCE(st, CASE WHEN COALESCE(all_ok, TRUE) THEN 'ok' ELSE 'unknown' END) status,
    COALESCE(stage_count, 0) stage_count, COALESCE(stages, '') stages, dq_total, dq_passed
  FROM per_run r LEFT JOIN per_stage s ON s.run_id = r.run_id)"""


@query("run_summary", f"WITH {st.LOG}, {SUMMARY} SELECT * FROM summary")
def _(t):
    return R.run_summary(st.written_log(t))


@query(
    "run_detail",
    st.with_log("SELECT run_id, stage, check_name, passed, expected, actual, rows_checked, rows_failed FROM log WHERE event = 'data_quality_check'"),
)
def _(t):
    return R.run_detail(st.log_events(t))


@query(
    "dq_by_stage",
    st.with_log(
        """SELECT run_id, stage, COUNT(*) AS checks, COUNT(*) FILTER (WHERE passed) AS checks_passed, CAST(SUM(rows_failed) AS BIGINT) AS rows_failed
        FROM log WHERE event = 'data_quality_check' GROUP BY 1, 2"""
    ),
)
def _(t):
    return R.dq_by_stage(st.log_events(t))


@query(
    "dashboard_metrics",
    f"WITH {st.LOG}, {SUMMARY}, {st.GRAPH.strip()}, "
    """latest AS (SELECT * FROM summary ORDER BY started_at DESC NULLS LAST, run_id DESC LIMIT 1)
    SELECT (SELECT COUNT(*) FROM summary) AS runs_total, run_id AS latest_run,
      CASE WHEN dq_total > 0 THEN dq_passed || '/' || dq_total ELSE '—' END AS dq_pass_rate,
      0::BIGINT AS dataset_total, (SELECT COUNT(*) FROM cols) AS column_total, (SELECT COUNT(*) FROM procs) AS process_total,
      0::BIGINT AS owner_total, 0::BIGINT AS tag_total,
      (SELECT COUNT(*) FROM struct_edges WHERE label = 'INPUT_TO') AS input_to_total, (SELECT COUNT(*) FROM struct_edges WHERE label = 'PRODUCES') AS produces_total,
      (SELECT COUNT(*) FROM derives) AS derives_from_total, (SELECT COUNT(*) FROM struct_edges WHERE label = 'DEPENDS_ON') AS depends_on_total,
      0::BIGINT AS owned_by_total, 0::BIGINT AS classified_as_total FROM latest""",
)
def _(t):
    nodes = t.part.select(F.lit("Column").alias("label")).unionByName(t.supplier.select(F.lit("Process").alias("label")))
    edges = st.derives_edges(t).unionByName(st.structural_edges(t))
    return R.dashboard_metrics(R.run_summary(st.written_log(t)), nodes, edges)


@query(
    "run_history",
    st.with_log(
        """SELECT run_id, MIN(ts) FILTER (WHERE event = 'pipeline_start') AS started_at, MAX(ts) FILTER (WHERE event = 'pipeline_complete') AS ended_at,
        CASE WHEN COUNT(*) FILTER (WHERE event = 'orchestrator_stage_failed') > 0 THEN 'failed'
          WHEN COUNT(*) FILTER (WHERE event = 'pipeline_complete') > 0 THEN 'ok' ELSE 'running' END AS status,
        arg_min(stage, ts) FILTER (WHERE event = 'orchestrator_stage_failed') AS failed_stage,
        MAX(duration_ms) FILTER (WHERE event = 'pipeline_complete') AS duration_ms,
        CAST(SUM(duration_ms) FILTER (WHERE event = 'stage_complete') AS BIGINT) AS stage_ms FROM log GROUP BY run_id"""
    ),
)
def _(t):
    return R.run_history(st.written_log(t))


@query(
    "catalog_hit_rate",
    st.with_log(
        """SELECT CAST(SUM(catalog_hits) AS BIGINT) AS hits, CAST(SUM(catalog_misses) AS BIGINT) AS misses,
        ROUND(SUM(catalog_hits)::DOUBLE / (SUM(catalog_hits) + SUM(catalog_misses)), 4) AS hit_rate
        FROM log WHERE event = 'lineage_manifest_complete'"""
    ),
)
def _(t):
    return R.catalog_hit_rate(st.log_events(t))


# --------------------------------------------------------------------------
# Data-quality checks
# --------------------------------------------------------------------------

COLUMNS = "check_name, expected, actual, rows_checked, rows_failed, passed"


def _count_sql(name: str, source: str, bad: str, expected: str = "0", actual: str = "''||b||''") -> str:
    return (
        f"SELECT '{name}' AS check_name, '{expected}' AS expected, {actual} AS actual, n AS rows_checked, b AS rows_failed, b = 0 AS passed "
        f"FROM (SELECT COUNT(*) n, COUNT(*) FILTER (WHERE {bad}) b FROM {source})"
    )


NOT_NULL_TXN = [("amount_usd", "stg_txn"), ("net_amount_usd", "stg_txn"), ("full_name", "stg_cust"), ("age", "stg_cust"), ("branch_region", "stg_cust")]


@query("dq_not_null", st.with_staged(" UNION ALL ".join(_count_sql(f"{c}_not_null", s, f"{c} IS NULL") for c, s in NOT_NULL_TXN)))
def _(t):
    return D.union_checks(
        D.run_checks(st.staged_txn(t), [D.not_null(f"{c}_not_null", c) for c, s in NOT_NULL_TXN if s == "stg_txn"]),
        D.run_checks(st.staged_cust(t), [D.not_null(f"{c}_not_null", c) for c, s in NOT_NULL_TXN if s == "stg_cust"]),
    )


@query("dq_non_negative", _count_sql("acctbal_nonneg", "customer", "c_acctbal < 0") + " UNION ALL " + _count_sql("supplier_nonneg", "supplier", "s_acctbal < 0"))
def _(t):
    return D.union_checks(
        D.run_checks(t.customer, [D.non_negative("acctbal_nonneg", "c_acctbal")]),
        D.run_checks(t.supplier, [D.non_negative("supplier_nonneg", "s_acctbal")]),
    )


@query("dq_conditional_zero", st.with_staged(_count_sql("reversal_net_zero", "stg_txn", "is_reversal AND net_amount_usd <> 0")))
def _(t):
    return D.run_checks(st.staged_txn(t), [D.zero_when("reversal_net_zero", "is_reversal", "net_amount_usd")])


@query(
    "dq_no_silent_drops",
    st.with_staged(
        """SELECT 'no_silent_drops' AS check_name, '>= ' || s AS expected, ''||a AS actual, s AS rows_checked, GREATEST(0, s - a) AS rows_failed, a >= s AS passed
        FROM (SELECT (SELECT COUNT(*) FROM stg_txn) a, (SELECT COUNT(*) FROM src_transaction) s)"""
    ),
)
def _(t):
    return D.no_silent_drops(st.staged_txn(t), st.src_transaction(t), "no_silent_drops")


@query(
    "dq_range",
    st.with_fact(_count_sql("age_18_120", "fact", "age < 18 OR age > 120") + " UNION ALL " + _count_sql("score_0_1", "fact", "risk_score < 0 OR risk_score > 1")),
)
def _(t):
    return D.run_checks(st.fact(t), [D.in_range("age_18_120", "age", 18, 120), D.in_range("score_0_1", "risk_score", 0.0, 1.0)])


def _parity_sql(name: str, a: str, s: str) -> str:
    return (
        f"SELECT '{name}' AS check_name, ''||s AS expected, ''||a AS actual, s AS rows_checked, ABS(s - a) AS rows_failed, a = s AS passed "
        f"FROM (SELECT (SELECT COUNT(*) FROM {a}) a, (SELECT COUNT(*) FROM {s}) s)"
    )


@query("dq_row_parity", st.with_fact(_parity_sql("cust_one_to_one", "stg_cust", "src_customer") + " UNION ALL " + _parity_sql("lines_per_order", "lineitem", "orders")))
def _(t):
    return D.row_parity(st.staged_cust(t), st.src_customer(t), "cust_one_to_one").unionByName(D.row_parity(t.lineitem, t.orders, "lines_per_order"))


@query("dq_multi_not_null", st.with_fact(_count_sql("fact_nulls", "fact", "risk_score IS NULL OR branch_region IS NULL OR volume_percentile IS NULL")))
def _(t):
    return D.run_checks(st.fact(t), [D.not_null("fact_nulls", "risk_score", "branch_region", "volume_percentile")])


@query(
    "dq_value_set",
    """SELECT 'flags' AS check_name, 'A,N,R' AS expected, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS actual, COUNT(*) AS rows_checked,
      0::BIGINT AS rows_failed, TRUE AS passed FROM lineitem
    UNION ALL SELECT 'status', 'F,O', 'F,O +' || COUNT(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) || ' other', COUNT(*), 1::BIGINT, FALSE FROM orders""",
)
def _(t):
    return D.value_set(t.lineitem, "l_returnflag", ["R", "A", "N"], "flags").unionByName(D.value_set(t.orders, "o_orderstatus", ["O", "F"], "status"))


@query(
    "dq_non_empty",
    "SELECT 'orders_nonempty' AS check_name, '> 0' AS expected, ''||n AS actual, n AS rows_checked, CASE WHEN n > 0 THEN 0 ELSE 1 END::BIGINT AS rows_failed, n > 0 AS passed "
    "FROM (SELECT COUNT(*) n FROM orders)",
)
def _(t):
    return D.non_empty(t.orders, "orders_nonempty")


@query("dq_mapping_coverage", st.with_staged(_count_sql("branch_region_mapping", "stg_cust", "branch_region IS NULL")))
def _(t):
    return D.run_checks(st.staged_cust(t), [D.not_null("branch_region_mapping", "branch_region")])


FIFTEEN = " UNION ALL ".join(
    [
        _count_sql("stg_txn_amount_usd_not_null", "stg_txn", "amount_usd IS NULL"),
        _count_sql("stg_txn_net_amount_usd_not_null", "stg_txn", "net_amount_usd IS NULL"),
        _count_sql("stg_txn_amount_usd_nonneg", "stg_txn", "amount_usd < 0"),
        _count_sql("stg_txn_reversal_net_zero", "stg_txn", "is_reversal AND net_amount_usd <> 0"),
        "SELECT 'stg_txn_no_silent_drops', '>= ' || s, ''||a, s, GREATEST(0, s - a), a >= s FROM (SELECT (SELECT COUNT(*) FROM stg_txn) a, (SELECT COUNT(*) FROM src_transaction) s)",
        _count_sql("stg_cust_full_name_not_null", "stg_cust", "full_name IS NULL"),
        _count_sql("stg_cust_age_not_null", "stg_cust", "age IS NULL"),
        _count_sql("stg_cust_branch_region_not_null", "stg_cust", "branch_region IS NULL"),
        _count_sql("stg_cust_age_18_120", "stg_cust", "age < 18 OR age > 120"),
        _parity_sql("stg_cust_one_to_one_with_src", "stg_cust", "src_customer"),
        _count_sql("L2_DQ_01", "fact", "risk_score < 0 OR risk_score > 1", "risk_score in [0,1]", "b||' rows out of range'"),
        _count_sql("L2_DQ_02", "fact", "risk_score IS NULL OR risk_tier IS NULL OR volume_percentile IS NULL", "0 NULLs in (risk_score, risk_tier, volume_percentile)", "b||' NULL rows'"),
        _parity_sql("L2_DQ_03", "fact", "src_customer"),
        "SELECT 'L2_DQ_04', 'HIGH,LOW,MEDIUM', s, n, CASE WHEN s = 'HIGH,LOW,MEDIUM' THEN 0 ELSE 1 END::BIGINT, s = 'HIGH,LOW,MEDIUM' "
        "FROM (SELECT string_agg(DISTINCT risk_tier, ',' ORDER BY risk_tier) s, COUNT(*) n FROM fact)",
        _count_sql("L2_DQ_05", "fact", "total_txn_volume_usd_90d < 0", "total_txn_volume_usd_90d >= 0", "b||' negative rows'"),
    ]
)


def _fifteen(t):
    # Checks run on the written tables, as in a daily run: nothing is computed once per check.
    txn, cust = st.stored(st.staged_txn(t)), st.stored(st.staged_cust(t))
    fact = st.stored(st.fact(t, txn, cust))
    staged = D.staging_checks(txn, st.src_transaction(t), cust, st.src_customer(t))
    return staged.unionByName(D.fact_checks(fact, st.src_customer(t), st.AS_OF))


@query("dq_all_checks", st.with_fact(FIFTEEN))
def _(t):
    return _fifteen(t)


@query(
    "dq_gate",
    st.with_fact(
        f"""SELECT COUNT(*) AS checks_total, COUNT(*) FILTER (WHERE NOT passed) AS checks_failed,
        COALESCE(string_agg(CASE WHEN NOT passed THEN check_name END, ',' ORDER BY check_name), '') AS failed_checks, bool_and(passed) AS passed FROM ({FIFTEEN})"""
    ),
)
def _(t):
    return D.gate(_fifteen(t))


def _unique_sql(name: str, table: str, keys: str) -> str:
    return (
        f"SELECT '{name}' AS check_name, '0' AS expected, ''||b AS actual, n AS rows_checked, b AS rows_failed, b = 0 AS passed "
        f"FROM (SELECT CAST(SUM(c) AS BIGINT) n, COUNT(*) FILTER (WHERE c > 1) b FROM (SELECT COUNT(*) c FROM {table} GROUP BY {keys}))"
    )


def _foreign_sql(name: str, child: str, key: str, parent: str, pkey: str) -> str:
    return (
        f"SELECT '{name}', '0', ''||b, n, b, b = 0 FROM (SELECT COUNT(*) n, COUNT(*) FILTER (WHERE {pkey} IS NULL) b "
        f"FROM {child} LEFT JOIN (SELECT DISTINCT {pkey} FROM {parent}) ON {key} = {pkey})"
    )


@query(
    "constraint_checks",
    _unique_sql("orders_pk", "orders", "o_orderkey") + " UNION ALL " + _unique_sql("lineitem_unique", "lineitem", "l_orderkey, l_linenumber")
    + " UNION ALL " + _foreign_sql("lineitem_orders_fk", "lineitem", "l_orderkey", "orders", "o_orderkey")
    + " UNION ALL " + _foreign_sql("line_region_fk", "lineitem", "l_linenumber", "region", "r_regionkey")
    + " UNION ALL " + _count_sql("status_domain", "orders", "o_orderstatus NOT IN ('F', 'O')"),
)
def _(t):
    return D.union_checks(
        D.unique_key(t.orders, ["o_orderkey"], "orders_pk"),
        D.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem_unique"),
        D.foreign_key(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "lineitem_orders_fk"),
        D.foreign_key(t.lineitem, "l_linenumber", t.region, "r_regionkey", "line_region_fk"),
        D.run_checks(t.orders, [D.in_domain("status_domain", "o_orderstatus", ["F", "O"])]),
    )
