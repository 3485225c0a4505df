"""The given tables in the roles of the banking, event-log and lineage tables.

Each stand-in is a projection of whole tables; its SQL twin (a WITH clause for the
oracle) stands next to it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.queries import Tables
from ledgerline.session import scratch_path

AS_OF = dt.date(2001, 6, 30)

# A line's currency: the first one is in US dollars, others in an order priority that quotes or in one that never does.
LINE_CURRENCY = (
    "CASE l_linenumber WHEN 1 THEN 'USD' WHEN 2 THEN '2-HIGH' WHEN 3 THEN '3-MEDIUM' WHEN 4 THEN '4-NOT SPECIFIED' "
    "WHEN 5 THEN '5-LOW' WHEN 6 THEN '1-URGENT' ELSE concat('unquoted-', l_linenumber) END"
)

# --------------------------------------------------------------------------
# Banking sources
# --------------------------------------------------------------------------


def src_branch(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.selectExpr(
        "CAST(n_nationkey AS STRING) AS branch_id", "n_name AS branch_name",
        "CASE WHEN r_name = 'ASIA' THEN NULL ELSE r_name END AS region",
    )


def src_customer(t: Tables) -> DataFrame:
    return t.customer.selectExpr(
        "CAST(c_custkey AS STRING) AS customer_id",
        "split_part(c_name, '#', 1) AS first_name",
        "split_part(c_name, '#', 2) AS last_name",
        "date_add(DATE '1930-01-01', CAST(floor(c_acctbal) AS INT) + 1000) AS dob",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'US' ELSE 'DE' END AS country_of_birth",
        "CASE WHEN c_nationkey = 2 THEN 'US' ELSE 'FR' END AS citizenship",
        "date_add(DATE '1990-01-01', c_nationkey) AS onboarded_date",
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'EXPIRED' WHEN 'AUTOMOBILE' THEN 'PENDING' "
        "WHEN 'HOUSEHOLD' THEN 'REJECTED' ELSE 'APPROVED' END AS kyc_status",
        "CASE WHEN c_acctbal >= 0 THEN CAST(date_sub(DATE '2001-06-30', CAST(floor(c_acctbal / 10) AS INT)) "
        "AS TIMESTAMP_NTZ) END AS kyc_reviewed_at",
        "CAST(c_nationkey AS STRING) AS branch_id",
    )


def src_account(t: Tables) -> DataFrame:
    return t.orders.selectExpr("CAST(o_orderkey AS STRING) AS account_id", "CAST(o_custkey AS STRING) AS customer_id")


def src_transaction(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS txn_id",
        "CAST(l_orderkey AS STRING) AS account_id",
        "CAST(l_shipdate AS DATE) AS txn_date",
        "l_shipdate AS txn_timestamp",
        "l_returnflag AS txn_type",
        "l_linestatus AS channel",
        "'SETTLED' AS status",
        "CAST(l_extendedprice AS DECIMAL(15,2)) AS amount",
        f"{LINE_CURRENCY} AS currency",
        "CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_tax > 0.04 THEN concat('US', l_suppkey) "
        "ELSE concat('DE', l_suppkey) END AS counterparty_bank_bic",
        "CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS reversal_flag",
    )


def src_fx_rate(t: Tables) -> DataFrame:
    """Daily rates per order priority; days before 1996 quote another currency."""
    return t.orders.groupBy(
        F.expr("CAST(o_orderdate AS DATE)").alias("rate_date"),
        F.col("o_orderpriority").alias("from_currency"),
    ).agg(
        F.expr("CAST(MIN(o_totalprice) / 100000 AS DECIMAL(18,8))").alias("rate"),
        F.expr("concat('S', MIN(o_orderstatus))").alias("rate_source"),
    ).withColumn("to_currency", F.expr("CASE WHEN rate_date < DATE '1996-01-01' THEN 'EUR' ELSE 'USD' END"))


BANK = """
src_branch AS (
  SELECT CAST(n_nationkey AS VARCHAR) branch_id, n_name branch_name,
         CASE WHEN r_name = 'ASIA' THEN NULL ELSE r_name END region
  FROM nation JOIN region ON n_regionkey = r_regionkey),
src_customer AS (
  SELECT CAST(c_custkey AS VARCHAR) customer_id, split_part(c_name, '#', 1) first_name, split_part(c_name, '#', 2) last_name,
         DATE '1930-01-01' + (CAST(floor(c_acctbal) AS INTEGER) + 1000) dob,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'US' ELSE 'DE' END country_of_birth,
         CASE WHEN c_nationkey = 2 THEN 'US' ELSE 'FR' END citizenship,
         DATE '1990-01-01' + c_nationkey onboarded_date,
         CASE c_mktsegment WHEN 'MACHINERY' THEN 'EXPIRED' WHEN 'AUTOMOBILE' THEN 'PENDING'
              WHEN 'HOUSEHOLD' THEN 'REJECTED' ELSE 'APPROVED' END kyc_status,
         CASE WHEN c_acctbal >= 0 THEN CAST(DATE '2001-06-30' - CAST(floor(c_acctbal / 10) AS INTEGER) AS TIMESTAMP) END kyc_reviewed_at,
         CAST(c_nationkey AS VARCHAR) branch_id
  FROM customer),
src_account AS (SELECT CAST(o_orderkey AS VARCHAR) account_id, CAST(o_custkey AS VARCHAR) customer_id FROM orders),
src_transaction AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) txn_id, CAST(l_orderkey AS VARCHAR) account_id,
         CAST(l_shipdate AS DATE) txn_date, l_shipdate txn_timestamp, l_returnflag txn_type, l_linestatus channel,
         'SETTLED' status, CAST(l_extendedprice AS DECIMAL(15,2)) amount,
         """ + LINE_CURRENCY + """ currency,
         CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_tax > 0.04 THEN 'US' || l_suppkey ELSE 'DE' || l_suppkey END counterparty_bank_bic,
         CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END reversal_flag
  FROM lineitem),
src_fx_rate AS (
  SELECT CAST(o_orderdate AS DATE) rate_date, o_orderpriority from_currency,
         CAST(MIN(o_totalprice) / 100000 AS DECIMAL(18,8)) rate, 'S' || MIN(o_orderstatus) rate_source,
         CASE WHEN CAST(o_orderdate AS DATE) < DATE '1996-01-01' THEN 'EUR' ELSE 'USD' END to_currency
  FROM orders GROUP BY ALL)"""

# A rate holds from its day on: the day's rate is that of the largest day not after it, found once per currency and day.
STAGED = BANK + """,
stg_fx AS (SELECT rate_date, from_currency, to_currency, rate, rate_source FROM src_fx_rate WHERE to_currency = 'USD'),
days AS (SELECT DISTINCT currency c, txn_date d FROM src_transaction WHERE currency <> 'USD'),
valid_day AS (SELECT c, d, MAX(rate_date) valid_from FROM days JOIN stg_fx ON from_currency = c AND rate_date <= d GROUP BY c, d),
opening AS (SELECT * FROM stg_fx WHERE (from_currency, rate_date) IN (SELECT (from_currency, MIN(rate_date)) FROM stg_fx GROUP BY from_currency)),
day_rate AS (
  SELECT c, d, x.rate, x.rate_source AS origin FROM valid_day JOIN stg_fx x ON x.from_currency = c AND x.rate_date = valid_from
  UNION ALL
  SELECT c, d, o.rate, o.rate_source || '_BACKFILL' FROM days JOIN opening o ON o.from_currency = c
  WHERE NOT EXISTS (SELECT 1 FROM valid_day v WHERE v.c = days.c AND v.d = days.d)
  UNION ALL SELECT 'USD', d, 1, NULL FROM (SELECT DISTINCT txn_date d FROM src_transaction)),
usd AS (
  SELECT s.*, r.rate, r.origin, ROUND(CAST(s.amount AS DECIMAL(20,2)) * CAST(r.rate AS DECIMAL(18,8)), 2) value
  FROM src_transaction s LEFT JOIN day_rate r ON r.c = s.currency AND r.d = s.txn_date),
stg_txn AS (
  SELECT txn_id, account_id, txn_date, txn_timestamp, txn_type, channel, status, value amount_usd, reversal_flag = 'Y' is_reversal,
    COALESCE(NOT starts_with(counterparty_bank_bic, 'US'), FALSE) is_international, if(reversal_flag = 'Y', value * 0, value) net_amount_usd,
    currency original_currency, rate fx_rate_used, origin fx_rate_source FROM usd),
stg_cust AS (
  SELECT customer_id, kyc_status, kyc_reviewed_at, onboarded_date, branch_id, concat(first_name, ' ', last_name) full_name,
    CAST(date_part('year', DATE '2001-06-30') - date_part('year', dob) - if(strftime(dob, '%m%d') > '0630', 1, 0) AS INTEGER) age,
    'US' IN (citizenship, country_of_birth) is_us_person, open_days kyc_days_since_review,
    kyc_status = 'EXPIRED' OR COALESCE(open_days > 365, FALSE) kyc_stale_flag,
    (SELECT region FROM src_branch b WHERE b.branch_id = p.branch_id) branch_region
  FROM (SELECT *, DATE '2001-06-30' - CAST(kyc_reviewed_at AS DATE) open_days FROM src_customer) p)"""

# Counted per account first, as an account has one owner; a percentile is the share of customers with less volume.
FACT = STAGED + """,
today AS (SELECT LEAST(MAX(txn_date), DATE '2001-06-30') reference_date FROM src_transaction),
by_account AS (
  SELECT account_id, COUNT(*) n, COUNT_IF(is_international) foreign_n, COUNT_IF(is_reversal) back_n,
    COUNT_IF(recent AND NOT is_reversal) recent_n, SUM(if(recent, net, 0)) recent_sum, SUM(if(is_reversal, 0, net)) kept_sum,
    COUNT(if(is_reversal, NULL, net)) kept_n
  FROM (SELECT *, CAST(net_amount_usd AS DECIMAL(38,2)) net, txn_date >= (SELECT reference_date - 90 FROM today) recent FROM stg_txn) GROUP BY account_id),
by_owner AS (
  SELECT customer_id, SUM(n) n, SUM(foreign_n) foreign_n, SUM(back_n) back_n, SUM(recent_n) recent_n, SUM(recent_sum) recent_sum,
    SUM(kept_sum) kept_sum, SUM(kept_n) kept_n FROM by_account JOIN src_account USING (account_id) GROUP BY customer_id),
activity AS (
  SELECT c.*, reference_date, COALESCE(n, 0)::BIGINT all_n, COALESCE(foreign_n, 0)::BIGINT all_foreign_n, COALESCE(back_n, 0)::BIGINT all_back_n,
    COALESCE(recent_n, 0)::BIGINT txn_count_90d, COALESCE(recent_sum, 0)::DOUBLE total_txn_volume_usd_90d,
    COALESCE(foreign_n::DOUBLE / n, 0) foreign_share, COALESCE(back_n::DOUBLE / n, 0) back_share,
    COALESCE(kept_sum::DOUBLE / NULLIF(kept_n, 0), 0) avg_txn_amount_usd
  FROM stg_cust c, today LEFT JOIN by_owner o ON o.customer_id = c.customer_id),
volumes AS (SELECT total_txn_volume_usd_90d v, SUM(COUNT(*)) OVER (ORDER BY total_txn_volume_usd_90d) - COUNT(*) lower_n FROM activity GROUP BY 1),
weighed AS (
  SELECT *, if(total_n > 1, lower_n::DOUBLE / (total_n - 1), 0) volume_share,
    0.4::DOUBLE * foreign_share + 0.3::DOUBLE * if(kyc_stale_flag, 1::DOUBLE, 0::DOUBLE) + 0.2::DOUBLE * if(total_n > 1, lower_n::DOUBLE / (total_n - 1), 0)
      + 0.1::DOUBLE * back_share points
  FROM activity JOIN volumes ON v = total_txn_volume_usd_90d, (SELECT COUNT(*) total_n FROM activity)),
fact AS (
  SELECT customer_id, DATE '2001-06-30' as_of_date, full_name, age, is_us_person, kyc_status, kyc_stale_flag, branch_region,
    total_txn_volume_usd_90d, txn_count_90d, foreign_share international_txn_ratio, avg_txn_amount_usd, back_share reversal_rate,
    volume_share volume_percentile, points risk_score, ['LOW', 'MEDIUM', 'HIGH'][1 + (points > 0.35)::INT + (points > 0.65)::INT] risk_tier, reference_date
  FROM weighed)"""


def with_bank(select: str) -> str:
    return f"WITH {BANK} {select}"


def with_staged(select: str) -> str:
    return f"WITH {STAGED} {select}"


def with_fact(select: str) -> str:
    return f"WITH {FACT} {select}"


def staged_txn(t: Tables) -> DataFrame:
    from ledgerline.plans.staging import stg_fx, stg_transactions

    return stg_transactions(src_transaction(t), stg_fx(src_fx_rate(t)))


def staged_cust(t: Tables) -> DataFrame:
    from ledgerline.plans.staging import stg_customers

    return stg_customers(src_customer(t), src_branch(t), AS_OF)


def fact(t: Tables, txn: DataFrame | None = None, cust: DataFrame | None = None) -> DataFrame:
    from ledgerline.plans.risk import fct_risk_profile

    txn = staged_txn(t) if txn is None else txn
    cust = staged_cust(t) if cust is None else cust
    fact = fct_risk_profile(txn, cust, src_account(t), AS_OF, dates=src_transaction(t))
    return fact.drop("computed_at")


# --------------------------------------------------------------------------
# Event log
# --------------------------------------------------------------------------


def log_events(t: Tables) -> DataFrame:
    """Runs are users, event kinds are event types, order is the time."""
    from ledgerline.sources.eventlog import FIELDS, LONGS

    given = t.events.selectExpr(
        "event_id",
        "CAST(ts AS STRING) AS ts",
        "CASE WHEN value < 50 THEN 'info' ELSE 'error' END AS level",
        "CASE event_type WHEN 'signup' THEN 'pipeline_start' WHEN 'purchase' THEN 'pipeline_complete' "
        "WHEN 'click' THEN 'stage_complete' WHEN 'view' THEN 'data_quality_check' "
        "ELSE CASE WHEN value < 40 THEN 'lineage_manifest_complete' ELSE 'orchestrator_stage_failed' END END AS event",
        "concat('stage_', get_json_object(props, '$.k')) AS stage",
        "concat('run_', user_id) AS run_id",
        "CASE WHEN event_type IN ('click', 'purchase') AND value >= 10 THEN CASE WHEN value < 90 THEN 'ok' ELSE 'failed' END END AS status",
        "CAST(floor(value * 10) AS BIGINT) AS duration_ms",
        "CASE WHEN event_type = 'click' THEN event_id END AS output_row_count",
        "CASE WHEN event_type = 'view' THEN concat('check_', get_json_object(props, '$.k')) END AS check_name",
        "CASE WHEN event_type = 'view' THEN value < 50 END AS passed",
        "CASE WHEN event_type = 'view' THEN '0' END AS expected",
        "CASE WHEN event_type = 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS actual",
        "CASE WHEN event_type = 'view' THEN event_id END AS rows_checked",
        "CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS rows_failed",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS catalog_hits",
        "CAST(floor(value) AS BIGINT) AS catalog_misses",
    )
    missing = [f for f in FIELDS if f not in given.columns]
    none = {f: F.lit(None).cast("bigint" if f in LONGS else "string") for f in missing}
    return given.withColumns(none).withColumn("pos", F.struct("ts", "event_id"))


def written_log(t: Tables) -> DataFrame:
    """The events appended as files, twice per run, and read back."""
    from ledgerline.sources.eventlog import FIELDS, append_events, read_event_log

    path = scratch_path(t.spark, "log")
    events = log_events(t).select(*FIELDS)
    early = F.col("ts") < "2024-01-15"
    append_events(events.where(early), path)
    append_events(events.where(~early), path)
    return read_event_log(t.spark, path)


LOG = """
log AS (
  SELECT event_id, CAST(ts AS VARCHAR) ts, CASE WHEN value < 50 THEN 'info' ELSE 'error' END AS level,
    CASE event_type WHEN 'signup' THEN 'pipeline_start' WHEN 'purchase' THEN 'pipeline_complete'
      WHEN 'click' THEN 'stage_complete' WHEN 'view' THEN 'data_quality_check'
      ELSE CASE WHEN value < 40 THEN 'lineage_manifest_complete' ELSE 'orchestrator_stage_failed' END END AS event,
    'stage_' || json_extract_string(props, '$.k') stage, 'run_' || user_id run_id,
    CASE WHEN event_type IN ('click', 'purchase') AND value >= 10 THEN CASE WHEN value < 90 THEN 'ok' ELSE 'failed' END END status,
    CAST(floor(value * 10) AS BIGINT) duration_ms, CASE WHEN event_type = 'click' THEN event_id END output_row_count,
    CASE WHEN event_type = 'view' THEN 'check_' || json_extract_string(props, '$.k') END check_name,
    CASE WHEN event_type = 'view' THEN value < 50 END passed, CASE WHEN event_type = 'view' THEN '0' END expected,
    CASE WHEN event_type = 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END actual,
    CASE WHEN event_type = 'view' THEN event_id END rows_checked,
    CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END rows_failed,
    CAST(json_extract_string(props, '$.k') AS BIGINT) catalog_hits, CAST(floor(value) AS BIGINT) catalog_misses
  FROM events)"""


def with_log(select: str) -> str:
    return f"WITH {LOG} {select}"


# --------------------------------------------------------------------------
# Lineage graph: parts are columns, a part derives from parts key/2 and key/3
# --------------------------------------------------------------------------


def graph_columns(t: Tables) -> DataFrame:
    return t.part.withColumn("p_table", F.expr(PART_TABLE)).selectExpr(*COLUMN_EXPRS)


# A part's table: its type picks the layer.
PART_TABLE = (
    "CASE p_type WHEN 'ECONOMY' THEN 'src_economy' WHEN 'STANDARD' THEN 'src_standard' WHEN 'MEDIUM' THEN 'stg_medium' "
    "WHEN 'SMALL' THEN 'stg_small' WHEN 'LARGE' THEN 'fct_large' ELSE 'fct_customer_risk_profile' END"
)
COLUMN_EXPRS = [
    "p_partkey",
    "concat(p_table, '::c', p_partkey) AS pk",
    "concat('c', p_partkey) AS column_name",
    "p_table AS dataset_name",
    "CASE p_brand WHEN 'Brand#1' THEN 'PASSTHROUGH' WHEN 'Brand#2' THEN 'RENAME' WHEN 'Brand#3' THEN 'AMBIGUOUS' "
    "WHEN 'Brand#4' THEN 'AGGREGATE' ELSE 'TRANSFORM' END AS transform_type",
    "p_retailprice / 3000 AS confidence",
    "p_type AS data_type",
    "CASE WHEN p_size > 40 THEN 'round(x, 2)' WHEN p_size > 30 THEN 'a || b' ELSE p_name END AS expression",
    "CASE WHEN p_size > 20 THEN p_name ELSE '' END AS semantic_description",
    "CASE WHEN p_size > 25 THEN 'sqlglot' ELSE 'catalog' END AS source",
    "CASE WHEN p_size > 25 THEN 'pending_review' ELSE 'ratified' END AS review_state",
]


def derives_edges(t: Tables) -> DataFrame:
    """DERIVES_FROM edges; both ends are joined to the parts for their table."""
    keys = t.part.where("p_partkey > 0").selectExpr(
        "p_partkey", "explode(array_distinct(array(p_partkey div 2, p_partkey div 3))) AS source_key"
    )
    ids = graph_columns(t).select("p_partkey", "pk")
    return (
        keys.join(ids.withColumnRenamed("pk", "src_id"), "p_partkey")
        .join(ids.select(F.col("p_partkey").alias("source_key"), F.col("pk").alias("dst_id")), "source_key")
        .select(F.lit("DERIVES_FROM").alias("label"), "src_id", "dst_id")
    )


def processes(t: Tables) -> DataFrame:
    return t.supplier.selectExpr(
        "concat('st_', s_nationkey, '::r', s_suppkey) AS pk",
        "concat('st_', s_nationkey) AS stage",
        "concat('r', s_suppkey) AS run_id",
        "CASE WHEN s_acctbal < 5000 THEN 'FILTER' ELSE 'TRANSFORM_JOIN' END AS transform_type",
        "CASE WHEN s_acctbal < 3000 THEN concat('stg_', s_nationkey) WHEN s_acctbal < 6000 THEN 'fct_customer_risk_profile' "
        "ELSE concat('fct_', s_nationkey) END AS target_table",
        "CAST(floor(s_acctbal) AS BIGINT) AS duration_ms",
        "s_suppkey AS output_row_count",
        "concat('SELECT C', s_suppkey % 12, ', max(x) FROM t') AS sql_text",
        "s_suppkey",
    )


def structural_edges(t: Tables) -> DataFrame:
    """INPUT_TO from the tables of the parts a supplier ships, PRODUCES, DEPENDS_ON."""
    procs = processes(t)
    used = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    tables = graph_columns(t).select(F.col("p_partkey").alias("l_partkey"), "dataset_name")
    reads = (
        used.join(tables, "l_partkey")
        .select("l_suppkey", "dataset_name")
        .distinct()
        .join(procs.select(F.col("s_suppkey").alias("l_suppkey"), "pk"), "l_suppkey")
        .select(F.lit("INPUT_TO").alias("label"), F.col("dataset_name").alias("src_id"), F.col("pk").alias("dst_id"))
    )
    writes = procs.select(F.lit("PRODUCES").alias("label"), F.col("pk").alias("src_id"), F.col("target_table").alias("dst_id"))
    parents = procs.select(F.col("s_suppkey").alias("parent"), F.col("pk").alias("dst_id"))
    depends = (
        procs.where("s_suppkey > 0").select(F.col("pk").alias("src_id"), F.expr("s_suppkey div 2").alias("parent"))
        .join(parents, "parent")
        .select(F.lit("DEPENDS_ON").alias("label"), "src_id", "dst_id")
    )
    return reads.unionByName(writes).unionByName(depends)


GRAPH = f"""
cols AS (
  SELECT p_partkey, p_table || '::c' || p_partkey pk, 'c' || p_partkey column_name, p_table dataset_name,
    CASE p_brand WHEN 'Brand#1' THEN 'PASSTHROUGH' WHEN 'Brand#2' THEN 'RENAME' WHEN 'Brand#3' THEN 'AMBIGUOUS'
      WHEN 'Brand#4' THEN 'AGGREGATE' ELSE 'TRANSFORM' END transform_type,
    p_retailprice / 3000 confidence, p_type data_type,
    CASE WHEN p_size > 40 THEN 'round(x, 2)' WHEN p_size > 30 THEN 'a || b' ELSE p_name END expression,
    CASE WHEN p_size > 20 THEN p_name ELSE '' END semantic_description,
    CASE WHEN p_size > 25 THEN 'sqlglot' ELSE 'catalog' END AS source,
    CASE WHEN p_size > 25 THEN 'pending_review' ELSE 'ratified' END review_state
  FROM (SELECT *, {PART_TABLE} p_table FROM part)),
links AS (
  SELECT p_partkey k, p_partkey // 2 s FROM part WHERE p_partkey > 0
  UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0),
derives AS (
  SELECT 'DERIVES_FROM' AS label, a.pk src_id, b.pk dst_id
  FROM links JOIN cols a ON a.p_partkey = k JOIN cols b ON b.p_partkey = s),
procs AS (
  SELECT 'st_' || s_nationkey || '::r' || s_suppkey pk, 'st_' || s_nationkey stage, 'r' || s_suppkey run_id,
    CASE WHEN s_acctbal < 5000 THEN 'FILTER' ELSE 'TRANSFORM_JOIN' END transform_type,
    CASE WHEN s_acctbal < 3000 THEN 'stg_' || s_nationkey WHEN s_acctbal < 6000 THEN 'fct_customer_risk_profile'
      ELSE 'fct_' || s_nationkey END target_table,
    CAST(floor(s_acctbal) AS BIGINT) duration_ms, s_suppkey output_row_count, 'SELECT C' || (s_suppkey % 12) || ', max(x) FROM t' sql_text, s_suppkey
  FROM supplier),
struct_edges AS (
  SELECT DISTINCT 'INPUT_TO' AS label, c.dataset_name src_id, p.pk dst_id
  FROM lineitem JOIN cols c ON c.p_partkey = l_partkey JOIN procs p ON p.s_suppkey = l_suppkey
  UNION ALL SELECT 'PRODUCES', pk, target_table FROM procs
  UNION ALL SELECT 'DEPENDS_ON', a.pk, b.pk FROM procs a JOIN procs b ON b.s_suppkey = a.s_suppkey // 2 WHERE a.s_suppkey > 0)"""


def with_graph(select: str) -> str:
    return f"WITH {GRAPH} {select}"


def recursive_graph(extra: str, select: str) -> str:
    return f"WITH RECURSIVE {GRAPH}, {extra} {select}"


def datasets(t: Tables) -> DataFrame:
    """One dataset per part table, with its number of columns as row count."""
    return graph_columns(t).groupBy(F.col("dataset_name").alias("name")).agg(
        F.count(F.lit(1)).alias("row_count"), F.max("column_name").alias("computed_at")
    ).selectExpr(
        "name",
        "CASE WHEN name LIKE 'src%' THEN 'layer_0' WHEN name LIKE 'stg%' THEN 'layer_1' ELSE 'layer_2' END AS layer",
        "row_count",
        "computed_at",
    )


DATASETS = """
datasets AS (
  SELECT dataset_name AS name, CASE WHEN dataset_name LIKE 'src%' THEN 'layer_0' WHEN dataset_name LIKE 'stg%' THEN 'layer_1'
    ELSE 'layer_2' END layer, COUNT(*) row_count, MAX(column_name) computed_at FROM cols GROUP BY dataset_name)"""


def certifications(t: Tables) -> DataFrame:
    """Tables certified by the suppliers' account balance."""
    return processes(t).groupBy(F.col("target_table").alias("table_name")).agg(
        F.expr("CASE WHEN MAX(duration_ms) > 5000 THEN 'P1' WHEN MAX(duration_ms) > 2500 THEN 'P2' ELSE 'P3' END").alias("profile"),
        F.expr("concat('runs ', COUNT(*))").alias("notes"),
    )


CERTS = """
certs AS (
  SELECT target_table table_name, CASE WHEN MAX(duration_ms) > 5000 THEN 'P1' WHEN MAX(duration_ms) > 2500 THEN 'P2' ELSE 'P3' END profile,
    'runs ' || COUNT(*) notes FROM procs GROUP BY target_table)"""

# --------------------------------------------------------------------------
# Catalog: an order is a target column, the parts of its lines are its sources
# --------------------------------------------------------------------------


def stored(df: DataFrame) -> DataFrame:
    """The frame as a table: the catalog's tables are stored ones, read more than once."""
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def catalog_lineage(t: Tables) -> DataFrame:
    # Flags and numbers keep this a hash aggregate.
    flag = "char(MIN(ascii(l_returnflag)))"
    lineage = t.lineitem.groupBy("l_orderkey", "l_suppkey", "l_partkey").agg(
        F.expr("CASE WHEN bool_or(l_linestatus = 'F') THEN 'ratified' ELSE 'pending_review' END").alias("review_state"),
        F.expr(f"CASE {flag} WHEN 'A' THEN 'catalog' WHEN 'N' THEN 'sqlglot' ELSE 'agent_inferred' END").alias("source"),
        F.expr("CASE WHEN MIN(l_tax) > 0.04 THEN 'PASSTHROUGH' ELSE 'TRANSFORM' END").alias("transform_type"),
        F.expr("1 - MIN(l_discount)").alias("confidence"),
        F.expr(f"concat('h', {flag})").alias("sql_hash"),
        F.expr("CAST(CAST(MIN(l_shipdate) AS DATE) AS STRING)").alias("computed_at"),
    ).selectExpr(
        "'stg_orders' AS target_table", "concat('c', l_orderkey) AS target_column", "concat('src_', l_suppkey) AS source_table",
        "concat('p', l_partkey) AS source_column", "concat('e', l_partkey) AS expression", "transform_type", "confidence",
        "source", "review_state", "CASE WHEN review_state = 'ratified' THEN 'ana' ELSE '' END AS ratified_by",
        "CASE WHEN review_state = 'ratified' THEN computed_at ELSE '' END AS ratified_at", "sql_hash", "computed_at",
    )
    return stored(lineage)


def parsed_maps(t: Tables) -> DataFrame:
    """Parser output: lines with little discount, of orders that are not pending."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where(
        "o_orderstatus <> 'P' AND l_discount <= 0.06"
    )
    return stored(joined.groupBy("l_orderkey", "l_suppkey", "l_partkey").agg(
        F.max("o_orderpriority").alias("prio"), F.max("o_totalprice").alias("price")
    ).selectExpr(
        "'STG_ORDERS' AS target_table", "concat('C', l_orderkey) AS target_column", "concat('SRC_', l_suppkey) AS source_table",
        "concat('P', l_partkey) AS source_column", "'TRANSFORM' AS transform_type", "concat('f', l_orderkey) AS full_expression",
        "prio = '1-URGENT' AS ambiguous", "CASE WHEN prio = '1-URGENT' THEN 0.5D WHEN price > 400000 THEN 0.9D ELSE 1.0D END AS confidence",
        "'hp' AS sql_hash",
    ))


def agent_maps(t: Tables) -> DataFrame:
    """Agent output for urgent orders that were filled."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where(
        "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"
    )
    return stored(joined.select("l_orderkey", "l_partkey").distinct().selectExpr(
        "'stg_orders' AS target_table", "concat('c', l_orderkey) AS target_column", "'src_agent' AS source_table",
        "concat('p', l_partkey) AS source_column", "'TRANSFORM' AS transform_type", "concat('g', l_orderkey) AS full_expression",
        "FALSE AS ambiguous", "0.8D AS confidence", "'ha' AS sql_hash",
    ))


CATALOG = """
lin AS (
  SELECT 'stg_orders' target_table, 'c' || l_orderkey target_column, 'src_' || l_suppkey source_table, 'p' || l_partkey source_column,
    'e' || l_partkey expression, CASE WHEN MIN(l_tax) > 0.04 THEN 'PASSTHROUGH' ELSE 'TRANSFORM' END transform_type,
    1 - MIN(l_discount) confidence,
    CASE MIN(l_returnflag) WHEN 'A' THEN 'catalog' WHEN 'N' THEN 'sqlglot' ELSE 'agent_inferred' END AS source,
    CASE WHEN MIN(l_linestatus) = 'F' THEN 'ratified' ELSE 'pending_review' END review_state,
    CASE WHEN MIN(l_linestatus) = 'F' THEN 'ana' ELSE '' END ratified_by,
    CASE WHEN MIN(l_linestatus) = 'F' THEN CAST(CAST(MIN(l_shipdate) AS DATE) AS VARCHAR) ELSE '' END ratified_at,
    'h' || MIN(l_returnflag) sql_hash, CAST(CAST(MIN(l_shipdate) AS DATE) AS VARCHAR) computed_at
  FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey),
parsed AS (
  SELECT 'STG_ORDERS' target_table, 'C' || l_orderkey target_column, 'SRC_' || l_suppkey source_table, 'P' || l_partkey source_column,
    'TRANSFORM' transform_type, 'f' || l_orderkey full_expression, MAX(o_orderpriority) = '1-URGENT' ambiguous,
    CASE WHEN MAX(o_orderpriority) = '1-URGENT' THEN 0.5::DOUBLE WHEN MAX(o_totalprice) > 400000 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END confidence,
    'hp' sql_hash
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_discount <= 0.06
  GROUP BY l_orderkey, l_suppkey, l_partkey),
agent AS (
  SELECT DISTINCT 'stg_orders' target_table, 'c' || l_orderkey target_column, 'src_agent' source_table, 'p' || l_partkey source_column,
    'TRANSFORM' transform_type, 'g' || l_orderkey full_expression, FALSE ambiguous, 0.8::DOUBLE confidence, 'ha' sql_hash
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')"""


def with_catalog(select: str) -> str:
    return f"WITH {CATALOG} {select}"
