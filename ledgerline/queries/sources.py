"""Readers, writers and table maintenance, over files written from the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.values import FEEDS
from ledgerline.queries import Tables, query
from ledgerline.queries import standins as st
from ledgerline.session import scratch_path
from ledgerline.sources import eventlog as E
from ledgerline.sources import landing as L
from ledgerline.sources import tables as S

DAY = "2001-06-30"


def _feeds(t: Tables):
    """Whole tables as the five landing feeds."""
    return {"branch": t.nation, "customer": t.customer, "account": t.orders, "transaction": t.lineitem, "fx_rate": t.part}


def _landing(t: Tables) -> str:
    root = scratch_path(t.spark, "landing")
    for sor, entity, _ in FEEDS:
        L.export_landing(_feeds(t)[entity], root, sor, entity, override=DAY)
    return root


# One feed more than was delivered.
EXPECTED = [*FEEDS, ("fx_vendor", "holiday", "src_holiday")]

FEED_SQL = """
feeds AS (
  SELECT 'core_banking' sor, 'branch' entity, (SELECT COUNT(*) FROM nation) n UNION ALL SELECT 'core_banking', 'customer', (SELECT COUNT(*) FROM customer)
  UNION ALL SELECT 'core_banking', 'account', (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'core_banking', 'transaction', (SELECT COUNT(*) FROM lineitem)
  UNION ALL SELECT 'fx_vendor', 'fx_rate', (SELECT COUNT(*) FROM part))"""


@query(
    "scan_csv",
    """SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer""",
)
def _(t):
    path = scratch_path(t.spark, "csv")
    blank = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("")
    t.customer.select("c_custkey", "c_name", "c_acctbal", blank.alias("segment")).write.option("header", True).csv(path)
    schema = T.StructType(
        [
            T.StructField("c_custkey", T.LongType()),
            T.StructField("c_name", T.StringType()),
            T.StructField("c_acctbal", T.DoubleType()),
            T.StructField("segment", T.StringType()),
        ]
    )
    return S.scan_csv(t.spark, path, schema)


@query("scan_parquet_partition", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    root = scratch_path(t.spark, "landing")
    L.export_landing(t.orders, root, "core_banking", "account", override=DAY)
    directory = L.resolve_partition(t.spark, root, "core_banking", "account", DAY)
    return L.scan_parquet_partition(t.spark, directory).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "resolve_partition",
    """SELECT 'latest' AS asked, o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y') = (SELECT MAX(strftime(o_orderdate, '%Y')) FROM orders)
    UNION ALL SELECT '1997', o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y') = '1997'""",
)
def _(t):
    root = scratch_path(t.spark, "landing")
    t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("business_date")).write.partitionBy("business_date").parquet(
        f"{root}/core_banking/account"
    )
    found = {asked: L.resolve_partition(t.spark, root, "core_banking", "account", asked) for asked in ("", "1997", "1800")}
    if found["1800"] is not None:
        raise AssertionError("a missing partition must resolve to none")
    latest, named = (t.spark.read.parquet(found[k]) for k in ("", "1997"))
    return latest.select(F.lit("latest").alias("asked"), "o_orderkey").unionByName(named.select(F.lit("1997").alias("asked"), "o_orderkey"))


@query(
    "validate_manifest",
    f"""WITH {FEED_SQL} SELECT sor, entity, '' || n AS row_count, '' AS reason, TRUE AS passed FROM feeds
    UNION ALL SELECT 'fx_vendor', 'holiday', NULL, 'landing partition not found', FALSE""",
)
def _(t):
    return L.validate_manifest(t.spark, _landing(t), EXPECTED, DAY).drop("directory", "src_table")


@query("checksum_files", f"WITH {FEED_SQL} SELECT sor, entity, TRUE AS passed, 64 AS digest_length FROM feeds")
def _(t):
    sums = L.checksum_files(t.spark, _landing(t), FEEDS, DAY)
    return sums.select("sor", "entity", "passed", F.length("actual").alias("digest_length"))


@query("reconcile_row_counts", f"WITH {FEED_SQL} SELECT sor, entity, n AS expected, n AS actual, TRUE AS passed FROM feeds")
def _(t):
    return L.reconcile_row_counts(t.spark, L.validate_manifest(t.spark, _landing(t), FEEDS, DAY))


@query(
    "gate_all_or_nothing",
    f"WITH {FEED_SQL} SELECT COUNT(*) + 1 AS feeds, 1::BIGINT AS failures, FALSE AS promote FROM feeds",
)
def _(t):
    return L.gate_all_or_nothing(L.validate_manifest(t.spark, _landing(t), EXPECTED, DAY))


@query("promote_full_refresh", "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS tax_id, c_acctbal FROM customer")
def _(t):
    target = T.StructType(
        [
            T.StructField("c_custkey", T.LongType()),
            T.StructField("c_name", T.StringType()),
            T.StructField("tax_id", T.StringType()),
            T.StructField("c_acctbal", T.DoubleType()),
        ]
    )
    path = scratch_path(t.spark, "src_customer")
    S.replace_table(L.promote_full_refresh(t.customer, target), path)
    return S.read_table(t.spark, path)


@query(
    "export_landing",
    """SELECT 'core_banking' AS sor, 'transaction' AS entity, CAST(MAX(CAST(l_shipdate AS DATE)) AS VARCHAR) AS business_date, COUNT(*) AS row_count, '1.0' AS schema_version FROM lineitem""",
)
def _(t):
    return L.export_landing(t.lineitem, scratch_path(t.spark, "landing"), "core_banking", "transaction", "l_shipdate").drop("sha256", "produced_at")


@query("replace_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    path = scratch_path(t.spark, "table")
    S.replace_table(t.customer.select("c_custkey"), path)
    S.replace_table(t.orders.select("o_orderkey", "o_orderstatus"), path)
    return S.read_table(t.spark, path)


@query("overwrite_partition", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version, o_orderstatus FROM orders")
def _(t):
    path = scratch_path(t.spark, "table")
    rows = t.orders.select("o_orderkey", F.lit(1).alias("version"), "o_orderstatus")
    S.overwrite_partition(rows, path, "o_orderstatus")
    S.overwrite_partition(rows.where("o_orderstatus = 'F'").withColumn("version", F.lit(2)), path, "o_orderstatus")
    return S.read_table(t.spark, path)


@query("ensure_table_shape", "SELECT 'legacy' AS tab, 'replaced' AS status, 0::BIGINT AS n UNION ALL SELECT 'current', 'kept', COUNT(*) FROM orders")
def _(t):
    spark = t.spark
    legacy, current = scratch_path(spark, "legacy"), scratch_path(spark, "current")
    S.replace_table(t.customer, legacy)
    S.replace_table(t.orders.withColumn("as_of_date", F.to_date("o_orderdate")), current)
    shape = t.orders.withColumn("as_of_date", F.to_date("o_orderdate")).schema
    parts = [
        S.read_table(spark, path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), F.lit(status).alias("status"), "n")
        for name, path, status in [
            ("legacy", legacy, S.ensure_table_shape(spark, legacy, shape, "as_of_date")),
            ("current", current, S.ensure_table_shape(spark, current, shape, "as_of_date")),
        ]
    ]
    return parts[0].unionByName(parts[1])


LOG_COLUMNS = ["run_id", "event", "stage", "ts", "duration_ms", "passed", "rows_failed"]


@query(
    "read_event_log",
    st.with_log("SELECT run_id, event, stage, ts, duration_ms, passed, rows_failed FROM log WHERE event NOT IN ('pipeline_start', 'pipeline_complete', 'orchestrator_stage_failed')"),
)
def _(t):
    """Starts become blank lines, completions broken JSON, failures JSON arrays."""
    path = scratch_path(t.spark, "log")
    events = st.log_events(t)
    good = F.to_json(F.struct(*[F.col(c) for c in E.FIELDS]))
    line = (
        F.when(F.col("event") == "pipeline_start", "   ")
        .when(F.col("event") == "pipeline_complete", F.expr("concat('{\"event\": \"', event, '\", \"ts\": ')"))
        .when(F.col("event") == "orchestrator_stage_failed", F.concat(F.lit("["), good, F.lit("]")))
        .otherwise(good)
    )
    events.select(line.alias("value")).write.text(path)
    return E.read_event_log(t.spark, path).select(*LOG_COLUMNS)


@query("append_events", st.with_log("SELECT run_id, event, stage, ts, duration_ms, passed, rows_failed FROM log"))
def _(t):
    return st.written_log(t).select(*LOG_COLUMNS)


@query("read_runs", st.with_log("SELECT run_id, event, stage, ts, duration_ms, passed, rows_failed FROM log WHERE run_id IN ('run_1', 'run_17', 'run_x')"))
def _(t):
    """Three runs of a log that was appended to twice and then packed."""
    path, packed = scratch_path(t.spark, "log"), scratch_path(t.spark, "log")
    events = st.log_events(t).select(*E.FIELDS)
    early = F.col("ts") < "2024-01-15"
    E.append_events(events.where(early), path)
    E.append_events(events.where(~early), path)
    E.compact_log(t.spark, path, packed)
    return E.read_event_log(t.spark, packed, ["run_1", "run_17", "run_x"]).select(*LOG_COLUMNS)


@query("latest_log", "SELECT 'run=b' AS log, COUNT(*) AS events FROM events WHERE event_type <> 'click'")
def _(t):
    path = scratch_path(t.spark, "log")
    events = st.log_events(t).select(*E.FIELDS)
    click = F.col("event") == "stage_complete"
    E.append_events(events.where(click).withColumn("run_id", F.lit("a")), path)
    E.append_events(events.where(~click).withColumn("run_id", F.lit("b")), path)
    name = F.concat(F.lit("run="), F.regexp_extract("log_file", r"/run_from=r-([^/]+)/", 1)).alias("log")
    newest = E.latest_log(t.spark, path).select(name)
    lines = E.read_event_log(t.spark, path).groupBy(name).agg(F.count(F.lit(1)).alias("events"))
    return lines.join(newest, "log")


@query(
    "table_presence",
    """SELECT 'orders' AS table_name, TRUE AS present, (SELECT COUNT(*) FROM orders) AS row_count UNION ALL SELECT 'lineitem', TRUE, (SELECT COUNT(*) FROM lineitem)
    UNION ALL SELECT 'src_holiday', FALSE, 0""",
)
def _(t):
    return S.table_presence(t.spark, {"orders": t.orders, "lineitem": t.lineitem, "src_holiday": S.catalog_table(t.spark, "src_holiday")})


@query(
    "schema_listing",
    """SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
      WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS data_type, ordinal_position AS "position"
    FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem', 'customer', 'documents')""",
)
def _(t):
    return S.schema_listing(t.spark, {n: getattr(t, n) for n in ("orders", "lineitem", "customer", "documents")})


@query(
    "coerce_metrics",
    st.with_log("SELECT stage, run_id, ts, output_row_count, duration_ms FROM log WHERE event = 'stage_complete' AND output_row_count IS NOT NULL"),
)
def _(t):
    return E.coerce_metrics(st.log_events(t))


def _start_events(t):
    """Starts as manifests: small values lack a key, large ones have a text for a list."""
    return st.log_events(t).where("event = 'pipeline_start'").withColumns(
        {
            "event": F.lit("transform_start"),
            "target_table": F.when(F.col("catalog_misses") >= 5, F.concat(F.lit("t_"), "stage")),
            "source_tables": F.when(F.col("catalog_misses") > 100, F.lit("src_a")).otherwise(F.expr("concat('[\"src_', stage, '\", \"src_b\"]')")),
            "depends_on_stages": F.lit("[]"),
            "transform_type": F.lit("FILTER"),
            "derived_columns": F.expr("concat('{\"c\": \"src_b.x\", \"d\": ', catalog_misses, '}')"),
        }
    )


@query(
    "coerce_manifest",
    st.with_log(
        """SELECT stage, run_id, ts, 't_' || stage AS target_table, 'src_' || stage || ',src_b' AS sources, 'c=src_b.x,d=' || catalog_misses AS derived
        FROM log WHERE event = 'pipeline_start' AND catalog_misses BETWEEN 5 AND 100"""
    ),
)
def _(t):
    derived = F.array_join(F.transform(F.array_sort(F.map_entries("derived_columns")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return E.coerce_manifest(_start_events(t)).select(
        "stage", "run_id", "ts", "target_table", F.array_join("source_tables", ",").alias("sources"), derived.alias("derived")
    )


@query(
    "manifest_without_metrics",
    st.with_log(
        """SELECT stage, run_id, ts FROM log s WHERE event = 'pipeline_start' AND catalog_misses BETWEEN 5 AND 100
        AND NOT EXISTS (SELECT 1 FROM log m WHERE m.event = 'stage_complete' AND m.run_id = s.run_id AND m.stage = s.stage)"""
    ),
)
def _(t):
    manifests = E.coerce_manifest(_start_events(t))
    return E.manifests_without_metrics(manifests, E.coerce_metrics(st.log_events(t))).select("stage", "run_id", "ts")
