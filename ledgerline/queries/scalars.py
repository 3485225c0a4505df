"""Projections, filters, predicates and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions import text as X
from ledgerline.operators import search as Q
from ledgerline.operators.asof import pick_rate
from ledgerline.operators.graph_build import derivation_edges
from ledgerline.queries import query
from ledgerline.queries import standins as st


@query("filter_eq", st.with_bank("SELECT rate_date, from_currency, CAST(rate AS DOUBLE) rate FROM src_fx_rate WHERE to_currency = 'USD'"))
def _(t):
    return st.src_fx_rate(t).where(F.col("to_currency") == "USD").select("rate_date", "from_currency", F.col("rate").cast("double").alias("rate"))


@query(
    "case_rate",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1.0 WHEN o_totalprice > 100000 THEN o_totalprice ELSE 2.0 END AS rate FROM orders""",
)
def _(t):
    asof = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    return t.orders.select("o_orderkey", pick_rate(F.col("o_orderstatus"), asof, F.lit(2.0), "O", "double").alias("rate"))


@query(
    "round_decimal",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(ROUND(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax + 1 AS DECIMAL(10,4)), 2) AS DOUBLE) AS usd FROM lineitem""",
)
def _(t):
    usd = S.usd_amount(F.col("l_extendedprice").cast("decimal(15,2)"), (F.col("l_tax") + 1).cast("decimal(10,4)"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", usd.cast("double").alias("usd"))


@query(
    "zero_reversals",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(15,2)) END AS DOUBLE) AS net FROM lineitem""",
)
def _(t):
    net = S.zero_if(S.is_flag(F.col("l_returnflag"), "R"), F.col("l_extendedprice").cast("decimal(15,2)"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", net.cast("double").alias("net"))


@query("bool_from_flag", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'R' AS is_reversal FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.is_flag(F.col("l_returnflag"), "R").alias("is_reversal"))


@query(
    "like_predicates",
    st.with_bank(
        """SELECT txn_id, counterparty_bank_bic IS NOT NULL AND counterparty_bank_bic NOT LIKE 'US%' AS is_international,
        (currency || '_BACKFILL') LIKE '%_BACKFILL' AS has_suffix FROM src_transaction"""
    ),
)
def _(t):
    return st.src_transaction(t).select(
        "txn_id",
        S.is_international(F.col("counterparty_bank_bic")).alias("is_international"),
        S.has_backfill_suffix(F.concat("currency", F.lit("_BACKFILL"))).alias("has_suffix"),
    )


@query("concat_suffix", st.with_bank("SELECT txn_id, counterparty_bank_bic || '_BACKFILL' AS label FROM src_transaction"))
def _(t):
    return st.src_transaction(t).select("txn_id", F.concat("counterparty_bank_bic", F.lit("_BACKFILL")).alias("label"))


@query("concat_name", st.with_bank("SELECT customer_id, first_name || ' ' || last_name AS full_name FROM src_customer"))
def _(t):
    return st.src_customer(t).select("customer_id", S.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"))


@query(
    "age_years",
    """SELECT o_orderkey, CAST(EXTRACT(YEAR FROM AGE(DATE '2023-02-28', CAST(o_orderdate AS DATE))) AS INTEGER) AS age,
    CAST(EXTRACT(YEAR FROM AGE(DATE '2024-02-29', CAST(o_orderdate AS DATE))) AS INTEGER) AS age_leap FROM orders""",
)
def _(t):
    born = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        S.age_years(born, F.lit("2023-02-28").cast("date")).alias("age"),
        S.age_years(born, F.lit("2024-02-29").cast("date")).alias("age_leap"),
    )


@query("or_predicate", st.with_bank("SELECT customer_id, citizenship = 'US' OR country_of_birth = 'US' AS is_us_person FROM src_customer"))
def _(t):
    return st.src_customer(t).select("customer_id", S.is_us_person(F.col("citizenship"), F.col("country_of_birth")).alias("is_us_person"))


@query(
    "days_since",
    st.with_bank(
        """SELECT customer_id, CASE WHEN kyc_reviewed_at IS NULL THEN NULL
        ELSE DATE_DIFF('day', CAST(kyc_reviewed_at AS DATE), DATE '2001-06-30') END AS days FROM src_customer"""
    ),
)
def _(t):
    return st.src_customer(t).select("customer_id", S.days_since(F.col("kyc_reviewed_at"), F.lit(st.AS_OF)).alias("days"))


@query(
    "stale_flag",
    st.with_bank(
        """SELECT customer_id, (kyc_reviewed_at IS NOT NULL AND DATE_DIFF('day', CAST(kyc_reviewed_at AS DATE), DATE '2001-06-30') > 365)
        OR kyc_status = 'EXPIRED' AS stale FROM src_customer"""
    ),
)
def _(t):
    return st.src_customer(t).select(
        "customer_id", S.stale_flag(F.col("kyc_reviewed_at"), F.col("kyc_status"), F.lit(st.AS_OF)).alias("stale")
    )


@query(
    "safe_ratio",
    """SELECT c_custkey, CASE WHEN COUNT(o_orderkey) = 0 THEN 0.0::DOUBLE ELSE COUNT(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / COUNT(o_orderkey) END AS ratio
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def _(t):
    # Orders shrink to one row per customer before the join.
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0)
    return t.customer.join(per, "c_custkey", "left").select(
        "c_custkey", S.safe_ratio(F.coalesce("f", zero), F.coalesce("n", zero)).alias("ratio")
    )


@query(
    "coalesce_zero",
    """SELECT c_custkey, CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(15,2))), 0) AS DOUBLE) AS total
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def _(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).alias("s"))
    return t.customer.join(per, "c_custkey", "left").select(
        "c_custkey", F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("total")
    )


@query(
    "least_date",
    "SELECT o_custkey, LEAST(MAX(CAST(o_orderdate AS DATE)), DATE '2000-06-30') AS ref FROM orders GROUP BY o_custkey",
)
def _(t):
    return t.orders.groupBy("o_custkey").agg(
        F.least(F.max(F.to_date("o_orderdate")), F.lit("2000-06-30").cast("date")).alias("ref")
    )


@query(
    "interval_bound",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) >= DATE '2000-06-30' - INTERVAL 90 DAY AS recent FROM lineitem",
)
def _(t):
    recent = S.within_days(F.to_date("l_shipdate"), F.lit("2000-06-30").cast("date"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", recent.alias("recent"))


@query(
    "weighted_score",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(0.4 AS DOUBLE) * l_discount + CAST(0.3 AS DOUBLE) * CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + CAST(0.2 AS DOUBLE) * l_tax + CAST(0.1 AS DOUBLE) * l_quantity AS score FROM lineitem""",
)
def _(t):
    score = S.risk_score(F.col("l_discount"), F.col("l_returnflag") == "R", F.col("l_tax"), F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"))


@query(
    "tier_case",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 50 > 0.65 THEN 'HIGH' WHEN l_quantity / 50 > 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM lineitem""",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.risk_tier(F.col("l_quantity") / 50).alias("tier"))


@query(
    "constants",
    "SELECT c_custkey, DATE '2001-06-30' AS as_of_date, TRUE AS stamped FROM customer",
)
def _(t):
    return t.customer.select("c_custkey", F.lit(st.AS_OF).alias("as_of_date"), F.current_timestamp().isNotNull().alias("stamped"))


@query(
    "pct_metric",
    """SELECT o_custkey, ROUND(COUNT(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE / COUNT(*) * 100, 4) AS pct FROM orders GROUP BY o_custkey""",
)
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("a"), F.count(F.lit(1)).alias("n"))
    return per.select("o_custkey", S.pct(F.col("a"), F.col("n")).alias("pct"))


@query(
    "infer_layer",
    st.with_graph(
        """SELECT pk, CASE WHEN starts_with(dataset_name, 'src_') THEN 'layer_0' WHEN starts_with(dataset_name, 'stg_') THEN 'layer_1'
        WHEN starts_with(dataset_name, 'fct_') OR starts_with(dataset_name, 'dim_') THEN 'layer_2' ELSE 'unknown' END AS layer,
        CASE WHEN starts_with(column_name, 'src_') THEN 'layer_0' ELSE 'unknown' END AS column_layer FROM cols"""
    ),
)
def _(t):
    return st.graph_columns(t).select(
        "pk", X.infer_layer(F.col("dataset_name")).alias("layer"), X.infer_layer(F.col("column_name")).alias("column_layer")
    )


@query("hash_sql", r"SELECT doc_id, sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS sql_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", X.hash_sql(F.col("text")).alias("sql_hash"))


@query(
    "type_sensitive",
    """SELECT doc_id, contains(s, '||') OR contains(s, 'concat') OR contains(s, 'date_diff') OR contains(s, 'age') OR contains(s, 'extract')
    OR contains(s, 'interval') OR contains(s, 'round') OR contains(s, 'cast') OR contains(s, ' + ') OR contains(s, ' - ')
    OR contains(s, ' * ') OR contains(s, ' / ') AS sensitive FROM (SELECT doc_id, lower(text) s FROM documents)""",
)
def _(t):
    return t.documents.select("doc_id", X.type_sensitive(F.col("text")).alias("sensitive"))


def _page_manifests(t):
    """A page is a manifest: host and last path word as trusted tables, its HTML as derivation."""
    host = F.regexp_extract("url", r"//([A-Za-z_]\w*)\.", 1)
    return t.pages.select(
        F.col("page_id"),
        F.concat(F.lit("page_"), F.col("page_id")).alias("target_table"),
        F.array(host, F.lit("example"), F.lit("www")).alias("source_tables"),
        F.lit("").alias("ts"),
        F.create_map(F.lit("body"), F.concat_ws(" ", "url", "html")).alias("derived_columns"),
    )


@query(
    "extract_column_refs",
    r"""WITH refs AS (
      SELECT page_id, url, unnest(regexp_extract_all(url || ' ' || html, '[A-Za-z_]\w*\.[A-Za-z_]\w*')) m FROM pages)
    SELECT DISTINCT 'page_' || page_id AS target_table, split_part(m, '.', 1) AS source_table, split_part(m, '.', 2) AS source_column
    FROM refs WHERE split_part(m, '.', 1) IN (regexp_extract(url, '//([A-Za-z_]\w*)\.', 1), 'example', 'www')""",
)
def _(t):
    return derivation_edges(_page_manifests(t)).select("target_table", "source_table", "source_column").distinct()


def _expressions(t):
    """Parts as projections: the size picks the shape, the type the alias."""
    return t.part.selectExpr(
        "p_partkey",
        "CASE WHEN p_size <= 5 THEN CAST(p_size AS STRING) WHEN p_size <= 10 THEN concat('p.', lower(p_type)) "
        "WHEN p_size <= 15 THEN concat('p.', p_brand) WHEN p_size <= 20 THEN 'SUM(p.amount)' "
        "WHEN p_size <= 25 THEN 'rank() OVER (ORDER BY x)' WHEN p_size <= 30 THEN 'CASE WHEN a.x > 0 THEN b.y END' "
        "WHEN p_size <= 35 THEN 'COALESCE(a.x, b.y)' WHEN p_size <= 40 THEN 'CURRENT_TIMESTAMP' "
        "ELSE concat('a.x * ', p_size) END AS expression",
        "CASE WHEN p_retailprice > 1000 THEN lower(p_type) ELSE 'other' END AS alias",
        "CASE WHEN p_retailprice > 950 THEN 2 ELSE 1 END AS n_tables",
    )


@query(
    "classify_expression",
    """SELECT p_partkey, CASE WHEN p_size <= 5 OR (p_size > 35 AND p_size <= 40) THEN 'CONSTANT'
      WHEN p_size <= 10 THEN CASE WHEN p_retailprice > 1000 THEN 'PASSTHROUGH' ELSE 'RENAME' END
      WHEN p_size <= 15 THEN 'TRANSFORM'
      WHEN p_size <= 20 THEN 'AGGREGATE' WHEN p_size <= 25 THEN 'WINDOW'
      WHEN p_size <= 35 THEN CASE WHEN p_retailprice > 950 THEN 'AMBIGUOUS' ELSE 'TRANSFORM' END
      ELSE 'TRANSFORM' END AS transform_type FROM part""",
)
def _(t):
    return _expressions(t).select(
        "p_partkey", X.transform_shape(F.col("expression"), F.col("alias"), F.col("n_tables")).alias("transform_type")
    )


@query(
    "tokenize",
    """SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS words FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda x: len(x) > 1) w0,
      list_transform(w0, lambda x: lower(x)) w FROM documents)""",
)
def _(t):
    words = X.tokenize(F.col("text"))
    return t.documents.select("doc_id", F.size(words).cast("bigint").alias("n_words"), F.array_join(words, " ").alias("words"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 140 THEN substr(text, 1, 140) || '…' ELSE text END AS short FROM documents")
def _(t):
    return t.documents.select("doc_id", X.truncate_text(F.col("text"), 140).alias("short"))


@query(
    "source_description_lookup",
    st.with_graph(
        """SELECT pk, COALESCE(NULLIF(semantic_description, ''), s_name, '') AS description
        FROM cols LEFT JOIN supplier ON lower(column_name) = lower('C' || s_suppkey) AND dataset_name = 'src_standard'"""
    ),
)
def _(t):
    curated = t.supplier.selectExpr("'SRC_standard' AS dataset_name", "concat('C', s_suppkey) AS column_name", "s_name AS description")
    return Q.describe_sources(st.graph_columns(t), curated).select("pk", F.col("semantic_description").alias("description"))
