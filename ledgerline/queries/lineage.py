"""Lineage graph, catalog, impact and search over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerline.functions.values import PENDING
from ledgerline.operators import catalog as C
from ledgerline.operators import graph as G
from ledgerline.operators import graph_build as B
from ledgerline.operators import search as Q
from ledgerline.operators.fingerprint import table_fingerprint
from ledgerline.operators.impact import impact_report
from ledgerline.queries import query
from ledgerline.queries import standins as st

# --------------------------------------------------------------------------
# Graph joins
# --------------------------------------------------------------------------


@query(
    "edge_one_hop",
    st.with_graph(
        """SELECT r.src_id AS upstream_table, w.dst_id AS downstream_table, p.stage AS via_process, p.transform_type
        FROM struct_edges r JOIN struct_edges w ON r.dst_id = w.src_id AND w.label = 'PRODUCES' JOIN procs p ON p.pk = r.dst_id
        WHERE r.label = 'INPUT_TO'"""
    ),
)
def _(t):
    return G.edge_one_hop(st.structural_edges(t), st.processes(t))


@query(
    "optional_match_count",
    st.with_graph("SELECT c.pk, COUNT(d.dst_id) AS source_count FROM cols c LEFT JOIN derives d ON d.src_id = c.pk GROUP BY c.pk"),
)
def _(t):
    return G.source_counts(st.graph_columns(t), st.derives_edges(t)).select("pk", "source_count")


@query(
    "readers_of_table",
    st.with_graph(
        """SELECT e.src_id AS dataset_name, p.stage, p.run_id, p.transform_type, p.target_table
        FROM struct_edges e JOIN procs p ON p.pk = e.dst_id WHERE e.label = 'INPUT_TO'"""
    ),
)
def _(t):
    return G.readers_of_table(st.structural_edges(t), st.processes(t)).drop("sql_text")


@query(
    "semi_whitelist",
    st.with_catalog("SELECT target_column, source_table, source_column FROM lin WHERE source_table IN (SELECT 'src_' || s_suppkey FROM supplier WHERE s_acctbal > 5000)"),
)
def _(t):
    base = t.supplier.where("s_acctbal > 5000").selectExpr("concat('src_', s_suppkey) AS name")
    return G.semi_whitelist(st.catalog_lineage(t), base).select("target_column", "source_table", "source_column")


@query(
    "missing_dependency",
    """SELECT 'r' || a.s_suppkey AS src_id, 'r' || (a.s_suppkey * 2) AS dst_id, b.s_suppkey IS NULL AS missing
    FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey * 2""",
)
def _(t):
    depends = t.supplier.selectExpr("'DEPENDS_ON' AS label", "concat('r', s_suppkey) AS src_id", "concat('r', s_suppkey * 2) AS dst_id")
    linked, missing = B.missing_dependency(depends, t.supplier.selectExpr("concat('r', s_suppkey) AS pk"))
    return linked.withColumn("missing", F.lit(False)).unionByName(missing.withColumn("missing", F.lit(True))).drop("label")


# --------------------------------------------------------------------------
# Walks
# --------------------------------------------------------------------------

# Walks start at the columns of one table, as a user asks from one card: upstream from the regulatory table, downstream from a source.
TOP, BOTTOM = "fct_customer_risk_profile", "src_economy"


def _columns_of(t, table):
    return st.graph_columns(t).where(F.col("dataset_name") == table).select(F.col("pk").alias("start"))


UP = f"""
hops AS (
  SELECT src_id AS "start", dst_id node, 1 AS h FROM derives WHERE starts_with(src_id, '{TOP}::')
  UNION SELECT w."start", d.dst_id, w.h + 1 FROM hops w JOIN derives d ON d.src_id = w.node WHERE w.h < 10)"""


@query(
    "column_ancestors",
    st.recursive_graph(
        f"""walks AS (
          SELECT src_id AS "start", dst_id node, 1 AS h FROM derives WHERE starts_with(src_id, '{TOP}::')
          UNION ALL SELECT w."start", d.dst_id, w.h + 1 FROM walks w JOIN derives d ON d.src_id = w.node WHERE w.h < 10)""",
        'SELECT "start", node AS ancestor, h AS hops, COUNT(*) AS paths FROM walks GROUP BY ALL',
    ),
)
def _(t):
    return G.column_ancestors(st.derives_edges(t), _columns_of(t, TOP), 10)


@query("column_chain", st.recursive_graph(UP, 'SELECT "start", node AS ancestor, h AS hops FROM hops'))
def _(t):
    return G.column_chain(st.derives_edges(t), _columns_of(t, TOP), 10)


@query("upstream_one_hop", st.with_graph('SELECT DISTINCT src_id AS "start", dst_id AS ancestor FROM derives'))
def _(t):
    return G.upstream_one_hop(st.derives_edges(t))


@query(
    "upstream_3hop",
    st.recursive_graph(UP.replace("w.h < 10", "w.h < 3"), 'SELECT "start", node AS ancestor, MIN(h) AS hops FROM hops GROUP BY ALL'),
)
def _(t):
    return G.upstream_3hop(st.derives_edges(t), _columns_of(t, TOP))


@query("downstream_direct", st.with_graph('SELECT DISTINCT dst_id AS "start", src_id AS descendant FROM derives'))
def _(t):
    return G.downstream_direct(st.derives_edges(t))


# Without a bound on hops a pair is kept at every length it is reached by; the longest chain of halves has fewer than 64.
DOWN = f"""
hops AS (
  SELECT dst_id AS "start", src_id node, 1 AS h FROM derives WHERE starts_with(dst_id, '{BOTTOM}::')
  UNION SELECT w."start", d.src_id, w.h + 1 FROM hops w JOIN derives d ON d.dst_id = w.node WHERE w.h < 10),
chain AS (SELECT "start", node AS descendant, MIN(h) AS hops FROM hops GROUP BY ALL)"""


@query("downstream_chain", st.recursive_graph(DOWN, 'SELECT "start", descendant, hops FROM chain'))
def _(t):
    return G.downstream_chain(st.derives_edges(t), _columns_of(t, BOTTOM), 10)


BLOCKED = DOWN + f""", {st.CERTS.strip()},
p1 AS (SELECT table_name FROM certs WHERE profile = 'P1'),
marked AS (
  SELECT chain.*, review_state = 'pending_review' AND CASE WHEN (SELECT COUNT(*) FROM p1) > 0
    THEN dataset_name IN (SELECT table_name FROM p1) ELSE starts_with(dataset_name, 'fct_') END blocked
  FROM chain JOIN cols ON pk = descendant)"""


def _gated(t):
    chain = G.downstream_chain(st.derives_edges(t), _columns_of(t, BOTTOM), 10)
    return G.gate_unratified(chain, st.graph_columns(t), st.certifications(t))


@query("gate_unratified", st.recursive_graph(BLOCKED, 'SELECT "start", descendant, hops FROM marked WHERE NOT blocked'))
def _(t):
    return _gated(t)[0]


@query("gate_unratified_count", st.recursive_graph(BLOCKED, "SELECT COUNT(*) FILTER (WHERE blocked) AS filtered FROM marked"))
def _(t):
    return _gated(t)[1]


@query(
    "trace_path",
    st.recursive_graph(
        f"""flow AS (SELECT src_id, dst_id FROM derives UNION SELECT src_id, dst_id FROM struct_edges WHERE label <> 'DEPENDS_ON'),
        roots AS (SELECT pk AS root FROM cols WHERE dataset_name = '{TOP}' UNION ALL SELECT '{TOP}'),
        down AS (SELECT root, dst_id AS node FROM roots JOIN flow ON src_id = root UNION SELECT w.root, f.dst_id FROM down w JOIN flow f ON f.src_id = w.node),
        up AS (SELECT root, src_id AS node FROM roots JOIN flow ON dst_id = root UNION SELECT w.root, f.src_id FROM up w JOIN flow f ON f.dst_id = w.node)""",
        "SELECT root, node, 'down' AS direction FROM down UNION ALL SELECT root, node, 'up' FROM up UNION ALL SELECT root, root, 'root' FROM roots",
    ),
)
def _(t):
    roots = _columns_of(t, TOP).union(t.spark.range(1).select(F.lit(TOP)))
    return G.trace_path(st.derives_edges(t).unionByName(st.structural_edges(t)), roots)


CHANGES = """
pick AS (SELECT dataset_name, arg_min(column_name, p_partkey) column_name FROM cols GROUP BY 1),
changes AS (SELECT dataset_name || '::' || column_name AS "start", dataset_name ct, column_name cc, k FROM pick, (SELECT unnest(['RENAME', 'TYPE_CHANGE', 'DROP']) k))"""


@query(
    "impact_report",
    st.recursive_graph(
        f"""{CHANGES.strip()},
        hops AS (
          SELECT dst_id AS "start", src_id node, 1 AS h FROM derives WHERE dst_id IN (SELECT "start" FROM changes)
          UNION SELECT w."start", d.src_id, w.h + 1 FROM hops w JOIN derives d ON d.dst_id = w.node WHERE w.h < 64),
        chain AS (SELECT "start", node AS descendant, MIN(h) AS hops FROM hops GROUP BY ALL),
        hit AS (
          SELECT ct, cc, k, c.* FROM changes JOIN chain USING ("start") JOIN cols c ON c.pk = descendant
          WHERE (k <> 'RENAME' OR hops = 1) AND (k <> 'TYPE_CHANGE' OR transform_type NOT IN ('PASSTHROUGH', 'RENAME')))""",
        """SELECT *, COUNT(*) OVER (PARTITION BY changed_table, changed_column, change_type) AS total_affected FROM (
        SELECT ct AS changed_table, cc AS changed_column, k AS change_type, dataset_name AS affected_table, column_name AS affected_column,
          NULL AS stage, NULL AS run_id, CASE WHEN dataset_name = 'fct_customer_risk_profile' THEN 'CRITICAL'
          WHEN starts_with(dataset_name, 'stg_') THEN 'HIGH' ELSE 'LOW' END AS severity, expression,
          CASE WHEN k = 'DROP' THEN 'source column dropped' WHEN k = 'RENAME' THEN 'reads the old name' WHEN transform_type = 'AMBIGUOUS' THEN 'ambiguous sources'
            WHEN contains(expression, 'round') OR contains(expression, '||') THEN 'type-sensitive expression' ELSE 'type-sensitivity unverified' END AS reason FROM hit
        UNION ALL
        SELECT ct, cc, k, p.target_table, NULL, p.stage, p.run_id,
          CASE WHEN p.target_table = 'fct_customer_risk_profile' OR starts_with(p.target_table, 'stg_') THEN 'HIGH' ELSE 'LOW' END, NULL, 'process reads the column'
        FROM changes JOIN struct_edges e ON e.label = 'INPUT_TO' AND e.src_id = ct JOIN procs p ON p.pk = e.dst_id
        WHERE k <> 'TYPE_CHANGE' AND regexp_matches(p.sql_text, '\\b' || cc || '\\b', 'i'))""",
    ),
)
def _(t):
    columns = st.graph_columns(t)
    changes = columns.groupBy(F.col("dataset_name").alias("table")).agg(F.min_by("column_name", "p_partkey").alias("column")).withColumn(
        "change_type", F.explode(F.array(F.lit("RENAME"), F.lit("TYPE_CHANGE"), F.lit("DROP")))
    )
    return impact_report(columns, st.derives_edges(t).unionByName(st.structural_edges(t)), st.processes(t), changes)


REFS = """
named AS (SELECT DISTINCT 'n' || p_partkey node, 'n' || unnest([p_partkey // 2, p_partkey // 3]) ref FROM part WHERE p_partkey > 0 AND p_type <> 'PROMO'),
stars AS (SELECT 'n' || p_partkey node, 'n' || (p_partkey // 2) ref FROM part WHERE p_partkey > 0 AND p_type = 'PROMO'),
refs AS (SELECT * FROM named UNION ALL SELECT * FROM stars),
base AS (SELECT 'n' || p_partkey node FROM part WHERE p_size > 25),
w AS (SELECT node target, ref node FROM named UNION SELECT w.target, r.ref FROM w JOIN refs r ON r.node = w.node WHERE w.node NOT IN (SELECT node FROM base)),
leaves AS (SELECT DISTINCT target, node FROM w WHERE node IN (SELECT node FROM base) OR node NOT IN (SELECT node FROM refs))"""


def _refs(t):
    inner = t.part.where("p_partkey > 0")
    named = inner.where("p_type <> 'PROMO'").selectExpr(
        "concat('n', p_partkey) AS node", "'v' AS column",
        "explode(array_distinct(array(concat('n', p_partkey div 2), concat('n', p_partkey div 3)))) AS ref_node", "'v' AS ref_column",
    )
    stars = inner.where("p_type = 'PROMO'").selectExpr(
        "concat('n', p_partkey) AS node", "'*' AS column", "concat('n', p_partkey div 2) AS ref_node", "'*' AS ref_column"
    )
    base = t.part.where("p_size > 25").selectExpr("concat('n', p_partkey) AS name")
    return named.unionByName(stars), base


SCOPED = """
inside AS (SELECT p_partkey k, p_type ty FROM part WHERE p_partkey > 0),
edges AS (
  SELECT k, 'n' || unnest([k // 2, k // 3]) ref, 'v' col FROM inside WHERE ty IN ('ECONOMY', 'STANDARD') UNION SELECT k, 'n' || (k // 3), 'v' FROM inside WHERE ty IN ('PROMO', 'SMALL')
  UNION SELECT k, 'n' || (k // 2), 'v' FROM inside WHERE ty = 'MEDIUM' AND k % 10 <> 0 UNION SELECT k, 'q', 'w' FROM inside WHERE ty = 'LARGE'),
ends AS (SELECT 'n' || p_partkey node FROM part WHERE p_size > 25),
w AS (SELECT 'n' || k target, ref node, col FROM edges JOIN inside USING (k) WHERE ty NOT IN ('PROMO', 'ECONOMY')
  UNION SELECT w.target, e.ref, e.col FROM w JOIN edges e ON 'n' || e.k = w.node AND w.col = 'v' WHERE w.node NOT IN (SELECT node FROM ends))
SELECT target AS target_node, 'v' AS target_column, node AS source_table, col AS source_column FROM w
WHERE node IN (SELECT node FROM ends) OR node NOT IN (SELECT 'n' || k FROM inside)"""


@query("resolve_scoped", f"WITH RECURSIVE {SCOPED}")
def _(t):
    """Each part's node has two tables in scope; its type decides how it names them: stars of which the first counts, bare names, aliases in capitals, an unknown alias, constants."""
    inner = t.part.where("p_partkey > 0").selectExpr("p_partkey AS k", "p_type AS ty", "concat('n', p_partkey) AS node")
    scope = inner.selectExpr(
        "node", "inline(array(struct(1 AS ordinal, 'a' AS alias, concat('n', k div 2) AS table), struct(2 AS ordinal, 'B' AS alias, concat('N', k div 3) AS table)))"
    )
    star, name = "'*' AS column", "'v' AS column"
    kinds = [
        ("PROMO", [(star, "'b'", "'*'"), (star, "'a'", "'*'")]),
        ("ECONOMY", [(star, "NULL", "'*'"), (star, "'a'", "'*'")]),
        ("STANDARD", [(name, "NULL", "'v'")]),
        ("MEDIUM", [(name, "'A'", "IF(k % 10 = 0, NULL, 'v')"), (name, "'b'", "'v'")]),
        ("SMALL", [(name, "concat('N', k div 3)", "'v'")]),
        ("LARGE", [(name, "'q'", "'w'")]),
    ]
    rows = [
        inner.where(F.col("ty") == kind).selectExpr("node", f"{i} AS position", column, f"CAST({qualifier} AS STRING) AS qualifier", f"CAST({ref} AS STRING) AS ref_column")
        for kind, listed in kinds
        for i, (column, qualifier, ref) in enumerate(listed)
    ]
    base = t.part.where("p_size > 25").selectExpr("concat('n', p_partkey) AS name")
    return G.resolve_to_base(G.scoped_references(reduce(lambda a, b: a.unionByName(b), rows), scope), base)


@query("resolve_to_base", f"WITH RECURSIVE {REFS} SELECT target AS target_node, 'v' AS target_column, node AS source_table, 'v' AS source_column FROM leaves")
def _(t):
    return G.resolve_to_base(*_refs(t))


@query(
    "flag_ambiguous",
    f"""WITH RECURSIVE {REFS}, n AS (SELECT target, COUNT(*) n FROM leaves WHERE node IN (SELECT node FROM base) GROUP BY 1)
    SELECT target_column, COALESCE(n, 0) AS n_tables, a AS ambiguous, CASE WHEN a THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM (
      SELECT 'n' || p_partkey target_column, n, (p_size > 30 AND COALESCE(n, 0) >= 2) OR (p_partkey > 0 AND p_type <> 'PROMO' AND COALESCE(n, 0) = 0) a
      FROM part LEFT JOIN n ON target = 'n' || p_partkey)""",
)
def _(t):
    refs, base = _refs(t)
    resolved = G.resolve_to_base(refs, base).select(F.col("target_node").alias("target_column"), "source_table")
    expressions = t.part.selectExpr(
        "concat('n', p_partkey) AS target_column",
        "CASE WHEN p_size > 40 THEN 'COALESCE(a, b)' WHEN p_size > 30 THEN 'CASE WHEN a THEN b END' ELSE p_name END AS expression",
        "CASE WHEN p_partkey > 0 AND p_type <> 'PROMO' THEN 1 ELSE 0 END AS n_refs",
    )
    return G.flag_ambiguous(resolved, expressions, base)


# --------------------------------------------------------------------------
# Graph listings
# --------------------------------------------------------------------------


@query(
    "lineage_graph_nodes",
    st.with_graph(
        f"""SELECT 'ds::' || name AS id, name AS label, 'DataSet' AS kind, layer, row_count AS n FROM (WITH {st.DATASETS.strip()} SELECT * FROM datasets)
        UNION ALL SELECT 'proc::' || pk, stage, 'Process', NULL, duration_ms FROM procs"""
    ),
)
def _(t):
    return G.graph_view(st.datasets(t), st.processes(t), st.structural_edges(t))[0]


@query(
    "lineage_graph_view",
    st.with_graph(
        """SELECT CASE WHEN label = 'INPUT_TO' THEN 'ds::' ELSE 'proc::' END || src_id AS from_id,
        CASE WHEN label = 'PRODUCES' THEN 'ds::' ELSE 'proc::' END || dst_id AS to_id, label FROM struct_edges"""
    ),
)
def _(t):
    edges = st.structural_edges(t).unionByName(st.derives_edges(t))
    return G.graph_view(st.datasets(t), st.processes(t), edges)[1]


@query("dataset_list", st.with_graph(f"SELECT * FROM (WITH {st.DATASETS.strip()} SELECT name, layer, row_count, computed_at FROM datasets) ORDER BY layer, name"))
def _(t):
    return G.dataset_list(st.datasets(t))


@query(
    "process_chain",
    st.with_graph("SELECT run_id, stage, transform_type, target_table, duration_ms, output_row_count FROM procs ORDER BY run_id, stage"),
)
def _(t):
    return G.process_chain(st.processes(t))


@query(
    "dedupe_process_by_stage",
    st.with_graph("SELECT stage, pk, run_id, target_table FROM procs QUALIFY ROW_NUMBER() OVER (PARTITION BY stage ORDER BY s_suppkey DESC) = 1"),
)
def _(t):
    return G.dedupe_process_by_stage(st.processes(t), "s_suppkey").select("stage", "pk", "run_id", "target_table")


@query(
    "process_detail",
    st.with_graph(
        """SELECT 'process' AS part, stage AS name, transform_type, output_row_count AS n FROM procs WHERE run_id = 'r0'
        UNION ALL SELECT 'input', src_id, NULL, NULL FROM struct_edges WHERE label = 'INPUT_TO' AND dst_id IN (SELECT pk FROM procs WHERE run_id = 'r0')
        UNION ALL SELECT 'output', target_table, NULL, NULL FROM procs WHERE run_id = 'r0'
        UNION ALL SELECT 'column', column_name, transform_type, (SELECT COUNT(*) FROM derives d WHERE d.src_id = c.pk) FROM cols c
          WHERE dataset_name = (SELECT target_table FROM procs WHERE run_id = 'r0')"""
    ),
)
def _(t):
    processes = st.processes(t)
    stage = processes.where("run_id = 'r0'").first()["stage"]
    return G.process_detail(
        processes, st.structural_edges(t).unionByName(st.derives_edges(t)), st.graph_columns(t), stage, "r0"
    )


@query("columns_of_dataset", st.with_graph("SELECT pk, column_name, transform_type, confidence FROM cols WHERE dataset_name = 'stg_medium' ORDER BY column_name"))
def _(t):
    return G.columns_of_dataset(st.graph_columns(t), "stg_medium").select("pk", "column_name", "transform_type", "confidence")


@query(
    "column_detail",
    st.with_graph("SELECT pk, transform_type, confidence, data_type, expression, semantic_description, source, review_state FROM cols WHERE column_name = 'c7'"),
)
def _(t):
    columns = st.graph_columns(t)
    tables = [r["dataset_name"] for r in columns.select("dataset_name").where("column_name = 'c7'").take(1)]
    return G.column_detail(columns, tables[0], "c7").select(
        "pk", "transform_type", "confidence", "data_type", "expression", "semantic_description", "source", "review_state"
    )


# --------------------------------------------------------------------------
# Catalog
# --------------------------------------------------------------------------

MERGE = f"""WITH {st.CATALOG.replace(' AS (', ' AS MATERIALIZED (')},
cat AS MATERIALIZED (SELECT lower(target_table) t, lower(target_column) c, lower(source_table) s, lower(source_column) sc, * FROM lin WHERE review_state = 'ratified'),
pp AS MATERIALIZED (SELECT lower(target_table) t, lower(target_column) c, lower(source_table) s, lower(source_column) sc, * FROM parsed),
cset AS MATERIALIZED (SELECT t, c, list_sort(list(s || '.' || sc)) l, arg_min(sql_hash, (s, sc)) h FROM cat GROUP BY 1, 2),
pset AS MATERIALIZED (SELECT t, c, list_sort(list(s || '.' || sc)) l, bool_or(ambiguous) amb, MAX(confidence) conf, MAX(sql_hash) h FROM pp GROUP BY 1, 2),
aset AS (SELECT DISTINCT target_table t, target_column c FROM agent),
decided AS MATERIALIZED (
  SELECT t, c, CASE WHEN cset.l IS NOT NULL THEN CASE WHEN NOT COALESCE(amb, TRUE) AND cset.l <> pset.l THEN 'diverged' ELSE 'catalog' END
      WHEN NOT amb AND conf >= 0.999 THEN 'parsed' WHEN a IS NOT NULL THEN 'agent' ELSE 'pending' END k,
    cset.h ch, pset.h ph
  FROM cset FULL OUTER JOIN pset USING (t, c) LEFT JOIN (SELECT *, 1 a FROM aset) USING (t, c)),
merged AS (
  SELECT target_table, target_column, source_table, source_column, expression, transform_type, 1.0::DOUBLE confidence, 'catalog' AS source,
    'ratified' review_state, COALESCE(ph, ch) sql_hash FROM cat JOIN decided USING (t, c) WHERE k = 'catalog'
  UNION ALL
  SELECT target_table, target_column, source_table, source_column, full_expression, transform_type, confidence, 'sqlglot',
    CASE WHEN k = 'pending' THEN 'pending_review' ELSE 'ratified' END, sql_hash FROM pp JOIN decided USING (t, c) WHERE k IN ('diverged', 'parsed', 'pending')
  UNION ALL
  SELECT target_table, target_column, source_table, source_column, full_expression, transform_type, confidence, 'agent_inferred', 'pending_review', sql_hash
  FROM agent JOIN decided ON t = target_table AND c = target_column WHERE k = 'agent')"""


def _merged(t):
    return C.merge_lineage(st.catalog_lineage(t), st.parsed_maps(t), st.agent_maps(t), "now")


@query("merge_lineage", f"{MERGE} SELECT * FROM merged")
def _(t):
    return _merged(t)


@query("full_outer_merge", f"{MERGE} SELECT source, review_state, COUNT(*) AS edges, COUNT(DISTINCT lower(target_column)) AS targets FROM merged GROUP BY 1, 2")
def _(t):
    per_target = _merged(t).groupBy("source", "review_state", F.lower("target_column").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return per_target.groupBy("source", "review_state").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("targets"))


@query(
    "divergences",
    f"""{MERGE} SELECT t AS target_table, c AS target_column, s AS source_table, sc AS source_column, bool_or(o = 1) AS in_catalog, bool_or(o = 2) AS in_parsed,
      MIN(ch) AS catalog_sql_hash, 'now' AS current_sql_hash
    FROM (SELECT t, c, s, sc, 1 o FROM cat UNION ALL SELECT t, c, s, sc, 2 FROM pp) JOIN decided USING (t, c) WHERE k = 'diverged' GROUP BY 1, 2, 3, 4""",
)
def _(t):
    return C.divergences(st.catalog_lineage(t), st.parsed_maps(t), "now")


@query(
    "downgrade_diverged",
    f"""{MERGE}, off AS (SELECT t, c FROM decided WHERE k = 'diverged')
    SELECT target_column, source_table, source_column, CASE WHEN hit THEN 'pending_review' ELSE review_state END AS review_state,
      CASE WHEN hit THEN '' ELSE ratified_by END AS ratified_by
    FROM (SELECT *, (target_table, target_column) IN (SELECT (t, c) FROM off) hit FROM lin)""",
)
def _(t):
    lineage = st.catalog_lineage(t)
    actions = C.downgrade_diverged(C.divergences(lineage, st.parsed_maps(t), "now"), "now")
    return C.set_review_state(lineage, actions)[0].select("target_column", "source_table", "source_column", "review_state", "ratified_by")


def _emitted(t):
    """Passthrough edges emitted again, and one new edge per order."""
    again = st.catalog_lineage(t).where("transform_type = 'PASSTHROUGH'").selectExpr(
        "target_table", "target_column", "source_table", "source_column", "'n' AS expression", "'RENAME' AS transform_type", "0.7D AS confidence",
        "'sqlglot' AS source", "'pending_review' AS review_state", "'' AS ratified_by", "'' AS ratified_at", "'hn' AS sql_hash", "'now' AS computed_at",
    )
    fresh = t.orders.selectExpr(
        "'stg_orders' AS target_table", "concat('c', o_orderkey) AS target_column", "'src_new' AS source_table", "o_orderpriority AS source_column",
        "'n' AS expression", "'RENAME' AS transform_type", "0.7D AS confidence", "'sqlglot' AS source", "'ratified' AS review_state",
        "'' AS ratified_by", "'' AS ratified_at", "'hn' AS sql_hash", "'now' AS computed_at",
    )
    return again.unionByName(fresh)


@query(
    "upsert_lineage",
    st.with_catalog(
        """SELECT * FROM lin WHERE transform_type <> 'PASSTHROUGH'
        UNION ALL SELECT target_table, target_column, source_table, source_column, 'n', 'RENAME', 0.7, CASE WHEN source = 'catalog' THEN source ELSE 'sqlglot' END,
          review_state, ratified_by, ratified_at, 'hn', 'now' FROM lin WHERE transform_type = 'PASSTHROUGH'
        UNION ALL SELECT 'stg_orders', 'c' || o_orderkey, 'src_new', o_orderpriority, 'n', 'RENAME', 0.7, 'sqlglot', 'ratified', '', '', 'hn', 'now' FROM orders"""
    ),
)
def _(t):
    return C.upsert_lineage(st.catalog_lineage(t), _emitted(t))


@query(
    "emit_edges",
    """WITH m AS (SELECT *, unnest(CASE WHEN p_size <= 10 THEN [''] WHEN p_size <= 30 THEN ['a'] ELSE ['a', 'b'] END) s FROM part)
    SELECT 'stg_parts' AS target_table, 'c' || p_partkey AS target_column, CASE s WHEN '' THEN '' ELSE 'src_' || s END AS source_table,
      CASE s WHEN '' THEN '' WHEN 'a' THEN p_name ELSE p_brand END AS source_column, p_name AS expression, CASE s WHEN '' THEN '' ELSE 'TRANSFORM' END AS transform_type,
      CASE WHEN p_retailprice > 950 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN p_type = 'PROMO' THEN 'agent_inferred' ELSE 'sqlglot' END AS source,
      CASE WHEN p_type = 'SMALL' THEN 'ratified' WHEN p_type = 'PROMO' OR p_retailprice <= 950 THEN 'pending_review' ELSE 'ratified' END AS review_state, 'hm' AS sql_hash FROM m""",
)
def _(t):
    maps = t.part.selectExpr(
        "'stg_parts' AS target_table", "concat('c', p_partkey) AS target_column", "p_name AS full_expression",
        "CASE WHEN p_retailprice > 950 THEN 1.0D ELSE 0.5D END AS confidence", "CASE WHEN p_type = 'PROMO' THEN 'agent_inferred' ELSE '' END AS source",
        "CASE WHEN p_type = 'SMALL' THEN 'ratified' ELSE '' END AS review_state", "'' AS sql_hash",
        "filter(array(named_struct('source_table', 'src_a', 'source_column', p_name, 'transform_type', 'TRANSFORM'), "
        "named_struct('source_table', 'src_b', 'source_column', p_brand, 'transform_type', 'TRANSFORM')), "
        "(s, i) -> p_size > 30 OR (i = 0 AND p_size > 10)) AS sources",
    )
    return C.emit_edges(maps, manifest_hash="hm").drop("ratified_by", "ratified_at", "computed_at")


@query(
    "upsert_description",
    """SELECT 'customer' AS table_name, COALESCE(column_name, new_name) AS column_name, CASE WHEN d IS NULL THEN old_text ELSE d END AS description,
      CASE WHEN d IS NULL THEN 'catalog' ELSE 'agent_inferred' END AS source,
      CASE WHEN d IS NULL THEN old_state WHEN old_state = 'ratified' THEN 'ratified' ELSE 'pending_review' END AS review_state
    FROM (SELECT c_name column_name, c_mktsegment old_text, CASE WHEN c_acctbal < 2000 THEN 'ratified' ELSE 'pending_review' END old_state FROM customer WHERE c_acctbal < 6000)
    FULL OUTER JOIN (SELECT c_name new_name, MAX(o_orderpriority) d FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1) ON new_name = column_name""",
)
def _(t):
    old = t.customer.where("c_acctbal < 6000").selectExpr(
        "'customer' AS table_name", "c_name AS column_name", "c_mktsegment AS description", "'catalog' AS source",
        "CASE WHEN c_acctbal < 2000 THEN 'ratified' ELSE 'pending_review' END AS review_state", "'' AS ratified_by", "'' AS ratified_at", "'' AS computed_at",
    )
    # The empty texts of unfilled orders must not arrive.
    text = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(""))
    per = t.orders.groupBy("o_custkey").agg(text.alias("description"))
    new = per.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "'customer' AS table_name", "c_name AS column_name", "description", "'agent_inferred' AS source", "'' AS review_state",
        "'' AS ratified_by", "'' AS ratified_at", "'now' AS computed_at",
    )
    return C.upsert_description(old, new).select("table_name", "column_name", "description", "source", "review_state")


def _actions(t, rejects: bool = False):
    """Filled orders are ratified, open ones downgraded; urgent ones get a second action."""
    first = t.orders.selectExpr(
        "1 AS seq", "CAST(o_orderdate AS STRING) AS ts", "CASE o_orderstatus WHEN 'F' THEN 'ratify' ELSE 'downgrade' END AS action",
        "'stg_orders' AS table_name", "concat('c', o_orderkey) AS column_name", "'ana' AS actor", "'' AS reason",
    )
    second = t.orders.where("o_orderpriority = '1-URGENT'").selectExpr(
        "2 AS seq", "CAST(o_orderdate AS STRING) AS ts", f"'{'reject' if rejects else 'ratify'}' AS action",
        "'stg_orders' AS table_name", "concat('c', o_orderkey) AS column_name", "'bob' AS actor", "'checked' AS reason",
    )
    return first.unionByName(second)


REVIEW = f"""WITH {st.CATALOG},
initial AS (SELECT target_column, MIN(review_state) state FROM lin GROUP BY 1),
acts AS (
  SELECT o_orderkey, 1 seq, CASE o_orderstatus WHEN 'F' THEN 'ratify' ELSE 'downgrade' END act, CAST(o_orderdate AS VARCHAR) ts FROM orders
  UNION ALL SELECT o_orderkey, 2, 'SECOND', CAST(o_orderdate AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'),
steps AS (
  SELECT *, CASE act WHEN 'ratify' THEN 'ratified' WHEN 'downgrade' THEN 'pending_review' ELSE 'absent' END to_state,
    LAG(CASE act WHEN 'ratify' THEN 'ratified' WHEN 'downgrade' THEN 'pending_review' ELSE 'absent' END) OVER (PARTITION BY o_orderkey ORDER BY seq) prev
  FROM acts LEFT JOIN initial ON target_column = 'c' || o_orderkey)"""

LOG_SQL = """SELECT ts, act AS action, 'stg_orders' AS table_name, 'c' || o_orderkey AS column_name,
  CASE WHEN act = 'downgrade' THEN 'system' WHEN seq = 1 THEN 'ana' ELSE 'bob' END AS actor,
  CASE WHEN state IS NULL THEN 'absent' ELSE COALESCE(prev, state) END AS from_state, to_state,
  CASE WHEN seq = 2 THEN 'checked' WHEN state IS NULL THEN 'no lineage row to update' ELSE '' END AS reason FROM steps"""

LAST_SQL = """, last AS (SELECT 'c' || o_orderkey col, arg_max(act, seq) act, arg_max(ts, seq) ts, arg_max(seq, seq) seq FROM acts GROUP BY 1)
SELECT target_column, source_table, source_column, CASE act WHEN 'ratify' THEN 'ratified' ELSE 'pending_review' END AS review_state,
  CASE WHEN act <> 'ratify' THEN '' WHEN seq = 1 THEN 'ana' ELSE 'bob' END AS ratified_by, CASE WHEN act = 'ratify' THEN ts ELSE '' END AS ratified_at
FROM lin JOIN last ON col = target_column"""

STATE_COLUMNS = ["target_column", "source_table", "source_column", "review_state", "ratified_by", "ratified_at"]


@query("set_review_state", REVIEW.replace("SECOND", "ratify") + LAST_SQL)
def _(t):
    return C.set_review_state(st.catalog_lineage(t), _actions(t))[0].select(*STATE_COLUMNS)


@query("set_review_state_log", REVIEW.replace("SECOND", "ratify") + LOG_SQL)
def _(t):
    return C.set_review_state(st.catalog_lineage(t), _actions(t))[1]


@query("reject", REVIEW.replace("SECOND", "reject") + LAST_SQL + " WHERE act <> 'reject'")
def _(t):
    return C.apply_review(st.catalog_lineage(t), _actions(t, rejects=True))[0].select(*STATE_COLUMNS)


@query("reject_log", REVIEW.replace("SECOND", "reject") + LOG_SQL)
def _(t):
    return C.apply_review(st.catalog_lineage(t), _actions(t, rejects=True))[1]


@query("get_edges", st.with_catalog("SELECT target_column, source_table, source_column, confidence FROM lin WHERE target_table = 'stg_orders'"))
def _(t):
    return C.get_edges(st.catalog_lineage(t), "stg_orders").select("target_column", "source_table", "source_column", "confidence")


@query("pending", st.with_catalog("SELECT target_column, source_table, source_column FROM lin WHERE review_state = 'pending_review'"))
def _(t):
    return C.pending_edges(st.catalog_lineage(t)).select("target_column", "source_table", "source_column")


@query("ratified_for_target", st.with_catalog("SELECT source_table, source_column FROM lin WHERE target_column = 'c7' AND review_state = 'ratified'"))
def _(t):
    return C.ratified_for_target(st.catalog_lineage(t), "stg_orders", "c7").select("source_table", "source_column")


@query("certification", st.with_graph(f"SELECT table_name, profile FROM (WITH {st.CERTS.strip()} SELECT * FROM certs) WHERE table_name = 'fct_customer_risk_profile'"))
def _(t):
    return C.certification(st.certifications(t), "fct_customer_risk_profile")


@query(
    "seed_certifications",
    st.with_graph(
        f"""SELECT COALESCE(table_name, n_table) AS table_name, COALESCE(n_profile, profile) AS profile, COALESCE(n_notes, notes) AS notes
        FROM (WITH {st.CERTS.strip()} SELECT * FROM certs) FULL OUTER JOIN (SELECT 'fct_' || c_nationkey n_table, 'P3' n_profile, 'customers ' || COUNT(*) n_notes FROM customer GROUP BY c_nationkey)
        ON n_table = table_name"""
    ),
)
def _(t):
    new = t.customer.groupBy("c_nationkey").agg(F.expr("concat('customers ', COUNT(*))").alias("notes")).selectExpr(
        "concat('fct_', c_nationkey) AS table_name", "'P3' AS profile", "notes"
    )
    return C.upsert_certifications(st.certifications(t), new)


@query("min_review_state", st.with_catalog("SELECT target_table, target_column, MIN(review_state) AS review_state FROM lin GROUP BY 1, 2"))
def _(t):
    return C.review_states(st.catalog_lineage(t))


@query(
    "catalog_counts",
    f"""WITH {st.GRAPH.strip()}, {st.CATALOG.strip()}, {st.CERTS.strip()}
    SELECT (SELECT COUNT(*) FROM lin) AS lineage_count, (SELECT COUNT(*) FROM certs) AS certifications_count,
      (SELECT COUNT(DISTINCT target_column) FROM lin WHERE review_state = 'pending_review') AS pending_count,
      (SELECT COUNT(*) FROM lin WHERE review_state <> 'pending_review') AS ratified_count""",
)
def _(t):
    return C.catalog_counts(st.catalog_lineage(t), st.certifications(t))


@query(
    "group_pending_sources",
    st.with_catalog(
        """SELECT target_table, target_column, first_value(source) OVER w AS source, first_value(confidence) OVER w AS confidence,
          first_value(computed_at) OVER w AS awaiting_since, first_value(sql_hash) OVER w AS sql_hash, COUNT(*) OVER (PARTITION BY target_column) AS source_count,
          source_table, source_column, transform_type
        FROM lin WHERE review_state = 'pending_review' WINDOW w AS (PARTITION BY target_column ORDER BY source_table, source_column)"""
    ),
)
def _(t):
    return C.pending_sources(st.catalog_lineage(t))


@query("topn_activity", REVIEW.replace("SECOND", "ratify") + f", l AS ({LOG_SQL}) SELECT * FROM l ORDER BY ts DESC, action, table_name, column_name, actor, from_state, to_state, reason LIMIT 20")
def _(t):
    log = C.set_review_state(st.catalog_lineage(t), _actions(t))[1]
    return C.topn_activity(log.select("ts", "action", "table_name", "column_name", "actor", "from_state", "to_state", "reason"))


# --------------------------------------------------------------------------
# Graph upserts
# --------------------------------------------------------------------------


@query(
    "upsert_dataset",
    st.with_graph(
        f"""SELECT COALESCE(o.name, n.name) AS name, COALESCE(o.layer, n.layer) AS layer, CASE WHEN COALESCE(n.rc, 0) = 0 THEN COALESCE(o.row_count, 0) ELSE n.rc END AS row_count,
          COALESCE(o.computed_at, n.computed_at) AS computed_at
        FROM (WITH {st.DATASETS.strip()} SELECT * FROM datasets) o FULL OUTER JOIN (
          SELECT target_table AS name, CASE WHEN target_table LIKE 'stg%' THEN 'layer_1' ELSE 'layer_2' END layer,
            COALESCE(arg_max(output_row_count, (run_id, output_row_count)) FILTER (WHERE output_row_count <> 0), 0) rc, MIN(run_id) computed_at FROM procs GROUP BY 1) n ON n.name = o.name"""
    ),
)
def _(t):
    seen = st.processes(t).select(F.col("target_table").alias("name"), F.col("output_row_count").alias("row_count"), F.col("run_id").alias("computed_at"))
    return B.upsert_dataset(st.datasets(t), seen)


def _process_rows(t):
    return st.processes(t).select(
        "pk", "stage", "run_id", "transform_type", "target_table", "duration_ms", "output_row_count", F.lit("old").alias("computed_at"), F.lit("").alias("sql_hash")
    )


@query(
    "upsert_process",
    st.with_graph(
        """SELECT pk, stage, run_id, 'FILTER' AS transform_type, target_table, duration_ms + 1 AS duration_ms, CASE WHEN output_row_count >= 5 THEN 'old' ELSE 'new' END AS computed_at
        FROM procs WHERE transform_type = 'FILTER' OR output_row_count < 5
        UNION ALL SELECT pk, stage, run_id, transform_type, target_table, duration_ms, 'old' FROM procs WHERE NOT (transform_type = 'FILTER' OR output_row_count < 5)"""
    ),
)
def _(t):
    rows = _process_rows(t)
    old = rows.where("output_row_count >= 5")
    new = rows.where("transform_type = 'FILTER' OR output_row_count < 5").withColumns(
        {"transform_type": F.lit("FILTER"), "duration_ms": F.col("duration_ms") + 1, "computed_at": F.lit("new")}
    )
    return B.upsert_process(old, new).select("pk", "stage", "run_id", "transform_type", "target_table", "duration_ms", "computed_at")


COLUMN_ROW = list(B.EMPTY["column"].replace(",", "").split()[0::2])


def _column_rows(t):
    return st.graph_columns(t).withColumns(
        {"derivation": F.lit(""), "computed_at": F.lit("old"), "sql_hash": F.lit("")}
    ).select(*COLUMN_ROW)


@query(
    "upsert_column",
    st.with_graph(
        """SELECT pk, CASE WHEN new THEN 'new' ELSE '' END AS derivation, semantic_description, CASE WHEN new THEN 0.9 ELSE confidence END AS confidence,
          CASE WHEN NOT new THEN source WHEN review_state = 'ratified' AND source = 'catalog' THEN 'catalog' ELSE 'sqlglot' END AS source, review_state
        FROM (SELECT *, data_type IN ('SMALL', 'LARGE') AS new FROM cols)"""
    ),
)
def _(t):
    old = _column_rows(t)
    none = F.lit(None).cast("string")
    new = old.where("data_type IN ('SMALL', 'LARGE')").withColumns(
        {"derivation": F.lit("new"), "confidence": F.lit(0.9), "semantic_description": none, "source": F.lit("sqlglot"), "review_state": F.lit(PENDING)}
    )
    return B.upsert_column(old, new).select("pk", "derivation", "semantic_description", "confidence", "source", "review_state")


@query(
    "upsert_column_stub",
    st.with_graph(
        """SELECT pk, CASE WHEN starts_with(pk, 'src_') THEN 1.0 ELSE confidence END AS confidence, CASE WHEN starts_with(pk, 'src_') THEN 'catalog' ELSE source END AS source,
          CASE WHEN starts_with(pk, 'src_') THEN 'ratified' ELSE review_state END AS review_state, CASE WHEN starts_with(pk, 'src_') THEN '' ELSE data_type END AS data_type FROM cols
        UNION ALL SELECT 'stg_new::' || s_name, 0.0, 'unresolved', 'pending_review', '' FROM supplier"""
    ),
)
def _(t):
    stubs = st.graph_columns(t).selectExpr("dataset_name", "column_name", "'now' AS computed_at").unionByName(
        t.supplier.selectExpr("'stg_new' AS dataset_name", "s_name AS column_name", "'now' AS computed_at")
    )
    return B.upsert_column_stub(_column_rows(t), stubs).select("pk", "confidence", "source", "review_state", "data_type")


@query("upsert_edge", st.with_graph("SELECT label, src_id, dst_id FROM derives UNION SELECT label, src_id, dst_id FROM struct_edges"))
def _(t):
    old = st.derives_edges(t)
    return B.upsert_edge(old, old.unionByName(st.structural_edges(t)))


def _manifests(t):
    """A supplier's run reads a source table named after its nation and writes one table."""
    return t.supplier.selectExpr(
        "concat('st_', s_nationkey) AS stage", "concat('r', s_suppkey) AS run_id", "'t' AS ts", "concat('stg_', s_nationkey) AS target_table",
        "array(concat('src_', s_nationkey), 'src_all') AS source_tables", "array(concat('st_', s_nationkey), 'st_none') AS depends_on_stages",
        "'TRANSFORM' AS transform_type", "map(s_name, concat('src_', s_nationkey, '.k * src_all.', s_name, ' + 0.65 + other.x')) AS derived_columns",
    )


def _ingested(t, graph=None):
    metrics = t.supplier.where("s_acctbal > 0").selectExpr(
        "concat('r', s_suppkey) AS run_id", "concat('st_', s_nationkey) AS stage", "'t' AS ts", "s_suppkey AS output_row_count", "s_suppkey AS duration_ms"
    )
    return B.ingest_manifests(graph or B.empty_graph(t.spark), _manifests(t), metrics)


@query(
    "ingest_manifests",
    """WITH s AS (SELECT 'st_' || s_nationkey || '::r' || s_suppkey pk, * FROM supplier)
    SELECT 'INPUT_TO' AS label, 'src_' || s_nationkey AS src_id, pk AS dst_id FROM s UNION ALL SELECT 'INPUT_TO', 'src_all', pk FROM s
    UNION ALL SELECT 'PRODUCES', pk, 'stg_' || s_nationkey FROM s UNION ALL SELECT 'DEPENDS_ON', pk, pk FROM s
    UNION ALL SELECT 'DERIVES_FROM', 'stg_' || s_nationkey || '::' || s_name, 'src_' || s_nationkey || '::k' FROM s
    UNION ALL SELECT 'DERIVES_FROM', 'stg_' || s_nationkey || '::' || s_name, 'src_all::' || split_part(s_name, '#', 1) FROM s""",
)
def _(t):
    return _ingested(t)[0]["edge"]


@query(
    "ingest_manifests_columns",
    """SELECT DISTINCT 'stg_' || s_nationkey || '::' || s_name AS pk, 'unresolved' AS source, 'pending_review' AS review_state, 0.0::DOUBLE AS confidence FROM supplier
    UNION ALL SELECT DISTINCT 'src_' || s_nationkey || '::k', 'catalog', 'ratified', 1.0 FROM supplier
    UNION ALL SELECT DISTINCT 'src_all::' || split_part(s_name, '#', 1), 'catalog', 'ratified', 1.0 FROM supplier""",
)
def _(t):
    return _ingested(t)[0]["column"].select("pk", "source", "review_state", "confidence")


@query(
    "ingest_column_maps",
    st.with_catalog(
        """SELECT 'stg_orders::' || target_column AS pk, arg_min(transform_type, (source_table, source_column)) AS transform_type, COUNT(*) AS n_edges
        FROM lin GROUP BY target_column"""
    ),
)
def _(t):
    runs = st.processes(t).where("run_id = 'r0'").select(
        "stage", "run_id", F.lit("now").alias("ts"), F.lit("stg_orders").alias("target_table"), F.array(F.lit("src_a")).alias("source_tables"),
        F.array().cast("array<string>").alias("depends_on_stages"), "transform_type", "duration_ms", "output_row_count", F.lit("h").alias("sql_hash"),
    )
    maps = st.catalog_lineage(t).withColumns({"ambiguous": F.lit(False), "data_type": F.lit("text"), "ts": F.col("computed_at")})
    graph = B.ingest_column_maps(B.empty_graph(t.spark), runs, maps)[0]
    edges = graph["edge"].where("label = 'DERIVES_FROM'").groupBy(F.col("src_id").alias("pk")).agg(F.count(F.lit(1)).alias("n_edges"))
    return graph["column"].where("dataset_name = 'stg_orders'").select("pk", "transform_type").join(edges, "pk")


@query("idempotency_check", "SELECT 'column' AS part, TRUE AS same UNION ALL SELECT 'dataset', TRUE UNION ALL SELECT 'edge', TRUE UNION ALL SELECT 'process', TRUE")
def _(t):
    once = _ingested(t)[0]
    twice = _ingested(t, once)[0]
    parts = [
        table_fingerprint(once[p], ()).select(
            F.lit(p).alias("part"), (F.col("fingerprint") == table_fingerprint(twice[p], ()).scalar()).alias("same")
        )
        for p in sorted(once)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "transform_type_of_target",
    """SELECT 'stg_orders' AS target_table, 'c' || l_orderkey AS target_column, COALESCE(
        arg_min(CASE WHEN l_tax > 0.04 THEN 'RENAME' ELSE 'TRANSFORM' END, (l_partkey, l_suppkey, l_linenumber)) FILTER (WHERE l_discount > 0.02),
        CASE WHEN bool_or(l_returnflag = 'R') THEN 'AMBIGUOUS' ELSE 'CONSTANT' END) AS transform_type FROM lineitem GROUP BY l_orderkey""",
)
def _(t):
    maps = t.lineitem.selectExpr(
        "'stg_orders' AS target_table", "concat('c', l_orderkey) AS target_column",
        "CASE WHEN l_discount > 0.02 THEN concat('s', lpad(l_partkey, 12, '0')) ELSE '' END AS source_table",
        "concat(lpad(l_suppkey, 12, '0'), '-', l_linenumber) AS source_column",
        "CASE WHEN l_tax > 0.04 THEN 'RENAME' ELSE 'TRANSFORM' END AS transform_type", "l_returnflag = 'R' AS ambiguous",
    )
    return B.transform_type_of_target(maps)


# --------------------------------------------------------------------------
# Search
# --------------------------------------------------------------------------


def _score_sql(text: str, col: str, table: str, terms: list[str]) -> str:
    t, c, d = f"lower({text})", f"lower({col})", f"lower({table})"
    alls = " AND ".join(f"contains({t}, '{w}')" for w in terms)
    anys = " OR ".join(f"contains({t}, '{w}')" for w in terms)
    name = " OR ".join(f"contains({c}, '{w}') OR contains('{w}', {c})" for w in terms)
    tab = " OR ".join(f"contains({d}, '{w}')" for w in terms)
    part = " OR ".join(f"contains({c}, '{w[:4]}')" for w in terms if len(w) >= 4) or "FALSE"
    return f"CASE WHEN {alls} THEN 3 WHEN {anys} OR {name} THEN 2 WHEN {tab} OR {part} THEN 1 ELSE 0 END"


def _documents_as_columns(t):
    return t.documents.selectExpr(
        "source AS dataset_name", "concat('d', doc_id) AS column_name", "text AS semantic_description", "CAST(n_chars AS DOUBLE) AS confidence"
    )


DOC_SCORE = _score_sql("text", "'d' || doc_id", "source", ["and", "the", "src1", "d77zz"])


@query("search_columns", f"SELECT * FROM (SELECT source AS dataset_name, 'd' || doc_id AS column_name, {DOC_SCORE} AS score FROM documents) WHERE score > 0")
def _(t):
    return Q.score_columns(_documents_as_columns(t), "And the: src1 d77zz a").select("dataset_name", "column_name", "score")


PART_SCORE = _score_sql("semantic_description", "column_name", "dataset_name", ["red", "ring", "medium"])


@query(
    "topk_search",
    st.with_graph(
        f"""SELECT pk, score, confidence, layer FROM (SELECT *, {PART_SCORE} AS score, CASE WHEN dataset_name LIKE 'src%' THEN 'layer_0'
          WHEN dataset_name LIKE 'stg%' THEN 'layer_1' ELSE 'layer_2' END AS layer FROM cols) WHERE score > 0
        ORDER BY score DESC, confidence DESC, dataset_name, column_name LIMIT 20"""
    ),
)
def _(t):
    return Q.search_columns(st.graph_columns(t), "Red ring, medium", k=20).select("pk", "score", "confidence", "layer")


@query("cap_fetch", st.with_graph(f"SELECT score, COUNT(*) AS n FROM (SELECT {PART_SCORE} AS score FROM cols) WHERE score > 0 GROUP BY 1"))
def _(t):
    # Every column is scored; nothing is cut off before the ranking.
    return Q.score_columns(st.graph_columns(t), "red ring medium").groupBy("score").agg(F.count(F.lit(1)).alias("n"))


NAME_HITS = "contains(lower(c_name), '0001')::INT + contains(lower(c_name), '12')::INT + contains(lower(c_name), '99')::INT"


def _customers_as_datasets(t):
    return t.customer.selectExpr("c_name AS name", "c_mktsegment AS layer", "c_custkey AS row_count")


@query("search_datasets", f"SELECT c_name AS name, {NAME_HITS} AS hits FROM customer WHERE {NAME_HITS} > 0")
def _(t):
    return Q.score_datasets(_customers_as_datasets(t), "0001 12-99").select("name", "hits")


@query("topk_datasets", f"SELECT c_name AS name, {NAME_HITS} AS hits FROM customer WHERE {NAME_HITS} > 0 ORDER BY hits DESC, name LIMIT 10")
def _(t):
    return Q.search_datasets(_customers_as_datasets(t), "0001 12-99").select("name", "hits")


@query(
    "layer_preference",
    st.with_graph(
        """SELECT pk, CASE WHEN dataset_name LIKE 'stg%' THEN 0 WHEN dataset_name LIKE 'fct%' THEN 1 ELSE 2 END AS layer_rank FROM cols"""
    ),
)
def _(t):
    return Q.layer_preference(G.with_layer(st.graph_columns(t)), "which staged amounts").select("pk", "layer_rank")


@query(
    "harvest_refs",
    r"""WITH d AS (SELECT doc_id, 'see `' || source || '.' || lang || '` and `' || upper(lang) || '.x1`: ' || text AS body FROM documents)
    SELECT DISTINCT doc_id, split_part(trim(m, '`'), '.', 1) AS "table", split_part(trim(m, '`'), '.', 2) AS "column"
      FROM (SELECT doc_id, unnest(regexp_extract_all(body, '`[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*`')) m FROM d)
    UNION ALL SELECT doc_id, k, NULL FROM d, (SELECT unnest(['with', 'src1', 'leaux']) k) WHERE regexp_matches(body, '(?i)(^|[^A-Za-z0-9_])' || k || '($|[^A-Za-z0-9_])')""",
)
def _(t):
    texts = t.documents.selectExpr("doc_id", "concat('see `', source, '.', lang, '` and `', upper(lang), '.x1`: ', text) AS body")
    return Q.harvest_refs(texts, "body", ["with", "src1", "leaux"]).select("doc_id", "table", "column")
