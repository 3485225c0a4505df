"""Walks on the shapes that separate the three dedup rules."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import graph as G
from ledgerline.operators import graph_build as B
from ledgerline.operators.fingerprint import table_fingerprint
from ledgerline.operators.impact import impact_report, sort_report


SHAPES = {
    "chain": [(f"n{i}", f"n{i + 1}") for i in range(14)],
    "diamond": [("d", "l"), ("d", "r"), ("l", "b"), ("r", "b"), ("b", "z")],
    "uneven": [("u", "v"), ("v", "w"), ("u", "w"), ("w", "x")],
    "cycle": [("c1", "c2"), ("c2", "c3"), ("c3", "c1")],
    "self": [("s", "s"), ("s", "t")],
    "hub": [(f"h{i}", "hub") for i in range(40)] + [("hub", "root")],
}
EDGES = [e for shape in SHAPES.values() for e in shape]


def frame(spark):
    return spark.createDataFrame([("DERIVES_FROM", a, b) for a, b in EDGES], "label string, src_id string, dst_id string")


def every(spark):
    """All nodes as start nodes."""
    return spark.createDataFrame(sorted({(n,) for e in EDGES for n in e}), "start string")


def brute(max_hops, reverse=False):
    """(start, node, hop) -> number of paths."""
    steps = {}
    for a, b in EDGES:
        steps.setdefault(b if reverse else a, []).append(a if reverse else b)
    out = Counter()
    for start in steps:
        level = Counter({start: 1})
        for hop in range(1, max_hops + 1):
            following = Counter()
            for node, n in level.items():
                for nxt in steps.get(node, []):
                    following[nxt] += n
            for node, n in following.items():
                out[(start, node, hop)] = n
            level = following
    return out


def shortest(max_hops, reverse=False):
    best = {}
    for start, node, hop in brute(max_hops, reverse):
        best[(start, node)] = min(hop, best.get((start, node), hop))
    return best


def test_ancestors_count_paths(spark, joins):
    got = G.column_ancestors(frame(spark), every(spark), 10)
    assert {(r["start"], r["ancestor"], r["hops"]): r["paths"] for r in got.collect()} == dict(brute(10))


def test_chain_keeps_each_hop(spark):
    got = G.column_chain(frame(spark), every(spark), 10)
    assert {tuple(r) for r in got.collect()} == set(brute(10))


def test_downstream_keeps_the_smallest_hop(spark, joins):
    got = G.downstream_chain(frame(spark), every(spark), 10)
    assert {(r["start"], r["descendant"]): r["hops"] for r in got.collect()} == shortest(10, reverse=True)


def test_hops_are_taken_as_asked_or_refused(spark):
    for bad in (0, -1, 2.5, True):
        with pytest.raises(ValueError):
            G.downstream_chain(frame(spark), every(spark), bad)
    assert {r["hops"] for r in G.downstream_chain(frame(spark), every(spark), 1).collect()} == {1}
    for far in (99, None):
        assert G.downstream_chain(frame(spark), every(spark), far).agg(F.max("hops")).first()[0] == 14


def test_start_without_edges_gives_nothing(spark):
    starts = spark.createDataFrame([("nowhere",)], "start string")
    assert G.column_chain(frame(spark), starts, 10).count() == 0


def test_trace_reaches_everything(spark, joins):
    edges = frame(spark).unionByName(
        spark.createDataFrame([("DEPENDS_ON", "root", "n0")], "label string, src_id string, dst_id string")
    )
    got = {tuple(r) for r in G.trace_path(edges, every(spark)).collect()}
    want = {(a, b, "down") for a, b in shortest(40)} | {(a, b, "up") for a, b in shortest(40, reverse=True)}
    want |= {(n, n, "root") for e in EDGES for n in e}
    assert got == want


COLUMN = "pk string, dataset_name string, column_name string, transform_type string, expression string, review_state string"


def test_gate_uses_certified_tables_or_the_prefix(spark):
    columns = spark.createDataFrame(
        [("fct_a::x", "fct_a", "x", "", "", "pending_review"), ("stg_b::y", "stg_b", "y", "", "", "pending_review")], COLUMN
    )
    chain = spark.createDataFrame([("s", "fct_a::x", 1), ("s", "stg_b::y", 2)], "start string, descendant string, hops int")
    certs = spark.createDataFrame([("stg_b", "p1")], "table_name string, profile string")
    for frame_, kept in [(certs, "fct_a::x"), (certs.limit(0), "stg_b::y")]:
        rest, count = G.gate_unratified(chain, columns, frame_)
        assert [r["descendant"] for r in rest.collect()] == [kept]
        assert count.first()["filtered"] == 1
    everything, none = G.gate_unratified(chain, columns, certs, include_unratified=True)
    assert everything.count() == 2 and none.first()["filtered"] == 0


def test_impact_rules(spark):
    columns = spark.createDataFrame(
        [
            ("src_a::k", "src_a", "k", "PASSTHROUGH", "k", "ratified"),
            ("stg_b::same", "stg_b", "same", "PASSTHROUGH", "k", "ratified"),
            ("stg_b::sum", "stg_b", "sum", "TRANSFORM", "k * 2", "ratified"),
            ("fct_customer_risk_profile::risk_score", "fct_customer_risk_profile", "risk_score", "AMBIGUOUS", "case", "ratified"),
        ],
        COLUMN,
    )
    edges = spark.createDataFrame(
        [
            ("DERIVES_FROM", "stg_b::same", "src_a::k"), ("DERIVES_FROM", "stg_b::sum", "src_a::k"),
            ("DERIVES_FROM", "fct_customer_risk_profile::risk_score", "stg_b::sum"), ("INPUT_TO", "src_a", "p::1"), ("INPUT_TO", "src_a", "p::2"),
        ],
        "label string, src_id string, dst_id string",
    )
    processes = spark.createDataFrame(
        [("p::1", "p", "1", "FILTER", "stg_b", "select K from src_a"), ("p::2", "q", "2", "FILTER", "stg_b", "select kk, 'k1' from src_a")],
        "pk string, stage string, run_id string, transform_type string, target_table string, sql_text string",
    )

    def report(kind):
        changes = spark.createDataFrame([("src_a", "k", kind)], "table string, column string, change_type string")
        rows = sort_report(impact_report(columns, edges, processes, changes)).collect()
        assert {r["total_affected"] for r in rows} == {len(rows)}
        return [(r["affected_column"], r["severity"]) for r in rows]

    assert report("RENAME") == [(None, "HIGH"), ("same", "HIGH"), ("sum", "HIGH")]
    assert report("TYPE_CHANGE") == [("risk_score", "CRITICAL"), ("sum", "HIGH")]
    assert report("DROP") == [("risk_score", "CRITICAL"), (None, "HIGH"), ("same", "HIGH"), ("sum", "HIGH")]


def manifest_frames(spark, rows=7):
    manifests = spark.createDataFrame(
        [
            ("02_b", "r1", "t2", "stg_b", ["src_a"], ["01_a", "00_none"], "FILTER", {"x": "src_a.k + 0.65", "x2": "stg_b.x2 || src_a.k"}),
            ("01_a", "r1", "t1", "stg_a", ["src_a"], [], "FILTER", {"y": "other.z"}),
        ],
        "stage string, run_id string, ts string, target_table string, source_tables array<string>, depends_on_stages array<string>, "
        "transform_type string, derived_columns map<string,string>",
    )
    metrics = spark.createDataFrame([("02_b", "r1", "t3", rows, 5)], "stage string, run_id string, ts string, output_row_count bigint, duration_ms bigint")
    return manifests, metrics


def test_manifest_ingest_is_idempotent_and_keeps_counts(spark):
    manifests, metrics = manifest_frames(spark)
    graph, missing = B.ingest_manifests(B.empty_graph(spark), manifests, metrics)
    assert [r["dst_id"] for r in missing.collect()] == ["00_none::r1"]
    edges = {(r["label"], r["src_id"], r["dst_id"]) for r in graph["edge"].collect()}
    assert ("DEPENDS_ON", "02_b::r1", "01_a::r1") in edges
    assert {e for e in edges if e[0] == "DERIVES_FROM"} == {
        ("DERIVES_FROM", "stg_b::x", "src_a::k"), ("DERIVES_FROM", "stg_b::x2", "src_a::k")
    }
    counts = {r["name"]: r["row_count"] for r in graph["dataset"].collect()}
    assert counts == {"stg_b": 7, "stg_a": 0, "src_a": 0}
    again, _ = B.ingest_manifests(graph, manifests, metrics.limit(0))
    for part in ("dataset", "column", "edge"):
        assert table_fingerprint(again[part]).first() == table_fingerprint(graph[part]).first()


def test_column_upsert_never_downgrades_a_ratified_column(spark):
    schema = B.EMPTY["column"]
    old = spark.createDataFrame([("t::c", "c", "t", "", "t0", "e", "steward", 1.0, "", "", "", "catalog", "ratified")], schema)
    new = spark.createDataFrame([("t::c", "c", "t", "d", "t1", "e2", None, 0.5, "X", "", "", "sqlglot", "pending_review")], schema)
    row = B.upsert_column(old, new).first()
    assert (row["review_state"], row["source"], row["semantic_description"]) == ("ratified", "catalog", "steward")
    assert (row["derivation"], row["confidence"], row["computed_at"]) == ("d", 0.5, "t0")
    stubs = spark.createDataFrame([("t", "c", "t2"), ("src_z", "k", "t2")], "dataset_name string, column_name string, computed_at string")
    kept = {r["pk"]: r for r in B.upsert_column_stub(old, stubs).collect()}
    assert kept["t::c"]["expression"] == "e"
    assert (kept["src_z::k"]["source"], kept["src_z::k"]["confidence"]) == ("catalog", 1.0)


def test_column_maps_ingest(spark):
    runs = spark.createDataFrame(
        [("02_b", "r1", "t", "stg_b", ["src_a"], [], "FILTER", 3, 9, "h")],
        "stage string, run_id string, ts string, target_table string, source_tables array<string>, depends_on_stages array<string>, "
        "transform_type string, duration_ms bigint, output_row_count bigint, sql_hash string",
    )
    maps = spark.createDataFrame(
        [("stg_b", "x", "src_a", "k", "e", "RENAME", 1.0, "sqlglot", "ratified", "h", False, "int", "t"),
         ("stg_b", "one", "", "", "1", "", 1.0, "sqlglot", "ratified", "h", False, "int", "t"),
         ("stg_b", "x", "stg_b", "x", "e", "RENAME", 1.0, "sqlglot", "ratified", "h", False, "int", "t")],
        "target_table string, target_column string, source_table string, source_column string, expression string, transform_type string, "
        "confidence double, source string, review_state string, sql_hash string, ambiguous boolean, data_type string, ts string",
    )
    graph, _ = B.ingest_column_maps(B.empty_graph(spark), runs, maps)
    types = {r["pk"]: r["transform_type"] for r in graph["column"].collect()}
    assert types == {"stg_b::x": "RENAME", "stg_b::one": "CONSTANT", "src_a::k": "PASSTHROUGH"}
    assert graph["edge"].where("label = 'DERIVES_FROM'").count() == 1


def test_column_maps_are_dealt_once_per_key(spark):
    """One pass over the targets, and stub rows that are dealt by their key before their constants are filled in."""
    runs = spark.createDataFrame(
        [("02_b", "r1", "t", "stg_b", ["src_a"], [], "FILTER", 3, 9, "h")],
        "stage string, run_id string, ts string, target_table string, source_tables array<string>, depends_on_stages array<string>, "
        "transform_type string, duration_ms bigint, output_row_count bigint, sql_hash string",
    )
    maps = spark.createDataFrame(
        [("stg_b", "x", "src_a", "k", "e", "RENAME", 1.0, "sqlglot", "ratified", "h", False, "int", "t1"),
         ("stg_b", "x", "src_a::k", "v", "f", "TRANSFORM", 0.5, "sqlglot", "ratified", "h", True, "int", "t2"),
         ("stg_b", "y", "src_a", "k::v", "g", "RENAME", 1.0, "sqlglot", "ratified", "h", False, "int", "t3")],
        "target_table string, target_column string, source_table string, source_column string, expression string, transform_type string, "
        "confidence double, source string, review_state string, sql_hash string, ambiguous boolean, data_type string, ts string",
    )
    column = B.ingest_column_maps(B.empty_graph(spark), runs, maps)[0]["column"]
    rows = {r["pk"]: r for r in column.collect()}
    assert set(rows) == {"stg_b::x", "stg_b::y", "src_a::k", "src_a::k::v"}
    assert (rows["stg_b::x"]["transform_type"], rows["stg_b::x"]["expression"], rows["stg_b::x"]["computed_at"]) == ("RENAME", "f", "t1")
    # Two sources have one key: the later row is taken whole.
    assert (rows["src_a::k::v"]["dataset_name"], rows["src_a::k::v"]["column_name"], rows["src_a::k::v"]["computed_at"]) == ("src_a", "k::v", "t3")
    assert (rows["src_a::k"]["source"], rows["src_a::k"]["confidence"], rows["src_a::k"]["data_type"]) == ("catalog", 1.0, "")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        column = B.ingest_column_maps(B.empty_graph(spark), runs, maps)[0]["column"]
        plan = column._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("hashpartitioning(target_table" in line for line in exchanges) == 1
    # The stubs are dealt by their key before they have their constants.
    assert sum("concat_ws(::, dataset_name" in line for line in exchanges) == 1
