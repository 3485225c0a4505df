"""Closures, scope rules, fused checks and the packed log."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import quality as Q
from ledgerline.operators.fingerprint import table_fingerprint
from ledgerline.operators.graph import reach, resolve_to_base, scoped_references
from ledgerline.sources import eventlog as E


def brute_reach(edges, starts):
    out = {}
    for s in starts:
        level, hops, seen = {s}, 0, {}
        while level:
            hops += 1
            level = {b for a, b in edges if a in level} - set(seen)
            seen.update(dict.fromkeys(level, hops))
        out |= {(s, n): h for n, h in seen.items()}
    return out


def test_reach_against_brute_force(spark):
    pairs = [(i, (i * 7 + j) % 40) for i in range(40) for j in (1, 3)] + [(200, 201), (201, 202), (202, 200), (5, 5), (300, 301)]
    edges = spark.createDataFrame([("DERIVES_FROM", str(a), str(b)) for a, b in pairs] + [("DERIVES_FROM", None, "1")], "label string, src_id string, dst_id string")
    starts = spark.createDataFrame([("0",), ("200",), ("5",), ("301",), (None,), ("0",)], "start string")
    want = brute_reach({(str(a), str(b)) for a, b in pairs}, ["0", "200", "5", "301"])
    assert {(r["start"], r["node"]): r["hops"] for r in reach(edges, starts).collect()} == want
    assert {(r["start"], r["node"]) for r in reach(edges, starts, 2).collect()} == {k for k, h in want.items() if h <= 2}
    assert reach(edges, starts.limit(0)).columns == ["start", "node", "hops"] and reach(edges, starts.limit(0)).count() == 0


def test_rows_written_grow_with_the_pairs_found(spark, monkeypatch):
    """A chain of n nodes from one start has n pairs in n levels; rewriting what was seen would write n * n / 2 rows."""
    from ledgerline.operators import scale

    real, rows = scale.bucketed, []

    def counted(df, *dealt):
        kept = real(df, *dealt)
        assert kept[0].count() == kept[1]
        rows.append(kept[1])
        return kept

    monkeypatch.setattr(scale, "bucketed", counted)
    n = 16
    edges = spark.createDataFrame([("D", f"{i:05d}", f"{i + 1:05d}") for i in range(n)], "label string, src_id string, dst_id string")
    assert reach(edges, spark.createDataFrame([("00000",)], "start string")).count() == n
    assert sum(rows) <= 6 * n < n * (n + 1) / 2


def test_levels_move_only_new_rows(spark, monkeypatch):
    from ledgerline.operators import scale

    first = spark.createDataFrame([(0, 0)], "k int, v int")
    plans = []

    def step(rows, level):
        return rows.select((F.col("k") + 1).alias("k"), F.lit(level).alias("v")).where("k < 4")

    real = scale.bucketed
    monkeypatch.setattr(scale, "bucketed", lambda df, *dealt: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *dealt))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r["k"] for r in scale.semi_naive(first, step, ["k"]).collect()) == [0, 1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The last level is compared with four parts, and only its own rows are dealt.
    assert plans[-1].count("LeftAnti") >= 3 and plans[-1].count("Exchange") == 1


def test_no_level_of_a_walk_goes_through_the_driver(spark, monkeypatch):
    """Small levels would be broadcast, which in a long walk takes all that it finds to the driver."""
    from ledgerline.operators import scale

    plans, real = [], scale.bucketed
    monkeypatch.setattr(scale, "bucketed", lambda df, *dealt: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *dealt))
    edges = spark.createDataFrame([("D", f"{i:05d}", f"{i + 1:05d}") for i in range(5)], "label string, src_id string, dst_id string")
    found = reach(edges, spark.createDataFrame([("00000",), ("00003",)], "start string")).collect()
    assert {(r["start"], r["node"], r["hops"]) for r in found} == {("00000", f"{i:05d}", i) for i in range(1, 6)} | {("00003", "00004", 1), ("00003", "00005", 2)}
    assert len(plans) >= 6 and not any("Broadcast" in p for p in plans)


SCOPE = [
    ("out", 1, "C", "cte"), ("out", 2, "o", "Orders"), ("cte", 1, "x", "users"), ("cte", 2, "y", "orders"),
    ("dup", 1, "a", "users"), ("dup", 2, "a", "orders"), ("self", 1, None, "self"), ("stars", 1, "x", "users"), ("stars", 2, "y", "cte"),
]
PROJECTIONS = [
    ("out", 1, "p", "c", "id"), ("out", 2, "q", None, "name"), ("out", 3, "r", "ORDERS", "total"), ("out", 4, "s", "nobody", "z"),
    ("out", 5, "k", None, None), ("out", 6, "p", "o", "second"), ("out", 7, "t", "c", "other"), ("out", 8, "u", "c", "k"),
    ("cte", 1, "id", "x", "id"), ("cte", 2, "*", "y", None), ("cte", 3, "*", "x", None), ("cte", 4, "k", None, None),
    ("dup", 1, "d", "a", "v"), ("dup", 2, "e", None, "v"), ("self", 1, "l", None, "m"), ("stars", 1, "*", None, None), ("stars", 2, "*", "x", None),
    ("top", 1, "n", "stars", "id"), ("lone", 1, "n", None, "v"),
]


def test_scope_rules(spark):
    scope = spark.createDataFrame(SCOPE, "node string, ordinal int, alias string, table string")
    rows = spark.createDataFrame(PROJECTIONS, "node string, position int, column string, qualifier string, ref_column string")
    base = spark.createDataFrame([("users",), ("orders",)], "name string")
    found = {}
    for r in resolve_to_base(scoped_references(rows, scope), base).collect():
        found.setdefault((r["target_node"], r["target_column"]), set()).add((r["source_table"], r["source_column"]))
    assert found == {
        ("out", "p"): {("users", "id")},  # through the alias, and the first of two projections named p
        ("out", "q"): {("orders", "name")},  # unqualified: orders, and through the first star of cte orders again
        ("out", "r"): {("orders", "total")},  # by the table's own name
        ("out", "s"): {("nobody", "z")},  # an alias nobody has
        ("out", "t"): {("orders", "other")},  # the first star only
        ("cte", "id"): {("users", "id")},
        ("dup", "d"): {("orders", "v")},  # the later of two equal aliases
        ("dup", "e"): {("users", "v"), ("orders", "v")},
        ("self", "l"): {("self", "m")},
        ("top", "n"): {("users", "id")},  # a bare star reaches users directly and through cte
    }  # constants, also behind a star, and names without a table in scope have no source


def test_fused_checks_read_a_table_once(spark, tmp_path):
    rows = [(i, "AB"[i % 2] if i % 7 else None, float(i - 3)) for i in range(50)]
    spark.createDataFrame(rows, "k int, t string, v double").write.parquet(str(tmp_path / "t"))
    table, source = spark.read.parquet(str(tmp_path / "t")), spark.range(60)
    checks = [
        Q.not_null("nulls", "t"), Q.non_negative("low", "v"), Q.Rows("same", source, exact=True), Q.Rows("drops", source, exact=False),
        Q.Rows("own", table, exact=False), Q.Values("tiers", "t", ["B", "A"]), Q.Values("more", "t", ["A", "C"]),
    ]
    got = Q.fused_checks(table.where("k < 49"), checks)
    found = {r["check_name"]: tuple(r)[1:] for r in got.collect()}
    assert found == {
        "nulls": ("0", "7", 49, 7, False), "low": ("0", "3", 49, 3, False), "same": ("60", "49", 60, 11, False),
        "drops": (">= 60", "49", 60, 11, False), "own": (">= 50", "49", 50, 1, False),
        "tiers": ("A,B", "A,B +1 other", 49, 1, False), "more": ("A,C", "A +2 other", 49, 1, False),
    }
    plan = Q.fused_checks(table, [c for c in checks if not isinstance(c, Q.Rows)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    nothing = {r["check_name"]: r["passed"] for r in Q.fused_checks(table.limit(0), [Q.not_null("n", "t"), Q.Values("v", "t", ["A"])]).collect()}
    assert nothing == {"n": True, "v": False}


def test_fingerprints_are_of_bags(spark):
    rows = [(i % 7, None if i % 3 else "x", dt.datetime(2024, 1, 1 + i % 5)) for i in range(200)]
    frame = spark.createDataFrame(rows, "a int, b string, computed_at timestamp")

    def of(df):
        return table_fingerprint(df).first()[0]

    want = of(frame)
    assert of(frame.repartition(7).orderBy(F.rand(3))) == want and of(frame.withColumn("computed_at", F.lit(None))) == want
    assert of(frame.unionByName(frame.limit(1))) != want and of(frame.distinct()) != want and of(frame.withColumn("a", F.lit(1))) != want
    assert len({of(frame.limit(0)), of(frame.limit(1)), want}) == 3
    plan = table_fingerprint(frame)._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and plan.count("Exchange") == 1


def test_a_log_of_many_runs_is_few_files_and_one_run_opens_few(spark, tmp_path):
    rows = [(f"2024-01-{i % 28 + 1:02d}", "e", "hot" if i % 3 else f"r{i:05d}", i) for i in range(6000)] + [("2024-01-01", "e", None, 7), ("2024-01-02", "e", "17", 8)]
    events = spark.createDataFrame(rows, "ts string, event string, run_id string, duration_ms long").repartition(9)
    many, packed = str(tmp_path / "many"), str(tmp_path / "packed")
    for k in range(3):
        E.append_events(events.where(F.col("duration_ms") % 3 == k), many)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        E.compact_log(spark, many, packed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = list(Path(packed).rglob("*.json"))
    assert 3 <= len(files) <= 16 and len(list(Path(many).rglob("*.json"))) <= 12
    for log in (many, packed):
        assert E.read_event_log(spark, log).agg(F.sum("duration_ms"), F.count("*")).first()[:] == (sum(r[3] for r in rows), len(rows))
    for run in ("r00300", "17", "hot", "none"):
        one = E.read_event_log(spark, packed, [run])
        assert one.count() == sum(r[2] == run for r in rows)
    opened = E.read_event_log(spark, packed, ["r00300"]).select("log_file").distinct().count()
    assert opened == 1
    plan = E.read_event_log(spark, packed, ["r00300"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "run_from" in plan


@pytest.mark.parametrize("name", ["resolve_scoped", "read_runs"])
def test_new_queries_have_rows(spark, name):
    from ledgerline import queries as registry

    registry.load_all()
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
