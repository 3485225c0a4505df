"""Hot keys, NULL keys and ties, broadcast and shuffled, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.asof import asof_backfill, asof_left_join
from ledgerline.operators.catalog import apply_review
from ledgerline.operators.graph import resolve_to_base
from ledgerline.operators.rank import percent_rank_global
from ledgerline.operators.scale import lookup_left_join, running_last



def rows(df):
    return Counter(tuple(r) for r in df.collect())


def facts(n=3000):
    """A third of the rows share one key, a third of those one time; some keys are NULL."""
    rng = random.Random(7)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "gone", None])
        ts = 50 if i % 9 == 0 else rng.randrange(100)
        out.append((i, key, ts))
    return out


def rates():
    rng = random.Random(8)
    return [(k, rng.randrange(5, 95), round(rng.random(), 6), f"{k}{j}") for k in ["hot", "a", "b", "c", "idle"] for j in range(20)]


def best(rate_rows, key, ts):
    """Latest rate at or before; equal times are settled by the larger payload."""
    hits = [(t, v, s) for k, t, v, s in rate_rows if k == key and t <= ts]
    return max(hits) if hits else None


def first(rate_rows, key):
    hits = [r for r in rate_rows if r[0] == key]
    if not hits:
        return None
    start = min(r[1] for r in hits)
    return max((v, s) for _, t, v, s in hits if t == start)


def test_asof(spark, joins):
    fact_rows, rate_rows = facts(), rates()
    left = spark.createDataFrame(fact_rows, "id int, k string, t int")
    right = spark.createDataFrame(rate_rows, "k string, t int, rate double, src string")
    got = asof_left_join(left, right, "k", "k", "t", "t", {"rate": "rate", "src": "src"})
    want = Counter()
    for i, k, t in fact_rows:
        hit = best(rate_rows, k, t)
        want[(i, k, t, hit and hit[1], hit and hit[2])] += 1
    assert rows(got) == want


def test_backfill(spark, joins):
    fact_rows, rate_rows = facts(), rates()
    left = spark.createDataFrame(fact_rows, "id int, k string, t int")
    right = spark.createDataFrame(rate_rows, "k string, t int, rate double, src string")
    got = asof_backfill(left, right, "k", "k", "t", "t", "rate", "src", "b")
    want = Counter()
    for i, k, t in fact_rows:
        hit, start = best(rate_rows, k, t), first(rate_rows, k)
        if k == "b":
            rate, src = 1.0, None
        elif hit:
            rate, src = hit[1], hit[2]
        elif start:
            rate, src = start[0], start[1] + "_BACKFILL"
        else:
            rate, src = None, None
        want[(i, k, t, rate, src)] += 1
    assert rows(got) == want


def test_percent_rank(spark, joins):
    values = [(i, 0.0 if i % 3 == 0 else (None if i % 7 == 0 else float(i % 400))) for i in range(2000)]
    df = spark.createDataFrame(values, "id int, v double").repartition(8)
    got = {r["id"]: r["pr"] for r in percent_rank_global(df, "v", "pr").collect()}
    order = lambda v: (v is None, v or 0.0)
    ranked = sorted(order(v) for _, v in values)
    lower = {}
    for n, key in enumerate(ranked):
        lower.setdefault(key, n)
    assert got == {i: lower[order(v)] / (len(values) - 1) for i, v in values}


def test_percent_rank_of_one_row(spark):
    df = spark.createDataFrame([(1, 5.0)], "id int, v double")
    assert percent_rank_global(df, "v", "pr").first()["pr"] == 0.0


def test_lookup_join_keeps_null_and_unknown_keys(spark, joins):
    left = [(i, None if i % 5 == 0 else ("h" if i % 2 else f"k{i % 11}")) for i in range(500)]
    l = spark.createDataFrame(left, "a int, k string")
    table = spark.createDataFrame([("h", 1), ("k2", 2), ("k4", 3)], "k string, v int")
    got = lookup_left_join(l, table, ["k"], ["v"])
    values = {"h": 1, "k2": 2, "k4": 3}
    assert rows(got) == Counter((a, k, values.get(k)) for a, k in left)


def test_lookup_join_takes_maps_and_equal_rows(spark, joins):
    left = spark.createDataFrame([("h" if i % 3 else None, {"a": 1}) for i in range(300)], "k string, m map<string,int>")
    got = lookup_left_join(left, spark.createDataFrame([("h", 1)], "k string, v int"), ["k"], ["v"])
    assert Counter(r["v"] for r in got.collect()) == {1: 200, None: 100}


@pytest.mark.parametrize("strict", [False, True])
def test_running_last_across_partitions(spark, strict):
    rng = random.Random(3)
    data = [("h" if i % 3 else f"k{i % 7}", i, rng.choice([None, i])) for i in range(900)]
    df = spark.createDataFrame(data, "k string, t int, v int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_last(df, ["k"], ["t"], "v", "last", strict=strict, first_out="first")
        result = rows(got.select("k", "t", "last", "first"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, last, start = Counter(), {}, {}
    for k, t, v in data:
        if v is not None:
            start.setdefault(k, v)
    for k, t, v in data:
        before = last.get(k)
        if v is not None:
            last[k] = v
        want[(k, t, before if strict else last.get(k), start.get(k))] += 1
    assert result == want


def test_review_actions_on_one_hot_column(spark, joins):
    """Many actions on one column apply in order; nothing counts after a reject."""
    lineage = spark.createDataFrame(
        [("t", c, "s", f"s{i}", "pending_review", "", "") for c in ("hot", "cut", "calm") for i in range(3)],
        "target_table string, target_column string, source_table string, source_column string, review_state string, ratified_by string, ratified_at string",
    )
    acts = [(i, str(i), "ratify" if i % 2 else "downgrade", "t", "hot", f"u{i}", "") for i in range(60)]
    acts += [(1, "1", "ratify", "t", "cut", "u", ""), (2, "2", "reject", "t", "cut", "u", "bad"), (3, "3", "ratify", "t", "cut", "u", "")]
    acts += [(1, "1", "ratify", "t", "none", "u", ""), (1, "1", "bogus", "t", "calm", "u", "")]
    actions = spark.createDataFrame(
        acts, "seq int, ts string, action string, table_name string, column_name string, actor string, reason string"
    )
    new, log = apply_review(lineage, actions)
    state = {(r["target_column"], r["source_column"]): (r["review_state"], r["ratified_by"]) for r in new.collect()}
    assert state == {
        **{("hot", f"s{i}"): ("ratified", "u59") for i in range(3)},
        **{("calm", f"s{i}"): ("pending_review", "") for i in range(3)},
    }
    entries = {(r["column_name"], r["ts"]): r for r in log.collect()}
    assert len(entries) == 64
    assert entries[("hot", "0")]["actor"] == "system"
    assert entries[("hot", "7")]["from_state"] == "pending_review"
    assert (entries[("cut", "2")]["from_state"], entries[("cut", "2")]["to_state"]) == ("ratified", "absent")
    assert entries[("cut", "3")]["from_state"] == "absent"
    assert entries[("none", "1")]["reason"] == "no lineage row to update"


def test_resolve_to_base(spark, joins):
    """Stars, an unknown alias, a constant and a cycle."""
    refs = spark.createDataFrame(
        [
            ("out", "x", "cte", "x"), ("out", "y", "all", "y"), ("out", "z", "mystery", "q"), ("out", "loop", "c1", "v"),
            ("out", "k", "cte", "k"), ("cte", "x", "base", "a"), ("cte", "x", "other", "b"), ("all", "*", "cte2", "*"),
            ("cte2", "y", "base", "why"), ("c1", "v", "c2", "v"), ("c2", "v", "c1", "v"), ("c2", "v", "base", "deep"),
        ],
        "node string, column string, ref_node string, ref_column string",
    )
    base = spark.createDataFrame([("base",), ("other",)], "name string")
    got = resolve_to_base(refs, base).where(F.col("target_node") == "out")
    assert {(r["target_column"], r["source_table"], r["source_column"]) for r in got.collect()} == {
        ("x", "base", "a"), ("x", "other", "b"), ("y", "base", "why"), ("z", "mystery", "q"), ("loop", "base", "deep"),
    }


@pytest.mark.parametrize("length", [70, 130])
def test_resolve_follows_long_chains(spark, length):
    links = [(f"n{i}", "v", f"n{i + 1}", "v") for i in range(length)] + [(f"n{length}", "v", "n5", "v"), (f"n{length}", "v", "base", "v")]
    refs = spark.createDataFrame(links, "node string, column string, ref_node string, ref_column string")
    got = resolve_to_base(refs, spark.createDataFrame([("base",)], "name string"))
    assert {(r["target_node"], r["source_table"]) for r in got.collect()} == {(f"n{i}", "base") for i in range(length + 1)}
