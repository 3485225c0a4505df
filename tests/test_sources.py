"""Event log lines, log files of one run, and manifests, in the shapes that real files have."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.text import transform_shape
from ledgerline.operators.runs import last_event_wins
from ledgerline.operators.upsert import upsert
from ledgerline.sources import eventlog as E
from ledgerline.sources import landing as L
from ledgerline.sources import tables as S


def test_only_whole_json_objects_are_events(spark):
    good = ['{"event":"a"}', '\t{"event":"c", "stage":"}{"} ', '{"event":"d","derived_columns":{"x":"y"}}', '{"event":"e","source_tables":["a"]}']
    bad = ['{"event":"a"} trailing', "{'event':'b'}", '{"event":"a"}{"event":"b"}', '{"event":"a"},{"event":"b"}', "", "  ", '["event"]', '{"event":', "7"]
    lines = spark.createDataFrame([(x,) for x in good + bad], "value string")
    assert sorted(r["event"] for r in E.parse_lines(lines).collect()) == ["a", "c", "d", "e"]


def test_the_last_event_of_a_run_wins_over_its_files(spark, tmp_path):
    kinds = [("2024-01-01", "failed"), ("2024-01-02", "ok")]
    for name, order in (("x", [0, 1]), ("y", [1, 0])):
        folder = tmp_path / name
        folder.mkdir()
        for k, i in enumerate(order):
            ts, status = kinds[i]
            event = {"ts": ts, "event": "stage_complete", "stage": "s", "run_id": "r", "status": status}
            (folder / f"{k}.jsonl").write_text(json.dumps(event) + "\n" + "\n" * (1000 * i))
        events = E.read_event_log(spark, str(folder))
        assert [r["status"] for r in last_event_wins(events).collect()] == ["ok"]


def test_appended_runs_are_few_files_and_read_back(spark, tmp_path):
    rows = [(f"2024-01-{i % 28 + 1:02d}", "e", f"r{i % 3}", i) for i in range(300)]
    events = spark.createDataFrame(rows, "ts string, event string, run_id string, duration_ms long").repartition(20)
    E.append_events(events, str(tmp_path / "log"))
    assert len(list((tmp_path / "log").glob("run_from=*/run_to=*/*.json"))) <= 6
    assert E.read_event_log(spark, str(tmp_path / "log")).agg(F.sum("duration_ms")).first()[0] == sum(range(300))


@pytest.mark.parametrize("tail", [" garbage", "{}", "]"])
def test_text_after_a_manifest_fails_it(spark, tmp_path, tail):
    root = str(tmp_path)
    L.export_landing(spark.range(5).withColumnRenamed("id", "k"), root, "core_banking", "branch", override="2024-01-01")
    expected = [("core_banking", "branch", "src_branch")]
    assert L.validate_manifest(spark, root, expected, "2024-01-01").first()["passed"]
    path = next(tmp_path.rglob("_manifest.json"))
    path.write_text(path.read_text() + tail)
    for sidecar in tmp_path.rglob("._manifest.json.crc"):
        sidecar.unlink()
    row = L.validate_manifest(spark, root, expected, "2024-01-01").first()
    assert not row["passed"] and row["reason"] == "_manifest.json invalid JSON"


def test_an_empty_zone_fails_every_feed(spark, tmp_path):
    checked = L.validate_manifest(spark, str(tmp_path), [("a", "b", "c")], "2024-01-01")
    rows = L.reconcile_row_counts(spark, checked).collect()
    assert [(r["sor"], r["expected"], r["passed"]) for r in rows] == [("a", -1, False)]


def test_shapes_of_expressions(spark):
    want = {
        "interval '1' day + x": "TRANSFORM", "'sum(x)'||a": "TRANSFORM", "stddev_samp(x)": "AGGREGATE", "array_agg(x)": "AGGREGATE",
        "1 + 2": "CONSTANT", "count(*)": "CONSTANT", "date '2024-01-01'": "CONSTANT", "cast(null as varchar)": "CONSTANT",
        "lag(x) over (order by y)": "AGGREGATE", "rank() over (order by y)": "WINDOW", "t.x": "PASSTHROUGH", "y": "RENAME", "date": "RENAME",
        "case when 'a' = 'b' then 1 end": "CONSTANT", "case when a.x > 0 then b.y end": "AMBIGUOUS",
    }
    rows = spark.createDataFrame([(k,) for k in want], "e string")
    got = {r[0]: r[1] for r in rows.select("e", transform_shape(F.col("e"), F.lit("x"), F.lit(2))).collect()}
    assert got == want


def test_a_repeated_key_of_a_batch_is_one_row(spark):
    old = spark.createDataFrame([("a", 1, "t0")], "k string, v int, computed_at string")
    new = spark.createDataFrame([("a", 9, "t1"), ("a", 2, "t2"), ("b", 3, "t1"), ("b", 3, "t1")], old.schema)
    assert sorted(tuple(r) for r in upsert(old, new, ["k"]).collect()) == [("a", 2, "t2"), ("b", 3, "t1")]


def test_a_refill_fills_defaults_and_swaps_all_or_nothing(spark, tmp_path):
    root, target = str(tmp_path / "landing"), str(tmp_path / "tables")
    feeds = [("a", "x", "src_x"), ("a", "y", "src_y")]
    shape = spark.createDataFrame([], "k long, state string, note string").schema
    for n in (3, 5):
        for _, entity, _ in feeds:
            L.export_landing(spark.range(n).withColumnRenamed("id", "k"), root, "a", entity, override=f"2024-01-0{n}")
        L.ingest(spark, root, f"2024-01-0{n}", target, feeds, {"src_x": shape}, {"src_x": {"state": "new"}})
        rows = spark.read.parquet(f"{target}/src_x").collect()
        assert len(rows) == n and {(r["state"], r["note"]) for r in rows} == {("new", None)}
        assert spark.read.parquet(f"{target}/src_y").count() == n
    with pytest.raises(OSError):
        S.swap_tables(spark, {f"{target}/src_x": f"{target}/src_y", f"{target}/src_z": f"{target}/nothing"})
    assert spark.read.parquet(f"{target}/src_x").columns == ["k", "state", "note"] and spark.read.parquet(f"{target}/src_y").count() == 5
