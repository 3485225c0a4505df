"""Runs and data-quality results read back from the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V


def _is(event: str):
    return F.col("event") == event


def last_event_wins(events: DataFrame, order: str = "pos") -> DataFrame:
    """Latest completion event of each (run, stage)."""
    done = events.where(_is("stage_complete") & F.col("stage").isNotNull())
    rest = [c for c in done.columns if c not in ("run_id", "stage")]
    picked = done.groupBy("run_id", "stage").agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select("run_id", "stage", "_r.*")


def run_summary(events: DataFrame, order: str = "pos") -> DataFrame:
    """One row per run.

    Status is the completion event's, else ``ok`` when every stage is ok (also
    with no stage at all), else ``unknown``.  ``stages`` lists the distinct stage
    names of the run, after they were reduced to one row each.
    """
    heads = events.groupBy("run_id").agg(
        F.max_by("ts", F.when(_is("pipeline_start"), F.col(order))).alias("started_at"),
        F.max_by("duration_ms", F.when(_is("pipeline_complete"), F.col(order))).alias("duration_ms"),
        F.max_by("status", F.when(_is("pipeline_complete"), F.col(order))).alias("_status"),
        F.count_if(_is("data_quality_check")).alias("dq_total"),
        F.count_if(_is("data_quality_check") & F.col("passed")).alias("dq_passed"),
    )
    stages = last_event_wins(events, order).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stage_count"),
        F.bool_and(F.coalesce("status", F.lit("ok")) == "ok").alias("_all_ok"),
        F.array_join(F.array_sort(F.collect_list("stage")), ",").alias("stages"),
    )
    status = F.coalesce(
        F.when(F.col("_status") != "", F.col("_status")),
        F.when(F.coalesce("_all_ok", F.lit(True)), "ok").otherwise("unknown"),
    )
    return heads.join(stages, "run_id", "left").select(
        "run_id",
        "started_at",
        "duration_ms",
        status.alias("status"),
        F.coalesce("stage_count", F.lit(0)).alias("stage_count"),
        F.coalesce("stages", F.lit("")).alias("stages"),
        "dq_total",
        "dq_passed",
    )


DQ_COLUMNS = ["check_name", "passed", "expected", "actual", "rows_checked", "rows_failed"]


def run_detail(events: DataFrame, run_id: str | None = None) -> DataFrame:
    """Data-quality rows of one run, or of all."""
    rows = events.where(_is("data_quality_check"))
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    return rows.select("run_id", F.coalesce("stage", F.lit("?")).alias("stage"), *DQ_COLUMNS)


def dq_by_stage(events: DataFrame, run_id: str | None = None) -> DataFrame:
    """Checks per run and stage."""
    return run_detail(events, run_id).groupBy("run_id", "stage").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if("passed").alias("checks_passed"),
        F.coalesce(F.sum("rows_failed"), F.lit(0)).alias("rows_failed"),
    )


def run_history(events: DataFrame, order: str = "pos") -> DataFrame:
    """Registry view of each run: status, failed stage, durations, from the log.

    A run that never completed is ``running``; the failed stage is the first one
    with a non-zero exit.
    """
    failed = F.col("event").isin("orchestrator_stage_failed", "orchestrator_stage_exception")
    failed = failed & (F.coalesce("exit_code", F.lit(1)) != 0)
    per_run = events.groupBy("run_id").agg(
        F.min(F.when(_is("pipeline_start"), F.col("ts"))).alias("started_at"),
        F.max(F.when(_is("pipeline_complete"), F.col("ts"))).alias("ended_at"),
        F.min_by(F.coalesce("stage_name", "stage"), F.when(failed, F.col(order))).alias("failed_stage"),
        F.count_if(_is("pipeline_complete")).alias("_done"),
        F.max(F.when(_is("pipeline_complete"), F.col("duration_ms"))).alias("duration_ms"),
        F.sum(F.when(_is("stage_complete"), F.col("duration_ms"))).alias("stage_ms"),
    )
    status = F.when(F.col("failed_stage").isNotNull(), "failed").when(F.col("_done") > 0, "ok").otherwise("running")
    return per_run.select("run_id", "started_at", "ended_at", status.alias("status"), "failed_stage", "duration_ms", "stage_ms")


def runs_latest_first(runs: DataFrame, by: str = "modified_at") -> DataFrame:
    return runs.orderBy(F.col(by).desc(), "run_id")


def catalog_hit_rate(events: DataFrame, run_id=None) -> DataFrame:
    """Share of columns answered by the catalog, 4 digits; of all runs or of one."""
    rows = events.where(_is("lineage_manifest_complete"))
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    return rows.agg(
        F.coalesce(F.sum("catalog_hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("catalog_misses"), F.lit(0)).alias("misses")
    ).select(
        "hits",
        "misses",
        F.when(F.col("hits") + F.col("misses") == 0, 0.0)
        .otherwise(F.round(F.col("hits").cast("double") / (F.col("hits") + F.col("misses")), 4))
        .alias("hit_rate"),
    )


def dashboard_metrics(runs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: runs, nodes and edges by label, the latest run and its pass rate.

    ``runs`` is ``run_summary``; ``nodes`` and ``edges`` have a ``label``.
    """
    latest = F.max_by(F.struct("run_id", "dq_passed", "dq_total"), F.struct("started_at", "run_id"))
    head = runs.agg(F.count(F.lit(1)).alias("runs_total"), latest.alias("_l"))
    node = nodes.agg(F.struct(*[F.count_if(F.col("label") == l).alias(l) for l in V.NODE_LABELS])).scalar()
    edge = edges.agg(F.struct(*[F.count_if(F.col("label") == l).alias(l) for l in V.EDGE_LABELS])).scalar()
    rate = F.when(
        F.col("_l.dq_total") > 0,
        F.concat(F.col("_l.dq_passed").cast("string"), F.lit("/"), F.col("_l.dq_total").cast("string")),
    ).otherwise("—")

    def total(counts, label: str):
        return counts[label].alias(label.lower() + "_total")

    return head.select(
        "runs_total",
        F.col("_l.run_id").alias("latest_run"),
        rate.alias("dq_pass_rate"),
        *[total(node, l) for l in V.NODE_LABELS],
        *[total(edge, l) for l in V.EDGE_LABELS],
    )
