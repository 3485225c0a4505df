"""Reviewed lineage catalog: evidence merge, upserts, review states.

Lineage is flat: one row per (target column, source column).  A target without a
known source has one row with blank source.  Nothing collects the sources of a
target into a list, so a column fed by very many others stays many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V
from ledgerline.operators.scale import lookup_left_join, running_last
from ledgerline.operators.upsert import keep_old, upsert

TARGET = ["target_table", "target_column"]
EDGE = [*TARGET, "source_table", "source_column"]
KEY = ["_t", "_c"]


def _keyed(df: DataFrame) -> DataFrame:
    """Case-insensitive key columns; NULL sources become blank."""
    src_t, src_c = F.coalesce("source_table", F.lit("")), F.coalesce("source_column", F.lit(""))
    return df.withColumns(
        {
            "source_table": src_t,
            "source_column": src_c,
            "_t": F.lower("target_table"),
            "_c": F.lower("target_column"),
            "_s": F.lower(src_t),
            "_sc": F.lower(src_c),
            "_real": (src_t != "") | (src_c != ""),
        }
    )


def _evidence(catalog: DataFrame, parsed: DataFrame, agent: DataFrame) -> DataFrame:
    """Edges of the three origins in one frame, marked by ``_from``."""
    cat = _keyed(catalog.where(F.col("review_state") == V.RATIFIED)).select(
        *EDGE, *KEY, "_s", "_sc", "_real", "expression", "transform_type", "sql_hash",
        F.lit(False).alias("ambiguous"), F.lit(1.0).alias("confidence"), F.lit("catalog").alias("_from"),
    )

    def maps(df: DataFrame, origin: str) -> DataFrame:
        return _keyed(df).select(
            *EDGE, *KEY, "_s", "_sc", "_real", F.col("full_expression").alias("expression"), "transform_type",
            "sql_hash", "ambiguous", F.col("confidence").cast("double").alias("confidence"), F.lit(origin).alias("_from"),
        )

    return cat.unionByName(maps(parsed, "parsed")).unionByName(maps(agent, "agent"))


def _decisions(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per edge: which origins have it.  Per target: which origin wins.

    Both aggregates keep flags and numbers only, so they stay hash aggregates.
    """
    def is_from(name: str) -> Column:
        return F.col("_from") == name

    per_edge = evidence.groupBy(*KEY, "_s", "_sc", "_real").agg(
        F.bool_or(is_from("catalog")).alias("in_catalog"),
        F.bool_or(is_from("parsed")).alias("in_parsed"),
        F.bool_or(is_from("agent")).alias("in_agent"),
        F.bool_or(is_from("parsed") & F.col("ambiguous")).alias("ambiguous"),
        F.max(F.when(is_from("parsed"), F.col("confidence"))).alias("confidence"),
    )
    real = F.col("_real")
    per_target = per_edge.groupBy(*KEY).agg(
        F.bool_or("in_catalog").alias("has_catalog"),
        F.bool_or("in_parsed").alias("has_parsed"),
        F.bool_or("in_agent").alias("has_agent"),
        F.bool_or("ambiguous").alias("ambiguous"),
        F.max("confidence").alias("confidence"),
        F.count_if(real & F.col("in_catalog")).alias("n_catalog"),
        F.count_if(real & F.col("in_parsed")).alias("n_parsed"),
        F.count_if(real & F.col("in_agent")).alias("n_agent"),
        F.count_if(real & F.col("in_catalog") & F.col("in_parsed")).alias("n_both"),
    )
    clear = F.col("has_parsed") & ~F.col("ambiguous")
    differ = (F.col("n_both") < F.col("n_catalog")) | (F.col("n_both") < F.col("n_parsed"))
    diverged = F.col("has_catalog") & clear & (F.col("n_catalog") > 0) & (F.col("n_parsed") > 0) & differ
    decided = per_target.where("has_catalog OR has_parsed").withColumn(
        "case",
        F.when(diverged, "diverged")
        .when(F.col("has_catalog"), "catalog")
        .when(clear & (F.col("confidence") >= 0.999), "parsed")
        .when(F.col("has_agent"), "agent")
        .otherwise("pending"),
    )
    winner = (
        F.when(F.col("case") == "catalog", "catalog").when(F.col("case") == "agent", "agent").otherwise("parsed")
    )
    n_winner = (
        F.when(winner == "catalog", F.col("n_catalog")).when(winner == "agent", F.col("n_agent")).otherwise(F.col("n_parsed"))
    )
    return per_edge, decided.withColumn("winner", winner).withColumn("n_winner", n_winner)


def _heads(evidence: DataFrame) -> DataFrame:
    """Text and hash a target's catalog rows may have to borrow, each pair from one row: that of the smallest source."""
    source = F.struct("_s", "_sc", "expression", "sql_hash")

    def of(name: str) -> Column:
        return F.min(F.when(F.col("_from") == name, source))

    heads = evidence.where(F.col("_from") != "agent").groupBy(*KEY).agg(of("parsed").alias("_parsed"), of("catalog").alias("_catalog"))
    return heads.select(
        *KEY,
        F.col("_parsed.expression").alias("parsed_expression"),
        F.col("_parsed.sql_hash").alias("parsed_hash"),
        F.col("_catalog.sql_hash").alias("catalog_hash"),
    )


DECISION = ["case", "winner", "n_winner", "parsed_expression", "parsed_hash", "catalog_hash"]


def merge_lineage(
    catalog: DataFrame, parsed: DataFrame, agent: DataFrame, sql_hash: str
) -> DataFrame:
    """One winning origin per target column, one row per winning source.

    ``catalog`` rows count only when ratified.  ``parsed`` and ``agent`` carry the
    map's full_expression, ambiguous, confidence and sql_hash on every row.  The
    source sets of catalog and parser are compared by counting common edges.  Each
    origin names a source of a target at most once.
    """
    evidence = _evidence(catalog, parsed, agent)
    decided = _decisions(evidence)[1].join(_heads(evidence), KEY, "left")
    joined = lookup_left_join(evidence, decided, KEY, DECISION)
    # A blank source stands for "no source known" and yields to any real one.
    won = joined.where((F.col("_from") == F.col("winner")) & (F.col("_real") | (F.col("n_winner") == 0)))
    from_catalog = F.col("winner") == "catalog"

    def filled(*cols: str) -> Column:
        return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cols], F.lit(""))

    source = (
        F.when(from_catalog, V.CATALOG)
        .when(F.col("case") == "agent", V.AGENT)
        .when((F.col("case") == "pending") & (F.col("n_winner") == 0), V.UNRESOLVED)
        .otherwise(V.PARSED)
    )
    state = F.when(F.col("case").isin("agent", "pending"), V.PENDING).otherwise(V.RATIFIED)
    own_hash = F.when(from_catalog, filled("parsed_hash", "catalog_hash")).otherwise(filled("sql_hash"))
    return won.select(
        *EDGE,
        F.when(from_catalog, filled("expression", "parsed_expression")).otherwise(F.col("expression")).alias("expression"),
        "transform_type",
        F.when(from_catalog, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        source.alias("source"),
        state.alias("review_state"),
        F.when(own_hash != "", own_hash).otherwise(F.lit(sql_hash)).alias("sql_hash"),
    )


def divergences(
    catalog: DataFrame, parsed: DataFrame, sql_hash: str
) -> DataFrame:
    """Sources of every target on which a ratified catalog and a clear parse differ.

    One row per source with the sides that name it, in place of two lists.
    """
    evidence = _evidence(catalog, parsed, parsed.limit(0))
    per_edge, decided = _decisions(evidence)
    split = decided.where(F.col("case") == "diverged").join(_heads(evidence), KEY)
    edges = lookup_left_join(
        per_edge.where("_real").select(*KEY, "_s", "_sc", "in_catalog", "in_parsed"),
        split.select(*KEY, "case", F.col("catalog_hash").alias("catalog_sql_hash")),
        KEY, ["case", "catalog_sql_hash"],
    )
    return edges.where(F.col("case").isNotNull()).select(
        F.col("_t").alias("target_table"),
        F.col("_c").alias("target_column"),
        F.col("_s").alias("source_table"),
        F.col("_sc").alias("source_column"),
        "in_catalog",
        "in_parsed",
        "catalog_sql_hash",
        F.lit(sql_hash).alias("current_sql_hash"),
    )


def emit_edges(
    maps: DataFrame, default_source: str = V.PARSED, auto_ratify: bool = True, manifest_hash: str = "", ts: str = ""
) -> DataFrame:
    """Catalog rows of column maps whose ``sources`` is an array of edges.

    A map without sources gives one row with blank source.  State and source of
    the map win over the defaults; a clear parse is ratified by default.
    """
    def given(c: str) -> Column:
        return F.when(F.trim(c) != "", F.trim(c))

    rows = maps.select("*", F.explode_outer("sources").alias("_s"))
    source = F.coalesce(given("source"), F.lit(default_source))
    ratify = F.lit(auto_ratify) & (source == V.PARSED) & (F.col("confidence") >= 0.999)
    return rows.select(
        *TARGET,
        F.coalesce("_s.source_table", F.lit("")).alias("source_table"),
        F.coalesce("_s.source_column", F.lit("")).alias("source_column"),
        F.col("full_expression").alias("expression"),
        F.coalesce("_s.transform_type", F.lit("")).alias("transform_type"),
        F.col("confidence").cast("double").alias("confidence"),
        source.alias("source"),
        F.coalesce(given("review_state"), F.when(ratify, V.RATIFIED).otherwise(V.PENDING)).alias("review_state"),
        F.lit("").alias("ratified_by"),
        F.lit("").alias("ratified_at"),
        F.coalesce(given("sql_hash"), F.lit(manifest_hash)).alias("sql_hash"),
        F.lit(ts).alias("computed_at"),
    )


def upsert_lineage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Emitted edges into the catalog; a ratified state and its ratifier stay."""
    return upsert(
        old,
        new,
        EDGE,
        {
            "source": lambda o, n: F.when(o == V.CATALOG, o).otherwise(n),
            "review_state": lambda o, n: F.when(o == V.RATIFIED, o).otherwise(n),
            "ratified_by": lambda o, n: F.coalesce(o, F.lit("")),
            "ratified_at": lambda o, n: F.coalesce(o, F.lit("")),
        },
        on_insert={"ratified_by": lambda o, n: F.lit(""), "ratified_at": lambda o, n: F.lit("")},
    )


def upsert_description(old: DataFrame, new: DataFrame) -> DataFrame:
    """Descriptions arrive as pending, update ratified ones in place, and may not be empty."""
    batch = new.where(F.coalesce(F.col("description"), F.lit("")) != "")
    return upsert(
        old,
        batch,
        ["table_name", "column_name"],
        {
            "review_state": lambda o, n: F.when(o == V.RATIFIED, o).otherwise(V.PENDING),
            "ratified_by": keep_old,
            "ratified_at": keep_old,
        },
        on_insert={
            "review_state": lambda o, n: F.lit(V.PENDING),
            "ratified_by": lambda o, n: F.lit(""),
            "ratified_at": lambda o, n: F.lit(""),
        },
    )


def upsert_certifications(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["table_name"])


def review_states(lineage: DataFrame) -> DataFrame:
    """State of each target: the smallest of its edges' states, so pending wins."""
    return lineage.groupBy(*TARGET).agg(F.min("review_state").alias("review_state"))


def apply_review(
    lineage: DataFrame, actions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Ratify, downgrade and reject a batch: (new lineage, audit rows).

    ``actions``: seq, ts, action, table_name, column_name, actor, reason.  Actions
    on one column apply in ``seq`` order.  Every action is audited; a column
    without lineage, or rejected earlier in the batch, is not updated.
    """
    to_state = (
        F.when(F.col("action") == "ratify", V.RATIFIED)
        .when(F.col("action") == "downgrade", V.PENDING)
        .when(F.col("action") == "reject", V.ABSENT)
    )
    on = ["table_name", "column_name"]
    batch = actions.withColumn("to_state", to_state).where(F.col("to_state").isNotNull())
    # Downgrades are the system's own, whoever is named.
    batch = batch.withColumn("actor", F.when(F.col("action") == "downgrade", "system").otherwise(F.col("actor")))

    before = review_states(lineage).select(
        F.col("target_table").alias("table_name"), F.col("target_column").alias("column_name"),
        F.col("review_state").alias("initial"),
    )
    gone = batch.groupBy(*on).agg(F.min(F.when(F.col("action") == "reject", F.col("seq"))).alias("rejected_at"))
    keyed = gone.join(before, on, "left")
    ordered = running_last(batch, on, ["seq"], "to_state", "_prev", strict=True)
    known = lookup_left_join(ordered, keyed, on, ["initial", "rejected_at"])
    absent = F.col("initial").isNull() | (F.col("rejected_at") < F.col("seq"))
    from_state = F.when(absent, V.ABSENT).otherwise(F.coalesce("_prev", "initial"))
    reason = F.when(
        (from_state == V.ABSENT) & (F.col("action") != "reject") & (F.coalesce(F.col("reason"), F.lit("")) == ""),
        "no lineage row to update",
    ).otherwise(F.col("reason"))
    log = known.select("ts", "action", *on, "actor", from_state.alias("from_state"), "to_state", reason.alias("reason"))

    final = batch.groupBy(*on).agg(
        F.max_by(F.struct("to_state", "actor", "ts"), "seq").alias("_last"),
        F.bool_or(F.col("action") == "reject").alias("_rejected"),
    ).select(
        F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"), "_last", "_rejected"
    )
    marked = lookup_left_join(lineage, final, TARGET, ["_last", "_rejected"])
    kept = marked.where(~F.coalesce("_rejected", F.lit(False)))
    ratified = F.col("_last.to_state") == V.RATIFIED
    hit = F.col("_last").isNotNull()
    changed = {
        "review_state": F.when(hit, F.col("_last.to_state")).otherwise(F.col("review_state")),
        "ratified_by": F.when(hit, F.when(ratified, F.col("_last.actor")).otherwise("")).otherwise(F.col("ratified_by")),
        "ratified_at": F.when(hit, F.when(ratified, F.col("_last.ts")).otherwise("")).otherwise(F.col("ratified_at")),
    }
    return kept.withColumns(changed).select(*lineage.columns), log


def set_review_state(lineage, actions):
    """Ratify and downgrade actions; see ``apply_review``."""
    return apply_review(lineage, actions.where(F.col("action").isin("ratify", "downgrade")))


def reject(lineage, actions):
    """Reject actions: the target's edges go, the audit row stays."""
    return apply_review(lineage, actions.where(F.col("action") == "reject"))


def downgrade_diverged(diverged: DataFrame, ts: str) -> DataFrame:
    """Downgrade actions, one per diverged target."""
    return diverged.select(
        F.col("target_table").alias("table_name"), F.col("target_column").alias("column_name")
    ).distinct().select(
        F.lit(0).cast("bigint").alias("seq"), F.lit(ts).alias("ts"), F.lit("downgrade").alias("action"),
        "table_name", "column_name", F.lit("system").alias("actor"),
        F.lit("parsed sources differ from the catalog").alias("reason"),
    )


def get_edges(lineage: DataFrame, table: str) -> DataFrame:
    return lineage.where(F.col("target_table") == table)


def pending_edges(lineage: DataFrame) -> DataFrame:
    return lineage.where(F.col("review_state") == V.PENDING)


def ratified_for_target(lineage: DataFrame, table: str, column: str) -> DataFrame:
    return lineage.where(
        (F.col("target_table") == table) & (F.col("target_column") == column) & (F.col("review_state") == V.RATIFIED)
    )


def certification(certs: DataFrame, table: str) -> DataFrame:
    return certs.where(F.col("table_name") == table).select("table_name", "profile")


def pending_sources(lineage: DataFrame) -> DataFrame:
    """Pending targets with their sources, one row per source.

    Header fields come from the target's first row in source order; a target
    whose only row has no source keeps one row with NULL source.
    """
    pending = pending_edges(lineage)
    real = (F.col("source_table") != "") | (F.col("source_column") != "")
    header = pending.groupBy(*TARGET).agg(
        F.min_by(F.struct("source", "confidence", "computed_at", "sql_hash"), F.struct("source_table", "source_column")).alias("_h"),
        F.count_if(real).alias("source_count"),
    )
    rows = lookup_left_join(
        pending.select(*EDGE, "transform_type", real.alias("_real")), header, TARGET, ["_h", "source_count"],
    )

    def shown(c: str) -> Column:
        return F.when(F.col("_real"), F.col(c)).alias(c)

    return rows.where(F.col("_real") | (F.col("source_count") == 0)).select(
        *TARGET,
        F.col("_h.source").alias("source"),
        F.col("_h.confidence").alias("confidence"),
        F.col("_h.computed_at").alias("awaiting_since"),
        F.col("_h.sql_hash").alias("sql_hash"),
        "source_count",
        shown("source_table"),
        shown("source_column"),
        shown("transform_type"),
    )


def catalog_counts(lineage: DataFrame, certs: DataFrame) -> DataFrame:
    """Lineage rows, certifications, pending targets and ratified rows."""
    pending = F.col("review_state") == V.PENDING
    # Per target first, so the distinct count is a plain sum.
    per_target = lineage.groupBy(*TARGET).agg(F.count(F.lit(1)).alias("_n"), F.count_if(pending).alias("_p"))
    n_certs = certs.agg(F.count(F.lit(1))).scalar()
    return per_target.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("lineage_count"),
        F.count_if(F.col("_p") > 0).alias("pending_count"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("_pending_rows"),
    ).select(
        "lineage_count",
        n_certs.alias("certifications_count"),
        "pending_count",
        F.greatest(F.lit(0).cast("bigint"), F.col("lineage_count") - F.col("_pending_rows")).alias("ratified_count"),
    )


def topn_activity(log: DataFrame, limit: int = 20) -> DataFrame:
    """Latest review-log rows; rows of one instant are ordered by their other fields."""
    rest = [c for c in log.columns if c != "ts"]
    return log.orderBy(F.col("ts").desc(), *rest).limit(limit)
