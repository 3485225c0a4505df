"""Graph tables kept up to date from manifests, one batch at a time.

A graph is four frames: ``dataset``, ``process``, ``column`` and ``edge`` (see
``EMPTY`` for their columns).  Every step is an upsert join, so ingesting the same
batch twice leaves the graph as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import values as V
from ledgerline.functions.text import column_refs, infer_layer
from ledgerline.operators.scale import lookup_left_join
from ledgerline.operators.upsert import keep_old, upsert

EMPTY = {
    "dataset": "name string, layer string, row_count bigint, computed_at string",
    "process": "pk string, stage string, run_id string, transform_type string, target_table string, "
    "duration_ms bigint, output_row_count bigint, computed_at string, sql_hash string",
    "column": "pk string, column_name string, dataset_name string, derivation string, computed_at string, "
    "expression string, semantic_description string, confidence double, transform_type string, "
    "data_type string, sql_hash string, source string, review_state string",
    "edge": "label string, src_id string, dst_id string",
}


def empty_graph(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in EMPTY.items()}


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _given(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def upsert_dataset(old: DataFrame, seen: DataFrame) -> DataFrame:
    """``seen``: name, row_count, computed_at, several rows per name allowed.

    A count of 0 means "not known" and never replaces a real one; layer and
    creation time are set once.
    """
    known = F.col("row_count") != 0
    new = seen.groupBy("name").agg(
        F.coalesce(F.max_by("row_count", F.when(known, F.struct("computed_at", "row_count"))), F.lit(0)).alias("row_count"),
        F.min("computed_at").alias("computed_at"),
    ).select("name", infer_layer(F.col("name")).alias("layer"), "row_count", "computed_at")
    return upsert(
        old,
        new,
        ["name"],
        {
            "layer": keep_old,
            "computed_at": keep_old,
            "row_count": lambda o, n: F.when(n == 0, F.coalesce(o, F.lit(0))).otherwise(n),
        },
    )


def upsert_process(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest run of each stage::run wins; its creation time is kept."""
    return upsert(old, new, ["pk"], {"computed_at": keep_old, "stage": keep_old, "run_id": keep_old})


def _column_rules() -> tuple[dict, dict]:
    """Review rules: ratified is never downgraded and keeps its catalog origin."""
    old_state, old_source = F.col("o.review_state"), F.col("o.source")

    def state(o: Column, n: Column) -> Column:
        wanted = F.coalesce(_given(n), _given(o), F.lit(V.PENDING))
        return F.when((o == V.RATIFIED) & (wanted == V.PENDING), o).otherwise(wanted)

    def origin(o: Column, n: Column) -> Column:
        wanted = F.coalesce(_given(n), _given(o), F.lit(V.UNRESOLVED))
        return F.when((old_state == V.RATIFIED) & (old_source == V.CATALOG), o).otherwise(wanted)

    rules = {
        "computed_at": keep_old,
        "column_name": keep_old,
        "dataset_name": keep_old,
        "semantic_description": lambda o, n: F.coalesce(n, o, F.lit("")),
        "review_state": state,
        "source": origin,
    }
    inserts = {
        "semantic_description": lambda o, n: _blank(n),
        "review_state": lambda o, n: F.coalesce(_given(n), F.lit(V.PENDING)),
        "source": lambda o, n: F.coalesce(_given(n), F.lit(V.UNRESOLVED)),
    }
    return rules, inserts


def upsert_column(old: DataFrame, new: DataFrame) -> DataFrame:
    """All properties are replaced but the description; NULL state or source keeps the old."""
    rules, inserts = _column_rules()
    return upsert(old, new, ["pk"], rules, inserts)


def upsert_column_stub(
    old: DataFrame, stubs: DataFrame, data_types: DataFrame | None = None, curated: DataFrame | None = None
) -> DataFrame:
    """Make sure source columns exist: dataset_name, column_name, computed_at.

    Columns of ``src_`` tables are forced to catalog/ratified/1.0 and take their
    type and, unless a steward wrote one, their curated description.  Any other
    column is created unresolved, and left alone if it is there.
    """
    spark = old.sparkSession
    none = spark.createDataFrame([], "dataset_name string, column_name string, data_type string, description string")
    types = (data_types if data_types is not None else none).select("dataset_name", "column_name", F.col("data_type").alias("_type"))
    texts = (curated if curated is not None else none).select("dataset_name", "column_name", F.col("description").alias("_text"))
    on = ["dataset_name", "column_name"]
    src = F.col("dataset_name").startswith("src_")
    # Rows are dealt by their key while they are narrow; what follows from the one that ``upsert`` would take is filled in then.
    pk = F.concat_ws("::", "dataset_name", "column_name")
    first = F.max(F.struct("computed_at", "column_name", "dataset_name", _blank(F.col("_text")).alias("_text"), _blank(F.col("_type")).alias("_type")))
    new = (
        stubs.groupBy(*on)
        .agg(F.min("computed_at").alias("computed_at"))
        .join(types, on, "left")
        .join(texts, on, "left")
        .repartition(pk)
        .groupBy(pk.alias("pk"))
        .agg(first.alias("_r"))
        .select("pk", "_r.*")
        .select(
            "pk",
            "column_name",
            "dataset_name",
            F.lit("").alias("derivation"),
            "computed_at",
            F.lit("").alias("expression"),
            F.when(src, _blank(F.col("_text"))).otherwise("").alias("semantic_description"),
            F.when(src, 1.0).otherwise(0.0).alias("confidence"),
            F.when(src, "PASSTHROUGH").otherwise("").alias("transform_type"),
            F.when(src, _blank(F.col("_type"))).otherwise("").alias("data_type"),
            F.lit("").alias("sql_hash"),
            F.when(src, V.CATALOG).otherwise(V.UNRESOLVED).alias("source"),
            F.when(src, V.RATIFIED).otherwise(V.PENDING).alias("review_state"),
        )
    )
    is_src = F.col("pk").startswith("src_")
    rules = {c: keep_old for c in old.columns if c != "pk"}
    for name in ("source", "review_state", "confidence", "data_type"):
        rules[name] = lambda o, n: F.when(is_src, n).otherwise(o)
    rules["semantic_description"] = lambda o, n: F.when(is_src & (_blank(o) == ""), n).otherwise(o)
    return upsert(old, new, ["pk"], rules)


def upsert_edge(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.select("label", "src_id", "dst_id")).dropDuplicates()


def _edge(df: DataFrame, label: str, src: Column, dst: Column) -> DataFrame:
    return df.select(F.lit(label).alias("label"), src.alias("src_id"), dst.alias("dst_id"))


def process_pk(stage: Column, run_id: Column) -> Column:
    return F.concat_ws("::", stage, run_id)


def column_pk(table: Column, column: Column) -> Column:
    return F.concat_ws("::", table, column)


def missing_dependency(depends: DataFrame, processes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges to known processes, rows whose process is missing)."""
    known = processes.select(F.col("pk").alias("dst_id"), F.lit(True).alias("_known"))
    marked = lookup_left_join(depends, known, ["dst_id"], ["_known"])
    return marked.where("_known").drop("_known"), marked.where("_known IS NULL").drop("_known")


def derivation_edges(manifests: DataFrame) -> DataFrame:
    """Column to source column for each ``table.column`` in a derivation text.

    Only tables the manifest reads or writes are trusted, so numbers and interval
    units that look like a reference are dropped; self-references are too.
    """
    cols = manifests.select("target_table", "source_tables", "ts", F.explode("derived_columns").alias("column", "derivation"))
    refs = cols.select("*", F.explode(column_refs(F.col("derivation"))).alias("r")).select(
        "*", F.col("r.table").alias("source_table"), F.col("r.column").alias("source_column")
    )
    trusted = F.array_contains("source_tables", F.col("source_table")) | (F.col("source_table") == F.col("target_table"))
    itself = (F.col("source_table") == F.col("target_table")) & (F.col("source_column") == F.col("column"))
    return refs.where(trusted & ~itself).select(
        "target_table", F.col("column").alias("target_column"), "source_table", "source_column", "ts"
    )


def _structure(graph: dict, runs: DataFrame, processes: DataFrame) -> tuple[dict, DataFrame]:
    """Datasets, processes and the edges around them; also the missing dependencies."""
    inputs = runs.select("*", F.explode("source_tables").alias("source_table"))
    seen = runs.select(
        F.col("target_table").alias("name"), F.coalesce("output_row_count", F.lit(0)).alias("row_count"), F.col("ts").alias("computed_at")
    ).unionByName(
        inputs.select(F.col("source_table").alias("name"), F.lit(0).cast("bigint").alias("row_count"), F.col("ts").alias("computed_at"))
    )
    process = upsert_process(graph["process"], processes)
    pk = process_pk(F.col("stage"), F.col("run_id"))
    depends = _edge(
        runs.select("*", F.explode("depends_on_stages").alias("dep")), "DEPENDS_ON", pk, process_pk(F.col("dep"), F.col("run_id"))
    )
    linked, missing = missing_dependency(depends, process)
    edge = upsert_edge(
        graph["edge"],
        _edge(inputs, "INPUT_TO", F.col("source_table"), pk)
        .unionByName(_edge(runs, "PRODUCES", pk, F.col("target_table")))
        .unionByName(linked),
    )
    return {"dataset": upsert_dataset(graph["dataset"], seen), "process": process, "edge": edge, "column": graph["column"]}, missing


def ingest_manifests(
    graph: dict, manifests: DataFrame, metrics: DataFrame, data_types: DataFrame | None = None, curated: DataFrame | None = None
) -> tuple[dict, DataFrame]:
    """A batch of logged manifests into the graph: (graph, missing dependencies)."""
    from ledgerline.operators.upsert import latest

    done = latest(metrics.select("run_id", "stage", "ts", "output_row_count", "duration_ms"), ["run_id", "stage"], "ts").drop("ts")
    runs = manifests.join(done, ["run_id", "stage"], "left")
    processes = latest(
        runs.select(
            process_pk(F.col("stage"), F.col("run_id")).alias("pk"), "stage", "run_id", "transform_type", "target_table",
            F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
            F.coalesce("output_row_count", F.lit(0)).alias("output_row_count"),
            F.col("ts").alias("computed_at"), F.lit("").alias("sql_hash"),
        ),
        ["pk"],
        F.struct("computed_at", "target_table"),
    )
    out, missing = _structure(graph, runs, processes)

    derived = manifests.select("target_table", "ts", F.explode("derived_columns").alias("column", "derivation"))
    none = F.lit(None).cast("string")
    targets = latest(
        derived.select(
            column_pk(F.col("target_table"), F.col("column")).alias("pk"), F.col("column").alias("column_name"),
            F.col("target_table").alias("dataset_name"), F.col("derivation"), F.col("ts").alias("computed_at"),
            F.lit("").alias("expression"), none.alias("semantic_description"), F.lit(0.0).alias("confidence"),
            F.lit("").alias("transform_type"), F.lit("").alias("data_type"), F.lit("").alias("sql_hash"),
            none.alias("source"), none.alias("review_state"),
        ),
        ["pk"],
        F.struct("computed_at", "derivation"),
    )
    links = derivation_edges(manifests)
    return _attach_columns(out, targets, links, data_types, curated), missing


def transform_type_of_target(maps: DataFrame, *more: Column) -> DataFrame:
    """One row per target: its first source's type, else AMBIGUOUS or CONSTANT; ``more`` aggregates are found in the same pass."""
    real = F.coalesce(F.col("source_table"), F.lit("")) != ""
    order = F.struct("source_table", "source_column")
    return maps.groupBy("target_table", "target_column").agg(
        F.coalesce(
            F.min_by(F.when(real, F.col("transform_type")), F.when(real, order)),
            F.when(F.bool_or("ambiguous"), "AMBIGUOUS").otherwise("CONSTANT"),
        ).alias("transform_type"),
        *more,
    )


def ingest_column_maps(
    graph: dict, runs: DataFrame, maps: DataFrame, data_types: DataFrame | None = None, curated: DataFrame | None = None
) -> tuple[dict, DataFrame]:
    """Merged lineage of a batch of stages into the graph.

    ``runs``: stage, run_id, ts, target_table, source_tables, depends_on_stages,
    transform_type, duration_ms, output_row_count, sql_hash.  ``maps``: the rows of
    ``merge_lineage`` plus ambiguous, data_type and ts.
    """
    processes = runs.select(
        process_pk(F.col("stage"), F.col("run_id")).alias("pk"), "stage", "run_id", "transform_type", "target_table",
        "duration_ms", "output_row_count", F.col("ts").alias("computed_at"), "sql_hash",
    )
    out, missing = _structure(graph, runs, processes)
    on = ["target_table", "target_column"]
    heads = transform_type_of_target(
        maps,
        F.max_by(F.struct("expression", "confidence", "data_type", "sql_hash", "source", "review_state"), "ts").alias("h"),
        F.min("ts").alias("ts"),
    )
    targets = heads.select(
        column_pk(F.col("target_table"), F.col("target_column")).alias("pk"), F.col("target_column").alias("column_name"),
        F.col("target_table").alias("dataset_name"), F.col("h.expression").alias("derivation"), F.col("ts").alias("computed_at"),
        F.col("h.expression").alias("expression"), F.lit(None).cast("string").alias("semantic_description"),
        F.col("h.confidence").alias("confidence"), "transform_type", F.col("h.data_type").alias("data_type"),
        F.col("h.sql_hash").alias("sql_hash"), F.col("h.source").alias("source"), F.col("h.review_state").alias("review_state"),
    )
    itself = (F.col("source_table") == F.col("target_table")) & (F.col("source_column") == F.col("target_column"))
    links = maps.where((F.coalesce("source_table", F.lit("")) != "") & ~itself).select(*on, "source_table", "source_column", "ts")
    return _attach_columns(out, targets, links, data_types, curated), missing


def _attach_columns(graph: dict, targets: DataFrame, links: DataFrame, data_types, curated) -> dict:
    column = upsert_column(graph["column"], targets)
    stubs = links.select(
        F.col("source_table").alias("dataset_name"), F.col("source_column").alias("column_name"), F.col("ts").alias("computed_at")
    )
    derives = _edge(
        links, "DERIVES_FROM",
        column_pk(F.col("target_table"), F.col("target_column")), column_pk(F.col("source_table"), F.col("source_column")),
    )
    return {
        **graph,
        "column": upsert_column_stub(column, stubs, data_types, curated),
        "edge": upsert_edge(graph["edge"], derives),
    }
