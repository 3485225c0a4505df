"""Lineage graph as tables: walks over edges, one-hop reads, listings.

``edges``: label, src_id, dst_id.  DERIVES_FROM points from a column to the column
it is computed from, so "upstream" follows the arrow and "downstream" reverses it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V
from ledgerline.functions.text import infer_layer
from ledgerline.operators.scale import lookup_left_join, semi_naive
from ledgerline.session import pin


class _Steps:
    """Distinct one-hop steps, written once and joined at every level."""

    def __init__(self, edges: DataFrame, reverse: bool):
        a, b = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
        steps = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node IS NOT NULL AND next IS NOT NULL")
        self.steps = pin(steps.distinct())

    def expand(self, frontier: DataFrame) -> DataFrame:
        """Frontier rows moved one hop; adaptive execution cuts a node that is hot on either side.

        Merged, as a broadcast a level would take all that a long walk finds through the driver.
        """
        return frontier.join(self.steps.hint("merge"), "node").drop("node").withColumnRenamed("next", "node")


def _hops(max_hops: int) -> int:
    """The asked number of hops; anything but a positive whole number is an error."""
    if not isinstance(max_hops, int) or isinstance(max_hops, bool) or max_hops < 1:
        raise ValueError(f"hops must be a positive whole number, not {max_hops!r}")
    return max_hops


def walk(edges: DataFrame, starts: DataFrame, max_hops: int, reverse: bool = False) -> DataFrame:
    """Every node reached from ``starts`` (start) in 1..max_hops hops: start, node, hops, paths.

    Paths are counted, not listed: each level is one row per (start, node), so
    diamonds and cycles never multiply the rows.  Levels are pinned, which keeps
    the plan of level k from repeating levels 1..k-1.
    """
    steps = _Steps(edges, reverse)
    frontier = starts.select("start").distinct().select(
        "start", F.col("start").alias("node"), F.lit(1).cast("bigint").alias("paths")
    )
    levels = []
    for hop in range(1, _hops(max_hops) + 1):
        frontier = pin(steps.expand(frontier).groupBy("start", "node").agg(F.sum("paths").alias("paths")))
        if hop > 1 and frontier.isEmpty():
            break
        levels.append(frontier.select("start", "node", F.lit(hop).alias("hops"), "paths"))
    return reduce(lambda a, b: a.unionByName(b), levels)


def reach(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, reverse: bool = False) -> DataFrame:
    """Every node reachable from ``starts`` (start) once, with its smallest hop count: start, node, hops.

    Only newly seen pairs are expanded, so the walk also ends on cycles; without
    ``max_hops`` it runs until a level finds nothing new.
    """
    steps = _Steps(edges, reverse)
    limit = None if max_hops is None else _hops(max_hops) - 1

    def hop(frontier: DataFrame, hops: int) -> DataFrame:
        return steps.expand(frontier.select("start", "node")).withColumn("hops", F.lit(hops))

    own = starts.where("start IS NOT NULL").select("start").distinct().select("start", F.col("start").alias("node"))
    return semi_naive(hop(own, 1), lambda found, level: hop(found, level + 1), ["start", "node"], limit)


def column_ancestors(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """Upstream columns per hop with the number of paths that lead there."""
    return walk(edges, starts, max_hops).withColumnRenamed("node", "ancestor")


def column_chain(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """Upstream columns, one row per (column, hop)."""
    return column_ancestors(edges, starts, max_hops).select("start", "ancestor", "hops")


def upstream_one_hop(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src_id").alias("start"), F.col("dst_id").alias("ancestor")).distinct()


def upstream_3hop(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Upstream columns within three hops, each once at its smallest hop."""
    return reach(edges, starts, 3).withColumnRenamed("node", "ancestor")


def downstream_direct(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst_id").alias("start"), F.col("src_id").alias("descendant")).distinct()


def downstream_chain(edges: DataFrame, starts: DataFrame, max_hops: int | None) -> DataFrame:
    """Every descendant once, at its smallest hop; None follows the chain to its end."""
    return reach(edges, starts, max_hops, reverse=True).withColumnRenamed("node", "descendant")


def trace_path(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Each of ``roots`` (start) itself and everything up and down from it: root, node, direction.

    DEPENDS_ON edges are no flow.  A root that lies on a cycle is its own ancestor
    and descendant besides.
    """
    flow = pin(edges.where(F.col("label") != "DEPENDS_ON").select("src_id", "dst_id").distinct())
    up = reach(flow, roots, reverse=True).select("start", "node", F.lit("up").alias("direction"))
    down = reach(flow, roots).select("start", "node", F.lit("down").alias("direction"))
    own = roots.select("start").distinct().select("start", F.col("start").alias("node"), F.lit("root").alias("direction"))
    return own.unionByName(up).unionByName(down).withColumnRenamed("start", "root")


def first_seen_dedup(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lowest-``order`` row per key."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def p1_tables(certs: DataFrame) -> DataFrame:
    return certs.where(F.upper("profile") == "P1").select(F.col("table_name").alias("dataset_name")).distinct()


def _blocked(columns: DataFrame, certs: DataFrame) -> DataFrame:
    """Pending columns that live in P1 tables (``fct_`` tables if none is certified)."""
    pending = columns.where(F.col("review_state") == V.PENDING).select("pk", "dataset_name")
    p1 = p1_tables(certs).withColumn("_p1", F.lit(True))
    any_p1 = p1.agg(F.count(F.lit(1)) > 0).scalar()
    marked = lookup_left_join(pending, p1, ["dataset_name"], ["_p1"])
    is_p1 = F.when(any_p1, F.coalesce("_p1", F.lit(False))).otherwise(F.col("dataset_name").startswith("fct_"))
    return marked.where(is_p1).select(F.col("pk").alias("descendant"), F.lit(True).alias("_blocked"))


def gate_unratified(
    chain: DataFrame,
    columns: DataFrame,
    certs: DataFrame,
    include_unratified: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Chain without unreviewed columns of P1 tables, and the number left out."""
    if include_unratified:
        return chain, chain.limit(0).agg(F.count(F.lit(1)).alias("filtered"))
    marked = lookup_left_join(
        chain, _blocked(columns, certs), ["descendant"], ["_blocked"]
    )
    hit = F.coalesce("_blocked", F.lit(False))
    return marked.where(~hit).drop("_blocked"), marked.agg(F.count_if(hit).alias("filtered"))


def _label(edges: DataFrame, label: str) -> DataFrame:
    return edges.where(F.col("label") == label)


def edge_one_hop(edges: DataFrame, processes: DataFrame) -> DataFrame:
    """Dataset to dataset through the process between them."""
    reads = _label(edges, "INPUT_TO").select(F.col("src_id").alias("upstream_table"), F.col("dst_id").alias("pk"))
    writes = _label(edges, "PRODUCES").select(F.col("src_id").alias("pk"), F.col("dst_id").alias("downstream_table"))
    # Reads and writes of one process pair up; a process writes one table.
    paired = reads.join(writes, "pk")
    named = lookup_left_join(
        paired, processes.select("pk", F.col("stage").alias("via_process"), "transform_type", F.lit(True).alias("_known")),
        ["pk"], ["via_process", "transform_type", "_known"],
    )
    return named.where("_known").select("upstream_table", "downstream_table", "via_process", "transform_type")


def readers_of_table(
    edges: DataFrame, processes: DataFrame, table: str | None = None
) -> DataFrame:
    reads = _label(edges, "INPUT_TO").select(F.col("src_id").alias("dataset_name"), F.col("dst_id").alias("pk"))
    if table is not None:
        reads = reads.where(F.col("dataset_name") == table)
    cols = ["stage", "run_id", "transform_type", "target_table", *[c for c in ("sql_text",) if c in processes.columns]]
    named = lookup_left_join(
        reads, processes.select("pk", *cols, F.lit(True).alias("_known")), ["pk"], [*cols, "_known"]
    )
    return named.where("_known").drop("pk", "_known")


def source_counts(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Columns with their number of sources, 0 kept."""
    counts = _label(edges, "DERIVES_FROM").groupBy(F.col("src_id").alias("pk")).agg(F.count(F.lit(1)).alias("source_count"))
    return columns.join(counts, "pk", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def columns_of_dataset(columns: DataFrame, table: str) -> DataFrame:
    return columns.where(F.col("dataset_name") == table).orderBy("column_name")


def column_detail(columns: DataFrame, table: str, column: str) -> DataFrame:
    return columns.where(F.col("pk") == f"{table}::{column}")


def count_by_label(df: DataFrame, labels: list[str], label_col: str = "label") -> DataFrame:
    """Rows per label; labels without rows count 0."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(l,) for l in labels], f"{label_col} string")
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, label_col, "left").select(label_col, F.coalesce("n", F.lit(0)).alias("n"))


def dataset_list(datasets: DataFrame) -> DataFrame:
    return datasets.select(
        "name", "layer", F.coalesce("row_count", F.lit(0)).alias("row_count"), "computed_at"
    ).orderBy("layer", "name")


def process_chain(processes: DataFrame, run_id: str | None = None) -> DataFrame:
    rows = processes if run_id is None else processes.where(F.col("run_id") == run_id)
    return rows.select("run_id", "stage", "transform_type", "target_table", "duration_ms", "output_row_count").orderBy(
        "run_id", "stage"
    )


def dedupe_process_by_stage(processes: DataFrame, order: str) -> DataFrame:
    """Last process of each stage."""
    rest = [c for c in processes.columns if c != "stage"]
    picked = processes.groupBy("stage").agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return picked.select("stage", "_r.*")


def process_detail(processes: DataFrame, edges: DataFrame, columns: DataFrame, stage: str, run_id: str) -> DataFrame:
    """One process: a head row, its input and output tables, its output columns."""
    pk = f"{stage}::{run_id}"
    head = processes.where(F.col("pk") == pk)
    written = _label(edges, "PRODUCES").where(F.col("src_id") == pk).agg(F.min("dst_id")).scalar()
    output = F.coalesce(written, head.agg(F.max("target_table")).scalar())
    none = F.lit(None)
    parts = [
        head.select(F.lit("process").alias("part"), F.col("stage").alias("name"), "transform_type", F.col("output_row_count").alias("n")),
        _label(edges, "INPUT_TO").where(F.col("dst_id") == pk).select(
            F.lit("input").alias("part"), F.col("src_id").alias("name"), none.cast("string").alias("transform_type"), none.cast("bigint").alias("n")
        ),
        head.select(F.lit("output").alias("part"), output.alias("name"), none.cast("string").alias("transform_type"), none.cast("bigint").alias("n")),
        source_counts(columns.where(F.col("dataset_name") == output), edges).select(
            F.lit("column").alias("part"), F.col("column_name").alias("name"), "transform_type", F.col("source_count").alias("n")
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def graph_view(datasets: DataFrame, processes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and structural edges of the picture; column edges are left out."""
    nodes = datasets.select(
        F.concat(F.lit("ds::"), "name").alias("id"), F.col("name").alias("label"), F.lit("DataSet").alias("kind"), "layer",
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("n"),
    ).unionByName(
        processes.select(
            F.concat(F.lit("proc::"), "pk").alias("id"), F.col("stage").alias("label"), F.lit("Process").alias("kind"),
            F.lit(None).cast("string").alias("layer"), F.coalesce("duration_ms", F.lit(0)).cast("bigint").alias("n"),
        )
    )
    ds, proc = F.lit("ds::"), F.lit("proc::")
    from_id = F.when(F.col("label") == "INPUT_TO", F.concat(ds, "src_id")).otherwise(F.concat(proc, "src_id"))
    to_id = F.when(F.col("label") == "PRODUCES", F.concat(ds, "dst_id")).otherwise(F.concat(proc, "dst_id"))
    structural = edges.where(F.col("label").isin("INPUT_TO", "PRODUCES", "DEPENDS_ON"))
    return nodes, structural.select(from_id.alias("from_id"), to_id.alias("to_id"), "label")


def scoped_references(projections: DataFrame, scope: DataFrame) -> DataFrame:
    """References of projections with the tables in scope looked up, as ``resolve_to_base`` takes them.

    ``scope``: node, ordinal, alias, table; the FROM and JOIN entries of each
    node in order, a subquery's table being its own node.  ``projections``: node,
    position, column, qualifier, ref_column; a row per column reference of a
    projection.  A star has ``*`` as column, and as qualifier the alias before
    it or NULL; a constant is a row without ref_column.

    Tables and aliases compare in lower case, and a table may be named by its
    alias or by itself; of equal names the later entry counts.  A qualified
    reference goes to the one table of that name, or to the qualifier itself if
    no entry has it.  An unqualified one goes to every distinct table in scope.
    Of several projections of one name, and of several stars, only the first
    counts; a bare star goes to every table in scope.
    """
    entry = scope.select("node", "ordinal", F.lower("alias").alias("_alias"), F.lower("table").alias("_table")).where("_table IS NOT NULL")
    names = F.array(F.struct(F.col("_alias").alias("name"), F.lit(0).alias("turn")), F.struct(F.col("_table").alias("name"), F.lit(1).alias("turn")))
    named = entry.select("node", "ordinal", "_table", F.explode(names).alias("n")).where("n.name IS NOT NULL")
    visible = named.groupBy("node", F.col("n.name").alias("_name")).agg(F.max_by("_table", F.struct("ordinal", "n.turn")).alias("_table"))
    visible = pin(visible)

    first = projections.groupBy("node", "column").agg(F.min("position").alias("position"))
    kept = projections.join(first, ["node", "column", "position"]).withColumn("_name", F.lower("qualifier"))
    constant = (F.col("column") != "*") & F.col("ref_column").isNull()
    target = F.when(F.col("column") == "*", F.lit("*")).otherwise(F.col("ref_column")).alias("ref_column")
    known = kept.where(~constant & F.col("_name").isNotNull()).join(visible, ["node", "_name"], "left")
    qualified = known.select("node", "column", F.coalesce("_table", "_name").alias("ref_node"), target)
    every = kept.where(~constant & F.col("_name").isNull()).join(visible.select("node", "_table").distinct(), "node")
    unqualified = every.select("node", "column", F.col("_table").alias("ref_node"), target)
    none = F.lit(None).cast("string")
    constants = kept.where(constant).select("node", "column", none.alias("ref_node"), none.alias("ref_column"))
    return qualified.unionByName(unqualified).unionByName(constants).distinct()


def resolve_to_base(
    refs: DataFrame, base_tables: DataFrame
) -> DataFrame:
    """Target columns resolved through intermediate names to base-table columns.

    ``refs``: node, column, ref_node, ref_column, one row per reference of a
    projection (``column`` and ``ref_column`` are ``*`` for a star), as
    ``scoped_references`` gives them.  A node of ``base_tables`` (name) ends the
    walk, a constant is a row without ref_node that leads nowhere, and a node
    that is neither known nor a base table, or refers to itself, is returned as
    it is.  A (start, node, column) seen before is not followed again, so the
    walk ends by itself, however long the chain.
    """
    ends = (
        base_tables.select(F.col("name").alias("ref_node"), F.lit("base").alias("_kind"))
        .unionByName(refs.select(F.col("node").alias("ref_node"), F.lit("inner").alias("_kind")))
        .groupBy("ref_node")
        .agg(F.min("_kind").alias("_kind"))
    )
    # Each reference knows whether it ends at a leaf, so a level is one join.
    marked = lookup_left_join(refs.distinct(), ends, ["ref_node"], ["_kind"])
    leaf = F.coalesce(F.col("_kind") == "base", F.lit(True)) | (F.col("ref_node") == F.col("node"))
    steps = pin(marked.withColumn("leaf", leaf).drop("_kind"))
    has_name = steps.where(F.col("column") != "*").select("node", "column").distinct()
    named = steps.where((F.col("column") != "*") & F.col("ref_node").isNotNull())
    star = steps.where(F.col("column") == "*").select("node", "ref_node", "leaf")

    def expand(found: DataFrame, level: int) -> DataFrame:
        rows = found.where("NOT leaf").drop("leaf")
        # Merged as in ``_Steps``: no level passes through the driver.
        by_name = rows.join(named.hint("merge"), ["node", "column"])
        by_star = rows.join(has_name.hint("merge"), ["node", "column"], "left_anti").join(star.hint("merge"), "node")
        start = ["target_node", "target_column"]
        return by_name.select(
            *start, F.col("ref_node").alias("node"), F.col("ref_column").alias("column"), "leaf"
        ).unionByName(by_star.select(*start, F.col("ref_node").alias("node"), "column", "leaf"))

    first = named.select(
        F.col("node").alias("target_node"), F.col("column").alias("target_column"),
        F.col("ref_node").alias("node"), F.col("ref_column").alias("column"), "leaf",
    )
    seen = semi_naive(first, expand, ["target_node", "target_column", "node", "column", "leaf"])
    return seen.where("leaf").select(
        "target_node", "target_column", F.col("node").alias("source_table"), F.col("column").alias("source_column")
    )


def flag_ambiguous(resolved: DataFrame, expressions: DataFrame, base_tables: DataFrame) -> DataFrame:
    """Per target: distinct base tables, ambiguity and confidence.

    ``expressions``: target_column, expression, n_refs.  A CASE or COALESCE over two
    or more base tables is ambiguous, and so is a target none of whose references
    reached a base table.
    """
    known = semi_whitelist(resolved, base_tables)
    per_table = known.groupBy("target_column", "source_table").agg(F.count(F.lit(1)).alias("_n"))
    per_target = per_table.groupBy("target_column").agg(
        F.count(F.lit(1)).alias("n_tables"), F.sum("_n").alias("n_sources")
    )
    low = F.lower("expression")
    branching = low.rlike(r"\bcase\b|\bcoalesce\s*\(")
    joined = expressions.join(per_target, "target_column", "left").withColumns(
        {"n_tables": F.coalesce("n_tables", F.lit(0)), "n_sources": F.coalesce("n_sources", F.lit(0))}
    )
    ambiguous = (branching & (F.col("n_tables") >= 2)) | ((F.col("n_refs") > 0) & (F.col("n_sources") == 0))
    return joined.select("target_column", "n_tables", ambiguous.alias("ambiguous")).withColumn(
        "confidence", F.when(F.col("ambiguous"), 0.5).otherwise(1.0)
    )


def semi_whitelist(edges: DataFrame, base_tables: DataFrame) -> DataFrame:
    """Edges whose source table is a known base table; a hot table is a hot key of the lookup."""
    base = base_tables.select(F.col("name").alias("source_table")).distinct().withColumn("_known", F.lit(True))
    return lookup_left_join(edges, base, ["source_table"], ["_known"]).where("_known").drop("_known")


def with_layer(columns: DataFrame) -> DataFrame:
    return columns.withColumn("layer", infer_layer(F.col("dataset_name")))
