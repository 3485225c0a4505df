"""Fixed values that results depend on."""

# Review states and evidence sources of a lineage edge.
RATIFIED = "ratified"
PENDING = "pending_review"
ABSENT = "absent"
CATALOG = "catalog"
PARSED = "sqlglot"
AGENT = "agent_inferred"
UNRESOLVED = "unresolved"

# Transform types.
TRANSFORM_TYPES = ["PASSTHROUGH", "RENAME", "TRANSFORM", "AGGREGATE", "WINDOW", "CONSTANT", "AMBIGUOUS"]

# Table-name prefixes and their layers.
LAYER_PREFIXES = [("src_", "layer_0"), ("stg_", "layer_1"), ("fct_", "layer_2"), ("dim_", "layer_2")]

# Substrings that make an expression sensitive to its input type.
TYPE_SENSITIVE = ["||", "concat", "date_diff", "age", "extract", "interval", "round", "cast", " + ", " - ", " * ", " / "]

# Aggregate function names.
AGGREGATES = ["sum", "count", "avg", "min", "max", "mode", "string_agg", "list", "median", "stddev", "variance", "first", "last", "any_value",
    "stddev_samp", "stddev_pop", "var_samp", "var_pop", "array_agg", "count_if", "bool_or", "bool_and", "approx_count_distinct", "percentile_cont",
    "percentile_disc", "corr", "covar_samp", "covar_pop", "group_concat", "listagg", "arg_min", "arg_max", "min_by", "max_by", "first_value",
    "last_value", "lag", "lead"]

# Keys every landing manifest must carry.
MANIFEST_KEYS = ["sor", "entity", "business_date", "row_count", "sha256", "produced_at", "schema_version"]

# Landing feeds and the source tables they refill, parents first.
FEEDS = [
    ("core_banking", "branch", "src_branch"),
    ("core_banking", "customer", "src_customer"),
    ("core_banking", "account", "src_account"),
    ("core_banking", "transaction", "src_transaction"),
    ("fx_vendor", "fx_rate", "src_fx_rate"),
]

# Words of SQL expressions that name no column.
RESERVED = [
    "and", "array", "asc", "between", "by", "case", "current", "current_date", "current_time", "current_timestamp", "desc", "distinct",
    "else", "end", "escape", "exists", "false", "filter", "following", "from", "in", "is", "like", "not", "null", "nulls", "or", "order",
    "over", "partition", "preceding", "range", "rows", "select", "similar", "then", "to", "true", "unbounded", "when", "where", "within",
]

# Node and edge labels of the lineage graph.
NODE_LABELS = ["DataSet", "Column", "Process", "Owner", "Tag"]
EDGE_LABELS = ["INPUT_TO", "PRODUCES", "DERIVES_FROM", "DEPENDS_ON", "OWNED_BY", "CLASSIFIED_AS"]

# Risk score weights, tier bounds and warning thresholds.
WEIGHT_INTERNATIONAL = 0.4
WEIGHT_STALE_KYC = 0.3
WEIGHT_VOLUME = 0.2
WEIGHT_REVERSAL = 0.1
TIER_HIGH = 0.65
TIER_MEDIUM = 0.35
WARN_HIGH_TIER = 0.30
WARN_STALE_KYC = 0.20

# Query words that point at a layer.
LAYER_WORDS = {
    "layer_0": ["raw", "source", "original", "ingest", "src_"],
    "layer_1": ["enriched", "derived", "computed", "normalized", "staged", "stg_"],
    "layer_2": ["risk", "score", "profile", "metric", "kpi", "90-day", "rolling", "fct_"],
}
