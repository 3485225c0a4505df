"""Precedence of catalog, parser and agent, one small case each."""

import pytest

from ledgerline.operators.catalog import divergences, merge_lineage

CATALOG = (
    "target_table string, target_column string, source_table string, source_column string, expression string, "
    "transform_type string, confidence double, source string, review_state string, sql_hash string"
)
MAPS = (
    "target_table string, target_column string, source_table string, source_column string, transform_type string, "
    "full_expression string, ambiguous boolean, confidence double, sql_hash string"
)


class Case:
    def __init__(self, spark, catalog=(), parsed=(), agent=(), now="HASH"):
        self.catalog = spark.createDataFrame(list(catalog), CATALOG)
        self.parsed = spark.createDataFrame(list(parsed), MAPS)
        self.agent = spark.createDataFrame(list(agent), MAPS)
        self.now = now

    def resolved(self):
        rows = merge_lineage(self.catalog, self.parsed, self.agent, self.now).collect()
        return sorted((r["target_column"], r["source_table"], r["source_column"], r["source"], r["review_state"]) for r in rows)

    def diverged(self):
        rows = divergences(self.catalog, self.parsed, self.now).collect()
        return sorted((r["source_table"], r["source_column"], r["in_catalog"], r["in_parsed"]) for r in rows)


def cat(col, table, source, state="ratified", hash_="HASH"):
    return ("stg", col, table, source, "expr", "PASSTHROUGH", 1.0, "catalog", state, hash_)


def mapped(col, table, source, ambiguous=False, conf=1.0, target="stg"):
    return (target, col, table, source, "PASSTHROUGH", "expr", ambiguous, conf, "HASH")


@pytest.fixture
def case(spark):
    return lambda **kw: Case(spark, **kw)


def test_catalog_alone_wins(case):
    c = case(catalog=[cat("rate", "src", "rate")])
    assert c.resolved() == [("rate", "src", "rate", "catalog", "ratified")] and c.diverged() == []


def test_agreement_is_the_catalogs_any_case(case):
    c = case(catalog=[cat("rate", "src", "rate")], parsed=[mapped("RATE", "SRC", "Rate", target="STG")])
    assert c.resolved() == [("rate", "src", "rate", "catalog", "ratified")] and c.diverged() == []


def test_another_hash_alone_is_no_divergence(case):
    c = case(catalog=[cat("rate", "src", "rate", hash_="OLD")], parsed=[mapped("rate", "src", "rate")], now="NEW")
    assert c.resolved()[0][3] == "catalog" and c.diverged() == []


def test_divergence_goes_to_the_parser(case):
    c = case(catalog=[cat("rate", "src", "rate_source")], parsed=[mapped("rate", "src", "rate")])
    assert c.resolved() == [("rate", "src", "rate", "sqlglot", "ratified")]
    assert c.diverged() == [("src", "rate", False, True), ("src", "rate_source", True, False)]


def test_clear_parse_without_catalog(case):
    assert case(parsed=[mapped("c", "src", "c")]).resolved() == [("c", "src", "c", "sqlglot", "ratified")]


def test_agent_resolves_an_ambiguous_parse(case):
    c = case(parsed=[mapped("c", "a", "x", True, 0.5), mapped("c", "b", "y", True, 0.5)], agent=[mapped("c", "a", "x", conf=0.8)])
    assert c.resolved() == [("c", "a", "x", "agent_inferred", "pending_review")]


def test_ambiguous_parse_without_help_stays_pending(case):
    assert case(parsed=[mapped("c", "a", "x", True, 0.5)]).resolved() == [("c", "a", "x", "sqlglot", "pending_review")]
    assert case(parsed=[mapped("c", "", "", True, 0.5)]).resolved() == [("c", "", "", "unresolved", "pending_review")]


def test_catalog_only_targets_are_kept_and_pending_rows_ignored(case):
    c = case(catalog=[cat("a", "src", "a"), cat("b", "src", "b", state="pending_review")], parsed=[mapped("c", "src", "c")])
    assert c.resolved() == [("a", "src", "a", "catalog", "ratified"), ("c", "src", "c", "sqlglot", "ratified")]


def test_two_sources_of_one_target(case):
    c = case(catalog=[cat("c", "a", "x"), cat("c", "b", "y")], parsed=[mapped("c", "b", "y"), mapped("c", "a", "x")])
    assert [r[1] for r in c.resolved()] == ["a", "b"] and c.diverged() == []


def test_ambiguous_parse_does_not_beat_the_catalog(case):
    c = case(catalog=[cat("c", "a", "x")], parsed=[mapped("c", "b", "y", True, 0.5)], agent=[mapped("c", "z", "z")])
    assert c.resolved() == [("c", "a", "x", "catalog", "ratified")] and c.diverged() == []


def test_empty_side_is_no_divergence(case):
    c = case(catalog=[cat("c", "a", "x")], parsed=[mapped("c", "", "")])
    assert c.resolved() == [("c", "a", "x", "catalog", "ratified")] and c.diverged() == []


def test_agent_alone_is_not_a_target(case):
    assert case(agent=[mapped("c", "a", "x")]).resolved() == []


def test_outcomes_beside_a_hot_target(case, joins):
    """One target with most of the sources, beside every kind of outcome."""
    hot = [("hot", "src", f"s{i}") for i in range(60)]
    data = dict(
        catalog=[cat(*e) for e in hot] + [cat("d", "a", "x"), cat("k", "a", "x")],
        parsed=[mapped(*e) for e in hot[:40]] + [mapped("d", "b", "y"), mapped("p", "a", "x"), mapped("u", "", "", True, 0.5)]
        + [mapped("g", "a", "x", True, 0.5)],
        agent=[mapped("g", "z", "z", conf=0.8)],
    )
    c = case(**data)
    assert len(c.resolved()) == 45 and len(c.diverged()) == 62
