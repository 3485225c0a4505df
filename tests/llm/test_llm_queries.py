"""Registered queries against their SQL, and the pipeline's stages against what they promise."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F
from test_llm_operators import brute_contamination, brute_spans

import corpus_pipeline
from ledgerline.llm import queries
from ledgerline.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES) and [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "near_dups", "benchmark", "personal", "mix",
    ]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) == ""


def test_held_out_accuracy(spark):
    docs = table(spark, FOLDER, "documents")
    found = queries.QUERIES["op8_language"](spark, FOLDER).where("held_out").join(docs, "doc_id").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95
    labels = table(spark, FOLDER, "labels")
    scored = queries.QUERIES["op1_mil_quality"](spark, FOLDER).join(labels, "doc_id").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.95


def test_stages(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    odd = docs.limit(3).withColumns({"text": F.array(F.lit(None).cast("string"), F.lit(""), F.lit("12 34"))[F.col("doc_id").cast("int") % 3]})
    docs = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    bench = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.toPandas())
        assert docs.columns[:5] == corpus_pipeline.COLUMNS
    language, near, benchmark, personal, mix = seen
    assert len(language) == table(spark, FOLDER, "documents").count()
    assert near.doc_id.is_unique and set(near.doc_id) < set(language.doc_id)
    clean = {i for i, t in zip(near.doc_id, near.text, strict=True) if not brute_contamination(t, bench)[-1]}
    assert set(benchmark.doc_id) == clean and len(clean) < len(near)
    assert set(personal.doc_id) == clean
    assert not any(brute_spans(t) for t in personal.text)
    assert (personal.n_chars == personal.text.str.len()).all()
    assert set(mix.doc_id) <= clean and mix.groupby("doc_id").size().max() <= 2


def test_pipeline_on_an_empty_table(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
        docs = docs.select(*corpus_pipeline.COLUMNS)
