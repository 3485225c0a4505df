"""A training corpus from raw documents: five stages, each a table that the next one reads.

language      predict each document's language, drop those without one
near_dups     keep one document of each group of near-duplicates
benchmark     drop documents that hold passages of the benchmark
personal      replace personal data and the terms that reveal it
mix           draw documents so that sources meet their target weights

All stages but the last return the columns of documents; the last adds the
number of the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import dartminhash, decontaminate, disclosure, hyperdimensional, mixing
from ledgerline.llm.common import bucket_of, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language of their own; those without a letter go.

    Prototypes are learned from the same documents as in op8.  Documents keep
    their given language, and get the predicted one where none was given.
    """
    prototypes = hyperdimensional.train_prototypes(docs.where(bucket_of(F.col("doc_id"), 5) != 0))
    found = hyperdimensional.predict_language(docs.select(*COLUMNS), prototypes)
    kept = found.where(F.col("lang_pred") != hyperdimensional.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate class."""
    return dartminhash.keep_one(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items cover less than one word in twenty."""
    found = decontaminate.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars brought up to date."""
    clean = disclosure.sanitise(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per drawn copy, numbered from 1."""
    drawn = mixing.mix_sources(docs.select(*COLUMNS)).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return drawn.select(*COLUMNS, copies)


STAGES = [
    ("language", language),
    ("near_dups", near_dups),
    ("benchmark", benchmark),
    ("personal", personal),
    ("mix", mix),
]

#: Random vectors and corpus-wide components have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
