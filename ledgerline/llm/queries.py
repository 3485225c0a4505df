"""Registered queries of the training-data operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import dartminhash, decontaminate, disclosure, host_suffix, hyperdimensional, mcd_rules, mil_quality, mixing, piecewise, pivots, substring, tokenizer_align, warc
from ledgerline.llm.common import bucket_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_mil_quality")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    model = mil_quality.train(docs, labels.where(~held_out))
    found = mil_quality.score_quality(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op2_host_suffix_array")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return host_suffix.extract_text(table(spark, folder, "pages"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT page_id, octet_length(encode(body)) AS n, hex, min(page_id) OVER (PARTITION BY hex, octet_length(encode(body))) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, ((5 * k) // 4 + 1)::INT, 2))::INT >> (3 - (5 * k) % 4)::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""


@query("op3_warc", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive_pages(table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
bw AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bwin AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(list_slice(ws, p, p + least(len(ws), 13) - 1), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM bw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bwin),
dwin AS MATERIALIZED (
  SELECT doc_id, k, p, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM dw, ks WHERE len(ws) >= k)),
hits AS MATERIALIZED (SELECT d.doc_id, d.p, d.k, b.item_id FROM dwin d JOIN bwin b ON d.win = b.win AND d.k = b.k),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op4_decontaminate", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP5_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
l AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight) AS cap_below,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight) AS weight_below
  FROM s),
f AS (SELECT *, cap_below + 2.0::DOUBLE * source_size / weight * (all_weight - weight_below) <= 1.5::DOUBLE * total AS is_full FROM l),
g AS (
  SELECT *, (1.5::DOUBLE * total - sum(CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE 0 END) OVER ())
            / nullif(all_weight - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER (), 0) AS water FROM f),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, water * weight) END AS target,
         ('0x' || substr(md5('mix' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM g),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(place * rate + shift) - floor((place - 1) * rate + shift)))::BIGINT AS taken FROM r"""


@query("op5_systematic_mix", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs, keep_text=False)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


@query("op7_dartminhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return dartminhash.class_ids(table(spark, folder, "documents"))


@query("op8_language")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of(F.col("doc_id"), 5) == 0
    prototypes = hyperdimensional.train_prototypes(docs.where(~held_out))
    found = hyperdimensional.predict_language(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


OP6_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT id, p, md5(array_to_string(list_slice(ws, p, p + 34), ' ')) AS win FROM (SELECT id, ws, unnest(range(1, len(ws) - 33)) AS p FROM d WHERE len(ws) >= 35)),
hit AS (SELECT id, p FROM w WHERE win IN (SELECT win FROM w GROUP BY win HAVING count(*) > 1)),
gone AS MATERIALIZED (SELECT DISTINCT id, unnest(range(p, p + 35)) AS q FROM hit),
kept AS (
  SELECT w.id, string_agg(w.word, ' ' ORDER BY w.q) AS rest FROM (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM d) w
  ANTI JOIN gone g ON w.id = g.id AND w.q = g.q GROUP BY w.id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT id, count(*) AS n FROM gone GROUP BY id) USING (id) LEFT JOIN kept USING (id)"""


@query("op6_substring_dedup", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_mcd_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    judged = mcd_rules.apply_rules(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "distance")


@query("op9_disclosure")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [
        F.size(F.expr(f"filter(base, x -> x.k = {k})")).cast("long").alias(f"n_{name}")
        for k, name in enumerate(disclosure.KINDS[:4])
    ]
    texts = [F.sha2(disclosure.spans_text("base"), 256).alias("base_sha256"), disclosure.spans_text("spans").alias("spans")]
    return found.select("doc_id", *counts, *texts)


@query("op11_piecewise_hash")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = piecewise.compare_with_next(table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op12_pivotal_grams")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = tokenizer_align.align_tokens(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
