"""Operators against brute force, on tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import os
import re
import tracemalloc
from collections import Counter

import cases
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import (
    dartminhash,
    decontaminate,
    disclosure,
    host_suffix,
    hyperdimensional,
    mcd_rules,
    mil_quality,
    mixing,
    substring,
    warc,
)


@pytest.fixture(scope="module")
def docs(spark):
    return cases.docs(spark).persist()


def empty(docs):
    return docs.limit(0)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


# --- quality ---------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = mil_quality.GatedAttention(width=5, hidden=3)
    x, owner, labels = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 1, 2, 3, 3, 3]), np.array([1.0, 0, 0, 1])

    def loss():
        y = model._forward(x, owner, 4)[-1]
        return -np.mean(0.5 / 0.5 * (labels * np.log(y) + (1 - labels) * np.log(1 - y)))

    found = model._gradients(x, owner, labels, 0.5)
    for name, value in model.p.items():
        for at in np.ndindex(value.shape):
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert found[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_quality_finds_the_bad_passage(spark):
    rng = cases.random.Random(3)
    rows = []
    for i in range(300):
        text = cases.words(rng, 200)
        if i % 2:
            at = rng.randrange(0, 130)
            text[at : at + 64] = [w.upper() + "!!" for w in text[at : at + 64]]
        rows.append((i, " ".join(text), i % 2 ^ 1))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = mil_quality.train(table.select("doc_id", "text"), table.where("doc_id < 200").select("doc_id", "quality"))
    got = mil_quality.score_quality(table, model).toPandas()
    late = got[got.doc_id >= 200]
    assert (late.predicted == late.quality).mean() > 0.97


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(None, 1), (5, None), (5, 1), (5, 1), (999, 0)], "doc_id long, quality int")
    model = mil_quality.train(docs, labels)
    got = mil_quality.score_quality(docs, model).toPandas()
    assert len(got) == len(cases.rows()) and got.score.between(0, 1).all()
    assert mil_quality.score_quality(empty(docs), mil_quality.train(empty(docs), labels.limit(0))).count() == 0


def test_every_passage_is_encoded():
    text = " ".join(cases.words(cases.random.Random(1), 1000))
    assert mil_quality.encode(text).shape == (16, mil_quality.WIDTH)
    assert mil_quality.encode(None).shape == mil_quality.encode(" \n").shape == (1, mil_quality.WIDTH)


# --- pages -----------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="has-sidebar"><nav><ul><li>Home<li>News</ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 text<br>line.<p>Second &eacute;&#x41;&nbsp;x<aside>related</aside><ul><li>one<li>two</ul>
<form><input>Mail</form><section class="comments"><p>Reader says</section><div class="article-header">Sub</div></article></main>
<aside>Side</aside><footer>&copy; host</footer></body></html>"""


def test_blocks_of_a_page():
    kept = [t for p, t in host_suffix.blocks(PAGE) if p == host_suffix.ARTICLE]
    assert kept == ["Title & more", "First bold text line.", "Second éA x", "one", "two", "Sub"]


def test_repeated_tokens_against_brute_force():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 3, 400).astype(np.uint64)
    pages = np.sort(rng.integers(0, 12, 400))
    for long in (1, 2, 5, 7):
        want = np.zeros(400, dtype=bool)
        seen = {}
        for i in range(400 - long + 1):
            if pages[i] == pages[i + long - 1]:
                seen.setdefault(tuple(tokens[i : i + long]), []).append(i)
        for places in seen.values():
            if len(set(pages[places])) > 1:
                for i in places:
                    want[i : i + long] = True
        assert (host_suffix.repeated_tokens(tokens, pages, long) == want).all()


def test_pages_without_an_article_lose_what_repeats(spark):
    rng = cases.random.Random(4)
    own = [" ".join(cases.words(rng, 20)) for _ in range(6)]
    rule = "all rights are kept by the owner of this site"
    rows = [(i, f"https://h.example/{i}", f"<div>{rule}</div><div>{t}</div>") for i, t in enumerate(own)]
    rows += [(None, None, None), (7, "https://h.example/7", PAGE), (7, "https://h.example/7", PAGE), (8, "x", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    for piece in (host_suffix.PIECE_TOKENS, 40):  # the second deals one host to several arrays
        got = host_suffix.extract_text(pages, piece_tokens=piece).toPandas()
        assert len(got) == len(rows)
        by_id = got.dropna(subset="page_id").drop_duplicates("page_id").set_index("page_id").text
        assert [by_id[i] for i in range(6)] == own
        assert by_id[7].startswith("Title & more\n") and len(by_id[8]) == 249_999
        assert got[got.page_id.isna()].text.tolist() == [""]
        assert (got.n_chars == got.text.str.len()).all()
    assert host_suffix.extract_text(pages.limit(0)).count() == 0


def test_repeats_decide_on_open_blocks_of_every_page(spark):
    """Beside an article too; copies of a page and short common blocks are no evidence, and the pieces make no difference."""
    rng = cases.random.Random(11)
    own = [" ".join(cases.words(rng, 30)) for _ in range(8)]
    rule = "all rights are kept by the owner of this site"
    teaser = "<article>Next story</article>"
    rows = [(i, f"https://h.example/{i}", f"<nav>one two three four five six</nav><h2>Introduction</h2><p>{t}</p>{teaser}<div>{rule}</div>") for i, t in enumerate(own[:4])]
    rows += [(i, f"https://h.example/{i}", f"<p>{own[i]}</p><footer>{rule}</footer>") for i in (4, 5)]
    rows += [(i, "https://h.example/copy", f"<p>{own[6]}</p><div>{rule}</div>") for i in (6, 7)]
    rows += [(8, "https://other.example/", f"<p>{own[7]}</p><div>{rule}</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Introduction\n{t}\nNext story" for i, t in enumerate(own[:4])}
    want |= {4: own[4], 5: own[5], 6: own[6], 7: own[6], 8: f"{own[7]}\n{rule}"}
    for piece in (host_suffix.PIECE_TOKENS, 60, 5):
        got = {r["page_id"]: r["text"] for r in host_suffix.extract_text(pages, piece_tokens=piece).collect()}
        assert got == want, piece


# --- archives --------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    htmls = [None, "", "<p>a</p>", "<p>a</p>", "é" * 10, "x" * 3_000_000, "<p>a</p>", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"]
    rows = [(i if i != 2 else 20, f"u{i}", h, "z") for i, h in enumerate(htmls)] + [(None, None, "<p>a</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.archive_pages(pages, str(tmp_path)).toPandas()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h, _ in rows:
        row = got[got.page_id.isna()].iloc[0] if i is None else got[got.page_id == i].iloc[0]
        data = (h or "").encode()
        assert row.payload_bytes == len(data) and row.payload_digest == warc.base32_sha1(data)
        response = first[h or ""] == i
        assert row.record_type == ("response" if response else "revisit")
        assert row.html == (h or "") if response else row.refers_to == first[h or ""]
    # Every indexed member of the rewritten files is one whole record.
    names = [n for n in os.listdir(tmp_path / "records") if n.endswith(".idx")]
    read = 0
    for name in names:
        data = (tmp_path / "records" / name.removesuffix(".idx")).read_bytes()
        for line in (tmp_path / "records" / name).read_text().splitlines():
            offset, length, record = line.split(" ", 2)
            headers, _ = warc.parse(gzip.decompress(data[int(offset) : int(offset) + int(length)]))
            assert headers["WARC-Record-ID"] == record
            read += 1
    assert read == len(rows)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_normaliser_takes_one_stream_or_many_members(tmp_path):
    records = [warc.record(i, "u", b"p" * (i * 400_000), None) for i in range(5)]
    (tmp_path / "one.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "many.gz").write_bytes(b"".join(map(gzip.compress, records)))
    for name in ("one", "many"):
        places = warc.normalise_file(str(tmp_path / f"{name}.gz"), str(tmp_path / f"{name}.out"))
        data = (tmp_path / f"{name}.out").read_bytes()
        assert [gzip.decompress(data[o : o + n]) for o, n in places] == records
    cut = io.BytesIO(gzip.compress(b"".join(records)[:-10]))
    (tmp_path / "cut.gz").write_bytes(cut.getvalue())
    with pytest.raises(ValueError):
        warc.normalise_file(str(tmp_path / "cut.gz"), str(tmp_path / "cut.out"))


def test_normaliser_wants_whole_members_and_skips_padding(tmp_path):
    data = b"".join(warc.record(i, "u", bytes([i]) * 300_000, None) for i in range(5))
    whole = gzip.compress(data)
    for cut in (whole[:-8], whole[:-1], gzip.compress(data[: len(data) // 2]) + whole[:20]):
        (tmp_path / "cut.gz").write_bytes(cut)
        with pytest.raises(ValueError):
            warc.normalise_file(str(tmp_path / "cut.gz"), str(tmp_path / "cut.out"))
    wrong = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    (tmp_path / "wrong.gz").write_bytes(wrong)
    with pytest.raises(Exception, match="check"):
        warc.normalise_file(str(tmp_path / "wrong.gz"), str(tmp_path / "wrong.out"))
    for padded in (whole + bytes(3_000_000), whole + bytes(7) + whole + bytes(1)):
        (tmp_path / "padded.gz").write_bytes(padded)
        assert len(warc.normalise_file(str(tmp_path / "padded.gz"), str(tmp_path / "padded.out"))) in (5, 10)


def test_archives_are_rewritten_and_read_one_a_task(spark, tmp_path):
    pages = spark.range(0, 60, 1, 6).selectExpr("id AS page_id", "'u' AS url", "encode(concat('p', id), 'UTF-8') AS payload", "CAST(NULL AS BIGINT) AS refers_to")
    written = warc.write_archives(pages, str(tmp_path / "raw"))
    assert written.count() == len(os.listdir(tmp_path / "raw")) == 6
    spread = warc.one_file_a_task(written)
    sizes = [len(part) for part in spread.select("path").rdd.glom().collect()]
    assert len(sizes) == 6 and max(sizes) <= 2
    index = warc.normalise_archives(written, str(tmp_path / "records"))
    read = warc.read_records(index)
    assert read.rdd.getNumPartitions() == 6
    assert sorted(r.page_id for r in read.select("page_id").collect()) == list(range(60))
    assert warc._with_scheme(spark, str(tmp_path)).startswith("file:///")


# --- decontamination -------------------------------------------------------


def brute_contamination(text, items):
    ws = folded_words(text)
    hit, found = set(), set()
    for item, body in items:
        bw = folded_words(body)
        k = min(13, len(bw))
        windows = {tuple(bw[i : i + k]) for i in range(len(bw) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1 if k else 0):
            if tuple(ws[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(ws), len(hit), len(found), decontaminate.digest(found), bool(hit) and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 7])
def test_contamination_against_brute_force(spark, docs, block):
    all_texts = cases.texts()
    long = all_texts[13].split(" ")
    items = [
        (1, " ".join(long[100:113])),
        (2, " ".join(all_texts[9].split(" ")[28:60])),
        (2, " ".join(all_texts[9].split(" ")[28:60])),
        (10, "ONE"),
        (None, "line line"),
        (4, None),
        (5, "!!"),
        (6, " ".join(long[5000:5012])),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, block_windows=block).collect()
    assert len(got) == len(cases.rows())
    for r in got:
        want = brute_contamination(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
    none = decontaminate.find_contamination(docs, bench.limit(0))
    assert none.where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty(docs), bench).count() == 0


# --- mixing ----------------------------------------------------------------


def test_targets_are_filled_by_weight(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, "d": 30, None: 500}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    left, target = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    open_ = set(sizes)
    while left > 1e-9:
        share = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += share * weights[s]
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
        open_ = {s for s in open_ if target[s] < 2 * sizes[s]}
    assert got == pytest.approx(target)


def test_mix_comes_near_its_targets(spark, docs):
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == len(cases.rows())
    assert (got["size"] == [len(space_words(t)) for t in got.text]).all()
    assert got.copies.between(0, 2).all()
    rng = cases.random.Random(9)
    rows = [(i, f"s{i % 7}" if i % 7 else "s0", "w " * rng.randint(0, 90)) for i in range(6000)]
    many = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(8)
    one = mixing.mix_sources(many, keep_text=False).toPandas()
    taken = (one["size"] * one.copies).groupby(one.source).sum()
    assert (taken - one.groupby("source").target.first()).abs().max() < 200
    two = mixing.mix_sources(many.repartition(5), keep_text=False).toPandas()
    assert one.set_index("doc_id").copies.to_dict() == two.set_index("doc_id").copies.to_dict()
    assert mixing.mix_sources(empty(docs)).count() == 0


# --- repeated windows ------------------------------------------------------


def brute_repeats(texts_, length):
    where = Counter()
    for t in texts_:
        w = space_words(t)
        where.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = []
    for t in texts_:
        w = space_words(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if where[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("length", [35, 20, 6])
def test_repeats_against_brute_force(spark, docs, length):
    got = Counter((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs, length).collect())
    assert got == Counter(brute_repeats([r[1] for r in cases.rows()], length))


def test_repeats_in_one_alphabet(spark):
    """Two words only: nearly every window repeats, inside texts too."""
    rng = cases.random.Random(8)
    texts_ = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 80))) for _ in range(40)] + ["a " * 200]
    table = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(table, 10).collect()}
    assert [got[i] for i in range(len(texts_))] == brute_repeats(texts_, 10)
    assert substring.remove_repeats(table.limit(0)).count() == 0


# --- near duplicates -------------------------------------------------------


def shingle_set(text):
    w = folded_words(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_classes(texts_):
    sets = [shingle_set(t) for t in texts_]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if folded_words(texts_[i]) == folded_words(texts_[j]) or both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_classes_against_brute_force(spark):
    rng = cases.random.Random(6)
    texts_ = cases.texts()
    for size in (12, 60, 300):
        base = cases.words(rng, size)
        for edits in (1, 1, 2, 3, 5, 9):
            near = list(base)
            for _ in range(edits * size // 60 + 1):
                near[rng.randrange(size)] = "edit" + cases.words(rng, 1)[0]
            texts_.append(" ".join(near))
    hub = cases.words(rng, 100)
    for _ in range(60):  # one large group of near copies
        near = list(hub)
        near[rng.randrange(100)] = "edit" + cases.words(rng, 1)[0]
        texts_.append(" ".join(near))
    table = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.class_ids(table).collect()}
    assert [got[i] for i in range(len(texts_))] == brute_classes(texts_)


def test_pairs_among_many_copies_of_an_absent_original(spark, monkeypatch):
    monkeypatch.setattr(dartminhash, "BLOCK", 16)  # many pairs of blocks in a bucket
    rng = np.random.default_rng(10)  # the one near pair shares buckets of 59 and more members only
    original = [f"w{i}" for i in range(304)]
    texts_ = []
    for i in range(200):  # two copies with three edits each are near each other, no others are
        copy = list(original)
        for at in rng.choice(np.arange(1, 59), 3 if i in (7, 42) else 6, replace=False):
            copy[at * 5] = f"c{i}x{at}"
        texts_.append(" ".join(copy))
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.class_ids(table).collect()}
    want = brute_classes(texts_)
    assert len(set(want)) == 199 and want[42] == 7
    assert [got[i] for i in range(len(texts_))] == want


def test_the_rest_is_joined_once_per_key(spark):
    """A member of several buckets meets its signature and its shingles in one joined row."""
    members = spark.createDataFrame([(f"b{b}", f"k{k}", b * k) for k in range(4) for b in range(k, 6)], "bucket string, key string, root int")
    sigs = spark.createDataFrame([(f"k{k}", f"s{k}") for k in range(5)], "key string, sig string")
    sets = spark.createDataFrame([(f"k{k}", f"f{k}") for k in range(4)], "key string, found string")
    rows = dartminhash._once_per_key(members, sigs, sets)
    want = sorted((r["key"], f"s{r['key'][1:]}", f"f{r['key'][1:]}", r["bucket"], r["root"]) for r in members.collect())
    assert sorted(tuple(r) for r in rows.collect()) == want and rows.columns == ["key", "sig", "found", "bucket", "root"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner") < plan.index("Aggregate [key")


def sent_back(df):
    """Column names that the Python steps of a frame's plan return."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return [re.findall(r"(\w+)#\d+", found) for found in re.findall(r"MapInArrow \w+\(.*?\)#\d+, \[(.*?)\]", plan)]


def test_what_a_step_has_used_up_stays_out_of_its_result(spark, docs, monkeypatch):
    """Texts, signatures and shingle sets go to Python, but not back."""
    monkeypatch.setattr(dartminhash, "stored", lambda df, label: df)
    keyed = docs.select(dartminhash._key(F.col("text")).alias("key"), "text")
    prints = dartminhash._prints(keyed, "set")
    assert sent_back(prints) == [["key", "sig", "bands", "found"]]
    assert prints.columns == ["key", "sig", "bands", "found"]
    a, b = (prints.select(F.col("key").alias(c)).where("key IS NOT NULL").distinct() for c in "ab")
    pairs = spark.createDataFrame(a.crossJoin(b.limit(3)).collect(), "a binary, b binary")
    table = spark.createDataFrame(prints.where("sig IS NOT NULL").dropDuplicates(["key"]).collect(), prints.schema)
    agreeing = dartminhash._agreeing(pairs, table, 0.65)
    assert sent_back(agreeing) == [["b", "a", "agree"]] and agreeing.columns == ["a", "b"]
    similar = dartminhash._similar(pairs, table, 0.8)
    assert sent_back(similar) == [["b", "a", "near"]] and similar.columns == ["a", "b"]
    assert {r["a"] for r in similar.collect()} >= {r["b"] for r in agreeing.collect() if r["a"] == r["b"]}
    assert sent_back(disclosure._found(keyed)) == [["key", "base", "entities"]]
    assert sent_back(disclosure.sanitise(docs)) == [["_row", "clean"]]


def test_one_of_each_class_stays(spark, docs):
    kept = dartminhash.keep_one(docs).toPandas()
    assert sorted(kept.columns) == sorted(docs.columns)
    ids = sorted(kept.doc_id.dropna().astype(int))
    classes = brute_classes(cases.texts())
    assert ids == sorted(set(classes)) and kept.doc_id.isna().sum() == 1
    assert dartminhash.keep_one(empty(docs)).count() == 0
    assert dartminhash.class_ids(empty(docs)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    for scale in (1.0, 0.3, 2.5):
        elements = rng.integers(0, 2**63, 400).astype(np.uint64)
        x, y = rng.random(400) * scale + 0.01, rng.random(400) * scale + 0.01
        want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        agree = (dartminhash.signature(elements, x, 1024) == dartminhash.signature(elements, y, 1024)).mean()
        assert agree == pytest.approx(want, abs=0.06)


def test_counts_can_weigh(spark):
    rows = [(0, "a b c d e " * 30), (1, "a b c d e " * 30 + "z"), (2, "p q r s t")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = dartminhash.near_duplicate_classes(table, weighting="count")
    assert got.select("class_key").distinct().count() >= 2


def test_components_of_chains_and_rings(spark):
    edges = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(60)]
    edges += [(b"a", b"b"), (b"b", b"c"), (b"c", b"a")]
    got = dartminhash.components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    assert {bytes(r["root"]) for r in got} == {b"000", b"a"} and len(got) == 64


# --- language --------------------------------------------------------------


def test_languages_are_told_apart(spark):
    rng = cases.random.Random(2)
    kinds = {"x": ["th", "ing", "an", "er"], "y": ["sch", "ung", "ein", "ü"], "z": ["ción", "ll", "ñ", "os"]}
    rows = []
    for i in range(150):
        lang = "xyz"[i % 3]
        text = " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
        rows.append((i, text, lang))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = hyperdimensional.train_prototypes(table.where("doc_id < 90"))
    got = hyperdimensional.predict_language(table.where("doc_id >= 90"), prototypes).toPandas()
    assert (got.lang_pred == got.lang).all() and got.score.between(0, 1).all()


def test_bundles_of_many_different_grams_take_little_memory():
    profiler = hyperdimensional.profiler_of(hyperdimensional.DIMENSIONS)
    rng = np.random.default_rng(5)
    counts = [(np.unique(rng.integers(0, hyperdimensional.SLOTS**3, 9000)), 2) for _ in range(5)]
    counts = [(codes, np.full(len(codes), n)) for codes, n in counts]
    tracemalloc.start()
    try:
        bundles = profiler.bundles(counts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6  # one product over all 45,000 vectors takes 184 MB and more
    codes, n = counts[3]
    assert (bundles[3] == sum(n[a : a + 500] @ profiler.vectors(codes[a : a + 500]) for a in range(0, len(codes), 500))).all()


def test_cosines_are_those_of_whole_bundles():
    profiler = hyperdimensional.Profiler(256)
    text = "Ab, cab!  bac"
    codes = profiler.codes(text)
    assert len(codes) == len(" ab cab bac ") - 2
    (_, bundle), = profiler.chunks([text, "", "12"])
    letters = [" abc".index(c) if c in " abc" else -1 for c in " ab cab bac "]
    want = np.zeros(256)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        rows = [np.roll(profiler.rotated[2][k], s) for k, s in ((a, 2), (b, 1), (c, 0))]
        want += rows[0].astype(int) * rows[1] * rows[2]
    assert (bundle[0] == want).all()


def test_language_edges(spark, docs):
    prototypes = hyperdimensional.train_prototypes(docs)
    assert set(prototypes) == {"de", "fr"}
    got = hyperdimensional.predict_language(docs, prototypes).toPandas()
    assert len(got) == len(cases.rows()) and "score" in got
    letterless = [not any(c.isalpha() for c in t or "") for t in got.text]
    assert ((got.lang_pred == "und") == letterless).all()
    nothing = hyperdimensional.predict_language(docs, hyperdimensional.train_prototypes(empty(docs))).toPandas()
    assert set(nothing.lang_pred) == {"und"}
    assert hyperdimensional.predict_language(empty(docs), prototypes).count() == 0


# --- components joined round by round --------------------------------------


def test_roots_joined_round_by_round_are_the_components(spark):
    rng = cases.random.Random(11)
    links = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(45)) if a != b]
    root = list(range(60))
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    roots = None
    for part in (links[:15], links[15:20], links[20:]):
        new = spark.createDataFrame([(bytes([min(p)]), bytes([max(p)])) for p in part], "a binary, b binary")
        roots = dartminhash._joined_up(roots, new)
    got = [(r.key[0], r.root[0]) for r in roots.collect()]
    ends = {i for p in links for i in p}
    assert len(got) == len(ends) and dict(got) == {i: root[i] for i in ends}


# --- personal data ---------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            luhn = sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
            good = {
                "email": True,
                "ip": name != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn,
                "phone": 10 <= len(digits) <= 15,
            }[name]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = cases.random.Random(7)
    parts = ["a", "b.c", "@", "x@y.de", ".", "-", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "+49", " ", "(", ")", "é", "%", "\n", "+1 202 555 0143"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert disclosure.base_spans(text) == brute_spans(text), text
    assert disclosure.base_spans("a" * 1_000_000 + "1" * 1_000_000) == []


def test_terms_that_reveal_are_found(spark):
    rng = cases.random.Random(1)
    common = cases.words(rng, 30)
    rows = []
    for i in range(60):
        text = [rng.choice(common) for _ in range(20)]
        if i < 4:
            text[10:10] = ["zorblax", f"key{i}", "joe@x.org"]
        rows.append((i, " ".join(text)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = disclosure.find_personal_data(table).toPandas().set_index("doc_id").spans
    for i in range(60):
        terms = [rows[i][1][s["s"] : s["e"]] for s in got[i] if s["k"] == 4]
        assert ("zorblax" in terms) == (i < 4) and "key0" not in terms
        assert not set(terms) - {"zorblax", *common}
    clean = disclosure.sanitise(table).toPandas().set_index("doc_id").text
    assert "joe" not in clean[0] and "[EMAIL]" in clean[0] and "zorblax" not in clean[0]
    assert clean[30] == rows[30][1]


def test_terms_anywhere_in_a_text_are_found_and_masked_everywhere(spark):
    rng = cases.random.Random(5)
    common = cases.words(rng, 40)
    rows = [(i, " ".join(rng.choice(common) for _ in range(30))) for i in range(80)]
    for i in range(6):
        rows[i] = (i, f"{rows[i][1]} please write to joe@x.org in one of these cases, then ask for {rng.choice(common)} Zorblax. {rng.choice(common)} 李明 {rng.choice(common)} Zorblax.")
    rows.append((80, "nothing here but zorblax himself"))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    clean = disclosure.sanitise(table).toPandas().set_index("doc_id").text
    for i in range(6):
        assert "zorblax" not in clean[i].lower() and "李明" not in clean[i]
        assert "please write to [EMAIL] in one of these cases, then ask for" in clean[i]
    assert clean[80] == "nothing here but [TERM] himself"
    assert all(clean[i] == rows[i][1] for i in range(6, 80))


def brute_revealing(texts, threshold, support):
    """Revealing words of a corpus, from the definition."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    holds, words, around, named = {}, {}, {}, set()
    for d, text in enumerate(texts):
        spans = brute_spans(text)
        for s, k, e in spans:
            holds.setdefault((k, text[s:e]), set()).add(d)
        found = list(word.finditer(text or ""))
        low = ["", *["".join(c.lower() if c.isascii() else c for c in m.group()) for m in found], ""]
        for i, m in enumerate(found):
            words.setdefault(low[i + 1], set()).add(d)
            covered = any(s < m.end() and m.start() < e for s, _, e in spans)
            if not covered and (len(m.group()) >= 3 or not m.group().isascii()):
                around.setdefault((d, low[i + 1]), (low[i], low[i + 2]))
                if m.group() != m.group().lower() or any(c.isdigit() or c.lower() == c.upper() for c in m.group()):
                    named.add((d, low[i + 1]))
    out = set()
    for rows in holds.values():
        for w, seen in words.items():
            both = [d for d in rows if (d, w) in around]
            if len({texts[d] for d in both}) < support or len(rows) == len(texts):
                continue
            own = math.log(len(texts) / len(rows))
            sides = [{around[d, w][x] for d in both} for x in (0, 1)]
            free = any((d, w) in named for d in both) or min(map(len, sides)) > 1
            if free and math.log(len(texts) * len(both) / (len(seen) * len(rows))) >= threshold * own:
                out.add(w)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_revealing_terms_against_the_definition(spark, seed):
    rng = cases.random.Random(seed)
    pool = [*cases.words(rng, 60), *(f"Name{chr(97 + i)}" for i in range(20)), "\u674e", "q7"]
    mails = [f"m{i}@x.org" for i in range(6)]
    texts = []
    for _ in range(60):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.6:
            mail = rng.randrange(6)
            text += [mails[mail], f"Name{chr(97 + mail)}", f"w{mail}ord", rng.choice(pool)]
        texts.append(" ".join(text))
    texts += texts[:10]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = set()
    for row in disclosure.find_personal_data(table).collect():
        got |= {texts[row.doc_id][x.s : x.e].lower() for x in row.spans if x.k == 4}
    want = brute_revealing(texts, disclosure.DISCLOSURE, disclosure.SUPPORT)
    assert got == want and want


def test_personal_data_edges(spark, docs):
    got = disclosure.find_personal_data(docs).toPandas()
    assert len(got) == len(cases.rows())
    want = {i: brute_spans(t) for i, t in enumerate(cases.texts())}
    for i, base in zip(got.doc_id, got.base, strict=True):
        if not pd.isna(i):
            assert [(b["s"], b["k"], b["e"]) for b in base] == want[int(i)]
    clean = disclosure.sanitise(docs).toPandas()
    assert list(clean.columns) == docs.columns and clean.text.isna().sum() == 1
    assert disclosure.find_personal_data(empty(docs)).count() == disclosure.sanitise(empty(docs)).count() == 0


# --- quality rules ---------------------------------------------------------


def brute_counts(text):
    t = text or ""
    w = space_words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if space_words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed


def test_base_counts_against_brute_force(spark, docs):
    got = mcd_rules.base_counts(docs).collect()
    assert len(got) == len(cases.rows())
    for r in got:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert tuple(r[n] for n in names) == brute_counts(r["text"])


def test_outliers_go_and_the_rest_stays(spark):
    rng = cases.random.Random(3)
    rows = []
    for i in range(400):
        text = cases.words(rng, rng.randint(30, 120))
        if i % 10 == 0:
            text = [w + "***" for w in text]
        rows.append((i, " ".join(text), ["de", None][i % 2], ["a", None, "b"][i % 3]))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mcd_rules.apply_rules(table).toPandas()
    assert len(got) == 400 and (got.kept == (got.doc_id % 10 != 0)).all()
    few = mcd_rules.apply_rules(table.limit(10)).toPandas()
    assert (few.kept == ~few.base_failed).all()


def test_rules_edges(docs):
    got = mcd_rules.apply_rules(docs).toPandas()
    assert len(got) == len(cases.rows()) and not got[got.base_failed].kept.any()
    assert mcd_rules.apply_rules(empty(docs)).count() == 0


def test_determinant_shrinks(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(3000, 4)) * [1, 2, 3, 4] + 5
    data[:600] += 40
    frame = pd.DataFrame(data, columns=list(mcd_rules.STATS)).assign(grp="g")
    rows = spark.createDataFrame(frame)
    logs = []
    for steps in (1, 2, 4):
        e = mcd_rules.mcd_estimates(rows, steps).collect()[0]
        logs.append(sum(np.log(e[f"l{i}{i}"]) for i in range(4)))
    assert logs[0] >= logs[1] - 1e-3 >= logs[2] - 2e-3
    assert [e[f"m{i}"] for i in range(4)] == pytest.approx([5] * 4, abs=0.5)
