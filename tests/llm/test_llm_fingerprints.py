"""Piecewise fingerprints against a slow version, chunk by chunk and pair by pair."""

from __future__ import annotations

import hashlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import piecewise
from ledgerline.llm.queries import QUERIES

MASK = (1 << 64) - 1


def slow_mix(h):
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 29)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 32)


def slow_fingerprint(text):
    data = (text or "").encode()
    levels = []
    for i in range(len(data)):
        h = 0
        for back in range(7):
            if i >= back:
                v = slow_mix(data[i - back] + 1)
                h ^= (v << 9 * back | v >> (64 - 9 * back)) & MASK
        h = slow_mix(h)
        levels.append(64 if not h or i == len(data) - 1 else (h & -h).bit_length() - 1)

    def signature(level):
        out, start = [], 0
        for i, at in enumerate(levels):
            if at >= level:
                chunk = data[max(start - 7, 0) : i + 1]
                code = sum((b + 1) * pow(0xD1342543DE82EF95, p, 1 << 64) for p, b in enumerate(chunk))
                code = slow_mix((code + len(chunk)) & MASK) >> 52
                if code not in out:
                    out.append(code)
                start = i + 1
        return out

    if not data:
        return "0:"
    chunks = [sum(at >= k for at in levels) for k in range(65)]
    level = next(k for k in range(65) if chunks[k] <= 64)
    while level and len(signature(level - 1)) <= 64:
        level -= 1
    found = [signature(level)]
    while chunks[level + len(found)] > 1:
        found.append(signature(level + len(found)))
    digits = piecewise._DIGITS
    return f"{level}:" + ":".join("".join(digits[c >> 6] + digits[c & 63] for c in codes) for codes in found)


def slow_likeness(x, y):
    if x == y:
        return 1.0
    (a, *left), (b, *right) = x.split(":"), y.split(":")
    best, low = 0.0, max(int(a), int(b))
    for level in (low, low + 1):
        if level - int(a) >= len(left) or level - int(b) >= len(right):
            continue
        p, q = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (left[level - int(a)], right[level - int(b)]))
        if not p or not q:
            continue
        row = list(range(len(q) + 1))
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(q):
                new.append(row[j] if c == d else 1 + min(row[j + 1], new[j]))
            row = new
        best = max(best, 1 - row[-1] / (len(p) + len(q)))
    return best


def some_texts():
    rng = cases.random.Random(11)
    base = cases.words(rng, 300)
    out = [t[:3000] if t else t for t in cases.texts()] + ["ab " * 400, "a" * 500, "\x00", "é", "line\n" * 90 + " ".join(base[:50])]
    for i in range(0, 300, 60):
        out.append(" ".join(base[:i] + ["edit"] + base[i + 1 :]))
    return out


def test_fingerprints_against_a_slow_version():
    texts = some_texts()
    got = [piecewise.fingerprint(t) for t in texts]
    assert got == [slow_fingerprint(t) for t in texts]
    pairs = [(a, b) for a in got for b in got]
    found = piecewise.likeness([a for a, _ in pairs], [b for _, b in pairs])
    assert found == pytest.approx([slow_likeness(a, b) for a, b in pairs])


def brute_next(rows):
    """Rows (doc_id, text) with the next row's text, ids descending, nulls last, ties told apart by nothing but their text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_each_row_meets_its_next(spark, parts):
    rows = list(enumerate(some_texts())) + [(None, "no id here at all")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = table.withColumns({"fingerprint": F.lit(1), "next": F.lit(2), "range": F.lit("x"), "_id": F.lit(0)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r["doc_id"]: r for r in piecewise.compare_with_next(table).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) and got[3]["next"] == 2 and got[3]["range"] == "x" and got[3]["_id"] == 0
    for i, text, after in brute_next(rows):
        r = got[i]
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == slow_fingerprint(text) and r["edited_fingerprint"] == slow_fingerprint(new)
        assert r["near_edited"] == pytest.approx(slow_likeness(slow_fingerprint(text), slow_fingerprint(new)))
        assert r["near_next"] == pytest.approx(slow_likeness(slow_fingerprint(text), slow_fingerprint(after)))


def test_awkward_rows(spark):
    docs = cases.docs(spark)
    got = piecewise.compare_with_next(docs).toPandas()
    assert len(got) == len(cases.rows()) and list(got.columns)[: len(docs.columns) - 1] == [c for c in docs.columns if c != "n_chars"]
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert got.groupby(got.text.fillna("")).fingerprint.nunique().max() == 1
    assert piecewise.compare_with_next(docs.limit(0)).count() == piecewise.fingerprint_texts(docs.limit(0)).count() == 0
    (one,) = piecewise.compare_with_next(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert piecewise.fingerprint_texts(docs).where("fingerprint IS NULL").count() == 0


def test_an_edited_text_is_nearer_than_another(spark):
    got = QUERIES["op11_piecewise_hash"](spark, "/root/testdata/sf0.001").toPandas()
    assert np.mean(got.near_edited > got.near_next) > 0.98 and got.near_edited.median() > 0.6 and got.near_next.median() < 0.1
