"""Token alignment against common ends found by set, on the tokenizers' own output."""

from __future__ import annotations

import hashlib
from collections import Counter

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import tokenizer_align
from ledgerline.llm.common import table
from ledgerline.llm.queries import QUERIES

FOLDER = tokenizer_align.FOLDER
TEXTS = [
    *(t if t is None or len(t) < 5000 else t[:5000] for t in cases.texts()),
    "<|endoftext|> and <s> </s> <unk> <0x41>",
    "a▁b", "  two  spaces ", " lead", "trail ", "tab\tand\r\nline", " 　 ", "ﬁ ① Å é 한",
    "\U0001f469‍\U0001f4bb" * 5, "日本語の文章です。" * 3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "I'm we'll 12345 6,789.01", "\x00\x01\x7f�",
]


@pytest.fixture(scope="module")
def sides():
    return (
        tokenizer_align.ByteTokenizer(f"{FOLDER}/{tokenizer_align.BYTE_BPE}"),
        tokenizer_align.PieceTokenizer(f"{FOLDER}/{tokenizer_align.PIECE_BPE}"),
    )


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(f"{FOLDER}/{tokenizer_align.BYTE_BPE}")
    found.encode_special_tokens = True
    return found


def test_ids_are_those_of_the_file(sides, plain):
    rng = cases.random.Random(1)
    letters = [*"abcXYZ '\"sdtmrelv0129.,\n\t\r", " ", " ", "é", "ß", "中", "́", " ", "\U0001f600", "<|endoftext|>", "٣", "½", "​", "\x1c", "\x85", "▁", " a", "  ", " \n"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        want = plain.encode(" " + text, add_special_tokens=False).ids
        got = sides[0].encode(" " + text)
        assert got.tolist() == want and sides[0].spell(got) == (" " + text).encode()
    assert sides[0].pieces[plain.token_to_id("Ġthe")] == b" the" and len(sides[0].pieces) == 50256


ends = st.lists(st.integers(1, 6), min_size=1, max_size=60).map(lambda x: np.cumsum(x).tolist())


@settings(max_examples=500, deadline=None)
@given(ends, ends, st.integers(0, 40))
def test_groups_end_where_both_end(a, b, equal):
    both = [*range(1, equal + 1)]  # a one-to-one stretch, then two irregular ones
    last = max(a[-1], b[-1]) + 1 + equal
    a = both + [x + equal for x in a] + [last, *range(last + 1, last + equal)]
    b = both + [x + equal for x in b] + [last, *range(last + 1, last + equal)]
    common = sorted(set(a) & set(b))
    assert tokenizer_align.group_ends(a, b) == ([a.index(x) + 1 for x in common], [b.index(x) + 1 for x in common])


def brute(texts, sides):
    found, linked = [], []
    for text in texts:
        spaced = " " + (text or "")
        a, b = (s.encode(spaced).tolist() for s in sides)
        if not text or any(b"".join(s.pieces[i] for i in ids) != spaced.encode() for s, ids in zip(sides, (a, b), strict=True)):
            found.append(None)
            linked.append(Counter())
            continue
        ends_a, ends_b = (np.cumsum([len(s.pieces[i]) for i in ids]).tolist() for s, ids in zip(sides, (a, b), strict=True))
        groups, i, j = [], 0, 0
        for x in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(x) + 1, ends_b.index(x) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        found.append((len(a), len(b), groups))
        linked.append(Counter((x, y) for g, h in groups for x in g for y in h))
    count = Counter(pair for links in linked for pair in links)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for f, links in zip(found, linked, strict=True):
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        string = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in f[2])
        best = sum(n for (x, y), n in links.items() if count[x, y] == most[x])
        out.append((f[0], f[1], len(f[2]), sum(links.values()), best, sum(n * count[p] for p, n in links.items()), string))
    return out, count, most


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.mark.parametrize("slice_bytes", [tokenizer_align.SLICE_BYTES, 300])
def test_alignment_against_brute_force(spark, sides, monkeypatch, slice_bytes):
    monkeypatch.setattr(tokenizer_align, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(tokenizer_align, "LISTED", tokenizer_align.LISTED if slice_bytes > 300 else 2)
    texts = TEXTS + TEXTS[5:8]
    rows = [(i, t, "x", "y", 7) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, slice string, pairs string, n_a int").repartition(3)
    want, count, most = brute(texts, sides)
    assert sum(not w[0] for w in want) == 3 and sum(w[0] > 0 for w in want) >= 15
    got = {r["doc_id"]: r for r in tokenizer_align.align_tokens(frame, keep_groups=True).collect()}
    assert [tuple(got[i][n] for n in [*NAMES, "groups"]) for i in range(len(texts))] == want
    assert all(r["slice"] == "x" and r["pairs"] == "y" for r in got.values())
    hashed = {r["doc_id"]: r["groups_sha256"] for r in tokenizer_align.align_tokens(frame).collect()}
    assert hashed == {i: hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for i, w in enumerate(want)}
    pairs = {(r["id_a"], r["id_b"]): (r["count"], r["is_best"]) for r in tokenizer_align.link_counts(frame).collect()}
    assert pairs == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_awkward_rows(spark):
    docs = cases.docs(spark)
    got = tokenizer_align.align_tokens(docs)
    assert got.count() == len(cases.rows()) and got.columns[: len(docs.columns)] == docs.columns
    assert got.where(F.coalesce("text", F.lit("")) == "").select(*NAMES).distinct().collect() == [(0,) * 6]
    assert tokenizer_align.align_tokens(docs.limit(0)).count() == tokenizer_align.link_counts(docs.limit(0)).count() == 0
    only = tokenizer_align.align_tokens(docs.where("text IS NULL OR text = ''")).collect()
    assert len(only) == 2 and all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in only)


def test_the_query_on_the_smallest_table(spark, sides):
    rows = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()}
    want = dict(zip(rows, brute(list(rows.values()), sides)[0], strict=True))
    found = QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", *NAMES, "groups_sha256"]
    for r in found.collect():
        w = want[r["doc_id"]]
        assert tuple(r)[1:] == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")
