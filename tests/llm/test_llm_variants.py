"""Spelling variants against all pairs of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import cases
from pyspark.sql import functions as F

from ledgerline.llm import pivots
from ledgerline.llm.common import table
from ledgerline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=3, typo=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    near = {w: [] for w in words}
    by_len = {}
    for w in words:
        by_len.setdefault(len(w), []).append(w)
    for w in words:
        for size in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [x for x in by_len.get(size, []) if one_edit(w, x)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def rows_of(found):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}


def test_two_grams_without_overlap_are_chosen_from_the_rarest():
    rng = cases.random.Random(2)
    rank = {a + b: i for i, (a, b) in enumerate((a, b) for a in "abc" for b in "abc")}
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(4, 9)))
        prefix, chosen, last = pivots.prefix_and_pivots(word, rank)
        ranks = [rank[g] for g in pivots.grams(word)]
        assert prefix == [i for i, r in enumerate(ranks) if r <= last] and last == sorted(ranks)[2]
        apart = [(ranks[i] + ranks[j], (i, j)) for i in prefix for j in prefix if j >= i + 2]
        assert ranks[chosen[0]] + ranks[chosen[1]] == min(apart)[0] and chosen[1] >= chosen[0] + 2


def test_near_words_against_all_pairs(spark):
    rng = cases.random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(700)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa"}
    table_ = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long").repartition(5)
    got = sorted((r["word"], r["other"]) for r in pivots.near_words(table_).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_forms_and_roots_against_brute_force(spark):
    rng = cases.random.Random(4)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts = []
    for _ in range(300):
        text = []
        for _ in range(40):
            word = rng.choice(base[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                at = rng.randrange(len(word))
                word = rng.choice([word[:at] + word[at + 1 :], word[:at] + "x" + word[at:], word[:at] + "é" + word[at + 1 :]])
            text.append(word.upper() if rng.random() < 0.2 else word)
        texts.append(rng.choice([" ", "1", "\n", "Ā"]).join(text))
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (5, None), (6, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for typo in (97, 3):
        assert rows_of(pivots.spelling_variants(frame, typo=typo)) == brute(rows, typo=typo)
    groups = pivots.group_variants(frame).agg(F.sum("words"), F.sum("n")).first()
    want = brute(rows)
    assert tuple(groups) == (len(want), sum(v[2] for v in want.values()))


def test_chains_of_forms(spark):
    chain = [("aaaaa", 1), ("aaaab", 2), ("aaabb", 4), ("aabbb", 8), ("abbbb", 16), ("bbbbb", 32), ("bbbbx", 31), ("zzzzz", 9)]
    got = {r["word"]: (r["form"], r["root"]) for r in pivots.spelling_forms(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert got["aaaaa"] == ("aaaab", "bbbbb") and got["bbbbx"] == (None, "bbbbx") and got["zzzzz"] == (None, "zzzzz")
    assert got["abbbb"] == ("bbbbb", "bbbbb")


def test_awkward_rows(spark):
    docs = cases.docs(spark)
    got = rows_of(pivots.spelling_variants(docs, least_count=1))
    assert got == brute([(r[0], r[1]) for r in cases.rows()], least=1) and got
    assert pivots.spelling_variants(docs.limit(0)).count() == 0


def test_the_query_on_the_smallest_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    found = QUERIES["op12_pivotal_grams"](spark, FOLDER)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"] and rows_of(found) == brute(rows)
