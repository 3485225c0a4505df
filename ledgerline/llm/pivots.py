"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are ordered by how rare they are among all words.  Its
prefix are the three rarest (and further places of the third one's kind), and
from them a dynamic programme chooses two pivots that do not overlap and are
rarest together.  One edit cannot touch both pivots, so of two near words the
one whose prefix ends with the rarer kind has a pivot that stands untouched in
the other's prefix: pivots are looked up among prefixes only.  The untouched
gram limits places: the edit is wholly behind it, then both words are equal up
to its end; or wholly before it, then they are equal from its start on.  Each
pivot and prefix gram therefore has two keys, and words that meet in one are
verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stored

#: Letters a word is made of once A-Z are lower-cased: 26 and those of U+00C0 to U+00FF.
ALPHABET = 26 + 0x100 - 0xC0
#: Length of a gram, edits apart, and grams of a prefix.
Q, EDITS = 2, 1
PREFIX = Q * EDITS + 1
#: One run in so many loses a code point.
TYPO = 97
LEAST_CHARS, LEAST_COUNT = 5, 3
#: Letters that two words must have in common before they are compared without looking at the rest.
SURE = 6
#: Different words a task holds before it passes their counts on.
HELD = 200_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def _long_runs(least: int) -> re.Pattern:
    """Maximal runs of letters with at least so many; a deletion makes no run longer."""
    return re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")


def _changes(doc_id: str | None, found: list[str], typo: int) -> list[tuple[str, str]]:
    """(run, run less a code point) of the different runs whose checksum says so."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    hashes = [(zlib.crc32(run.encode("utf-8"), start), run) for run in set(found)]
    return [(run, run[: h % len(run)] + run[h % len(run) + 1 :]) for h, run in hashes if h % typo == 0]


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) that are long and frequent enough.

    Words are counted in the task before they are sent.  Null texts have no
    words, a null doc_id is the empty text in the checksum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        pattern = _long_runs(least_chars)

        def passed_on() -> pa.RecordBatch:
            words = [w for w, n in held.items() if n and len(w) >= least_chars]
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([held[w] for w in words], pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = pattern.findall((text.as_py() or "").translate(_LOWER))
                held.update(found)
                for run, changed in _changes(doc_id, found, typo):
                    n = found.count(run)
                    held[run] -= n
                    held[changed] += n
                if len(held) >= HELD:
                    yield passed_on()
                    held.clear()
        yield passed_on()

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def grams(word: str) -> list[str]:
    return [word[i : i + Q] for i in range(len(word) - Q + 1)]


def prefix_and_pivots(word: str, rank: dict[str, int]) -> tuple[list[int], list[int], int]:
    """Places of a word's prefix grams, places of its pivots, and the rank of the prefix's last kind.

    ``rank`` orders kinds of gram, the rarest first.
    """
    order = sorted((rank[g], i) for i, g in enumerate(grams(word)))
    last = order[min(PREFIX, len(order)) - 1][0]
    prefix = sorted((i, r) for r, i in order if r <= last)
    # best[k]: least sum of ranks of k grams so far that do not overlap, and where they are.
    history: list[list[tuple[int, tuple[int, ...]] | None]] = []
    for i, r in prefix:
        free = next((best for best, (j, _) in zip(reversed(history), reversed(prefix[: len(history)]), strict=True) if j + Q <= i), [(0, ())])
        best = list(history[-1]) if history else [(0, ())]
        for k in range(1, EDITS + 2):
            if len(free) >= k and free[k - 1] is not None:
                new = (free[k - 1][0] + r, (*free[k - 1][1], i))
                if len(best) <= k:
                    best.append(new)
                else:
                    best[k] = min(best[k], new)
        history.append(best)
    return [i for i, _ in prefix], list(history[-1][EDITS + 1][1]), last


def _keys(word: str, at: int, is_pivot: bool) -> Iterator[str]:
    """What stays the same around an untouched gram: all up to its end, or all from its start.

    Where that is only a few letters, the rest counts too: one edit leaves its
    first or its second half as it is, halves being those of the pivot's word,
    whose rest may be a letter shorter or longer.
    """
    for mark, same, rest in (("<", word[: at + Q], word[at + Q :]), (">", word[at:], word[:at])):
        if len(same) >= SURE:
            yield mark + same
            continue
        for n in (len(rest),) if is_pivot else range(max(0, len(rest) - EDITS), len(rest) + EDITS + 1):
            half = n // 2
            yield f"{mark}{same}[{n}[{rest[:half]}"
            yield f"{mark}{same}]{n}]{rest[max(0, len(rest) - n + half) :]}"


def _gram_ranks(words: DataFrame) -> dict[str, int]:
    """Rank of each kind of gram, the rarest first.  There are at most ALPHABET**2 = 8100 kinds."""
    places = F.expr(f"sequence(1, length(word) - {Q - 1})")
    kinds = words.select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(Q)))).alias("gram"))
    counted = kinds.groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {g: k for k, (_, g) in enumerate(sorted((r["n"], r["gram"]) for r in counted))}


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for every two of ``words`` (word, n; different words) exactly one edit apart, both ways.

    Words need at least four code points, so that two grams without overlap
    exist among any three, and letters of ``ALPHABET``.
    """
    rank = words.sparkSession.sparkContext.broadcast(_gram_ranks(words))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"is_pivot": [], "key": [], "word": [], "n": [], "last": []}
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                prefix, pivots, last = prefix_and_pivots(word, rank.value)
                for is_pivot, places in ((True, pivots), (False, prefix)):
                    keys = {key for at in places for key in _keys(word, at, is_pivot)}
                    out["is_pivot"] += [is_pivot] * len(keys)
                    out["key"] += sorted(keys)
                    out["word"] += [word] * len(keys)
                    out["n"] += [n] * len(keys)
                    out["last"] += [last] * len(keys)
            kinds = [pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    entries = stored(words.select("word", "n").mapInArrow(index, "is_pivot boolean, key string, word string, n long, last int"), "gram-index")
    pivots = entries.where("is_pivot").select("key", "word", "n", "last")
    prefixes = entries.where("NOT is_pivot").select("key", *[F.col(c).alias(f"other_{c}") for c in ("word", "n", "last")])
    near = (
        (F.col("last") <= F.col("other_last"))
        & (F.abs(F.length("word") - F.length("other_word")) <= EDITS)
        & (F.levenshtein("word", "other_word", EDITS) == EDITS)
    )
    pairs = pivots.join(prefixes, "key").where(near)
    ways = F.array(
        F.struct("word", "n", F.col("other_word").alias("other"), "other_n"),
        F.struct(F.col("other_word").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    # Dealt by word: rows of a pair meet, and what follows by word moves nothing.
    both = pairs.select(F.explode(ways).alias("x")).select("x.*").repartition("word")
    return both.dropDuplicates(["word", "other"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: where its chain of forms ends.

    A form is at least twice as frequent as its word, so a chain has no ring
    and at most log2 of the largest count many steps; each round doubles the
    steps taken.
    """
    jumps = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        after = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(jumps.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "roots")
        jumps = new.select("word", "root")
        if not new.where("further IS NOT NULL").limit(1).count():
            return jumps


def spelling_forms(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per row of ``words`` (word, n).

    Near words differ by one inserted, deleted or replaced code point.  A
    word's form is its most frequent near word (ties: the first in code-point
    order) if that is at least twice as frequent, else null; its root is where
    forms lead to, itself without a form.
    """
    near = near_words(words)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.max("other_n").alias("most"),
        F.min_by("other", F.struct(-F.col("other_n"), F.col("other"))).alias("other"),
    )
    joined = words.join(best, "word", "left")
    has = F.col("most") >= 2 * F.col("n")
    forms = stored(
        joined.select(
            "word",
            F.when(has, F.col("other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, F.col("most")).alias("form_n"),
        ),
        "forms",
    )
    found = forms.join(_roots(forms), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """Spelling forms of the words in ``docs`` (doc_id, text, ...); other columns are not looked at.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z
    lower-cased; where the crc32 of ``doc_id:run`` is a multiple of ``typo`` a
    code point is deleted.  Counted are words of at least five code points
    with at least ``least_count`` places, repeated rows as often as they stand
    there.  Null and empty texts have no words, a null doc_id is empty in the
    checksum; an empty table gives an empty result.
    """
    words = stored(count_words(docs, least_count=least_count, typo=typo), "words")
    return spelling_forms(words)


def group_variants(docs: DataFrame) -> DataFrame:
    """(root, n, words): one row per group of spellings, its root, places of all its words, and how many words it has."""
    found = spelling_variants(docs)
    return found.groupBy("root").agg(F.sum("n").alias("n"), F.count("*").alias("words"))
