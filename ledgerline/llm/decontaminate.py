"""Benchmark decontamination by a broadcast set of test n-grams.

Test items become windows of ``n`` folded words (a shorter item is one window).
Windows go to the executors in blocks of a fixed size; every block is a
broadcast that no benchmark can outgrow, and each document passes the blocks
one after the other inside its task, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import Packed, append_columns, folded_words

WINDOW = 13
#: Windows in one broadcast: about 60 MB in a worker at 13 words each.
BLOCK_WINDOWS = 200_000

SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
_RESULTS = [
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("n_items", T.LongType()),
    ("items_sha256", T.StringType()),
    ("hit_spans", SPANS),
    ("contaminated", T.BooleanType()),
]


def _windows(benchmark: DataFrame, n: int) -> Iterator[tuple[str, tuple[bytes, ...]]]:
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = folded_words(row[1])
        for at in range(min(len(words), max(1, len(words) - n + 1))):
            yield row[0] or "", tuple(words[at : at + n])
            if len(words) <= n:
                break


def _blocks(benchmark: DataFrame, n: int, size: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    block: dict[tuple[bytes, ...], set[str]] = {}
    held = 0
    for item, window in _windows(benchmark, n):
        block.setdefault(window, set()).add(item)
        held += 1
        if held >= size:
            yield block
            block, held = {}, 0
    yield block


class _Scanner:
    """Finds the windows of one block in a document's words."""

    def __init__(self, block: dict[tuple[bytes, ...], set[str]]):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, dict[bytes, set[str]]] = {}
        for window, items in block.items():
            key = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in window], dtype=np.int32)
            by_length.setdefault(len(window), {})[key.tobytes()] = items
        rng = np.random.default_rng(13)
        self.lengths = []
        for length, windows in sorted(by_length.items()):
            factors = rng.integers(1, 2**62, length, dtype=np.int64) | 1
            keys = np.frombuffer(b"".join(windows), dtype=np.int32).reshape(-1, length).astype(np.int64)
            self.lengths.append((length, factors, np.unique((keys * factors).sum(axis=1)), windows))

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged hit spans [start, end) and the items with an occurring window."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int32, count=len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        starts, ends, items = [], [], set()
        for length, factors, hashes, windows in self.lengths:
            if len(words) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(at):
                continue
            code = np.zeros(len(at), dtype=np.int64)
            for k in range(length):
                code += ids[at + k] * factors[k]
            place = np.minimum(np.searchsorted(hashes, code), len(hashes) - 1)
            for start in at[hashes[place] == code].tolist():
                found = windows.get(ids[start : start + length].tobytes())
                if found is not None:
                    starts.append(start)
                    ends.append(start + length)
                    items |= found
        return _merged(zip(starts, ends, strict=True)), items


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, hit_spans and contaminated.

    ``hit_spans`` are word ranges [start, end) covered by windows of any item;
    hashes only select candidates, the words themselves decide.  A document is
    contaminated if at least one word in twenty is hit.  Null and empty texts
    have no words and are clean.  Items without words have no window; items of
    one id count once, a null id is the empty text.  An empty benchmark leaves
    all documents clean.  Columns named like a result are replaced; repeated
    rows are judged each.
    """
    blocks = _blocks(benchmark, n, block_windows)
    sc = docs.sparkSession.sparkContext
    state = [("_spans", SPANS), ("_items", T.ArrayType(T.StringType())), ("_words", T.LongType())]
    packed = Packed(docs, [k for k, _ in _RESULTS])
    docs = docs.select(packed.row, "text")
    for number, block in enumerate(blocks):
        shipped = sc.broadcast(block)

        def make(shipped=shipped):
            scanner = _Scanner(shipped.value)

            def scan(texts, spans=None, items=None, counts=None):
                out: list[list] = [[], [], []]
                for i, text in enumerate(texts):
                    words = folded_words(text)
                    hit, found = scanner.scan(words)
                    if spans is not None:
                        hit = _merged([*map(tuple, hit), *map(tuple, spans[i])])
                        found = found.union(items[i])
                    for column, value in zip(out, (hit, sorted(found), len(words)), strict=True):
                        column.append(value)
                return out

            return scan

        docs = append_columns(docs, ["text"] + [k for k, _ in state] * (number > 0), state, make)

    spans, items = F.col("_spans"), F.col("_items")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    results = {
        "n_words": F.col("_words"),
        "n_hit": hit,
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", items), 256),
        "hit_spans": spans,
    }
    docs = docs.select(*packed.unpacked(), *[v.alias(k) for k, v in results.items()])
    return docs.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(items: set[str]) -> str:
    """Digest of a set of item ids, as in ``items_sha256``."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
