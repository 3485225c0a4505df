"""Remove word sequences that occur more than once in the corpus, by level-wise doubling.

A window of the full length can repeat only if the shorter windows inside it
do.  So short windows are counted first, and only what repeats is looked at
again at twice the length, until the full length is reached.  At a short length
one window stands for each full one: the one with the smallest hash inside it
(equal full windows choose equal ones), about one word in fourteen.  At the
full length every window of what survived is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import Packed, append_columns, space_words, stored

LENGTH = 35

_WORD_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """A 64-bit hash per space-separated word."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8")
    data = np.frombuffer(raw, dtype=np.uint8)
    solid = ~_SPACE[data]
    if not solid.any():
        return np.empty(0, dtype=np.uint64)
    begins = solid & np.concatenate(([True], ~solid[:-1]))
    starts = np.flatnonzero(begins)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
    weights = _powers(_WORD_BASE, int(place[solid].max()) + 1)
    value = np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * weights[np.where(solid, place, 0)], np.uint64(0))
    return mix(np.add.reduceat(value, starts))


class Windows:
    """Hashes of a text's windows of consecutive words, for any length."""

    def __init__(self, text: str | bytes | None):
        words = word_hashes(text)
        self.n = len(words)
        powers = _powers(_BASE, self.n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)))
        self.inverse = _powers(_BASE_INVERSE, self.n)

    def hashes(self, length: int) -> np.ndarray:
        if self.n < length:
            return np.empty(0, dtype=np.uint64)
        return mix((self.sums[length:] - self.sums[:-length]) * self.inverse[: self.n - length + 1])


def _sliding(values: np.ndarray, width: int, better) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = better(values[: len(values) - step], values[step:])
        span += step
    return values


def _anchors(windows: Windows, length: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """(short hashes, smallest short hash inside each full window)."""
    short = windows.hashes(length)
    return short, _sliding(short, full - length + 1, np.minimum)


def _levels(length: int) -> list[int]:
    """Lengths to count before the full one, each about twice the one before."""
    out = [length]
    while out[0] > 9:
        out.insert(0, (out[0] + 1) // 2)
    return out[:-1]


def _live(windows: Windows, alive: dict[int, np.ndarray], full: int) -> np.ndarray:
    """Which full windows still have a repeated anchor at every level so far."""
    keep = np.ones(max(0, windows.n - full + 1), dtype=bool)
    for length, values in alive.items():
        keep &= np.isin(_anchors(windows, length, full)[1], values)
    return keep


def _first_of_each(key: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Positions of the first row of every (key, item)."""
    order = np.lexsort((item, key))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (np.diff(key[order]) != 0) | (np.diff(item[order]) != 0)
    return order[fresh]


def _send(keys: list, items: list, codes: list, rebuilt: bool) -> Iterator[pa.RecordBatch]:
    """Rows (route, key, item, kind) that bring equal codes to one place.

    Kind 0 is a code that the task holds once; kind 1 one that it holds more
    often, sent once; kind 2 is each of the latter's items, which are known to
    repeat and go to a place of their own, once per task however many copies of
    the text it holds.  So neither a code nor a text that fills the corpus sends
    more than one row per task and item.  ``rebuilt``: the item is the code and
    left out of kinds 0 and 1.  Rows keep their order, in which neighbours
    compress well.
    """
    if not keys:
        return
    key, item, code = np.concatenate(keys), np.concatenate(items), np.concatenate(codes)
    _, first, place, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n[place] > 1)
    twice = twice[_first_of_each(key[twice], item[twice])]
    sent = np.concatenate((first, twice))
    kind = np.concatenate(((n > 1).astype(np.int8), np.full(len(twice), 2, dtype=np.int8)))
    route = np.concatenate((code[first], mix(key[twice].view(np.uint64) ^ mix(item[twice].view(np.uint64)))))
    order = np.argsort(sent, kind="stable")
    sent, kind, route = sent[order], kind[order], route[order]
    item = np.where(kind < 2, 0, item[sent]) if rebuilt else item[sent]
    for a in range(0, len(sent), 100_000):
        b = slice(a, a + 100_000)
        columns = [route[b].view(np.int64), key[sent[b]], item[b], kind[b]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["route", "key", "item", "kind"])


def _met(rebuilt: bool):
    """Task over routed rows: the (key, item) pairs whose code came from two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)] for batch in batches]
        if not held:
            return
        route, key, item, kind = (np.concatenate(c) for c in zip(*held, strict=True))
        _, place, n = np.unique(route, return_inverse=True, return_counts=True)
        marked = np.bincount(place, weights=kind == 1) > 0
        kept = np.flatnonzero((kind == 2) | ((kind == 0) & ((n > 1) | marked)[place]))
        if rebuilt:
            item = np.where(kind == 2, item, route)
        kept = kept[_first_of_each(key[kept], item[kept])]
        for a in range(0, len(kept), 100_000):
            b = kept[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[b]), pa.array(item[b])], ["key", "item"])

    return run


_ROUTED = "route long, key long, item long, kind byte"


def _texts(batches: Iterator[pa.RecordBatch], levels: list[int]):
    """(key, windows, surviving hashes per level) of every text."""
    for batch in batches:
        columns = [batch.column(f"v{m}").to_pylist() for m in levels]
        for i, (key, text) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            alive = {m: np.asarray(c[i] or (), dtype=np.int64).view(np.uint64) for m, c in zip(levels, columns, strict=True)}
            yield key, Windows(text), alive


def _sparse_level(found: DataFrame, done: list[int], length: int, full: int) -> DataFrame:
    """(_key, v<length>): the text's anchor hashes that occur twice or more in the corpus."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes = [], []
        for key, windows, alive in _texts(batches, done):
            if windows.n < full:
                continue
            short, least = _anchors(windows, length, full)
            live = _live(windows, alive, full)
            # An anchor is the smallest of some live window around it.
            margin = np.zeros(full - length, np.uint64)
            reach = np.concatenate((margin, np.where(live, least, np.uint64(0)), margin))
            values = short[_sliding(reach, full - length + 1, np.maximum) == short]
            keys.append(np.full(len(values), key, dtype=np.int64))
            codes.append(values)
        yield from _send(keys, [c.view(np.int64) for c in codes], codes, rebuilt=True)

    met = found.mapInArrow(emit, _ROUTED).repartition("route").mapInArrow(_met(True), "key long, item long")
    return met.groupBy(F.col("key").alias("_key")).agg(F.collect_set("item").alias(f"v{length}"))


def _full_level(found: DataFrame, levels: list[int], full: int) -> DataFrame:
    """(key, item): starts of the full windows that occur twice or more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, codes = [], [], []
        for key, windows, alive in _texts(batches, levels):
            at = np.flatnonzero(_live(windows, alive, full))
            keys.append(np.full(len(at), key, dtype=np.int64))
            starts.append(at.astype(np.int64))
            codes.append(windows.hashes(full)[at])
        yield from _send(keys, starts, codes, rebuilt=False)

    return found.mapInArrow(emit, _ROUTED).repartition("route").mapInArrow(_met(False), "key long, item long")


def _cover(full: int):
    """Task over rows sorted by key and start: the removed word spans of each key, [start, end, start, end, ...]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        spans: list[int] = []
        for batch in batches:
            keys, spans_of = [], []
            for key, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != kept:
                    if kept is not None:
                        keys.append(kept)
                        spans_of.append(spans)
                    kept, spans = key, [start, start + full]
                elif start <= spans[-1]:
                    spans[-1] = max(spans[-1], start + full)
                else:
                    spans += [start, start + full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(spans_of, pa.list_(pa.int32()))], ["key", "spans"]
            )
        if kept is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([kept], pa.int64()), pa.array([spans], pa.list_(pa.int32()))], ["key", "spans"]
            )

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans) of ``docs`` (_key, text, ...): word spans covered by windows that occur twice or more.

    ``_key`` is a hash of the text; rows of one text count as copies of each
    other.  The first level is written; later ones join on the key with all
    columns of ``docs``, so that they and the caller share one exchange of it.
    """
    levels = _levels(length)
    found = docs
    for i, m in enumerate(levels):
        part = _sparse_level(found, levels[:i], m, length)
        found = found.join(stored(part, f"repeated-{m}") if i == 0 else part, "_key")
    windows = _full_level(found, levels, length).repartition("key").sortWithinPartitions("key", "item")
    return windows.mapInArrow(_cover(length), "key long, spans array<int>")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and kept_text.

    Every word in a window of ``length`` words whose sequence also starts
    elsewhere, in the same or another document, is removed; windows are judged
    on the input.  ``kept_text`` joins the remaining words by one space.  Null,
    empty and shorter texts lose nothing (null keeps an empty text).  Repeated
    rows are copies of each other and so lose all their windows.  An empty table
    gives an empty result.  Columns named like a result are replaced.

    Texts are shuffled once, by a hash of the text; all later exchanges carry
    hashes and places.  64-bit hashes at three lengths have to agree before two
    windows count as equal.
    """
    results = [
        ("n_words", T.LongType()),
        ("n_removed", T.LongType()),
        ("kept_sha256", T.StringType()),
        ("kept_text", T.StringType()),
    ]
    packed = Packed(docs, [n for n, _ in results])
    docs = docs.select(packed.row, "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    spans = repeated_spans(docs, length)
    joined = docs.join(spans.select(F.col("key").alias("_key"), F.col("spans").alias("_spans")), "_key", "left").drop("_key")

    def make():
        def cut(texts, spans_of):
            out: list[list] = [[], [], [], []]
            for text, spans in zip(texts, spans_of, strict=True):
                words = space_words(text)
                kept, at = [], 0
                for start, end in zip((spans or [])[::2], (spans or [])[1::2], strict=True):
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                rest = b" ".join(kept)
                made = (len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8"))
                for column, value in zip(out, made, strict=True):
                    column.append(value)
            return out

        return cut

    cut = append_columns(joined, ["text", "_spans"], results, make)
    return cut.select(*packed.unpacked(), *[n for n, _ in results])
