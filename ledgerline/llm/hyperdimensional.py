"""Language identification with hyperdimensional profiles.

Every letter slot has a random vector of +1 and -1.  An n-gram binds its
letters' vectors, each rotated by its place; a text bundles its n-grams; a
language bundles its training texts.  The language whose prototype has the
highest cosine with a text is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import SLICE, append_columns

DIMENSIONS = 1024
#: Letter slots: 0 is any run of other characters, 1-26 are a-z, other letters share the rest by code point.
SLOTS = 256
#: N-grams held at once, counted and not yet bundled.
CHUNK = 400_000
#: Distinct n-grams whose vectors are made at once; bounds the memory of one matrix product, however varied the texts.
VECTORS = 2000
UNKNOWN = "und"

_GRAM = 3


def _slots() -> np.ndarray:
    """Slot of every code point, letters of either case alike."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            o = ord(low[0])
            table[c] = o - 96 if 97 <= o <= 122 else 27 + o * 40503 % (SLOTS - 27)
    return table


class Profiler:
    """Item memory, n-gram codes and bundles; equal on every executor."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.slots = _slots()
        base = np.random.default_rng(8).integers(0, 2, (SLOTS, dimensions), dtype=np.int8) * 2 - 1
        self.rotated = [np.roll(base, _GRAM - 1 - k, axis=1) for k in range(_GRAM)]

    def codes(self, text: str | None) -> np.ndarray:
        """Distinct-by-place codes of the text's n-grams; none if it has no letter."""
        if not text:
            return np.empty(0, dtype=np.int64)
        slots = self.slots[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        slots = np.concatenate(([0], slots, [0])).astype(np.int64)
        slots = slots[(slots > 0) | np.concatenate(([True], slots[:-1] > 0))]
        if len(slots) < _GRAM:
            return np.empty(0, dtype=np.int64)
        return (slots[:-2] * SLOTS + slots[1:-1]) * SLOTS + slots[2:]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of n-gram codes, one row each."""
        out = self.rotated[_GRAM - 1][codes % SLOTS]
        for k in range(_GRAM - 2, -1, -1):
            codes = codes // SLOTS
            out = out * self.rotated[k][codes % SLOTS]
        return out.astype(np.float32)

    def bundles(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Bundle of each (codes, counts) pair, one row each."""
        if not counts:
            return np.empty((0, self.rotated[0].shape[1]), dtype=np.float32)
        codes, n = (np.concatenate(parts) for parts in zip(*counts, strict=True))
        row = np.repeat(np.arange(len(counts)), [len(c) for c, _ in counts])
        order = np.argsort(codes, kind="stable")
        codes, n, row = codes[order], n[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(codes) != 0)))
        ends = np.append(first, len(codes))
        out = np.zeros((len(counts), self.rotated[0].shape[1]), dtype=np.float32)
        for a in range(0, len(first), VECTORS):
            b = min(a + VECTORS, len(first))
            part = slice(ends[a], ends[b])
            table = np.zeros((len(counts), b - a), dtype=np.float32)
            table[row[part], np.searchsorted(codes[first[a:b]], codes[part])] = n[part]
            out += table @ self.vectors(codes[first[a:b]])
        return out

    def chunks(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray]]:
        """(positions, bundles) of the texts that have letters, a bounded number of n-grams at a time."""
        at: list[int] = []
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for i, text in enumerate(texts):
            codes = self.codes(text)
            if len(codes):
                at.append(i)
                counts.append(np.unique(codes, return_counts=True))
                held += len(codes)
            if held >= CHUNK:
                yield at, self.bundles(counts)
                at, counts, held = [], [], 0
        if at:
            yield at, self.bundles(counts)


@lru_cache(maxsize=2)
def profiler_of(dimensions: int) -> Profiler:
    """One profiler for all tasks of a Python worker."""
    return Profiler(dimensions)


def train_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """One prototype per language of ``docs`` (text, lang), bundled from all its texts.

    Tasks count n-grams per language and bundle them once; sums of the bundles
    are formed by Spark per (language, dimension), so what reaches the driver is
    one vector per language.  Rows without a language or a letter teach nothing.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = profiler_of(dimensions)
        seen: dict[str, dict[str, np.ndarray]] = {}
        for batch in (whole.slice(a, SLICE) for whole in batches for a in range(0, whole.num_rows, SLICE)):
            for text, lang in zip(*(batch.column(k).to_pylist() for k in ("text", "lang")), strict=True):
                codes = profiler.codes(text)
                if len(codes):
                    held = seen.setdefault(lang, _Counts())
                    held.add(codes)
        for lang, held in seen.items():
            held.fold()
            total = np.zeros(dimensions)
            for a in range(0, len(held.codes), VECTORS):
                part = slice(a, a + VECTORS)
                total += held.n[part].astype(np.float64) @ profiler.vectors(held.codes[part])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tolist()])], ["lang", "bundle"])

    schema = "lang string, bundle array<double>"
    sums = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("text", "lang")
        .mapInArrow(partial, schema)
        .select("lang", F.posexplode("bundle").alias("at", "value"))
        .groupBy("lang", "at")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("bundle"))
    )
    return {r["lang"]: np.array([x["value"] for x in r["bundle"]]) for r in sums.collect()}


class _Counts:
    """Sorted n-gram codes with counts; new codes wait and are merged in bulk."""

    def __init__(self):
        self.codes, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, codes: np.ndarray) -> None:
        self.new.append(codes)
        self.waiting += len(codes)
        if self.waiting >= CHUNK:
            self.fold()

    def fold(self) -> None:
        if not self.new:
            return
        codes, n = np.unique(np.concatenate(self.new), return_counts=True)
        self.codes, place = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
        self.n = np.bincount(place, weights=np.concatenate([self.n, n])).astype(np.int64)
        self.new, self.waiting = [], 0


def predict_language(
    docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS
) -> DataFrame:
    """``docs`` with lang_pred and score (cosine with the predicted prototype, not below 0).

    The whole text counts.  Null, empty and letterless texts are ``und`` with
    score 0, as is everything if no language was learned.  Equal cosines go to
    the language first in order.  Columns named like a result are replaced.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names])

    def make():
        profiler = profiler_of(dimensions)

        def predict(texts):
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for at, bundles in profiler.chunks(texts) if names else ():
                norms = np.maximum(np.linalg.norm(bundles, axis=1), 1e-12)
                cosine = bundles @ matrix.T.astype(np.float32) / norms[:, None]
                best = cosine.argmax(axis=1)
                for i, b, c in zip(at, best, cosine[np.arange(len(at)), best], strict=True):
                    lang[i], score[i] = names[b], float(min(1.0, max(0.0, c)))
            return [lang, score]

        return predict

    return append_columns(docs, ["text"], [("lang_pred", T.StringType()), ("score", T.DoubleType())], make)
