"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes decides where a chunk ends, so an edit
moves only the boundaries near it.  Bits of that hash are a ladder of block
sizes: at level k every position whose k lowest bits are zero is a boundary,
hence the boundaries of one level are some of those of the level below.  A
fingerprint holds the level at which the whole text has at most 64 chunks, one
code per chunk there, and the codes of the level above.  Two fingerprints are
compared where they share a level, by the edit distance of their codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.llm.common import Packed, append_columns, stored
from ledgerline.llm.substring import mix

#: Bytes of the rolling window, and chunks of a signature at most: one machine word of the comparison.
WINDOW, CHUNKS = 7, 64
#: Bits of a chunk's code, written as two characters.
CODE_BITS = 12
#: Rows compared at a time.
ROWS = 256

_U = np.uint64
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODES = [a + b for a in _DIGITS for b in _DIGITS]
_VALUES = {code: i for i, code in enumerate(_CODES)}
_BASE = _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _levels(data: np.ndarray) -> np.ndarray:
    """The highest level at which each byte is a boundary."""
    rolled = np.zeros(len(data), dtype=np.uint64)
    spread = _BYTE[data]
    for back in range(min(WINDOW, len(data))):
        turned = (spread << _U(9 * back)) | (spread >> _U(64 - 9 * back)) if back else spread
        rolled[back:] ^= turned[: len(data) - back]
    rolled = mix(rolled)
    lowest = rolled & (~rolled + _U(1))
    return np.where(lowest == 0, 64, np.log2(np.maximum(lowest, _U(1)).astype(np.float64))).astype(np.int64)


def _codes(sums: np.ndarray, inverse: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code per chunk: its bytes and the window that opened it."""
    starts = np.maximum(np.concatenate(([0], ends[:-1])) - WINDOW, 0)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)) >> _U(64 - CODE_BITS)


def fingerprint(text: str | None) -> str:
    """``level:codes:codes one level up:...``; null is the empty text, whose fingerprint is ``0:``.

    A chunk that has come before in the text is not written again, so a loop
    fills no signature.
    """
    data = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
    n = len(data)
    if not n:
        return "0:"
    levels = _levels(data)
    levels[-1] = 64  # the end of the text ends a chunk at every level
    at_least = np.cumsum(np.bincount(levels, minlength=65)[::-1])[::-1]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * _powers(_BASE, n), dtype=np.uint64)))
    inverse = _powers(_INVERSE, n)

    def signature(level: int) -> list[int]:
        return list(dict.fromkeys(_codes(sums, inverse, np.flatnonzero(levels >= level) + 1).tolist()))

    level = int(np.argmax(at_least <= CHUNKS))
    found = [signature(level)]
    while level and len(below := signature(level - 1)) <= CHUNKS:
        level, found = level - 1, [below, *found]
    while at_least[top := level + len(found)] > 1:
        found.append(signature(top))
    return f"{level}:" + ":".join("".join([_CODES[c] for c in codes]) for codes in found)


def _signatures(print_: str) -> tuple[int, list[str]]:
    level, *parts = print_.split(":")
    return int(level), parts


def _values(codes: str) -> np.ndarray:
    return np.array([_VALUES[codes[i : i + 2]] for i in range(0, len(codes), 2)], dtype=np.int32)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, a bit a chunk, all pairs at once."""
    n = len(left)
    x, y = np.full((n, CHUNKS), -1, dtype=np.int32), np.full((n, CHUNKS), -2, dtype=np.int32)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        x[i, : len(a)], y[i, : len(b)] = a, b
    bit = _U(1) << np.arange(CHUNKS, dtype=np.uint64)
    open_ = np.full(n, ~_U(0))
    for j in range(max((len(b) for b in right), default=0)):
        match = ((x == y[:, j : j + 1]) * bit).sum(axis=1, dtype=np.uint64)
        both = open_ & match
        open_ = (open_ + both) | (open_ - both)
    return np.bitwise_count(~open_).astype(np.int64)


def likeness(left: list[str], right: list[str]) -> list[float]:
    """1 less the share of chunks that have to be deleted or inserted to turn one signature into the other.

    Signatures are compared at the lowest level that both fingerprints have
    and at the one above it, the better of two counts.  Without a common level
    the likeness is 0; two empty texts have 1.
    """
    best = np.zeros(len(left))
    pairs: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if a == b:
            best[i] = 1.0
            continue
        (la, sa), (lb, sb) = _signatures(a), _signatures(b)
        low = max(la, lb)
        for x, y in list(zip(sa[low - la :], sb[low - lb :], strict=False))[:2]:
            if x and y:
                pairs.append((i, _values(x), _values(y)))
    if pairs:
        owner, xs, ys = zip(*pairs, strict=True)
        same = _common(list(xs), list(ys))
        total = np.array([len(x) + len(y) for x, y in zip(xs, ys, strict=True)])
        np.maximum.at(best, np.array(owner), 2.0 * same / total)
    return best.tolist()


def edited(text: str | None, after: str | None) -> str:
    """The last third of a text's code points replaced by the first as many, or all, of another text."""
    text, after = text or "", after or ""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with the fingerprint of each whole text; equal texts have equal ones.

    Null is the empty text.  Repeated rows stay.  An empty table gives an
    empty result.  A column named fingerprint is replaced.
    """
    return append_columns(docs, ["text"], [("fingerprint", T.StringType())], lambda: lambda texts: [[fingerprint(t) for t in texts]])


def _squeezed():
    pack = zstandard.ZstdCompressor(level=3).compress
    return lambda texts: [[pack((t or "").encode("utf-8")) for t in texts]]


def _with_next(df: DataFrame, fields: list[tuple[str, T.DataType]], compute: Callable[[list, list], list[list]]) -> DataFrame:
    """(row, *fields): ``compute`` of every row's text and that of the next row by descending id, the last row's next being the first.

    ``df`` has _row, _id and text.  Rows move once, into ranges of ids, their
    texts compressed.  A row's next is the one below it in its range; only the last row of a range waits
    for the first text of another, and which range that is is found among the
    ranges' numbers alone.
    """
    names = [n for n, _ in fields]
    kinds = [to_arrow_type(t) for _, t in fields]
    order = [F.col("_id").desc_nulls_last(), F.col("mark"), F.col("packed")]
    squeezed = append_columns(df.withColumn("mark", F.xxhash64("text")), ["text"], [("packed", T.BinaryType())], _squeezed).drop("text")
    dealt = squeezed.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    schema = T.StructType(
        [dealt.schema["_row"], *[T.StructField(n, t) for n, t in fields]]
        + [T.StructField("range", T.IntegerType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType())]
        + [T.StructField("is_first", T.BooleanType()), T.StructField("is_last", T.BooleanType())]
    )

    def batch_of(rows: pa.Array, made: list[list], number: int, first: list, last: list, ends: tuple[list, list]) -> pa.RecordBatch:
        arrays = [rows, *[pa.array(v, k) for v, k in zip(made, kinds, strict=True)]]
        arrays += [pa.array([number] * len(rows), pa.int32()), pa.array(first, pa.string()), pa.array(last, pa.string())]
        arrays += [pa.array(e, pa.bool_()) for e in ends]
        return pa.RecordBatch.from_arrays(arrays, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
        held_row, held, started = None, None, False

        def out(rows, texts, nexts, ends_range):
            head, tail = [None] * len(texts), [None] * len(texts)
            is_first, is_last = [False] * len(texts), [False] * len(texts)
            nonlocal started
            if not started:
                head[0], is_first[0], started = texts[0], True, True
            if ends_range:
                tail[-1], is_last[-1] = texts[-1], True
            return batch_of(rows, compute(texts, nexts), number, head, tail, (is_first, is_last))

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts, rows = [unpack(t).decode("utf-8") for t in batch.column("packed").to_pylist()], batch.column("_row")
                if held_row is not None:
                    yield out(held_row, [held], [texts[0]], False)
                if len(texts) > 1:
                    yield out(rows.slice(0, len(texts) - 1), texts[:-1], texts[1:], False)
                held_row, held = rows.slice(len(texts) - 1), texts[-1]
        if held_row is not None:
            yield out(held_row, [held], [None], True)

    made = stored(dealt.select("_row", "packed").mapInArrow(run, schema), "with-next", compression="zstd")
    firsts = made.where("is_first").select(F.col("range").alias("next_range"), F.col("first").alias("next"))
    line = Window.orderBy("next_range")
    ring = firsts.select("next_range").select(
        F.coalesce(F.lag("next_range").over(line), F.max("next_range").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("range"),
        "next_range",
    )
    waiting = made.where("is_last").select("_row", "range", F.col("last").alias("text"))
    waiting = waiting.join(ring, "range").join(firsts, "next_range")
    late = append_columns(waiting.select("_row", "text", "next"), ["text", "next"], fields, lambda: compute)
    return made.where("NOT is_last").select("_row", *names).union(late.select("_row", *names))


def compare_with_next(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, ...) with fingerprints of its text and of its edited text, and how like they are.

    The edited text has its last third replaced by the beginning of the next
    document's text, by descending doc_id, the first document following the
    last.  Adds n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited (likeness of the text's and the edited
    text's fingerprint) and near_next (of the text's and the next document's);
    columns of these names are replaced, others stay as they are.  Without
    ``keep_text`` the texts are left out, and travel once instead of twice.

    Null is the empty text.  Texts under three code points are not changed by
    the edit.  Rows without doc_id come last, rows of one doc_id are in the
    order of a hash of their texts; a single row is its own next.  An empty
    table gives an empty result.
    """
    fields = [
        ("n_chars", T.LongType()),
        ("edited_sha256", T.StringType()),
        ("fingerprint", T.StringType()),
        ("edited_fingerprint", T.StringType()),
        ("near_edited", T.DoubleType()),
        ("near_next", T.DoubleType()),
    ]
    packed = Packed(docs, [*(n for n, _ in fields), *([] if keep_text else ["text"])])

    def compute(texts: list, nexts: list) -> list[list]:
        texts = [t or "" for t in texts]
        changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
        known: dict[str, str] = {}
        own, new, after = ([known.get(t) or known.setdefault(t, fingerprint(t)) for t in group] for group in (texts, changed, [n or "" for n in nexts]))
        digests = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed]
        return [[len(t) for t in texts], digests, own, new, likeness(own, new), likeness(own, after)]

    rows = docs.select(packed.row, F.col("doc_id").alias("_id"), "text")
    found = _with_next(rows, fields, compute)
    return found.select(*packed.unpacked(), *[n for n, _ in fields])
