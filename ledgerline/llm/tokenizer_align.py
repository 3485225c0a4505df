"""Alignment of two tokenizers' tokens, and how often their ids are linked.

Both tokenizers cut the same bytes.  Where a token of each ends at one byte, a
group ends.  Most of a text is often one-to-one, so the two arrays of ends run
side by side at a constant shift of index: stretches are compared at that shift
and doubled as long as they agree, then halved to find where they stop.  The
irregular group there is resolved end by end, which gives the new shift.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import Packed, stored

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of one slice: its documents share a list of id pairs.
SLICE_BYTES = 4_000_000
#: Links of one group that are listed one by one; beyond that its ids are counted first.
LISTED = 4096
#: Tokens of a one-to-one stretch that are compared singly before stretches are.
PROBE = 8
#: How a byte-level tokenizer splits text before merging: fixed value.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class _Spelling:
    """The bytes of ids, from all pieces in one array."""

    def __init__(self, pieces: list[bytes]):
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        shift = self._starts[ids] - (np.cumsum(sizes) - sizes)
        return self._bytes[np.arange(sizes.sum()) + np.repeat(shift, sizes)].tobytes()


class ByteTokenizer:
    """Byte-level BPE of a tokenizer file; ``pieces[id]`` are an id's bytes.

    Ids of a byte-level vocabulary are in the order of its merges, so merging by
    smallest id is merging by rank.  Strings of special tokens are plain text.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        letter = _byte_letters()
        special = {e["content"] for e in read.get("added_tokens", [])}
        vocabulary = read["model"]["vocab"]
        ranks = {bytes(letter[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self._coder = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.spell = _Spelling(self.pieces)

    def encode(self, text: str) -> np.ndarray:
        return self._coder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class PieceTokenizer:
    """Pieces of a model file that begins a text with a space; ``pieces[id]`` are an id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self._coder = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._coder.id_to_piece(i) for i in range(self._coder.get_piece_size())]
        self.pieces = [
            bytes([int(name[3:5], 16)]) if self._coder.is_byte(i) else name.replace("▁", " ").encode("utf-8") for i, name in enumerate(names)
        ]
        self.spell = _Spelling(self.pieces)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that begins with the space the model adds."""
        return np.array(self._coder.encode(text[1:], num_threads=1), dtype=np.int64)


def group_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Numbers of tokens of either side before each common end, in order.

    ``a`` and ``b`` are the ends of the tokens in bytes, increasing, with the
    same last end.
    """
    i = j = 0
    out_a: list[int] = []
    out_b: list[int] = []
    n = len(a)
    a, b = [*a, -1], [*b, -2]  # no stretch agrees beyond the last end
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            # One-to-one at the shift j - i: one by one at first, then stretches twice as long each time, then half as long.
            start, shift, step = i, j - i, PROBE
            i, j = i + 1, j + 1
            while a[i] == b[j] and i - start < PROBE:
                i, j = i + 1, j + 1
            if i - start == PROBE:
                while a[i : i + step] == b[i + shift : i + shift + step]:
                    i, step = i + step, 2 * step
                while step > 1:
                    step //= 2
                    if a[i : i + step] == b[i + shift : i + shift + step]:
                        i += step
            j = i + shift
            if i - start > 1:
                out_a += range(start + 1, i + 1)
                out_b += range(start + shift + 1, j + 1)
            else:
                out_a.append(i)
                out_b.append(j)
            if i == n:
                break
            x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        out_a.append(i)
        out_b.append(j)
    return out_a, out_b


class Aligner:
    """Aligns texts with two tokenizers; ids of the second are below ``self.width``."""

    def __init__(self, first: ByteTokenizer, second: PieceTokenizer):
        self.sides = (first, second)
        self.width = len(second.pieces)
        # Each id twice, with the mark after it inside its side of a group and at that side's end.
        marked = [[f"{i}{mark}".encode() for i in range(len(side.pieces)) for mark in marks] for side, marks in zip(self.sides, ((",", "|"), (",", ";")), strict=True)]
        self._marked = _Spelling(marked[0] + marked[1])

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers; None for texts whose bytes a tokenizer does not give back."""
        if not text:
            return None
        spaced = " " + text
        want = spaced.encode("utf-8")
        found = self.sides[0].encode(spaced), self.sides[1].encode(spaced)
        return found if all(side.spell(ids) == want for side, ids in zip(self.sides, found, strict=True)) else None

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = [np.cumsum(side.spell.lengths[ids]).tolist() for side, ids in zip(self.sides, (a, b), strict=True)]
        found = group_ends(*ends)
        return np.array(found[0], dtype=np.int64), np.array(found[1], dtype=np.int64)

    def written(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, in ASCII."""
        out = np.empty(len(a) + len(b), dtype=np.int64)
        first = 0
        for side, ids, ends, other in zip(self.sides, (a, b), (ends_a, ends_b), (np.concatenate(([0], ends_b[:-1])), ends_a), strict=True):
            codes = first + 2 * ids
            codes[ends - 1] += 1
            out[np.arange(len(ids)) + np.repeat(other, np.diff(ends, prepend=0))] = codes
            first += 2 * len(side.pieces)
        return self._marked(out)[:-1]

    def links(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes a * width + b of the linked id pairs, each once, and how many links each has."""
        from_a, from_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
        sizes_a, sizes_b = ends_a - from_a, ends_b - from_b
        few = sizes_a * sizes_b <= LISTED
        listed = np.empty(0, dtype=np.int64)
        if few.any():
            listed_a = np.flatnonzero(np.repeat(few, sizes_a))
            group = np.repeat(np.arange(len(few)), sizes_a)[listed_a]
            partners = sizes_b[group]
            place = np.arange(partners.sum()) - np.repeat(np.cumsum(partners) - partners, partners) + np.repeat(from_b[group], partners)
            listed = np.repeat(a[listed_a], partners) * self.width + b[place]
        if few.all():
            return np.unique(listed, return_counts=True)
        codes, counts = [listed], [np.ones(len(listed), dtype=np.int64)]
        for g in np.flatnonzero(~few):
            ids_a, n_a = np.unique(a[from_a[g] : ends_a[g]], return_counts=True)
            ids_b, n_b = np.unique(b[from_b[g] : ends_b[g]], return_counts=True)
            codes.append((ids_a[:, None] * self.width + ids_b[None, :]).ravel())
            counts.append((n_a[:, None] * n_b[None, :]).ravel())
        found, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(found), dtype=np.int64)
        np.add.at(total, inverse, np.concatenate(counts))
        return found, total


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest takes; the first byte tells how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{data[0]}", offset=1).astype(np.int64)


class _Slice:
    """Documents of one slice and their id pairs."""

    def __init__(self, number: str):
        self.number, self.bytes = number, 0
        self.batches: list[pa.RecordBatch] = []
        self.columns: dict[str, list] = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups")}
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []


def _aligned(docs: DataFrame, packed: Packed, folder: str, keep_groups: bool) -> DataFrame:
    """Rows of two kinds, by slice: documents with their link counts as places in the slice's list of pairs, and that list."""
    schema = T.StructType(
        [T.StructField("slice", T.StringType()), T.StructField("_row", docs.schema["_row"].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
        + [T.StructField("groups", T.StringType()), T.StructField("places", T.BinaryType()), T.StructField("times", T.BinaryType())]
        + [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("n_docs", T.ArrayType(T.IntegerType()))]
    )
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def written(held: _Slice) -> Iterator[pa.RecordBatch]:
        sizes = [len(c) for c in held.codes]
        every = np.concatenate([*held.codes, np.empty(0, dtype=np.int64)])
        pairs, inverse, n_docs = np.unique(every, return_inverse=True, return_counts=True)
        places = np.split(inverse, np.cumsum(sizes)[:-1]) if sizes else []  # increasing, as a document's codes are
        at = 0
        for batch in held.batches:
            rows = slice(at, at + batch.num_rows)
            at += batch.num_rows
            made = [held.columns[k][rows] for k in held.columns]
            made += [[_packed(np.diff(p, prepend=0)) for p in places[rows]], [_packed(c) for c in held.counts[rows]]]
            made += [[None] * batch.num_rows] * 2
            arrays = [pa.array([held.number] * batch.num_rows, pa.string()), batch.column("_row")]
            arrays += [pa.array(v, k) for v, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)
        if len(pairs):
            row = held.batches[0].column("_row")
            arrays = [pa.array([held.number]), pa.nulls(1, row.type), *[pa.nulls(1, k) for k in kinds[:-2]]]
            arrays += [pa.array([pairs], kinds[-2]), pa.array([n_docs.astype(np.int32)], kinds[-1])]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteTokenizer(os.path.join(folder, BYTE_BPE)), PieceTokenizer(os.path.join(folder, PIECE_BPE)))
        nothing = np.empty(0, dtype=np.int64)
        task, numbers = TaskContext.get().partitionId(), itertools.count()
        held = _Slice(f"{task}-{next(numbers)}")
        for batch in batches:
            begun = 0
            texts = batch.column("text")
            for at in range(batch.num_rows):
                text = texts[at].as_py()
                held.bytes += len(text or "") + 64
                found = aligner.tokens(text)
                if found is None:
                    values, links = (0, 0, 0, 0, ""), (nothing, nothing)
                else:
                    ends = aligner.groups(*found)
                    string = aligner.written(*found, *ends)
                    links = aligner.links(*found, *ends)
                    digest = string.decode("ascii") if keep_groups else hashlib.sha256(string).hexdigest()
                    values = (len(found[0]), len(found[1]), len(ends[0]), int(links[1].sum()), digest)
                for column, value in zip(held.columns.values(), values, strict=True):
                    column.append(value)
                held.codes.append(links[0])
                held.counts.append(links[1])
                if held.bytes >= SLICE_BYTES or at == batch.num_rows - 1:
                    held.batches.append(batch.slice(begun, at + 1 - begun))
                    begun = at + 1
                if held.bytes >= SLICE_BYTES:
                    yield from written(held)
                    held = _Slice(f"{task}-{next(numbers)}")
        yield from written(held)

    return stored(docs.mapInArrow(run, schema), "aligned")


def _pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, count, is_best): in how many documents a pair is linked, and whether its first id is linked more often with none."""
    listed = aligned.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x"))
    counted = listed.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("count"))
    # At most as many rows as the second tokenizer has ids share a first id.
    most = F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / width)))
    return counted.select("pair", "count", (F.col("count") == most).alias("is_best"))


def _width(folder: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECE_BPE)).get_piece_size()


def link_counts(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(id_a, id_b, count, is_best): every pair of ids linked in ``docs`` (text, ...), and how many documents link it."""
    width = _width(folder)
    aligned = _aligned(docs.select(Packed(docs, []).row, "text"), Packed(docs, []), folder, False)
    found = _pair_counts(aligned, width)
    return found.select(F.floor(F.col("pair") / width).alias("id_a"), F.pmod("pair", F.lit(width)).alias("id_b"), "count", "is_best")


def align_tokens(docs: DataFrame, folder: str = FOLDER, keep_groups: bool = False) -> DataFrame:
    """Each row of ``docs`` (text, ...) with its tokens by two tokenizers aligned.

    Adds n_a, n_b (tokens), n_groups, n_links (pairs of tokens in one group),
    n_best (links of id pairs that no pair of the same first id beats in the
    number of documents linking it), count_sum (those numbers over all links)
    and groups_sha256, or groups itself with ``keep_groups``; columns of these
    names are replaced.  ``folder`` holds the tokenizers' files on every
    machine.

    The first tokenizer reads a space and the text, the second adds the space
    itself; special tokens' strings are plain text.  Null and empty texts, and
    those whose bytes one tokenizer does not give back, have no tokens: zeros
    and ''.  Repeated rows count as documents of their own.  An empty table
    gives an empty result.

    Documents are aligned in slices of bounded bytes.  A slice sends each of its
    id pairs once, with the number of its documents that link it, and gets
    the corpus-wide counts back for the slice; links of single documents do not
    travel.
    """
    name = "groups" if keep_groups else "groups_sha256"
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", name]
    packed = Packed(docs, made)
    aligned = _aligned(docs.select(packed.row, "text"), packed, folder, keep_groups)
    counts = _pair_counts(aligned, _width(folder))
    listed = aligned.where("pairs IS NOT NULL").select("slice", F.posexplode("pairs").alias("place", "pair"))
    known = listed.join(counts, "pair").select(F.col("slice").alias("of"), "place", "count", "is_best")
    rows = aligned.where("pairs IS NULL").drop("pairs", "n_docs")
    columns = ["n_a", "n_b", "n_groups", "n_links", "groups"]
    schema = T.StructType([rows.schema["_row"], *[rows.schema[c] for c in columns], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of a slice with their sums over links."""
        places = right.column("place").to_numpy()
        count, best = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        count[places] = right.column("count").to_numpy()
        best[places] = right.column("is_best").to_numpy()
        sums: tuple[list, list] = ([], [])
        for at, times in zip(left.column("places").to_pylist(), left.column("times").to_pylist(), strict=True):
            place, n = np.cumsum(_unpacked(at)), _unpacked(times)
            sums[0].append(int((best[place] * n).sum()))
            sums[1].append(int((count[place] * n).sum()))
        arrays = [left.column(c) for c in ["_row", *columns]] + [pa.array(s, pa.int64()) for s in sums]
        return pa.table(arrays, names=schema.names)

    found = rows.groupBy("slice").cogroup(known.groupBy("of")).applyInArrow(summed, schema)
    return found.select(*packed.unpacked(), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias(name))
