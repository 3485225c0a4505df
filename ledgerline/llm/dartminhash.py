"""Near-duplicates by DartMinHash signatures, banded joining and an exact check.

Darts land on every shingle at the times of a Poisson process that is hashed
from the shingle alone, so all documents see the same darts.  A shingle of
weight w owns the region below height w: only darts that land there count.  Each
dart aims at one of k coordinates; the earliest dart per coordinate is the
signature, and two documents agree in a coordinate with the probability of
their weighted Jaccard similarity.  Only about k ln k + 2k darts are thrown per
document, however many shingles it has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import append_columns, folded, stored, without
from ledgerline.llm.substring import Windows, mix

SHINGLE = 5
THRESHOLD = 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8**5)**32 < 4e-6.
BANDS, ROWS = 32, 5
#: Pairs whose signatures agree less are not compared; 160 coordinates put a true 0.8 below with probability < 1e-5.
ESTIMATE = 0.65
#: Buckets up to this size compare all their members at once, larger ones a few stars a round and then what is left.
SMALL = 8
#: Heads of larger buckets that a member is compared with a round, those with most bands in common; others follow in later rounds or with the rest.
HEADS = 2
#: Links a pair below which a round with heads is the last one; it changes what finds a link, not which links there are.
YIELD = 0.1
#: Members, and bytes of shingle sets, of about one block when the rest of a large bucket is compared.
BLOCK, BLOCK_BYTES = 256, 4_000_000

_U = np.uint64


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the word n-grams, repeats kept; a shorter text is one shingle, a wordless one has none."""
    windows = Windows(folded(text))
    return np.sort(windows.hashes(min(n, windows.n))) if windows.n else np.empty(0, dtype=np.uint64)


def _darts(elements: np.ndarray, weights: np.ndarray, until: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, time) of the darts that land in the elements' regions before ``until``."""
    layers = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), layers)
    height = np.arange(len(owner)) - np.repeat(np.cumsum(layers) - layers, layers)
    cell = mix(elements[owner] + mix(height.astype(np.uint64) + _U(1)))
    room = np.minimum(weights[owner] - height, 1.0)
    clock = np.zeros(len(cell))
    thrown, block = 0, int(until) + 1
    hashes, times = [], []
    while len(cell):
        number = np.arange(thrown + 1, thrown + block + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
        dart = mix(cell[:, None] + number[None, :])
        gap = -np.log(((dart >> _U(11)).astype(np.float64) + 0.5) / 2.0**53)
        time = clock[:, None] + np.cumsum(gap, axis=1)
        fits = time <= until
        if (room < 1).any():
            fits &= (mix(dart + _U(7)) >> _U(11)).astype(np.float64) / 2.0**53 < room[:, None]
        hashes.append(dart[fits])
        times.append(time[fits])
        more = time[:, -1] <= until
        cell, room, clock = cell[more], room[more], time[more, -1]
        thrown += block
    return np.concatenate(hashes), np.concatenate(times)


def signature(elements: np.ndarray, weights: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Hash of the earliest dart per coordinate; distinct ``elements`` with positive ``weights``."""
    until = (k * math.log(k) + 2 * k) / float(weights.sum())
    while True:
        hashes, times = _darts(elements, weights, until)
        aim = (mix(hashes + _U(3)) % _U(k)).astype(np.int64)
        order = np.argsort(-times, kind="stable")
        out, hit = np.zeros(k, dtype=np.uint64), np.zeros(k, dtype=bool)
        out[aim[order]] = hashes[order]
        hit[aim] = True
        if hit.all():
            return out
        until *= 2


def _weighted(found: np.ndarray, weighting: str) -> tuple[np.ndarray, np.ndarray]:
    elements, counts = np.unique(found, return_counts=True)
    return elements, counts.astype(np.float64) if weighting == "count" else np.ones(len(elements))


def _prints(keyed: DataFrame, weighting: str) -> DataFrame:
    """``keyed`` (key, text, ...) less its text, with sig, bands and found; null for texts without words.

    sig holds 16 bits a coordinate, found the sorted distinct shingle hashes of
    32 bits.  The texts are read here only.
    """

    def make():
        def compute(texts):
            out: list[list] = [[], [], []]
            for text in texts:
                windows = shingles(text)
                if not len(windows):
                    for column in out:
                        column.append(None)
                    continue
                sig = signature(*_weighted(windows, weighting))
                rows = sig.reshape(BANDS, ROWS)
                band = np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    band = mix(band * _U(0xD1342543DE82EF95) + rows[:, r])
                out[0].append((sig & _U(0xFFFF)).astype(np.uint16).tobytes())
                out[1].append(band.view(np.int64).tolist())
                out[2].append(np.unique(windows.astype(np.uint32)).tobytes())
            return out

        return compute

    fields = [("sig", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("found", T.BinaryType())]
    return stored(append_columns(keyed, ["text"], fields, make, spent=["text"]), "prints")


def _key(text: Column) -> Column:
    """A digest of the folded words, in the engine: exact copies share it."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded_text = F.translate(F.coalesce(text, F.lit("")), upper, lower)
    spaced = F.regexp_replace(folded_text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.unhex(F.md5(F.trim(spaced).cast("binary")))


def _agreeing(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least ``least`` of their coordinates."""

    def make():
        def compute(left, right):
            if not left:
                return [[]]
            x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(left), -1) for s in (left, right))
            return [(x == y).mean(axis=1).tolist()]

        return compute

    for side in ("a", "b"):
        pairs = pairs.join(signatures.select(F.col("key").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    sigs = ["sig_a", "sig_b"]
    found = append_columns(pairs, sigs, [("agree", T.DoubleType())], make, spent=sigs)
    return found.where(F.col("agree") >= least).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``threshold``."""

    def make():
        def compute(left, right):
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            return [out]

        return compute

    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("found").alias(f"set_{side}")), side)
    both = ["set_a", "set_b"]
    return append_columns(pairs, both, [("near", T.BooleanType())], make, spent=both).where("near").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key that each end of ``edges`` (a, b) reaches.

    Every round points each key's neighbours and itself to the smallest key
    known among them, then halves paths; rounds end when nothing changes.  Rows
    are edges only, so a large component is never one row or one task.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
    edges = stored(edges.select(both).select("x.a", "x.b"), "edges")
    first = edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("root"))
    roots = stored(first.select("key", F.least("key", "root").alias("root")), "roots")
    while True:
        heard = edges.join(roots, F.col("b") == F.col("key")).select(F.col("a").alias("key"), "root", F.lit(None).cast("binary").alias("old"))
        every = heard.union(roots.select("key", "root", F.col("root").alias("old")))
        least = every.groupBy("key").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        far = roots.select(F.col("key").alias("mid"), F.col("root").alias("far"))
        jumped = least.join(far, F.col("root") == F.col("mid"), "left")
        new = stored(jumped.select("key", F.least("root", F.coalesce("far", "root")).alias("root"), "old"), "roots")
        roots = new.select("key", "root")
        if not new.where("root <> old").limit(1).count():
            return roots


def _joined_up(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` (key, root) with new ``links`` (a, b): only the roots at their ends are joined anew."""
    if roots is None:
        return components(links)
    for side in ("a", "b"):
        ends = roots.select(F.col("key").alias(side), F.col("root").alias(f"root_{side}"))
        links = links.join(ends, side, "left").withColumn(side, F.coalesce(f"root_{side}", side)).drop(f"root_{side}")
    merged = components(links.where("a <> b").distinct())
    changed = merged.select(F.col("key").alias("root"), F.col("root").alias("new"))
    moved = roots.join(changed, "root", "left").select("key", F.coalesce("new", "root").alias("root"))
    # A key that was alone stands for itself among the ends and is not yet among the roots.
    return stored(moved.union(merged.join(roots, "key", "left_anti").select("key", "root")), "roots")


def _small_pairs(members: DataFrame) -> DataFrame:
    """All pairs inside the buckets of at most ``SMALL`` members."""
    listed = members.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.collect_list("key").alias("ks"))
    pairs = F.expr(
        "flatten(transform(ks, (x, i) -> transform(slice(ks, i + 2, size(ks)), y -> struct(least(x, y) AS a, greatest(x, y) AS b))))"
    )
    return listed.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _star_pairs(members: DataFrame, known: DataFrame | None, turn: int) -> DataFrame:
    """Pairs of each larger bucket's members with its heads, where bucket and pair span several components.

    One head is drawn anew each round; once links are ``known`` (key, root,
    degree) the member with most of them is another, as edited copies are often
    near their original but not near each other.
    """
    members = members.where(F.col("n") > SMALL).select("bucket", "key")
    if known is None:
        members = members.withColumns({"root": F.col("key"), "degree": F.lit(0).cast("long")})
    else:
        root, degree = F.coalesce("root", "key").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree")
        members = members.join(known, "key", "left").select("bucket", "key", root, degree)
    lot = F.xxhash64("key", F.lit(turn))
    head = F.struct("key", "root")
    heads = members.groupBy("bucket").agg(
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.min_by(head, lot).alias("drawn"),
        F.max_by(head, F.struct("degree", lot)).alias("hub"),
    )
    chosen = F.array("drawn") if known is None else F.array_distinct(F.array("drawn", "hub"))
    heads = heads.where("low <> high").select("bucket", F.explode(chosen).alias("head"))
    met = members.join(heads, "bucket").where("root <> head.root").select("key", F.col("head.key").alias("head"))
    # Most bands in common first: a member meets HEADS heads a round, not one per band.  A key has two heads a band at most.
    shared = met.repartition("key").groupBy("key", "head").agg(F.count("*").alias("bands"))
    best = F.sort_array(F.collect_list(F.struct("bands", F.xxhash64("head", F.lit(turn)).alias("lot"), "head")), False)
    pairs = shared.groupBy("key").agg(best.alias("best")).select("key", F.explode(F.slice("best", 1, HEADS)).alias("of"))
    return pairs.select(F.least("key", "of.head").alias("a"), F.greatest("key", "of.head").alias("b"))


def _once_per_key(members: DataFrame, *tables: DataFrame) -> DataFrame:
    """``members`` (key, ...) with the columns of ``tables``, joined once a key and not once a bucket it is in."""
    rest = [c for c in members.columns if c != "key"]
    held = members.groupBy("key").agg(F.collect_list(F.struct(*rest)).alias("at"))  # a key is in BANDS buckets at most
    for found in tables:
        held = held.join(found, "key")
    return held.withColumn("at", F.explode("at")).select(*[c for c in held.columns if c != "at"], "at.*")


def _rest_blocks(members: DataFrame, known: DataFrame | None, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, key, sig, found, root, x, y): the members of the larger buckets that span several components, once per pair of blocks.

    A component that fills a block in its bucket has blocks of its own; the
    others share blocks.  Every two members of different components meet in
    exactly one pair (x, y) of blocks.
    """
    members = members.where(F.col("n") > SMALL).select("bucket", "key", "n")
    if known is None:
        members = members.withColumn("root", F.col("key"))
    else:
        members = members.join(known.select("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    spread = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    members = members.join(spread.where("low <> high").select("bucket"), "bucket", "left_semi")
    size = sets.select("key", (F.lit(1 / BLOCK) + F.length("found") / BLOCK_BYTES).alias("size"))
    members = stored(_once_per_key(members.select("bucket", "key", "root"), size), "rest")
    parts = F.ceil("size").cast("int")
    roots = members.groupBy("bucket", "root").agg(F.sum("size").alias("size"))
    own = roots.where("size >= 1").select("bucket", "root", F.hex("root").alias("of"), parts.alias("parts"))
    shared = roots.where("size < 1").groupBy("bucket").agg(F.sum("size").alias("size"))
    shared = shared.select("bucket", F.lit("").alias("of"), parts.alias("parts"))
    listed = own.drop("root").union(shared).select("bucket", "of", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    listed = listed.groupBy("bucket").agg(F.collect_list(F.struct("of", "part")).alias("blocks"))
    shared = shared.select("bucket", F.col("parts").alias("shared"))
    placed = members.join(own, ["bucket", "root"], "left").join(shared, "bucket", "left")
    part = F.when(F.col("of").isNull(), F.pmod(F.xxhash64("root"), "shared")).otherwise(F.pmod(F.xxhash64("key"), "parts"))
    mine = F.named_struct(F.lit("of"), F.coalesce("of", F.lit("")), F.lit("part"), part.cast("int"))
    placed = _once_per_key(placed.select("bucket", "key", "root", mine.alias("mine")), signatures.select("key", "sig"), sets)
    placed = placed.join(listed, "bucket").withColumn("other", F.explode("blocks")).where("mine.of <> other.of OR mine.of = ''")
    x, y = F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")
    return placed.select("bucket", "key", "sig", "found", "root", x, y)


def _linked(least: float, threshold: float):
    """Group function: links between the components of two blocks, of which each joins two that were apart."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n, out = len(group), []
        keys = group["key"].tolist()
        sigs = np.frombuffer(b"".join(group["sig"]), dtype=np.uint16).reshape(n, -1)
        sets = [np.frombuffer(s, dtype=np.uint32) for s in group["found"]]
        root = np.unique(np.array([r.hex() for r in group["root"]]), return_inverse=True)[1]
        for i in range(n - 1):
            apart = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            apart = apart[(sigs[apart] == sigs[i]).mean(axis=1) >= least]
            for j in apart:
                if root[i] == root[j]:
                    continue
                x, y = sets[i], sets[j]
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    out.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _rest_links(
    members: DataFrame, known: DataFrame | None, signatures: DataFrame, sets: DataFrame, least: float, threshold: float
) -> DataFrame:
    """Links (a, b) that the stars of larger buckets have not found: all pairs across components are compared, block by block."""
    rows = _rest_blocks(members, known, signatures, sets)
    # Dealt by all keys, or a join's partitions would be taken as they are.
    groups = rows.repartition("bucket", "x", "y").groupBy("bucket", "x", "y")
    return groups.applyInPandas(_linked(least, threshold), "a binary, b binary").distinct()


def _buckets(signatures: DataFrame) -> DataFrame:
    """(bucket, key, n): texts that share a band, n of them; of buckets with the same members one stands for all."""
    members = signatures.select("key", F.explode("bands").alias("bucket"))
    marks = [F.expr(f"bit_xor(xxhash64(key, {i}))").alias(f"mark{i}") for i in (1, 2)]
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), *marks).where("n > 1")
    different = shared.groupBy("n", "mark1", "mark2").agg(F.min("bucket").alias("bucket"))
    return stored(members.join(different.select("bucket", "n"), "bucket").select("bucket", "key", "n"), "buckets")


def near_duplicate_keys(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, root) for the texts of ``prints`` (key, sig, bands, found) that have a near-duplicate with another key."""
    own = prints.where("sig IS NOT NULL")
    signatures = stored(own.select("key", "sig", "bands").dropDuplicates(["key"]), "signatures")
    members = _buckets(signatures)
    wanted = own.select("key", "found").join(members.select("key").distinct(), "key", "left_semi")
    sets = stored(wanted.dropDuplicates(["key"]), "shingle-sets")
    least = min(ESTIMATE, threshold - 0.15)
    near = roots = known = tested = None
    turn = 0
    while True:
        pairs = _star_pairs(members, known, turn)
        if turn == 0:
            pairs = pairs.union(_small_pairs(members)).distinct()
        else:
            pairs = pairs.distinct().join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        agreeing = stored(_agreeing(pairs, signatures, least), "agreeing")
        found = stored(_similar(agreeing, sets, threshold), "near")
        links = found.count()
        if not links:
            break
        near = found if near is None else near.union(found)
        roots = _joined_up(roots, found)
        ends = near.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
        known = stored(roots.join(ends, "key"), "known")
        turn += 1
        # Both ways are exact; the rest is cheaper once heads seldom link.
        if turn > 1 and links < YIELD * pairs.count():
            break
    found = stored(_rest_links(members, known, signatures, sets, least, threshold), "near")
    if found.limit(1).count():
        roots = _joined_up(roots, found)
    return roots if roots is not None else members.select("key", F.col("key").alias("root")).limit(0)


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, weighting: str = "set") -> DataFrame:
    """``docs`` with class_key: rows of one class have it in common.

    Classes are the connected components of pairs with a Jaccard similarity of
    ``threshold`` or more on the sets of five folded words; equal word sequences
    are copies whatever their case and punctuation.  ``weighting="count"``
    draws signatures from shingle counts instead of sets.  Texts without words,
    null ones included, are copies of each other; shorter texts are one
    shingle.  An empty table gives an empty result.  A column named class_key is
    replaced.

    Copies meet in their key before any pair is made.  Small buckets compare
    all members; large ones draw a head a round, from the second on also the
    member that has most links, and compare each member with the two heads it
    has most bands in common with.  Rounds go on among large buckets that still
    hold several components, until a round links few of its pairs.  What members of different components such buckets then still hold
    are compared with each other, all of them, in pairs of blocks of bounded
    size.  Only pairs with agreeing signatures come to the exact check.
    """
    docs = without(docs, ["class_key"])
    return _classed(docs, docs.columns, threshold, weighting).select("row.*", "class_key")


def _classed(docs: DataFrame, kept: list[str], threshold: float, weighting: str = "set") -> DataFrame:
    """(row, class_key) per row of ``docs``; row holds the ``kept`` columns, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    keyed = docs.select(row, "text", _key(F.col("text")).alias("key"))
    if "text" in kept:
        prints, rows = _prints(keyed.select("key", "text"), weighting), keyed
    else:
        prints = rows = _prints(keyed, weighting)
    roots = near_duplicate_keys(prints, threshold)
    joined = rows.select("row", "key").join(roots, "key", "left")
    return joined.select("row", F.hex(F.coalesce("root", "key")).alias("class_key"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document with the smallest id of each near-duplicate class; one row a class, with the columns of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("text").alias("text"), _key(F.col("text")).alias("key"))
    prints = _prints(keyed.select("key", "text", F.col("row.doc_id").alias("doc_id")), "set")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    # Who stays is found without the texts, and a class's row has one key: texts travel once, by it.
    classed = prints.select("key", "doc_id").join(near_duplicate_keys(prints, threshold), "key", "left")
    chosen = classed.groupBy(F.coalesce("root", "key").alias("class")).agg(F.min(F.struct(first.alias("first"), "key")).alias("of"))
    rows = keyed.select("row", "key").join(chosen.select("of.key"), "key", "left_semi")
    rank = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"))
    return rows.groupBy("key").agg(F.min_by("row", rank).alias("row")).select("row.*")


def class_ids(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and class_rows: the smallest id and the number of rows of the document's class."""
    classed = stored(_classed(docs, ["doc_id"], threshold).select("row.doc_id", "class_key"), "classes")
    heads = classed.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return classed.join(heads, "class_key").select("doc_id", "class_id", "class_rows")
