"""Personal data: exact base spans, and terms that reveal a protected entity.

The base spans (mail, network and card numbers, phones) are the protected
entities.  How strongly a term of the same text reveals an entity is its
pointwise mutual information over the corpus as a share of the entity's own
information content: 1 if the term is found in that entity's documents only, 0
if the two are independent.  Terms above a threshold are spans too, wherever in
the corpus they stand, and sanitising replaces entities by their kind and terms
by a general word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import Packed, append_columns, folded, stored
from ledgerline.llm.substring import word_hashes

#: Order of kinds in results; ``term`` is what the corpus adds.
KINDS = ("email", "ip", "card", "phone", "term")
#: Share of an entity's information that a term may give away.
DISCLOSURE = 0.9
#: Different texts in which the pair has to meet: fewer are no estimate.
SUPPORT = 3
#: ASCII words of fewer letters are no terms.
TERM_LETTERS = 3
#: Bits of the sets of hashes that tasks get: 1 MB, whatever the corpus.
BITS = 1 << 23
REPLACEMENTS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs that ``folded`` keeps together.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The part before an @ never holds one, so each @ is tried once, in time linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time from each run of dotted numbers; a part over 255 drops its four."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            digits = [p.lstrip("0") for p in four]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in digits):
                yield start, end
            start = end + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every base span, in order; offsets count code points."""
    text = text or ""
    finders = (_emails, _ips, _cards, _phones)
    return sorted((start, kind, end) for kind, find in enumerate(finders) for start, end in find(text))


def _number(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8"), digest_size=8).digest(), "big", signed=True)


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """The different entities of a text's base spans, as hashes."""
    return sorted({_number(f"{KINDS[kind]}:{text[start:end]}") for start, kind, end in spans})


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(number, start, end) of the words that can be terms: outside base spans, and not short ASCII ones."""
    cover = sorted((s, e) for s, _, e in spans)
    out, last = [], 0
    for i, m in enumerate(_WORD.finditer(text)):
        start, end = m.span()
        while last < len(cover) and cover[last][1] <= start:
            last += 1
        if any(s < end and start < e for s, e in cover[last : last + len(KINDS)]):
            continue
        if end - start >= TERM_LETTERS or not m.group().isascii():
            out.append((i, start, end))
    return out


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, bool, int, int]]:
    """(term, named, before, after) of each different free word, as hashes.

    ``named``: written once at least with a capital, a digit or letters without
    case, as names and numbers are.  ``before`` and ``after`` are the words
    around the first place where it stands; 0 at the text's ends.
    """
    hashes = [0, *word_hashes(folded(text)).view(np.int64).tolist(), 0]
    out: dict[int, list] = {}
    for i, start, end in free_words(text, spans):
        named = text[start:end] != text[start:end].lower() or any(c.isdigit() or c.lower() == c.upper() for c in text[start:end])
        seen = out.setdefault(hashes[i + 1], [named, hashes[i], hashes[i + 2]])
        seen[0] |= named
    return [(term, *rest) for term, rest in out.items()]


_SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("s", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("e", T.IntegerType())]
    )
)


def _found(docs: DataFrame) -> DataFrame:
    """``docs`` less its text, with base (spans) and entities (hashes)."""

    def make():
        def compute(texts):
            spans = [base_spans(text) for text in texts]
            base = [[dict(zip("ske", x, strict=True)) for x in found] for found in spans]
            return [base, [entities_of(text or "", found) for text, found in zip(texts, spans, strict=True)]]

        return compute

    fields = [("base", _SPANS), ("entities", T.ArrayType(T.LongType()))]
    return append_columns(docs, ["text"], fields, make, spent=["text"])


def _hash_set(values: DataFrame, column: str) -> np.ndarray:
    """The low bits of a column of hashes as a set of ``BITS`` bits; who is in it may be another with the same bits."""
    low = F.col(column).bitwiseAND(F.lit(BITS - 1))
    bit = F.expr(f"shiftleft(1L, CAST(`{column}` & 63 AS INT))")
    words = values.select(F.shiftright(low, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(BITS // 64, dtype=np.int64)
    for word, bits in words.collect():  # at most BITS / 64 rows
        out[word] = bits
    return out.view(np.uint64)


def _within(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set."""
    hashes = hashes.view(np.uint64)
    place = (hashes & np.uint64(BITS - 1)) >> np.uint64(6)
    return (bits[place.astype(np.int64)] >> (hashes & np.uint64(63))) & np.uint64(1) > 0


def _rows_of(docs: DataFrame, each, schema: str) -> DataFrame:
    """The rows (key, ...) that ``each(text)`` gives for the texts of ``docs`` (key, text), in batches of bounded size."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.binary() if n == "key" else pa.bool_() if n == "named" else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                rows += [(key, *found) for found in each(text.as_py())]
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("key", "text").where("text IS NOT NULL").mapInArrow(run, schema)


def _holder_terms(docs: DataFrame, watched: np.ndarray) -> DataFrame:
    """(key, term, named, before, after) of the texts that may hold a watched entity."""

    def each(text):
        spans = base_spans(text)
        entities = entities_of(text, spans)
        if not entities or not _within(np.array(entities, dtype=np.int64), watched).any():
            return []
        return terms_of(text, spans)

    rows = _rows_of(docs, each, "key binary, term long, named boolean, before long, after long")
    # Copies of a text say the same.
    same = [F.min(c).alias(c) for c in ("named", "before", "after")]
    return rows.groupBy("key", "term").agg(*same)


def _term_rows(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, n_term): number of rows of ``docs`` that hold the term, for the terms that may be ``wanted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: list[np.ndarray] = []
        waiting = 0

        def counted():
            terms, times = np.unique(np.concatenate(new), return_counts=True)
            for a in range(0, len(terms), 100_000):
                b = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(terms[b].view(np.int64)), pa.array(times[b])], ["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                terms = word_hashes(folded(text))
                new.append(np.unique(terms[_within(terms, wanted)]))
                waiting += len(new[-1]) + 1
                if waiting >= 1_000_000:
                    yield from counted()
                    new, waiting = [], 0
        if new:
            yield from counted()

    rows = docs.select("text").where("text IS NOT NULL").mapInArrow(count, "term long, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n_term"))


def revealing_terms(
    found: DataFrame, docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT
) -> DataFrame:
    """(entity, term) pairs whose disclosure reaches the threshold; a term is any free word of a text with the entity.

    ``found`` has key (of the text) and entities per row, ``docs`` key and text.
    Counts are over all rows, so copies weigh alike on both sides of each ratio,
    but ``support`` counts different texts.  A word that is never written like
    a name has to stand free besides: after different words and before
    different words in the texts of the entity, or each word of a phrase that
    goes with the entity would count.
    """
    held = found.select("key", F.explode("entities").alias("entity")).groupBy("entity", "key").agg(F.count("*").alias("n"))
    held = stored(held, "entity-texts")
    watched = held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"))
    watched = stored(watched.where(F.col("texts") >= support).drop("texts"), "entities")
    most = watched.agg(F.max("n_entity")).first()[0]
    if most is None:
        return watched.select("entity", F.col("entity").alias("term"))
    total = float(max(found.count(), 1))
    terms = stored(_holder_terms(docs, _hash_set(watched, "entity")), "terms")
    often = terms.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= support)
    counts = _term_rows(docs, _hash_set(often, "term"))
    # No pair of a term in more rows than this reaches the threshold, so the others need not be paired.
    rare = counts.where(F.col("n_term") <= F.lit(float(most) ** disclosure * total ** (1 - disclosure) + 1))
    texts = held.join(watched, "entity").join(terms.join(rare, "term"), "key")
    sides = [f(c).alias(f"{name}_{c}") for c in ("before", "after") for name, f in (("low", F.min), ("high", F.max))]
    pairs = texts.groupBy("entity", "term").agg(
        F.sum("n").alias("n_both"), F.count("*").alias("texts"), F.max("named").alias("named"),
        F.max("n_term").alias("n_term"), F.max("n_entity").alias("n_entity"), *sides,
    )
    free = F.col("named") | ((F.col("low_before") < F.col("high_before")) & (F.col("low_after") < F.col("high_after")))
    mutual = F.log(F.lit(total) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    own = F.log(F.lit(total) / F.col("n_entity"))
    telling = (F.col("texts") >= support) & free & (own > 0) & (mutual >= F.lit(disclosure) * own)
    return pairs.where(telling).select("entity", "term")


def _added(docs: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """(key, more): spans of revealing terms per text of ``docs`` (key, text), wherever they stand; None if there are no such terms."""
    terms = stored(pairs.select("term").distinct(), "revealing")
    if terms.isEmpty():
        return None
    wanted = _hash_set(terms, "term")

    def each(text):
        hashes = word_hashes(folded(text))
        hit = _within(hashes, wanted)
        if not hit.any():
            return []
        return [(int(hashes[i].view(np.int64)), s, e) for i, s, e in free_words(text, base_spans(text)) if hit[i]]

    rows = _rows_of(docs, each, "key binary, term long, s long, e long").distinct()
    span = F.struct(F.col("s").cast("int").alias("s"), F.lit(KINDS.index("term")).alias("k"), F.col("e").cast("int").alias("e"))
    return rows.join(terms, "term", "left_semi").groupBy("key").agg(F.collect_list(span).alias("more"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def _with_more(rows: DataFrame, more: DataFrame | None) -> DataFrame:
    if more is None:
        return rows.withColumn("more", F.lit(None).cast(_SPANS))
    return rows.join(more, "key", "left")


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` less their text with base and spans: arrays of (s, k, e), k a number of KINDS.

    ``spans`` holds the base spans and every place of a term that reveals an entity
    anywhere in the corpus, outside base spans.  Null and empty
    texts have none.  Spans of different kinds may overlap.  Repeated rows have
    the same spans; an empty table gives an empty result.  Columns named like a
    result are replaced.
    """
    packed = Packed(docs, ["text", "base", "spans"])
    docs = _keyed(docs.select(packed.row, "text"))
    found = stored(_found(docs), "personal")
    joined = _with_more(found, _added(docs, revealing_terms(found, docs, disclosure, support)))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPANS))))
    return joined.select(*packed.unpacked(), "base", every.alias("spans"))


def spans_text(spans: str):
    """A column of spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], REPLACEMENTS[KINDS[kind]]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with their columns, personal data in text replaced; null texts stay null."""
    columns = docs.columns
    packed = Packed(docs, ["text"])
    keyed = _keyed(docs.select(packed.row, "text"))
    found = stored(_found(keyed.select("key", "text")), "personal")
    joined = _with_more(keyed, _added(keyed, revealing_terms(found, keyed, disclosure, support)))

    def make():
        def compute(texts, extra):
            return [
                [
                    t if t is None else masked(t, base_spans(t) + [(x["s"], x["k"], x["e"]) for x in m or ()])
                    for t, m in zip(texts, extra, strict=True)
                ]
            ]

        return compute

    inputs = ["text", "more"]
    done = append_columns(joined.select("_row", *inputs), inputs, [("clean", T.StringType())], make, spent=inputs)
    return done.select(*packed.unpacked(), F.col("clean").alias("text")).select(*[F.col(f"`{c}`") for c in columns])
