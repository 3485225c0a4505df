"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.session import scratch_path

#: A word of the space-separated kind: everything but the six ASCII white-space characters.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

#: Rows that are Python values at a time.
SLICE = 1000

#: A-Z to lower case, ASCII other than letters and digits to a space; bytes of non-ASCII characters stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged, as UTF-8; ``bytes.split`` knows exactly the six characters."""
    return [] if text is None else text.encode("utf-8").split()


def folded(text: str | None) -> bytes:
    """UTF-8 of a text in lower case, with spaces for ASCII other than letters and digits."""
    return b"" if text is None else text.encode("utf-8").translate(_FOLD)


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return folded(text).split()


def word_count(text: Column) -> Column:
    """Number of space-separated words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD)).cast("long")


def without(df: DataFrame, names) -> DataFrame:
    """The frame less the columns that a result is about to define anew."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


class Packed:
    """A table's columns in one struct, so that no name of theirs meets an operator's own.

    ``columns`` are those left when ``made``, the results to come, are taken out.
    """

    def __init__(self, df: DataFrame, made):
        taken = {n.lower() for n in made}
        self.columns = [c for c in df.columns if c.lower() not in taken]
        parts = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.columns)]
        self.row = F.struct(F.lit(True).alias("row"), *parts).alias("_row")

    def unpacked(self) -> list[Column]:
        return [F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(self.columns)]


def append_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., list[list]]],
    spent: Sequence[str] = (),
) -> DataFrame:
    """Every column of ``df`` but the ``spent`` ones and the computed ``fields``, one Arrow batch at a time.

    ``make()`` is called once per task and returns a function from the lists of
    input values to the lists of result values.  The rows stay where they are.
    Input columns named like a result are replaced by it; spent ones are read
    and never sent back from Python, which no later drop could save.
    """
    names = [n for n, _ in fields]
    gone = {n.lower() for n in [*names, *spent]}
    carried = [c for c in df.columns if c.lower() not in gone]
    read = list(dict.fromkeys([*carried, *inputs]))
    df = df.select(*[F.col(f"`{c}`") for c in read])
    schema = T.StructType([df.schema[c] for c in carried] + [T.StructField(n, t) for n, t in fields])
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in (whole.slice(a, SLICE) for whole in batches for a in range(0, max(1, whole.num_rows), SLICE)):
            made = compute(*[batch.column(read.index(c)).to_pylist() for c in inputs])
            arrays = [batch.column(read.index(c)) for c in carried]
            arrays += [pa.array(v, k) for v, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*carried, *names])

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends there.

    The table outlives a lost executor, is compressed, and later reads take
    only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of a value's text, modulo ``modulus``; null has bucket of the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
