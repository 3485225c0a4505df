"""Order-independent fingerprint of a table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a row's digest, hexadecimal characters of one, and what sums of words are taken modulo.
WORDS, HEX = 4, 16
MODULUS = 1 << (4 * HEX)


def row_digest(df: DataFrame, exclude: tuple[str, ...] = ("computed_at",)) -> Column:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("_NULL_")) for c in df.columns if c not in exclude]
    return F.sha2(F.concat_ws("|", *cells), 256)


def table_fingerprint(df: DataFrame, exclude: tuple[str, ...] = ("computed_at",)) -> DataFrame:
    """One digest over all rows, equal for equal bags of rows.

    A multiset hash: the words of every row's digest are added up, each word
    modulo 2**64.  Addition forgets the order and counts repeats, and it is
    combined where the rows are: a task sends one row, whatever the table's size.
    """
    digests = df.select(row_digest(df, exclude).alias("_h"))
    words = [F.conv(F.substring("_h", 1 + i * HEX, HEX), 16, 10).cast("decimal(20,0)") for i in range(WORDS)]
    sums = digests.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)])
    parts = [F.pmod(F.coalesce(F.col(f"_w{i}"), F.lit(Decimal(0))), F.lit(Decimal(MODULUS))).cast("decimal(20,0)").cast("string") for i in range(WORDS)]
    return sums.select(F.sha2(F.concat_ws(":", F.col("_n").cast("string"), *parts), 256).alias("fingerprint"))
