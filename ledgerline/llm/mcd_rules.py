"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Each document gets exact base counts and a vector of transformed statistics.
Per language and source a minimum-covariance-determinant estimate of centre and
scatter is found by concentration steps from a coordinate-wise robust start, and
documents beyond a Mahalanobis distance are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Packed, stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT = 30
#: Fewer rows than this do not make an estimate of their own.
MIN_GROUP = 50
#: Share of a group that the determinant is minimised over.
CORE = 0.75
STEPS = 4
#: Parts that a group's rows are joined and first summed in.
PARTS = 64
#: Squared distance beyond which a document is rejected; for normal data one in two million passes it.
CUT = 35.0
#: Median of the chi-squared distribution with four degrees of freedom.
CHI2_MEDIAN = 3.3567
#: Standard deviations below which a statistic is taken for noise, in the order of STATS.
NOISE = (0.10, 0.45, 0.45, 1.0)
STATS = ("s_word", "s_symbol", "s_upper", "s_repeat")

_SPACES = r"[\x20\x09-\x0D]+"
_D = range(len(STATS))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the statistics.

    Null counts as the empty text.  Every count is over the whole text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumns(
        {
            "_words": F.array_remove(F.split(text, _SPACES, -1), ""),
            "_lines": lines,
            "word_chars": F.length(F.regexp_replace(text, _SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
            "_other": F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\s.,;:]")),
        }
    )
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    docs = docs.withColumns(
        {
            "n_words": n.cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
        }
    )
    # Most texts repeat no window and skip the sort.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_sorted", F.when(repeats, placed))

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get("_sorted", i - 1), F.get("_sorted", i + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    starts = F.array_sort(F.transform(F.filter("_sorted", twice), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + s + WINDOW - F.greatest(s, a["end"])).alias("n"), (s + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    docs = docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    words, chars = F.col("n_words"), F.greatest("word_chars", F.lit(1))
    failed = (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * words)
    repeated = F.col("n_repeat_words") / F.greatest(words, F.lit(1)) + F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1))
    return docs.withColumns(
        {
            "base_failed": failed,
            "s_word": F.log(F.greatest(F.col("word_chars") / F.greatest(words, F.lit(1)), F.lit(0.1))),
            "s_symbol": F.log1p(100.0 * F.col("_other") / chars),
            "s_upper": F.log1p(100.0 * F.col("_upper") / chars),
            "s_repeat": F.log1p(100.0 * repeated),
        }
    ).drop("_words", "_lines", "_upper", "_other", "_windows", "_sorted")


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with ``grp``: language and source, or the language's small sources, or all that is small."""

    def name(*columns: str) -> Column:
        parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(c))) for c in columns]
        return F.concat_ws("\u0001", *parts)

    def merged(frame: DataFrame, to: Column) -> DataFrame:
        large = frame.groupBy("grp").count().where(F.col("count") >= MIN_GROUP).select("grp", F.lit(True).alias("_large"))
        frame = frame.join(large, "grp", "left")
        return frame.withColumn("grp", F.when(F.col("_large"), F.col("grp")).otherwise(to)).drop("_large")

    rows = rows.withColumn("grp", name("lang", "source"))
    rows = merged(rows, F.concat(F.lit("small\u0001"), name("lang")))
    return merged(rows, F.lit("small"))


def _distance() -> Column:
    """Squared Mahalanobis distance of the statistics from mean m<i> and Cholesky factor l<i><j>."""
    solved: list[Column] = []
    for i, s in zip(_D, STATS, strict=True):
        rest = reduce(lambda a, j: a - F.col(f"l{i}{j}") * solved[j], range(i), F.col(s) - F.col(f"m{i}"))
        solved.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, y: a + y * y, solved[1:], solved[0] * solved[0])


def _factored(moments: DataFrame) -> DataFrame:
    """(grp, m<i>, l<i><j>) from means and covariances c<i><j>; noise is the least variance."""
    for i in _D:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (NOISE[i] ** 2 if i == j else 0.0)
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), rest)
            value = F.sqrt(F.greatest(rest, F.lit(NOISE[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}")
            moments = moments.withColumn(f"l{i}{j}", value)
    return moments.select("grp", *[f"m{i}" for i in _D], *[f"l{i}{j}" for i in _D for j in range(i + 1)])


def _start(rows: DataFrame) -> DataFrame:
    """Coordinate-wise median and spread of the middle half, without covariances."""
    quartiles = rows.groupBy("grp").agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(s) for s in STATS])
    values = {f"m{i}": F.col(s)[1] for i, s in zip(_D, STATS, strict=True)}
    values |= {f"c{i}{j}": F.lit(0.0) for i in _D for j in range(i)}
    values |= {f"c{i}{i}": F.pow((F.col(s)[2] - F.col(s)[0]) / 1.349, 2) for i, s in zip(_D, STATS, strict=True)}
    return _factored(quartiles.withColumns(values))


def mcd_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(grp, m<i>, l<i><j>, scale) per group of ``rows`` (grp, statistics).

    A concentration step takes the ``CORE`` nearest rows of each group and
    estimates anew from them; it never raises the determinant.  ``scale`` makes
    the median squared distance that of normal data.  Every step is two
    map-side combined aggregates after a join by group and part, so no group is
    gathered anywhere.  Other columns of ``rows`` only help to deal them out.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)))

    def beside(table: DataFrame) -> DataFrame:
        parts = F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))
        return rows.join(table.select("*", F.explode(parts).alias("part")), ["grp", "part"])

    estimate = stored(_start(rows), "mcd")
    for _ in range(steps):
        far = beside(estimate).groupBy("grp").agg(F.percentile_approx(_distance(), CORE, 1000).alias("far"))
        near = beside(estimate.join(far, "grp")).where(_distance() <= F.col("far"))
        means = [F.avg(s).alias(f"m{i}") for i, s in zip(_D, STATS, strict=True)]
        spread = [F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i in _D for j in range(i + 1)]
        estimate = stored(_factored(near.groupBy("grp").agg(*means, *spread)), "mcd")
    median = beside(estimate).groupBy("grp").agg(F.percentile_approx(_distance(), 0.5, 1000).alias("mid"))
    scale = F.greatest(F.lit(1.0), F.col("mid") / CHI2_MEDIAN)
    return stored(estimate.join(median.select("grp", scale.alias("scale")), "grp"), "mcd")


def apply_rules(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` less their text with the base counts, base_failed, distance and kept.

    ``kept`` is false for base failures and for documents whose scaled squared
    distance passes ``cut``.  Base failures take no part in estimates.  Groups
    below ``MIN_GROUP`` rows share an estimate with the language's other small
    sources, then with all small groups; if even those are too few there is
    nothing to compare with and base rules alone decide.  Null languages and
    sources are groups of their own.  Null and empty texts fail by length.
    Repeated rows and ties are judged alike.  An empty table gives an empty
    result.  Columns named like a result are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    packed = Packed(docs, ["text", *made])
    narrow = docs.select(packed.row, "text", "lang", "source", F.xxhash64("doc_id").alias("mark"))
    counts = stored(base_counts(narrow).drop("text"), "counts")
    rows = stored(_grouped(counts), "rules")
    counted = rows.where("NOT base_failed").select("grp", *STATS, "mark")
    enough = counted.groupBy("grp").count().where(F.col("count") >= MIN_GROUP).select("grp")
    estimate = mcd_estimates(counted).join(enough, "grp")
    judged = rows.join(estimate, "grp", "left").withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)
    return judged.withColumn("kept", kept).select(*packed.unpacked(), *made)
