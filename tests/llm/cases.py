"""Small tables with the awkward rows every operator has to take."""

from __future__ import annotations

import random

#: Beside the given columns, names that operators make or use inside.
CLASHES = ["score", "key", "n_words", "size", "scale", "grp", "part", "value", "n", "hash", "spans", "base", "near", "row", "root", "bands", "v9", "copies"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def texts() -> list[str | None]:
    """Copies, near copies, shared passages, repeats inside a text, empty and wordless ones, one long text."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base[:60] + ["changed"] + base[61:]
    passage = words(rng, 50)
    shared = [words(rng, 30) + passage + words(rng, 20) for _ in range(3)]
    loop = words(rng, 40)
    long = words(rng, 6000)
    return [
        None,
        "",
        " \n\t ",
        "1234 !!",
        "one",
        " ".join(base),
        " ".join(base),
        " ".join(near),
        "\n".join(base).upper(),
        *[" ".join(s) for s in shared],
        " ".join(loop + loop),
        " ".join(long),
        "mail a.b@c.de or x@y and 10.0.0.1 1.2.3.999 or +49 (30) 1234-5678 card 4111 1111 1111 1111.",
        "é@x.yz @@ a@b.c.d@e.f 1.2.3.4.5.6.7.8 +1 4111-1111-1111-1112",
        "line\nline\n\nline\n" + "same words again and again here now " * 6,
        "café 中文 \U0001f600 naïve",
    ]


def rows() -> list[tuple]:
    found = [(i, t, ["de", "fr", None][i % 3], ["s1", "s2", None, "s3"][i % 4], 1, *CLASHES) for i, t in enumerate(texts())]
    found.append((None, "a row without an id " * 3, None, None, None, *[None] * len(CLASHES)))
    found += [found[5], found[5]]  # repeated rows
    return found


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)
