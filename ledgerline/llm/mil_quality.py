"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded as a vector of
character and word statistics; gated attention gives each passage a weight; the
weighted sum is scored.  Only document labels are known in training, the
attention finds the passages that explain them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import append_columns

#: Words of a passage; the last one of a text may be shorter.
PASSAGE = 64
#: Labelled documents per class that the model is fitted on, drawn by a hash of the id.
SAMPLE_PER_CLASS = 1500
#: Passages of a training document that enter one step, drawn anew each epoch; scoring uses all.
BAG = 64
HIDDEN = 16
EPOCHS = 60
SEED = 17

#: Character classes of an encoding, by number.
_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "mark", "symbol", "other")
_BUCKETS = 24


def _class_table() -> np.ndarray:
    table = np.full(0x110000, _CLASSES.index("other"), dtype=np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        name = (
            "newline" if ch == "\n"
            else "space" if ch.isspace()
            else "upper" if ch.isupper()
            else "lower" if ch.isalpha()
            else "digit" if ch.isdigit()
            else "stop" if ch in ".,;:"
            else "mark" if ch in "!?'\"()-"
            else "symbol" if c < 128
            else "other"
        )
        table[c] = _CLASSES.index(name)
    return table


_TABLE = _class_table()
#: Encoded statistics: classes' shares, then word statistics, then hashed character pairs.
WIDTH = len(_CLASSES) + 6 + _BUCKETS


def encode(text: str | None, passage: int = PASSAGE) -> np.ndarray:
    """One row of WIDTH statistics per passage of the whole text; an empty text is one row of zeros."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kinds = _TABLE[codes] if len(codes) else np.empty(0, np.uint8)
    # The six ASCII white-space characters alone part words.
    gap = (codes == 32) | ((codes >= 9) & (codes <= 13))
    begins = ~gap & np.concatenate(([True], gap[:-1])) if len(codes) else np.empty(0, bool)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros((1, WIDTH))
    n = len(starts)
    cuts = starts[::passage].copy()
    cuts[0] = 0
    sizes = np.diff(np.append(cuts, len(codes)))
    rows = np.repeat(np.arange(len(cuts)), sizes)
    out = np.zeros((len(cuts), WIDTH))
    shares = np.bincount(rows * len(_CLASSES) + kinds, minlength=len(cuts) * len(_CLASSES))
    out[:, : len(_CLASSES)] = shares.reshape(len(cuts), -1) / sizes[:, None]

    solid = np.flatnonzero(~gap)
    word = np.cumsum(begins) - 1
    length = np.bincount(word[solid], minlength=n).astype(np.float64)
    # A word's identity: a sum of its characters' spread codes by place.
    spread = (codes[solid].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    turn = (solid - starts[word[solid]]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    identity = np.add.reduceat(spread * turn * turn, np.searchsorted(solid, starts))
    bag = np.arange(n) // passage
    count = np.bincount(bag, minlength=len(cuts)).astype(np.float64)
    mean = np.bincount(bag, length, len(cuts)) / count
    order = np.lexsort((identity, bag))
    fresh = np.concatenate(([True], (np.diff(identity[order]) != 0) | (np.diff(bag[order]) != 0)))
    distinct = np.bincount(bag[order], fresh, len(cuts)) / count
    follows = np.concatenate(([False], identity[1:] == identity[:-1]))
    lone = np.bincount(bag, (length == 1) & np.isin(kinds[starts], (6, 7, 8)), len(cuts)) / count
    at = len(_CLASSES)
    out[:, at] = np.log1p(mean)
    out[:, at + 1] = np.sqrt(np.maximum(np.bincount(bag, length * length, len(cuts)) / count - mean * mean, 0)) / 8
    out[:, at + 2] = distinct
    out[:, at + 3] = np.bincount(bag, follows, len(cuts)) / count
    out[:, at + 4] = lone
    out[:, at + 5] = np.log1p(count) / 4
    pair = (kinds[:-1].astype(np.int64) * len(_CLASSES) + kinds[1:]) * 2654435761 % (1 << 32) % _BUCKETS
    if len(pair):
        hashed = np.bincount(rows[:-1] * _BUCKETS + pair, minlength=len(cuts) * _BUCKETS).reshape(len(cuts), -1)
        out[:, at + 6 :] = hashed / sizes[:, None]
    return out


class GatedAttention:
    """p = sigmoid(c z + b), z = sum of a_k h_k, a = softmax(w (tanh(V x_k) * sigmoid(U x_k))), h = tanh(E x)."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(width)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = {
            "E": rng.normal(0, scale, (width, hidden)),
            "V": rng.normal(0, scale, (width, hidden)),
            "U": rng.normal(0, scale, (width, hidden)),
            "w": rng.normal(0, 0.1, hidden),
            "c": rng.normal(0, 0.1, hidden),
            "b": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, owner: np.ndarray, n: int):
        p = self.p
        h, t = np.tanh(x @ p["E"]), np.tanh(x @ p["V"])
        g = 1 / (1 + np.exp(-np.clip(x @ p["U"], -30, 30)))
        score = np.clip((t * g) @ p["w"], -30, 30)
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, score)
        raw = np.exp(score - top[owner])
        a = raw / np.bincount(owner, raw, n)[owner]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, owner, a[:, None] * h)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return h, t, g, a, z, y

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> GatedAttention:
        """Adam on the log loss, classes weighed alike; bags are visited in a drawn order."""
        rng = np.random.default_rng(seed)
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), np.maximum(every.std(axis=0), 0.02)
        share = np.clip(labels.mean(), 0.02, 0.98)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            rate = 0.02 / (1 + epoch / 15)
            order = rng.permutation(len(bags))
            for begin in range(0, len(order), 128):
                picked = order[begin : begin + 128]
                drawn = [bags[i] if len(bags[i]) <= BAG else bags[i][rng.choice(len(bags[i]), BAG, replace=False)] for i in picked]
                x = self._scaled(np.concatenate(drawn))
                owner = np.repeat(np.arange(len(picked)), [len(d) for d in drawn])
                step += 1
                for k, g in self._gradients(x, owner, labels[picked], share).items():
                    g = g + 1e-4 * self.p[k]
                    m, v = moments[k]
                    m[...] = 0.9 * m + 0.1 * g
                    v[...] = 0.999 * v + 0.001 * g * g
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x, owner, labels, share) -> dict[str, np.ndarray]:
        p, n = self.p, len(labels)
        h, t, g, a, z, y = self._forward(x, owner, n)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        error = weight * (y - labels) / n
        d_z = error[:, None] * p["c"]
        d_h = a[:, None] * d_z[owner]
        d_a = (d_z[owner] * h).sum(axis=1)
        d_score = a * (d_a - np.bincount(owner, a * d_a, n)[owner])
        d_t, d_g = d_score[:, None] * p["w"] * g, d_score[:, None] * p["w"] * t
        return {
            "E": x.T @ (d_h * (1 - h * h)),
            "V": x.T @ (d_t * (1 - t * t)),
            "U": x.T @ (d_g * g * (1 - g)),
            "w": (t * g).T @ d_score,
            "c": z.T @ error,
            "b": np.array([error.sum()]),
        }

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return self._forward(self._scaled(np.concatenate(bags)), owner, len(bags))[-1] if bags else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> GatedAttention:
    """Fit on at most ``per_class`` documents of each quality label.

    The sample is drawn by a hash of the id from ``labels`` (doc_id, quality),
    which holds the rows to learn from; rows with nulls teach nothing.  The ids
    of the sample, bounded by ``per_class``, are broadcast to the documents, and
    the encoded passages of the sampled documents come to the driver.  Without
    both labels the untrained model scores near one half.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = [
        known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)
    ]
    picked = picked[0].union(picked[1])

    def make():
        return lambda texts: [[encode(t).astype(np.float32).tobytes() for t in texts]]

    wanted = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    wanted = wanted.dropDuplicates(["doc_id"])
    rows = append_columns(wanted, ["text"], [("bag", T.BinaryType())], make).select("doc_id", "quality", "bag").collect()
    rows.sort(key=lambda r: r["doc_id"])
    model = GatedAttention()
    targets = np.array([r["quality"] for r in rows], dtype=np.float64)
    if len(set(targets)) < 2:
        return model
    bags = [np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, WIDTH).astype(np.float64) for r in rows]
    return model.fit(bags, targets)


def score_quality(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """``docs`` with score (0 to 1, higher for label 1) and predicted (score >= 0.5).

    All passages of a text count, whatever its length; null and empty texts are
    one empty passage.  Repeated rows get equal scores; an empty table gives an
    empty result.  Columns named like a result are replaced.
    """

    def make():
        def compute(texts):
            scores: list[float] = []
            bags: list[np.ndarray] = []
            held = 0
            for text in texts:
                bags.append(encode(text))
                held += len(bags[-1])
                if held >= 4000:
                    scores += model.score(bags).tolist()
                    bags, held = [], 0
            scores += model.score(bags).tolist()
            return [scores, [int(s >= 0.5) for s in scores]]

        return compute

    fields = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
    return append_columns(docs, ["text"], fields, make)
