"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  Its features are shape statistics (letter case, symbols, separators, repeated words, length)
of the line itself and of the lines before and after it; a 2x2 table of transition weights ties neighbours.  Forward and
backward passes give each line's marginal, and the mean of the marginals weighted by line length is the document's raw
quality.  A monotone calibration, also fitted on the training rows, puts the best cut at ``CUT``.

Labels are per document, lines are not labelled.  Training treats that as a latent chain: all lines of a good document
are good; the lines of a bad document are relabelled by the model itself for a few rounds, and at least the worst half of
the document's length stays bad.  Emission and transition weights are found together, by gradient ascent on the exact
likelihood of the labelled chains until the gradient is small (``CLOSE``) or ``STEPS`` are done.

The fit uses a bounded sample: about ``SAMPLE`` labelled documents of each label, by a hash of the id, of at most
``SAMPLE_LINES`` lines each; executors send the driver their lines' features, not their texts.  Every text is scored with
all its lines, and a line is one element of the chain however long it is.

Defined cases: a null text is empty; an empty text is one empty line and gets the score that this line gets; without
labelled rows, or with one label only, the score is the share of that label (0.5 without any); null ids count as an empty
id in the fold; other columns are ignored; repeated rows and ties are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import id_remainder

CUT = 0.7
SAMPLE = 1_000
SAMPLE_LINES = 256
ROUNDS, STEPS, RATE, RIDGE, CLOSE = 3, 300, 0.1, 1e-3, 2e-4
ODD = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,;:!?'\"()-\t_")
N_OWN = 10


def shape(line: str) -> tuple[float, ...]:
    """Own features of a line, each about 0 to 1."""
    n = len(line)
    if not n:
        return (0.0,) * (N_OWN - 1) + (1.0,)
    words = line.split()
    k = len(words) or 1
    rest = line.translate(ODD)
    odd = sum(1 for c in rest if not c.isalnum()) if rest else 0
    upper = sum(map(str.isupper, words))
    return (
        upper / k,
        min(1.0, odd / k),
        min(1.0, line.count("!") / k),
        line.count("|") / k,
        1.0 - len(set(words)) / k if k >= 4 else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        min(1.0, sum(map(line.count, "0123456789")) / n * 4),
        min(1.0, (line.count(".") + line.count(",")) / k),
        min(1.0, k / 50),
        1.0 if k < 2 else 0.0,
    )


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Own features and lengths of the lines that hold anything (of one empty line, if none does)."""
    lines = [line for line in (text or "").split("\n") if line.strip()] or [""]
    return np.array([shape(x) for x in lines]), np.array([len(x) + 1.0 for x in lines])


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of the lines: a constant, own, the line before, the line after (zeros beyond the ends)."""
    zero = np.zeros((1, own.shape[1]))
    return np.concatenate((np.ones((len(own), 1)), own, np.concatenate((zero, own[:-1])), np.concatenate((own[1:], zero))), axis=1)


def marginals(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line good) and summed pair marginals (2x2) of a chain; emit is the score of good against bad.

    Plain scaled forward-backward on two states, as floats: chains are short and many.
    """
    e = np.exp(np.clip(trans, -30, 30))
    t00, t01, t10, t11 = float(e[0, 0]), float(e[0, 1]), float(e[1, 0]), float(e[1, 1])
    good = (1 / (1 + np.exp(-np.clip(emit, -60, 60)))).tolist()
    n = len(good)
    forward = [(0.0, 0.0)] * n
    a0, a1 = 1 - good[0], good[0]
    forward[0] = (a0, a1)
    for i in range(1, n):
        p = good[i]
        b0, b1 = (a0 * t00 + a1 * t10) * (1 - p), (a0 * t01 + a1 * t11) * p
        s = b0 + b1
        a0, a1 = b0 / s, b1 / s
        forward[i] = (a0, a1)
    out = [0.0] * n
    pairs = np.zeros((2, 2))
    c0 = c1 = 1.0
    p00 = p01 = p10 = p11 = 0.0
    for i in range(n - 1, -1, -1):
        a0, a1 = forward[i]
        x0, x1 = a0 * c0, a1 * c1
        out[i] = x1 / (x0 + x1)
        if i:
            p = good[i]
            f0, f1 = forward[i - 1]
            u0, u1 = (1 - p) * c0, p * c1
            m00, m01, m10, m11 = f0 * t00 * u0, f0 * t01 * u1, f1 * t10 * u0, f1 * t11 * u1
            s = m00 + m01 + m10 + m11
            p00 += m00 / s
            p01 += m01 / s
            p10 += m10 / s
            p11 += m11 / s
            c0, c1 = t00 * u0 + t01 * u1, t10 * u0 + t11 * u1
            s = c0 + c1
            c0, c1 = c0 / s, c1 / s
    pairs[:] = ((p00, p01), (p10, p11))
    return np.array(out), pairs


class Chains:
    """Chains of several documents, by descending length, so that each step of a pass is one operation on all that go on."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        by_length = lengths[self.order]
        self.active = [int(np.searchsorted(-by_length, -t, side="left")) for t in range(int(lengths.max()))]

    def marginals(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(line good) of every line, and per document (in the order given) its summed pair marginals, as ``marginals`` has them."""
        e = np.exp(np.clip(trans, -30, 30))
        good = 1 / (1 + np.exp(-np.clip(emit, -60, 60)))
        own = np.stack((1 - good, good), axis=1)
        forward = np.empty_like(own)
        a = own[self.starts]
        forward[self.starts] = a
        for t, k in enumerate(self.active[1:], 1):
            at = self.starts[:k] + t
            a = (forward[at - 1] @ e) * own[at]
            forward[at] = a / a.sum(axis=1, keepdims=True)
        out = np.empty(len(emit))
        pairs = np.zeros((len(self.starts), 2, 2))
        after = np.ones((len(self.starts), 2))
        for t in range(len(self.active) - 1, -1, -1):
            k = self.active[t]
            at = self.starts[:k] + t
            x = forward[at] * after[:k]
            out[at] = x[:, 1] / x.sum(axis=1)
            if t:
                u = own[at] * after[:k]
                m = forward[at - 1][:, :, None] * e * u[:, None, :]
                pairs[:k] += m / m.sum(axis=(1, 2), keepdims=True)
                c = u @ e.T
                after[:k] = c / c.sum(axis=1, keepdims=True)
        back = np.empty_like(pairs)
        back[self.order] = pairs
        return out, back


class Model:
    """Weights of a fitted chain, and the raw quality at which a document counts as good."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, cut: float, constant: float | None = None):
        self.weights, self.trans, self.cut, self.constant = weights, trans, cut, constant

    def lines(self, own: np.ndarray) -> np.ndarray:
        return marginals(with_neighbours(own) @ self.weights, self.trans)[0]

    def raw(self, own: np.ndarray, size: np.ndarray) -> float:
        return float(np.dot(self.lines(own), size) / size.sum())

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        raw = self.raw(*lines_of(text))
        low = raw < self.cut
        return min(1.0, max(0.0, raw / self.cut * CUT if low else CUT + (raw - self.cut) / max(1e-9, 1 - self.cut) * (1 - CUT)))


def worst_half(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which lines of a bad document are taken as good: those the model finds good, but for the worst half by length."""
    order = np.argsort(p, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    must = np.zeros(len(p), dtype=bool)
    must[order[before < size.sum() / 2]] = True
    return (p > 0.5) & ~must


def fit(docs: list[tuple[tuple[np.ndarray, np.ndarray], int]]) -> Model:
    """Chain weights and calibration from (``lines_of`` a text, label) pairs."""
    labels = np.array([y for _, y in docs])
    if not len(docs) or labels.min() == labels.max():
        return Model(np.zeros(1), np.zeros((2, 2)), 0.5, float(labels[0]) if len(docs) else 0.5)
    feats = [f for f, _ in docs]
    x = [with_neighbours(own) for own, _ in feats]
    every = np.concatenate(x)
    at = np.cumsum([0, *map(len, x)])
    size = np.concatenate([s for _, s in feats])
    of_doc = np.repeat(np.arange(len(docs)), np.diff(at))
    balance = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    y = labels[of_doc].astype(float)
    lengths = np.diff(at)
    chains = Chains(lengths)
    # A document weighs by its label's share, a line of it by its part of the document.
    line_weight = (balance / lengths)[of_doc]
    pair_weight = balance / np.maximum(1, lengths - 1)
    inner = np.flatnonzero(of_doc[1:] == of_doc[:-1])
    k = every.shape[1]
    theta = np.zeros(k + 4)
    for _ in range(ROUNDS):
        seen = np.zeros((2, 2))
        path = y.astype(int)
        np.add.at(seen, (path[inner], path[inner + 1]), pair_weight[of_doc[inner]])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            # Observed less expected counts, and Adam's step along them.
            p, pairs = chains.marginals(every @ theta[:k], theta[k:].reshape(2, 2))
            g = np.concatenate((every.T @ (line_weight * (y - p)), (seen - np.tensordot(pair_weight, pairs, 1)).reshape(-1))) - RIDGE * theta
            if np.abs(g).max() < CLOSE:
                break
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        # Lines of bad documents get their labels anew.
        p, _ = chains.marginals(every @ theta[:k], theta[k:].reshape(2, 2))
        for d in np.flatnonzero(labels == 0):
            lo, hi = at[d], at[d + 1]
            y[lo:hi] = worst_half(p[lo:hi], size[lo:hi])
    w, trans = theta[:k], theta[k:].reshape(2, 2)
    model = Model(w, trans, 0.5)
    raw = np.array([model.raw(own, s) for own, s in feats])
    return Model(w, trans, best_cut(raw, labels))


def best_cut(raw: np.ndarray, labels: np.ndarray) -> float:
    """The raw quality that parts the labels with the fewest errors, each label counting the same; middle of the best gap."""
    order = np.argsort(raw, kind="stable")
    r, y = raw[order], labels[order]
    wrong = np.concatenate(([0.0], np.cumsum(y == 1))) / max(1, (y == 1).sum()) + np.concatenate(((np.cumsum((y == 0)[::-1]))[::-1], [0.0])) / max(1, (y == 0).sum())
    edges = np.concatenate(([0.0], (r[1:] + r[:-1]) / 2, [1.0]))
    wide = np.concatenate(([0.0], r[1:] - r[:-1], [0.0]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(np.clip(edges[best[np.argmax(wide[best])]], 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, train_on: Column, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs`` for which ``train_on`` (over doc_id) holds."""
    known = labels.where(train_on & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sizes = known.groupBy("quality").agg(F.count(F.lit(1)).alias("rows")).withColumn("part", sample / F.col("rows"))
    at = F.pmod(F.xxhash64(F.lit("quality"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    some = known.join(F.broadcast(sizes), "quality").where(at < F.col("part")).select("doc_id", "quality")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            few = pdf[[(t or "").count("\n") < SAMPLE_LINES for t in pdf["text"]]]
            got = [lines_of(t) for t in few["text"]]
            yield pd.DataFrame({"doc_id": few["doc_id"], "quality": few["quality"], "own": [own.reshape(-1) for own, _ in got], "size": [size for _, size in got]})

    # The sample is bounded, and so is what is broadcast of it.
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInPandas(measure, "doc_id long, quality int, own array<double>, size array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["own"]))
    return fit([((np.array(r["own"]).reshape(-1, N_OWN), np.array(r["size"])), r["quality"]) for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """doc_id and score of every document, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [shared.value.score(t) for t in pdf["text"]]})

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score reaches the cut, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.where(quality("text") >= CUT)


def held_out_run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: fold 2 of 4 by id is held out of training."""
    model = train(docs, labels, id_remainder("doc_id", 4) != 2)
    return score(docs, model).select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
