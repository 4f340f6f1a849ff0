"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of characters that are neither letters nor marks becomes one space, and its n-grams of 1 to
``ORDERS`` characters are hashed into ``BUCKETS`` features.  Training adds up counts per (language, feature) on the
executors; the matrix of log-probabilities (features x languages, 4 bytes each) is broadcast and its size is fixed by
``BUCKETS`` and the number of languages.  Scoring takes a batch of texts as a sparse matrix, rows of feature numbers end to
end, and multiplies it by that matrix: one gather, one sum per row.  Long texts are rows of at most ``PIECE`` characters
that share no n-gram, and their sums are added.

The model is fitted on a bounded sample: at most about ``SAMPLE`` documents a language, chosen by a hash of the id.  That
bound is the only one; every text is scored in full.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any training row everything is
``und``; null ids count as an empty id in the fold and the sample; rows are scored one by one, so repeated rows and ties
don't matter (the first language in order wins a tie); other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import id_remainder
from ledgermill.llm.hashing import seeds

ORDERS = 4
BUCKETS = 1 << 16
SAMPLE = 4_000
SMOOTHING = 0.5
PIECE = 1 << 17
UND = "und"
_MUL = (seeds(ORDERS, 71) >> np.uint64(33)).astype(np.uint32) | np.uint32(1)


@lru_cache(1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Code point to its lower-case letter or mark, 0 for anything else; and which are letters.  Planes past 3 hold few of either."""
    fold, letter = np.zeros(sys.maxunicode + 1, dtype=np.uint32), np.zeros(sys.maxunicode + 1, dtype=bool)
    for k in (*range(0x33480), *range(0xE0100, 0xE01F0)):
        c = chr(k)
        if (kind := category(c)[0]) in "LM":
            low = c.lower()
            fold[k] = ord(low) if len(low) == 1 else k
            letter[k] = kind == "L"
    return fold, letter


def letters(text: str) -> np.ndarray:
    """Lower-cased code points with one 0 for each run of others and one at either end; empty without letters."""
    fold, letter = _fold()
    out, had = [], False
    for lo in range(0, len(text), PIECE):
        raw = np.frombuffer(text[lo : lo + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cps = fold[raw]
        had = had or bool(letter[raw].any())
        keep = cps != 0
        keep[1:] |= keep[:-1] & (cps[1:] == 0)
        if lo == 0 or (out and len(out[-1]) and out[-1][-1] != 0):
            keep[:1] = True
        out.append(cps[keep])
    if not had:
        return np.empty(0, dtype=np.uint32)
    cps = np.concatenate(([0], *out, [0])).astype(np.uint32)
    return cps[np.concatenate(([True], (cps[1:] != 0) | (cps[:-1] != 0)))]


def features(cps: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of the n-grams, order by order."""
    h = np.zeros(len(cps), dtype=np.uint32)
    for n in range(ORDERS):
        if len(cps) <= n:
            return
        h = h[: len(cps) - n] * np.uint32(0x01000193) + cps[n:] * _MUL[n]
        mixed = h ^ (h >> np.uint32(15))
        mixed = mixed * np.uint32(0x85EBCA6B + 2 * n)
        yield (mixed >> np.uint32(16)) & np.uint32(BUCKETS - 1)


def rows_of(texts: Iterator[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sparse rows of about PIECE code points together: which text each row is of, the rows' starts, and features by order.

    The features are an array of orders x code points, BUCKETS where no n-gram of a row begins.
    """
    held: list[tuple[int, np.ndarray, int]] = []
    size = 0

    def done() -> tuple[list[int], np.ndarray, np.ndarray]:
        flat = np.concatenate([part for _, part, _ in held])
        sizes = np.array([len(part) for _, part, _ in held])
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(held)), sizes)
        inside = np.arange(len(flat)) - starts[row] < np.array([n for *_, n in held])[row]
        out = np.full((ORDERS, len(flat)), BUCKETS, dtype=np.uint32)
        for n, f in enumerate(features(flat)):
            good = inside[: len(f)] & (row[: len(f)] == row[n:])
            out[n, : len(f)][good] = f[good]
        return [k for k, *_ in held], starts, out

    for k, text in enumerate(texts):
        cps = letters(text or "")
        for lo in range(0, len(cps), PIECE):
            # An n-gram is in the piece that it begins in; the next piece's first characters are there to end it.
            held.append((k, cps[lo : lo + PIECE + ORDERS - 1], PIECE))
            size += len(held[-1][1])
            if size >= PIECE:
                yield done()
                held, size = [], 0
    if held:
        yield done()


def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per language the counts of its features, once a task."""
    total: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, some in pdf.groupby("lang")["text"]:
            got = total.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
            for _, _, found in rows_of(some):
                got += np.bincount(found.reshape(-1), minlength=BUCKETS + 1)
    for lang, got in total.items():
        at = np.flatnonzero(got[:BUCKETS])
        yield pd.DataFrame({"lang": lang, "feature": at.astype(np.int32), "n": got[at]})


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and log P(feature | language), from rows (doc_id, text, lang), all of them labelled."""
    at = F.pmod(F.xxhash64(F.lit("langid"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).withColumn("part", sample / F.col("rows"))
    some = rows.join(F.broadcast(sizes), "lang").where(at < F.col("part")).select("lang", "text")
    got = some.mapInPandas(counts, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    for k, lang in enumerate(langs):
        one = got[got["lang"] == lang]
        table[one["feature"].to_numpy(), k] += one["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32) if langs else table.astype(np.float32)


def scores(texts: list[str | None], langs: list[str], table: np.ndarray) -> list[tuple[str, float]]:
    """The likeliest language of each text and its posterior; priors are even."""
    out = [(UND, 0.0)] * len(texts)
    if not langs:
        return out
    padded = np.concatenate((table, np.zeros((1, len(langs)), dtype=table.dtype)))
    total = np.zeros((len(texts), len(langs)))
    seen = set()
    for which, starts, found in rows_of(texts):
        for f in found:
            np.add.at(total, which, np.add.reduceat(np.take(padded, f, axis=0), starts, axis=0, dtype=np.float64))
        seen.update(which)
    best = total.argmax(axis=1)
    sure = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
    for k in seen:
        out[k] = langs[best[k]], float(sure[k])
    return out


def identify(docs: DataFrame, train_on: Column, id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score of every document; the model learns from the rows where ``train_on`` holds."""
    base = docs.select(F.col(id_col).cast("string").alias("doc_id"), "text")
    rows = docs.where(train_on & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col(id_col).alias("doc_id"), "text", "lang")
    langs, table = fit(rows)
    model = docs.sparkSession.sparkContext.broadcast((langs, table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, table = model.value
        for pdf in batches:
            got = scores(list(pdf["text"]), langs, table)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [x for x, _ in got], "score": [s for _, s in got]})

    return base.mapInPandas(run, "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def held_out_run(docs: DataFrame) -> DataFrame:
    """The contract's columns: fold 1 of 3 by id is held out of training."""
    fold = id_remainder("doc_id", 3)
    return identify(docs, fold != 1).select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
