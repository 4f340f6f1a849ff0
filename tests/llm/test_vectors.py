"""Operators 11 and 13 against brute force, and on odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import topk, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, q int, row string"


def whole(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def ints(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


@pytest.fixture(scope="module")
def odd_vectors():
    """Copies, repeated rows, ids that are null or stand for several vectors, and every kind of vector that takes no part."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(120)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)]  # copies of a query's vector
    rows += [rows[0], rows[0], (100, rows[7][1]), (None, rows[9][1]), (None, None)]
    rows += [(200, None), (250, []), (300, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (350, [float("nan")] * 6), (400, [float("inf")] * 6), (450, [1.0, 2.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 1, "r") for i, v in rows], SCHEMA)


def brute_topk(rows, k, every):
    taken = list(dict.fromkeys((i, tuple(ints(v))) for i, v in rows if whole(v) and len(v) == 6))
    out = []
    for i, v in taken:
        if i is None or i % every:
            continue
        found = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for j, w in taken if j != i), key=lambda t: t[:3])[:k]
        out += [(i, n + 1, j, -s) for n, (s, _, _, j) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("bits", "wave"), [(6, 1 << 21), (1, 6), (8, 12)])
def test_topk_is_brute_force(spark, odd_vectors, monkeypatch, bits, wave):
    monkeypatch.setattr(topk, "WAVE_CELLS", wave)
    got = topk.search(frame(spark, odd_vectors), F.col("vec_id") % 50 == 0, bits=bits)
    assert sorted(map(tuple, got.collect()), key=str) == brute_topk(odd_vectors, topk.K, 50)


def test_topk_of_few_rows(spark):
    assert topk.every_fiftieth(frame(spark, [])).count() == 0
    assert topk.every_fiftieth(frame(spark, [(0, [1.0, 2.0])])).count() == 0
    assert topk.every_fiftieth(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = topk.every_fiftieth(frame(spark, [(0, [1.0, 2.0]), (2, [0.0, 1.0]), (1, [0.0, 1.0])]))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]


def test_huge_components_are_exact(spark):
    got = topk.every_fiftieth(frame(spark, [(0, [1e7, 1.0]), (1, [1e7, 0.0]), (2, [1e7, 1.0]), (3, [1e38, 0.0])]))
    x = ints([1e7, 1.0])
    assert [tuple(r)[2:] for r in sorted(got.collect(), key=lambda r: r["rank"])] == [(3, (1 << 63) - 1), (2, x[0] ** 2 + x[1] ** 2), (1, x[0] ** 2)]


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-300, 300, (500, 8)), rng.integers(-300, 300, (20, 8)).astype(float)
    for bits in (1, 4, 8):
        cells = topk.Cells(x.min(axis=0).tolist(), x.max(axis=0).tolist(), bits)
        boxes = cells.boxes(cells.codes(x))
        score = x @ q.T
        assert (boxes @ np.vstack([q.T, np.abs(q.T)]) + cells.slack(q) >= score).all()
        assert (boxes @ np.vstack([q.T, -np.abs(q.T)]) - cells.slack(q) <= score).all()


def test_few_exact_vectors_are_read(spark, sf):
    rows = vectors.scaled(spark.read.parquet(f"{sf}/embeddings.parquet"))
    file = topk.vector_file(rows, topk.K)
    ranges = file.mapInPandas(topk._ranges, "dim int, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    cells = topk.Cells([r["low"] for r in ranges], [r["high"] for r in ranges], topk.BITS)
    coded = file.select("row", "sole", "alone", "x").mapInPandas(topk._coded(cells), "row long, sole long, alone boolean, code binary")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("vec_id").alias("query_id"), F.col("x").alias("qx"))
    assert topk._candidates(asked, coded, cells, topk.K).count() < 0.1 * asked.count() * rows.count()


def brute_whitening(rows, components=4):
    taken = [(i, ints(v)) for i, v in rows if whole(v) and len(v) == 6]
    x = np.array(list(dict.fromkeys(tuple(v) for _, v in taken)), dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = {}
    for i, v in taken:
        y = n * np.array(v) - s
        for k in range(components):
            out.setdefault((i, k + 1), []).append((n, int((y * y).sum()), abs(float((np.array(v) - s / n) @ u[:, k] / math.sqrt(e[k]))), float(e[k] / np.trace(c.T @ c / n))))
    return out


def test_whitening_is_brute_force(spark, odd_vectors):
    got = {}
    for r in whitening.whiten(frame(spark, odd_vectors)).collect():
        assert r["identity_error"] <= 1e-9
        got.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
    want = brute_whitening(odd_vectors)
    assert set(got) == set(want)
    for key, rows in want.items():
        assert [r[:2] for r in sorted(got[key])] == [r[:2] for r in sorted(rows)]
        assert np.allclose(sorted(got[key]), sorted(rows), rtol=1e-9, atol=1e-12)


def test_whitened_fit_list_is_white(spark, sf):
    got = whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet")).toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy(dtype=float)
    assert wide.shape == (500, 4) and got["n"].eq(500).all()
    assert np.abs(wide.mean(axis=0)).max() < 1e-9
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(4)).max() < 1e-9
    assert got.groupby("component")["explained"].first().is_monotonic_decreasing


def test_components_without_variance(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, 0.0)] * 4
    flat = whitening.whiten(frame(spark, [(1, [1.0, 2.0, 0.0]), (2, [1.5, 2.0, 0.0]), (3, [0.25, 2.0, 0.0])])).collect()
    assert {(r["component"], r["whitened"] is None, round(r["explained"], 9)) for r in flat} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}


def test_sums_beyond_64_bits():
    x = np.array([[(1 << 62) + 5, -7], [3, 1 << 61]], dtype=np.int64)
    model = whitening.Whitening(2, [int(x[0, 0]) + 3, int(x[1, 1]) - 7], np.eye(2), np.ones(2), 2.0)
    assert [list(map(int, r)) for r in model.offsets(x)] == [[2 * int(r[0]) - model.sums[0], 2 * int(r[1]) - model.sums[1]] for r in x]
    assert model.deviations(x) == [None, None]
    near = np.array([[3_000_000_000, 0], [0, 0]], dtype=np.int64)
    model = whitening.Whitening(1, [0, 0], np.eye(2), np.ones(2), 2.0)
    assert model.deviations(near) == [9 * 10**18, 0]
