"""Whitening against a dense eigendecomposition of the covariance of distinct vectors."""

import math

import numpy as np
import pytest

from reviewlens.llm import whitening
from reviewlens.llm.queries import op13_whitening
from reviewlens.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, n long, key string, vector string"


def plain(rows, dimensions, components=4):
    """Clean rows with their x vectors, and what they should become: n, deviations, eigenpairs, trace."""
    clean = []
    for key, vector in rows:
        if vector and len(vector) == dimensions and all(c is not None and math.isfinite(c) for c in vector):
            clean.append((key, tuple(math.floor(256 * float(np.float32(c))) for c in vector)))
    fit = sorted(set(x for _, x in clean))
    n = len(fit)
    sums = [sum(column) for column in zip(*fit)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in clean]
    centred = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return clean, n, sums, deviations, values[::-1][:components], vectors[:, ::-1][:, :components], values.sum()


def check(got, rows, dimensions, k=4, close=1e-9):
    clean, n, sums, deviations, values, vectors, total = plain(rows, dimensions, k)
    k = len(values)
    assert len(got) == k * len(clean)
    keyed = {}
    for r in got:
        keyed.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    x = np.array([c[1] for c in clean], dtype=float)
    want = (x - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
    scores = np.full((len(clean), k), np.nan)
    for i, ((key, _), deviation) in enumerate(zip(clean, deviations)):
        own = keyed[key, deviation if deviation < 1 << 63 else None]
        for r in own:
            assert r["n"] == n and abs(r["explained"] / (values[r["component"] - 1] / total) - 1) < 1e-9
            assert r["identity_error"] < 1e-9
            scores[i, r["component"] - 1] = r["whitened"]
    signs = np.sign((scores * want).sum(axis=0))
    assert np.abs(scores * signs - want).max() < close
    assert len({r["identity_error"] for r in got}) <= 1


@pytest.mark.parametrize("dimensions, n", [(1, 9), (2, 30), (3, 40), (5, 60), (24, 300), (70, 400)])
def test_random_vectors(spark, monkeypatch, dimensions, n):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 4096)
    rng = np.random.default_rng(dimensions)
    scales = 0.9 ** np.arange(dimensions)
    vectors = (rng.standard_normal((n, dimensions)) * scales + rng.standard_normal(dimensions)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += rows[:7] + [(1000 + i, vectors[i].tolist()) for i in range(5)] * 3
    df = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], SCHEMA).repartition(5)
    got = whiten(df).collect()
    check(got, rows, dimensions)


def test_flat_spectrum_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "SLOTS", 2)
    rng = np.random.default_rng(2)
    vectors = rng.uniform(-1, 1, (3000, 40)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], SCHEMA).repartition(6)
    check(whiten(df, dimensions=40).collect(), rows, 40, close=1e-8)


def test_odd_input(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 6)).astype(np.float32))]
    rows += [(100, None), (101, []), (102, [1.0] * 5), (103, [1.0, None, 0, 0, 0, 0]), (104, [float("nan")] + [0.0] * 5)]
    rows += [(105, [float("inf")] + [0.0] * 5), (106, [-float("inf")] + [0.0] * 5), (None, [0.5] * 6), (107, [-0.0, 1 / 512, -1 / 512, 0, 1, 2])]
    df = spark.createDataFrame([(k, v and [None if c is None else float(c) for c in v], 1, "a", "b") for k, v in rows], SCHEMA)
    check(whiten(df).collect(), rows, 6)
    check(whiten(df, components=2).collect(), rows, 6, k=2)


def test_without_variance(spark):
    def of(vectors):
        return whiten(spark.createDataFrame([(i, v, 1, "a", "b") for i, v in enumerate(vectors)], SCHEMA)).collect()

    assert of([]) == of([[1.0, 2.0]]) == of([[1.0, 2.0]] * 3) == of([None, [], [float("nan")]]) == []
    # Two directions only.
    rng = np.random.default_rng(4)
    plane = (rng.integers(-9, 9, (40, 2)) @ rng.integers(-3, 3, (2, 8))).astype(float)
    got = of(plane.tolist())
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9


def test_large_entries(spark):
    rows = [(0, [1e12, 5.0, -3.0]), (1, [-2e12, 1.0, 4.0]), (2, [3.5e12, 0.0, 1e12]), (3, [0.0, 7.0, -1e12])]
    df = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], SCHEMA)
    got = whiten(df, components=2).collect()
    assert {r["deviation"] for r in got} == {None}
    check(got, rows, 3, k=2)
    assert len(whiten(spark.createDataFrame([(0, [3e38], 1, "", ""), (1, [-3e38], 1, "", "")], SCHEMA)).collect()) == 2


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(op13_whitening(spark, folder).collect(), rows, 64, close=1e-9)
