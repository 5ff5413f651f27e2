"""Whitening against a dense eigenvalue solver and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhound.llm import whitening


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["random", "equal", "two values", "zero", "low rank", "graded", "diagonal", "negative"])
def test_components(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    e = {
        "random": rng.random(n), "equal": np.ones(n), "two values": np.repeat([3.0, 1.0], [n // 2, n - n // 2]), "zero": np.zeros(n),
        "low rank": np.where(np.arange(n) < max(1, n // 4), rng.random(n), 0), "graded": 10.0 ** -np.linspace(0, 14, n), "diagonal": rng.random(n), "negative": rng.normal(size=n),
    }[kind]
    a = np.diag(e) if kind == "diagonal" else (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.components(a)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 and (np.diff(values) <= 0).all()
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 and np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13


def test_polar_factor():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    e = rng.normal(size=20)
    e[:3] = 1e-9, -1e-9, 50.0
    u = whitening.polar((q * e) @ q.T)
    assert np.abs(u - (q * np.sign(e)) @ q.T).max() < 1e-6 and np.abs(u @ u - np.eye(20)).max() < 1e-12


def plain(rows, k):
    """``{(vec_id, component): ...}`` and the rank, from a dense solver and exact sums."""
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, v + [0] * (width - len(v))) for i, v in ok]
    fit = np.array(sorted({tuple(v) for _, v in ok}), float).reshape(-1, width)
    n, s = len(fit), [int(x) for x in fit.sum(0)]
    e, w = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(width, width))
    e, w = e[::-1], w[:, ::-1]
    out = []
    for i, v in ok:
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)])
        out += [(i, c + 1, n, deviation, centred @ w[:, c] / np.sqrt(e[c]), e[c] / e.sum()) for c in range(min(k, width))]
    return out


def agree(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0], r[1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    a, b = np.array([r[4] for r in got]), np.array([r[4] for r in want])
    component = np.array([r[1] for r in got])
    for c in set(component.tolist()):
        x, y = a[component == c], b[component == c]
        assert np.abs(x - np.sign(x @ y) * y).max() < 1e-8  # one sign for all rows
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9) and max(r[6] for r in got) < 1e-8 and len({r[6] for r in got}) == 1


def test_against_dense_solver(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 12)) @ np.diag(1.6 ** -np.arange(12)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[5].tolist()) for i in range(200)]  # copies count once in the fit
    rows += [(5, x[6].tolist()), (None, x[7].tolist()), (2000, None), (2001, [float("nan")] * 12), (2002, [None] * 12), (2003, [1.0, 2.0]), (2004, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(None).cast("int")).repartition(6)
    agree(whitening.whiten(df, 4).collect(), plain(rows, 4))
    assert {r.component for r in whitening.whiten(df).collect()} == set(range(1, 13))


def test_odd_tables(spark):
    def run(rows, k=4):
        return sorted(map(tuple, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k).collect()))

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [])]) == []
    assert run([(1, [1.0]), (2, [1.0])]) == [(1, 1, 1, 0, None, None, 0.0), (2, 1, 1, 0, None, None, 0.0)]
    flat = run([(1, [1.0, 0.0]), (2, [3.0, 0.0])])
    assert [(r[0], r[1], r[3], r[4] and abs(r[4])) for r in flat] == [(1, 1, 512**2, 1.0), (1, 2, 512**2, None), (2, 1, 512**2, 1.0), (2, 2, 512**2, None)] and flat[0][4] == -flat[2][4]
    assert run([(1, [2.0**50]), (2, [0.0])])[0][3] is None  # beyond a long


def test_on_given_embeddings(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    agree(whitening.op12_whitening(spark, path).collect(), plain(rows, 4))
