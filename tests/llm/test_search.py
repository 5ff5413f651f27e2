"""Exact top-k search against scoring all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhound.llm import search


def plain(rows, k, asked):
    ints = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (q, x) in enumerate(ints):
        if asked(q):
            scores = ((min(max(sum(s * t for s, t in zip(x, y)), -(1 << 63)), (1 << 63) - 1), i) for b, (i, y) in enumerate(ints) if a != b)
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda p: (-p[0], p[1]))[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("clash")).withColumn("part", F.lit(None).cast("int"))


def vectors(rng, n=900):
    hub = rng.normal(size=24)
    x = [(hub + rng.normal(size=24) * 0.1) if i % 3 == 0 else rng.normal(size=24) for i in range(n)]  # a third in one group
    sparse = [[float(rng.normal()) if rng.random() < 0.2 else 0.0 for _ in range(24)] for _ in range(200)]
    return [list(map(float, v)) for v in x] + sparse


@pytest.mark.parametrize(("shard", "block", "sample"), [(4096, 512, 2048), (60, 7, 2048), (60, 40, 4)])
def test_against_all_pairs(spark, monkeypatch, shard, block, sample):
    monkeypatch.setattr(search, "SAMPLE", sample)  # few centres, and no bars where the sample is too small
    rng = np.random.default_rng(1)
    rows = list(enumerate(vectors(rng)))
    rows += [(20_000 + i, rows[30][1]) for i in range(12)] + [(20, rows[21][1]), (20, rows[21][1])]  # ties over the border of k; ids that repeat
    rows += [(None, [1.0] * 24), (40_000, None), (40_020, [float("nan")] * 24), (40_040, [None] * 24), (40_060, []), (40_080, [1.0, -1.0]), (40_100, [0.0] * 24), (40_120, [-3.0] * 24), (40_140, [float("inf")] * 24)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = search.exact_top_k(frame(spark, rows), 5, F.col("vec_id") % 20 == 0, shard=shard, block=block)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, lambda i: i % 20 == 0)


def test_small_and_empty_tables(spark):
    every = F.lit(True)
    for rows in ([], [(1, [1.0])], [(1, [1.0]), (2, [-1.0]), (3, [-0.5])], [(1, None)], [(1, []), (2, [])]):
        assert sorted(map(tuple, search.exact_top_k(frame(spark, rows), 5, every).collect())) == plain(rows, 5, lambda i: True)
    assert search.exact_top_k(frame(spark, [(1, [1.0])]), 5, F.lit(None).cast("boolean")).count() == 0


def test_scores_beyond_a_long(spark):
    rows = [(1, [2.0**30, 1.0]), (2, [2.0**26, -5.0]), (3, [-(2.0**30), 3.0]), (4, [1.0, 1.0]), (5, [2.0**40, 2.0**41])]
    got = search.exact_top_k(frame(spark, rows), 3, F.lit(True))
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, lambda i: True)


def test_terms_are_split_and_probed():
    """Most vectors are never scored to the end, and none that belongs to the best is lost."""
    rng = np.random.default_rng(4)
    x = rng.integers(-100, 100, (2000, 32)) * (rng.random((2000, 32)) < 0.3)
    terms = search.Postings(x)
    for q in rng.integers(-100, 100, (20, 32)):
        score = x @ q
        bar = int(np.sort(score)[-5])
        probed, of = [0], search.Postings.of

        def counted(self, term, places, probed=probed, of=of):
            probed[0] += len(places)
            return of(self, term, places)

        search.Postings.of = counted
        try:
            at, found = terms.reach(q, bar)
        finally:
            search.Postings.of = of
        assert at.tolist() == np.flatnonzero(score >= bar).tolist() and (found == score[at]).all()
        assert 0 < probed[0] < x.size / 4
        assert len(terms.reach(q, int(np.maximum(q * x.max(0), q * x.min(0)).sum()) + 1)[0]) == 0


def test_on_given_embeddings(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = search.op11_exact_top_k(spark, path)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, lambda i: i % 50 == 0)
