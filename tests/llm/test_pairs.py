"""Near duplicates of texts and vectors against comparing all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhound.llm import neardup, vectors
from tallyhound.llm.flatgraph import FlatGraph
from tallyhound.llm.graph import components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def smallest_reachable(ids, linked):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = smallest_reachable(ids, pairs)
    return sorted((d, len(sets[d]), root[d], root[d] == d) for d in ids)


def edited(words, rng, n):
    w = list(words)
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"x{rng.integers(1 << 40)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(2)
    base = [f"w{rng.integers(5000)}" for _ in range(150)]
    out = [edited(base, rng, int(rng.integers(1, 12))) for _ in range(150)]  # similarities on both sides of the threshold
    out += [" ".join(base[: int(n)]) for n in rng.integers(100, 150, 30)]
    passage = [f"p{i}" for i in range(60)]
    out += [" ".join(passage + [f"q{rng.integers(1 << 40)}" for _ in range(int(rng.integers(5, 90)))]) for _ in range(60)]
    out += ["Same TEXT again here"] * 20 + ["same text\tagain  here", None, "", " \n ", "one", "ONE", "one two", "one two", "a b c", "a b c d", "É b c", "é b c"]
    out += [" ".join(f"z{j}" for j in range(20_000)), " ".join(f"z{j}" for j in range(20_300))]
    out += [" ".join(f"s{i}" for i in range(8)), " ".join(f"s{i}" for i in range(9)), " ".join(f"s{i}" for i in range(10))]
    order = rng.permutation(len(out))
    return [(int(i), t) for i, t in zip(order, out, strict=True)]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, docs, words, percent):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).repartition(5)
    got = neardup.near_duplicates(df, words, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(docs, words, percent)


@pytest.mark.parametrize("turns", [0, 1])
def test_rest_finds_all_over_many_blocks(spark, docs, monkeypatch, turns):
    """Without the star's help or after it, in blocks of a few rows, the same links are found."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    some = docs[::2]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = neardup.near_duplicates(df, 3, 85, turns=turns).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(some, 3, 85)


def test_rows_of_a_large_group_stay_linear(spark, monkeypatch):
    """2,000 edited copies of one text with similarities on both sides of the threshold: all links are kept, no task gives out pairs."""
    rng = np.random.default_rng(21)
    base = [f"w{rng.integers(5000)}" for _ in range(120)]
    some = [(i, edited(base, rng, int(rng.integers(1, 9)))) for i in range(2000)]
    made, write = {}, neardup.write_shared

    def counted(df, what):
        out = write(df, what)
        made.setdefault(what, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "write_shared", counted)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 3, 85).collect()}
    keys = neardup.CHUNKS * neardup.WIDTH
    assert max(max(made[x]) for x in ("links", "pairs", "able", "cells")) <= 2000 * keys and max(made["links"]) <= 4 * 2000
    sets = {i: shingles(t, 3) for i, t in some}
    near = [(a, b) for a in sets for b in range(a) if 100 * (n := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    assert got == smallest_reachable(sorted(sets), near) and len(set(got.values())) > 1


def test_on_given_documents(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = neardup.op1_minhash_near_dedup(spark, path)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute(docs, 3, 85)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(df).select("doc_id", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(None, None, False), (None, None, False), (1, 1, True), (1, 1, True), (2, 1, False)], key=repr)
    assert sorted(r.doc_id or 0 for r in neardup.drop_near_duplicates(df).collect()) == [0, 0, 1]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.drop_near_duplicates(df.limit(0)).count() == 0


def test_signature_pairs_meet(spark):
    """Any two signatures within the guaranteed distance share a key."""
    rng = np.random.default_rng(4)
    n, indexed = 400, neardup.CHUNKS * neardup.WIDTH
    assert indexed == neardup.SLOTS and neardup.DISTANCE == 2 * neardup.CHUNKS - 1  # the distance in use is the one guaranteed
    a = rng.integers(0, 1 << 16, (n, neardup.SLOTS)).astype(np.uint16)
    b = a.copy()
    for i in range(n):
        b[i, rng.choice(indexed, neardup.DISTANCE, replace=False)] ^= 1
    same = neardup.chunk_keys(a) == neardup.chunk_keys(b)
    assert same.any(1).all() and (np.argmax(same, 1) // neardup.WIDTH == neardup.first_key(a != b) // neardup.WIDTH).all()
    assert same[np.arange(n), neardup.first_key(a != b)].all()


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    ids = {x for e in edges for x in e if e[0] != e[1]}
    want = smallest_reachable(sorted(ids), [e for e in edges if e[0] != e[1]])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)


def brute_vectors(rows, cosine):
    ok = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[i] = x / np.linalg.norm(x)
    ids = sorted(ok)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine]
    n = {i: sum(i in p for p in pairs) for i, _ in rows}
    root = smallest_reachable([i for i, _ in rows], pairs)
    return sorted((i, n[i], root[i], root[i] == i) for i, _ in rows)


COLUMNS = ("vec_id", "n_links", "component_id", "kept")


@pytest.mark.parametrize("exact", [True, False])
def test_vectors_against_all_pairs(spark, exact):
    rng = np.random.default_rng(6)
    hub = rng.normal(size=32)
    rows = [(hub + rng.normal(size=32) * 0.25).tolist() for _ in range(120)] + [rng.normal(size=32).tolist() for _ in range(300)]
    rows += [[2 * x for x in rows[0]], rows[1], rows[1], rows[1], None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [1.0, 2.1], []]
    rows = [(i * 3, v) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("label", F.lit(None).cast("int"))
    want = brute_vectors(rows, 0.9)
    got = sorted(map(tuple, vectors.near_vectors(df, exact=exact).select(*COLUMNS).collect()))
    assert got == want
    got = vectors.near_vectors(df, shard=60, group=60, exact=exact).collect()  # several overlapping shards in blocks
    assert all(r.recall >= 0.98 for r in got)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in got)
    assert sum(a[1] for a in got) >= (1 if exact else 0.95) * sum(b[1] for b in want) and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert vectors.near_vectors(df.limit(0), exact=exact).count() == 0
    one = vectors.near_vectors(spark.createDataFrame([(None, [1.0]), (4, [1.0])], "vec_id long, embedding array<double>"), exact=exact).select(*COLUMNS)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted([(None, 0, None, False), (4, 0, 4, True)], key=repr)


def hot_group():
    """A third of the rows are distinct near copies of one vector, far more than a block holds; other pairs lie just above the threshold."""
    rng = np.random.default_rng(12)
    hub = rng.normal(size=64)
    x = np.concatenate((hub + rng.normal(size=(400, 64)) * 0.23, rng.normal(size=(800, 64))))
    for i in range(500, 900, 2):  # even-spread pairs at a cosine just above 0.9
        u = x[i] / np.linalg.norm(x[i])
        v = x[i + 1] - (x[i + 1] @ u) * u
        x[i + 1] = 0.9001 * u + np.sqrt(1 - 0.9001**2) * v / np.linalg.norm(v)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_vectors_hot_group_over_many_blocks(spark):
    """All pairs in blocks: no link is lost, links at the threshold included."""
    rows = hot_group()
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=60, exact=True).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute_vectors(rows, 0.9)


def test_graph_on_a_hot_group(spark):
    """The graph keeps a dense group together, and what it misses is what the audit says."""
    rows = hot_group()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_vectors(rows, 0.9)
    got = vectors.near_vectors(df, group=150, recall=0.9).collect()
    found = sorted(tuple(r[c] for c in COLUMNS) for r in got)
    assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))
    share = sum(a[1] for a in found) / sum(b[1] for b in want)
    own = np.mean([a[1] / b[1] for a, b in zip(found, want, strict=True) if b[1]])
    assert got[0].recall >= 0.9 and share >= 0.9 and own >= 0.88 and min(share, own) >= got[0].recall - 0.1


def test_audit_and_fallback(spark, monkeypatch):
    """A search that loses links is noticed, and all pairs are compared instead."""
    rows = hot_group()[:300]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lossy = vectors.graph_links
    monkeypatch.setattr(vectors, "TURNS", 1)
    monkeypatch.setattr(vectors, "graph_links", lambda *a: lossy(*a).filter("id % 3 = 0"))
    got = vectors.near_vectors(df).collect()
    assert got[0].recall == 1.0 and sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute_vectors(rows, 0.9)


def test_vectors_on_given_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = sorted(map(tuple, vectors.op7_embedding_near_dedup(spark, path).collect()))
    want = brute_vectors(rows, 0.9)
    assert sum(a[1] for a in got) >= 0.98 * sum(b[1] for b in want)


def test_flat_graph_recall():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 48))
    x[300:700] = x[3] + rng.normal(size=(400, 48)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = FlatGraph(x.astype(np.float32)).build()
    assert (graph.near >= 0).sum(1).max() <= graph.degree
    a, b = (np.concatenate(v) for v in zip(*graph.within(0.9), strict=True))
    a, b = np.unique(np.sort(np.stack((a, b)), axis=0), axis=1)
    s = np.einsum("ij,ij->i", x[a], x[b])
    true = int((np.triu(x @ x.T, 1) >= 0.9).sum())
    assert (s >= 0.9).sum() >= 0.98 * true
