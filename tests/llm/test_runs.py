"""Periodic runs against a plain search over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhound.llm import runs


def plain_runs(words, length=24, exponent=3):
    """For each period from the smallest, stretches that agree with themselves a period before; a stretch counts for its smallest period."""
    out = {}
    w = np.array(words)
    for q in range(1, len(words) // exponent + 1):
        same = np.concatenate(([False], w[q:] == w[:-q], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            n = b - a + q
            if n >= max(length, exponent * q):
                out.setdefault((a, n), q)
    return sorted((a, n, q) for (a, n), q in out.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_collapsed(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def cases(rng):
    yield [0] * 500
    yield [0, 1] * 60
    yield ([0, 1, 2, 3, 4] * 9 + [7] + [0, 1, 2, 3, 4] * 9) * 4  # runs in runs
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    yield b  # Fibonacci word
    yield [bin(i).count("1") % 2 for i in range(1024)]  # no cubes
    yield [x for i in range(150) for x in [1000 + i, *range(16)]]  # the same line after ever other words
    yield [x for i in range(150) for x in [*range(16), 1000 + i]]
    yield [0] * 23
    yield [0] * 24
    for _ in range(120):
        n, letters = int(rng.integers(1, 400)), int(rng.integers(1, 4))
        w = rng.integers(0, letters, n).tolist()
        for _ in range(int(rng.integers(0, 5))):
            at, q, k = int(rng.integers(0, n)), int(rng.integers(1, 20)), int(rng.integers(2, 8))
            unit = rng.integers(0, 6, q).tolist()
            w[at:at] = (unit * (k + 1))[: q * k + int(rng.integers(0, q))]
        yield w


def test_runs_against_all_periods():
    rng, met = np.random.default_rng(3), 0
    for w in cases(rng):
        want = plain_runs(w)
        assert runs.runs_of(np.array(w)) == want, w
        met += len(want)
        assert runs.runs_of(np.array(w), 6, 4) == plain_runs(w, 6, 4)
        assert runs.repeating([np.array(w), np.array([10**6])], 16) == ([0] if any(w[i : i + 16] == w[j : j + 16] for i in range(len(w) - 15) for j in range(i)) else [])
    assert met > 150


def test_no_steps_by_pairs():
    """Many places of one passage, and one word all along: work stays near linear (both end in seconds, or never)."""
    n = 60_000
    assert runs.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    lines = np.array([x for i in range(8000) for x in [100 + i, *range(20)]])
    assert runs.runs_of(lines) == []


def test_operator_rows(spark):
    line = "a b c d e f g h "
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, line * 3, 0), (4, line * 3, 0), (5, line * 3 + "z", 1), (None, "  x\x1cy " * 12, 2), (6, "é ü " * 20 + "end", 3), (7, line + line, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("_text", F.lit("other")).withColumn("n_words", F.lit(9))
    got = runs.periodic_runs(df)
    assert got.columns == ["doc_id", "_text", "n_words", "runs", "collapsed"]
    for r, (doc, text, _) in zip(sorted(got.collect(), key=lambda r: (r.doc_id or 0, r.n_words)), sorted(rows, key=lambda r: (r[0] or 0, len(words_of(r[1])))), strict=True):
        w = words_of(text)
        want = plain_runs(w)
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (doc, len(w), want, plain_collapsed(w, want))
    assert runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="exponent"):
        runs.periodic_runs(df, exponent=2)


def test_long_text(spark):
    """Several MB in one text, half of it periodic."""
    rng = np.random.default_rng(5)
    head = [f"w{x}" for x in rng.integers(0, 5000, 300_000)]
    text = " ".join(head + head[:40_000] * 8)
    got = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(text) > 3_000_000 and [tuple(x) for x in got[0].runs] == [(300_000, 320_000, 40_000)] and got[0].collapsed == " ".join(head + head[:40_000])


def expected(doc, text):
    w = words_of(text)
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(plain_collapsed(w, found)))


def test_query_on_given_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = runs.op13_periodic_runs(spark, path).drop("n_words").collect()
    assert sorted(map(tuple, got)) == sorted(expected(*r) for r in docs) and sum(r.n_runs for r in got) > 10
