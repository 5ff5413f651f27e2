"""Periodic runs of words: stretches that repeat a shorter sequence of words several times over.

A run of period q that starts at i is the maximal pair (i, i + q): the words from both places agree up to the run's end and differ after it, and
the words before both places differ. So runs are read off the maximal pairs of a text. Its suffixes are sorted, the intervals of their common
prefixes are walked bottom up, and the occurrences that meet in an interval are paired where their left words are of different classes. Only
pairs at most as far apart as ``depth / (exponent - 1)`` are looked for; occurrences that near lie at equal distances, and all but the first
of them have the same left word, so that one class covers a window up to its end and the window's ends alone can give a pair. A pair needs
no extension: its distance and depth are the run's period and length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyhound.llm.common import free, map_texts, read, text_slices
from tallyhound.llm.words import mix64, ngram_hashes

#: A run is at least so many words long, and at least so many times its period.
LENGTH, EXPONENT = 24, 3
RUN = StructType([StructField(x, LongType()) for x in ("start", "length", "period")])


def repeating(words: list[np.ndarray], depth: int) -> list[int]:
    """Which of the word sequences hold the same ``depth`` words at two places (by hash: perhaps one more, never one less)."""
    sizes = np.array([len(w) for w in words])
    which = np.repeat(np.arange(len(words)), sizes)
    grams = ngram_hashes(mix64(np.concatenate(words).astype(np.uint64) + np.uint64(1)), depth)
    last = which[depth - 1 :][: len(grams)]
    whole = which[: len(grams)] == last
    at = last[whole]
    key = grams[whole] ^ mix64(at.astype(np.uint64))
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    return np.unique(at[order[same]]).tolist()


def suffixes(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose first ``depth`` words stand at another place too, in the order of their suffixes, and the words that each has in common
    with the one before (0 for the first). By prefix doubling; a place whose words so far are unique isn't sorted again."""
    n = len(words)
    _, rank, sizes = np.unique(words, return_inverse=True, return_counts=True)
    active = np.flatnonzero(sizes[rank] > 1)
    rank = (np.cumsum(sizes) - sizes)[rank]  # the place of the group's first in the order
    levels, width, chosen = [rank.astype(np.int32)], 1, None
    while len(active):
        if chosen is None and 2 * width > depth:
            chosen = active  # alike in over half of depth; pairs alike in fewer than depth fall out by their common prefixes
        nxt = active + width
        key = rank[active] * (n + 2) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, at, 0))
        fresh = np.diff(key, prepend=-1) != 0
        part = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[active] = old + part - group
        width *= 2
        levels.append(rank.astype(np.int32))
        alone = fresh & np.append(fresh[1:], True)
        active = active[~alone]
    if chosen is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = chosen[np.argsort(rank[chosen])]
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(len(order) - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = (a < n) & (b < n)
        same = fits & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = np.where(same, 1 << k, 0)
        a, b, common = a + step, b + step, common + step
    return order, np.concatenate(([0], common))


def maximal_pairs(order: list[int], common: list[int], left: list[int], least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """``first, second, depth`` of every maximal pair with ``depth >= least`` and ``depth >= (exponent - 1) * (second - first)``.

    The intervals are closed bottom up. Each keeps its places in order, their left words beside it in ``left``; the smaller of two
    neighbours is put into the larger."""
    found: list[tuple[int, int, int]] = []

    def meet(one: list[int], two: list[int], depth: int) -> list[int]:
        if len(one) < len(two):
            one, two = two, one
        reach = depth // (exponent - 1)
        for x in two:
            k = bisect_left(one, x - reach)
            if k < len(one) and one[k] < x and left[one[k]] != left[x]:
                found.append((one[k], x, depth))
            k = bisect_right(one, x + reach) - 1
            if k >= 0 and one[k] > x and left[one[k]] != left[x]:
                found.append((x, one[k], depth))
        for x in two:
            if x > one[-1]:
                one.append(x)
            else:
                insort(one, x)
        return one

    open_: list[tuple[int, list[int]]] = []
    for place, depth in zip(order, [*common[1:], 0], strict=True):
        part = [place]
        while open_ and open_[-1][0] > depth:
            below, places = open_.pop()
            part = meet(places, part, below)
        if depth < least:
            open_.clear()
        elif open_ and open_[-1][0] == depth:
            open_[-1] = (depth, meet(open_[-1][1], part, depth))
        else:
            open_.append((depth, part))
        yield from found
        found.clear()


def runs_of(words: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run of the numbered words, by start, then period."""
    least = -(-length * (exponent - 1) // exponent)  # depth of the shortest run: at least this share lies after the first period
    order, common = suffixes(words, least)
    if not len(order):
        return []
    left = [-1, *words[:-1].tolist()]
    best: dict[tuple[int, int], int] = {}  # a stretch's smallest period; its multiples give pairs too
    for a, b, depth in maximal_pairs(order.tolist(), common.tolist(), left, least, exponent):
        q = b - a
        if q + depth >= length:
            best[a, q + depth] = min(q, best.get((a, q + depth), q))
    return sorted((a, n, q) for (a, n), q in best.items())


def outside(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, size, q in runs:
        depth[start + q] += 1
        depth[start + size] -= 1
    return np.cumsum(depth[:-1]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """All columns of ``docs`` but ``text``; then ``n_words``, ``runs`` (array of start, length and period, in words from 0, by start, then
    period) and ``collapsed``: the words that no run repeats, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch whose words equal those a period before, with the smallest such period, of at least
    ``length`` words and ``exponent`` (3 or more) periods, that neither neighbour extends. A word is left out of ``collapsed`` if a run holds
    it after that run's first period. Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are handled one by one, so
    repeated rows stay; an empty table gives no rows; a column that is named like one of the three is replaced. Texts are taken whole; a
    text's task needs about 100 bytes a word, and four more for each doubling of its longest repeated passage.
    """
    if exponent < 3:
        raise ValueError("exponent must be 3 or more")
    new = {"n_words", "runs", "collapsed"}
    kept = [c for c in docs.columns if c.lower() not in new | {text.lower()}]
    body = free("text", kept)
    least = -(-length * (exponent - 1) // exponent)
    item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, body):
            split = [t.encode().split() for t in texts]  # at ASCII white space
            number = defaultdict(count().__next__)
            words = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in split]
            found: list[list] = [[] for _ in texts]
            collapsed = [None] * len(texts)
            for i in repeating(words, least):
                found[i] = runs_of(words[i], length, exponent)
                if found[i]:
                    collapsed[i] = b" ".join([split[i][k] for k in np.flatnonzero(outside(len(split[i]), found[i]))]).decode()
            for i, w in enumerate(split):
                if collapsed[i] is None:
                    collapsed[i] = b" ".join(w).decode()
            rows = [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in found]
            own = [part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(w) for w in split], pa.int64()), pa.array(rows, item), pa.array(collapsed, pa.string())], names=[*kept, "n_words", "runs", "collapsed"])

    schema = StructType([*docs.select(*kept).schema.fields, StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    return map_texts(docs.select(*kept, F.col(text).cast("string").alias(body)), run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which every tenth document by the crc32 of its id becomes periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = F.pmod(g, n.cast("long")).cast("int")
    rows = rows.withColumn("a", F.when(n > 0, a))
    p = (F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    rows = rows.withColumn("p", p)
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(i >= F.col("a"), F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).otherwise(i)))
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(again, " ")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read(spark, sf_dir, "documents")))
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
