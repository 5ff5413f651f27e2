"""MinHash near-dedup by a multi-index Hamming join.

1. A document is its set of word shingles. Equal sets form one class; a class goes on with its smallest doc_id.
2. A class has a signature of ``SLOTS`` MinHash values of 16 bits, split into ``CHUNKS`` chunks. Two signatures that differ in at most
   ``DISTANCE = 2 * CHUNKS - 1`` slots agree, by pigeonhole, in all but one slot of some chunk. So every chunk is indexed once for each slot
   that may be wrong, under the values of the others: all pairs within that distance meet under a key. The same distance is the limit for
   pairs to be confirmed. Slots of a pair of similarity s differ with probability 1 - s each, so a pair exactly at 0.85 is beyond 31 of 80
   with probability 5e-8, one exactly at 0.8 with 3e-5, and more similar ones with less.
3. Groups of copies are not expanded into pairs. Members of a key are first confirmed against the key's largest component so far (a star).
   Then only pairs between different components remain; tasks that hold blocks of a key's members confirm all of those that sizes and
   signatures allow, skip pairs that earlier links have joined, and return the links that join components.
4. A link is confirmed on the full shingle sets, which travel only for documents that have a possible partner.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhound.llm.common import cores, drop_shared, free, map_texts, read, settled, text_slices, write_shared
from tallyhound.llm.graph import components
from tallyhound.llm.words import mix64, ngram_hashes, words_of

#: Signature: slots in all, chunks, slots of a chunk.
SLOTS, CHUNKS, WIDTH = 80, 16, 5
#: Slots in which signatures may differ: all pairs within it meet under a key, and only those are confirmed.
DISTANCE = 2 * CHUNKS - 1
#: Members of a key, and bytes of their shingles, that one block holds, about.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
#: Bytes of shingle sets that one confirming task holds, about.
TILE_BYTES = 16 << 20
#: Ids up to this count are broadcast to a scan; more are joined.
BROADCAST_IDS = 500_000

_SEEDS = mix64(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD, _ADD = _SEEDS[:SLOTS] | np.uint64(1), _SEEDS[SLOTS:]


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts in a row, and where each text's begin (one more entry than texts).

    A-Z is lower-cased; a text with fewer words is one shingle; a text without words has none.
    """
    w = words_of([t.encode().lower() for t in texts])
    grams = ngram_hashes(w.hash, words)
    out, at = [], [0]
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        own = np.unique(grams[a : b - words + 1]) if b - a >= words else ngram_hashes(w.hash[a:b], int(b - a)) + np.uint64(b - a) if b > a else grams[:0]
        out.append(own)
        at.append(at[-1] + len(own))
    return np.concatenate(out) if out else grams[:0], np.array(at)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16-bit MinHash values, a row for each non-empty set."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), SLOTS), np.uint16)
    if len(starts):
        for k in range(SLOTS):
            out[:, k] = mix64(np.minimum.reduceat((sets + _ADD[k]) * _ODD[k], starts)).astype(np.uint16)
    return out


def fingerprints(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two numbers: sums over its shingles."""
    sums = np.concatenate((np.zeros((1, 2), np.uint64), np.cumsum(np.stack((mix64(sets ^ np.uint64(0xA5A5)), mix64(sets ^ np.uint64(0x5A5A5A))), 1), axis=0, dtype=np.uint64)))
    return sums[at[1:]] - sums[at[:-1]]


def features(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, fp`` (128 bits of the set) ``, sig`` for every row; ``fp`` and ``sig`` are null for empty sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sets, at = shingle_sets(texts, words)
            size = np.diff(at)
            sig = signatures(sets, at)
            fp = fingerprints(sets, at)
            rank = np.cumsum(size > 0) - 1
            rows = [(fp[i].tobytes(), sig[rank[i]].tobytes()) if size[i] else (None, None) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], names=["doc_id", "n_shingles", "fp", "sig"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, fp binary, sig binary")


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows): for each chunk and each slot that may be wrong, the chunk, that slot and the values of the others."""
    parts = sig[:, : CHUNKS * WIDTH].reshape(len(sig), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
    for wrong in range(WIDTH):
        value = np.zeros((len(sig), CHUNKS), np.uint64)
        for s in range(WIDTH):
            if s != wrong:
                value = (value << np.uint64(16)) | parts[:, :, s]
        out[:, :, wrong] = mix64(value + mix64(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(wrong + 1)))
    return out.reshape(len(sig), CHUNKS * WIDTH).view(np.int64)


def key_rows(reps: DataFrame) -> DataFrame:
    """``id, n, key, nth`` (``n`` shingles) for every key of every signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = chunk_keys(matrix(b.column("sig")))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))], names=["id", "n", "keys"])

    return reps.select("id", F.col("n_shingles").alias("n"), "sig").mapInArrow(settled(run), "id long, n long, keys array<long>").select("id", "n", F.posexplode("keys").alias("nth", "key"))


def matrix(column: Iterable) -> np.ndarray:
    raw = column.to_pylist() if hasattr(column, "to_pylist") else column
    return np.frombuffer(b"".join(map(bytes, raw)), np.uint16).reshape(-1, SLOTS)


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, fp, set`` of the documents in ``ids``, once for equal rows; the scan is filtered by a broadcast where there are few ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sets, at = shingle_sets(texts, words)
            raw = [sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in fingerprints(sets, at)], pa.binary()), pa.array(raw, pa.binary())], names=["id", "fp", "set"])

    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")
    return map_texts(found, run, "id long, fp binary, set binary").dropDuplicates(["id", "fp"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, tiles: int) -> DataFrame:
    """The pairs ``a, b`` with ``100 * |A & B| >= percent * |A | B|``.

    Pairs are dealt over a square of ``tiles`` by the hashes of both ends. A tile gets each set that its pairs need once, and holds about
    ``TILE_BYTES``: memory doesn't depend on how often a document occurs in pairs.
    """
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles))
    dealt = write_shared(pairs.select("a", "b", tile("a").alias("ta"), tile("b").alias("tb")), "pairs")
    needed = dealt.select(F.col("ta").alias("ua"), F.col("tb").alias("ub"), F.explode(F.array("a", "b")).alias("id")).distinct()
    held = needed.join(sets, "id")

    def run(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        of: dict[int, list[np.ndarray]] = {}
        for i, x in zip(s["id"], s["set"], strict=True):
            of.setdefault(i, []).append(np.frombuffer(x, np.uint64))
        keep = []
        for a, b in zip(p["a"], p["b"], strict=True):
            keep.append(any(near(x, y, percent) for x in of.get(a, ()) for y in of.get(b, ())))
        return p.loc[keep, ["a", "b"]] if keep else p[["a", "b"]]

    return dealt.groupBy("ta", "tb").cogroup(held.groupBy("ua", "ub")).applyInPandas(run, "a long, b long")


def near(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def joined(links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links, and the components that they make."""
    both = write_shared(links.unionByName(found), "links")
    drop_shared(links, found)
    return both, components(both)


def star_pairs(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """For every component that shares a key with a larger one: one pair ``a, b`` of members of both.

    ``members`` are ``key, id``. The pair chosen is one that shares the most keys.
    """
    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of = named.groupBy("key", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id")).alias("m")).withColumn("m", F.col("m.id"))
    hubs = of.groupBy("key").agg(F.max(F.struct("n", (-F.col("component")).alias("minus"), "m")).alias("hub"))
    pairs = of.join(hubs, "key").filter("component <> -hub.minus").select("component", (-F.col("hub.minus")).alias("to"), F.col("m").alias("a"), F.col("hub.m").alias("b"))
    counted = pairs.groupBy("component", "to", "a", "b").agg(F.count("*").alias("n"))
    # a component's nearest hub only: the others stay for later turns and for the rest
    best = counted.groupBy("component").agg(F.max(F.struct("n", (-F.col("to")).alias("to"), "a", "b")).alias("p"))
    return best.select("p.a", "p.b")


def cells(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, nth, id, n, component, own, lo, hi`` of the members of keys that hold several components, dealt to cells of bounded size.

    The members of a key's largest component are linked already, so they need not meet each other: only the others (the fringe) meet among
    themselves and with them. Both are dealt to blocks of about ``BLOCK`` members and ``BLOCK_BYTES`` of shingles, by hash. In a cell with
    ``lo = hi`` all members meet; in others those of block ``lo`` meet those of block ``hi``. A key that fits one block is one cell.
    """
    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    blocks = lambda m, n: F.ceil(F.greatest(m / BLOCK, n * 8 / BLOCK_BYTES)).cast("int")
    keys = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.max(F.struct("m", (-F.col("component")).alias("minus"), "n")).alias("hub")).filter("parts > 1")
    alone = blocks(F.col("m"), F.col("n")) == 1
    fringe = F.greatest(F.lit(1), blocks(F.col("m") - F.col("hub.m"), F.col("n") - F.col("hub.n")))
    keys = keys.select("key", (-F.col("hub.minus")).alias("hub"), alone.alias("alone"), fringe.alias("fringe"), F.greatest(F.lit(1), blocks(F.col("hub.m"), F.col("hub.n"))).alias("rest"))
    at = named.join(keys, "key").withColumn("h", F.xxhash64("id", "key"))
    linked = F.col("component") == F.col("hub")
    own = F.when(F.col("alone"), 0).when(linked, F.col("fringe") + F.pmod("h", F.col("rest"))).otherwise(F.pmod("h", F.col("fringe"))).cast("int")
    most = F.when(F.col("alone"), 0).when(linked, F.col("fringe") - 1).otherwise(F.col("fringe") + F.col("rest") - 1).cast("int")
    at = at.select("key", "nth", "id", "n", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), most)).alias("other"))
    return at.select("key", "nth", "id", "n", "component", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


CELL = "key long, nth int, id long, n long, component long, own int, lo int, hi int, fp binary, sig binary"


def first_key(wrong: np.ndarray) -> np.ndarray:
    """For pairs (rows of differing slots): the number of the first key that they share, so that a pair is looked at under that key only."""
    wrong = wrong.reshape(-1, CHUNKS, WIDTH)
    first = np.argmax(wrong.sum(2) <= 1, axis=1)
    return first * WIDTH + np.argmax(wrong[np.arange(len(wrong)), first], axis=1)  # slot 0 where there is no error


def runs_of(g: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Where the cells of a sorted task begin and end."""
    edge = np.ones(len(g) + 1, bool)
    if len(g):
        edge[1:-1] = np.any([g[c].to_numpy()[1:] != g[c].to_numpy()[:-1] for c in ("key", "lo", "hi")], axis=0)
    at = np.flatnonzero(edge)
    return zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


class Cell:
    """The members of one cell, and which of them may be linked as far as sizes and signatures tell."""

    def __init__(self, g: pd.DataFrame, percent: int) -> None:
        self.id, self.n, self.component, self.own, self.nth = (g[c].to_numpy() for c in ("id", "n", "component", "own", "nth"))
        self.sig, self.percent, self.within = matrix(g["sig"]), percent, g["lo"].iloc[0] == g["hi"].iloc[0]

    def partners(self, i: int, component: np.ndarray) -> np.ndarray:
        """Members after ``i`` of other components that it may be linked with."""
        j = np.arange(i + 1, len(self.id))
        fine = (component[j] != component[i]) & (100 * np.minimum(self.n[j], self.n[i]) >= self.percent * np.maximum(self.n[j], self.n[i]))
        if not self.within:
            fine &= self.own[j] != self.own[i]
        j = j[fine]
        if len(j):
            wrong = self.sig[j] != self.sig[i]
            near = np.count_nonzero(wrong, axis=1) <= DISTANCE
            j = j[near][first_key(wrong[near]) == self.nth[i]]
        return j


def possible(percent: int):
    """Task: the members of cells that have a partner they may be linked with. At most the rows that came."""
    columns = [x.split()[0] for x in CELL.split(", ")]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["key", "lo", "hi", "id"], kind="stable")
        keep = np.zeros(len(g), bool)
        for a, b in runs_of(g):
            cell = Cell(g.iloc[a:b], percent)
            for i in range(b - a - 1):
                if len(j := cell.partners(i, cell.component)):
                    keep[a + i] = True
                    keep[a + j] = True
        return g.loc[keep, columns]

    return run


def tree(percent: int):
    """Task: links ``a, b`` confirmed on full sets that join the components of a cell, at most one less than its members.

    Members of components that have been joined meanwhile don't meet any more: a further link between them changes nothing.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["key", "lo", "hi", "id"], kind="stable")
        left, right = [], []
        for a, b in runs_of(g):
            part = g.iloc[a:b]
            cell, component = Cell(part, percent), part["component"].to_numpy().copy()
            sizes = np.fromiter((len(x) // 8 for x in part["set"]), np.int64, b - a)
            at = np.concatenate(([0], np.cumsum(sizes)))
            known, shingle = np.unique(np.frombuffer(b"".join(map(bytes, part["set"])), np.uint64), return_inverse=True)
            mark = np.zeros(len(known), bool)
            for i in range(b - a - 1):
                j = cell.partners(i, component)
                if not len(j):
                    continue
                own = shingle[at[i] : at[i + 1]]
                mark[own] = True
                while len(j):
                    now, j = j[:64], j[64:]
                    common = np.fromiter((np.count_nonzero(mark[shingle[at[x] : at[x + 1]]]) for x in now), np.int64, len(now))
                    for x in now[100 * common >= percent * (sizes[i] + sizes[now] - common)]:
                        if component[x] != component[i]:
                            left.append(cell.id[i])
                            right.append(cell.id[x])
                            component[component == component[x]] = component[i]
                    j = j[component[j] != component[i]]
                mark[own] = False
        return pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})

    return run


def rest_links(members: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between different components: enough of them to join all that any link between documents under one key joins.

    Signatures tell which members have a possible partner; only those meet again with their full sets, in cells, and a cell returns the
    links of a spanning forest. Rows grow with the members of keys, never with their pairs.
    """
    spark = members.sparkSession

    def by_task(rows: DataFrame, stored: DataFrame, size) -> DataFrame:
        """Cells dealt to tasks of about ``TILE_BYTES``, a fixed number: adaptive execution would merge tasks that are small but busy."""
        volume = stored.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        tasks = max(4 * cores(spark), int(volume) // TILE_BYTES + 1)
        return rows.withColumn("task", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(tasks))).repartition(tasks, "task").groupBy("task")

    dealt = write_shared(cells(members, labels), "cells")
    met = dealt.join(reps.select("id", F.col("n_shingles").alias("n"), "fp", "sig"), ["id", "n"])
    met = met.select("key", "nth", "id", "n", "component", "own", "lo", "hi", "fp", "sig")
    able = write_shared(by_task(met, dealt, F.lit(2 * SLOTS + 80)).applyInPandas(possible(percent), CELL), "able")
    found = by_task(able.join(sets, ["id", "fp"]), able, 2 * SLOTS + 80 + 8 * F.col("n")).applyInPandas(tree(percent), "a long, b long")
    found = write_shared(found, "links")
    drop_shared(dealt, able)
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, turns: int = 1) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class_id`` for every row of ``docs``.

    Documents are linked if the Jaccard similarity of their sets of ``words``-word shingles is at least ``percent`` / 100. ``component_id``
    is the smallest doc_id reachable over links, ``kept`` tells whether it is the row's own, ``class_id`` the smallest doc_id with an equal
    set. Null, empty and blank texts have no shingles and no links. Rows without doc_id come back without component and aren't kept.
    Repeated rows are in the same component; other columns don't matter; an empty table gives no rows.
    """
    seen = write_shared(features(docs, words), "features")
    reps = write_shared(seen.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp", "n_shingles", "sig").agg(F.min("doc_id").alias("id")), "classes")
    keys = key_rows(reps)
    shared = keys.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    members = write_shared(keys.join(shared, "key").select("key", "nth", "id", "n"), "members")
    involved = write_shared(members.select("id").distinct(), "involved")
    sets = write_shared(sets_of(docs, involved, words), "sets")
    volume = sets.agg(F.coalesce(F.sum(F.length("set")), F.lit(0))).first()[0]
    tiles = max(math.isqrt(2 * cores(docs.sparkSession)) + 1, volume // TILE_BYTES + 1)
    links = write_shared(docs.sparkSession.createDataFrame([], "a long, b long"), "links")
    labels = components(links)
    for turn in range(turns):
        found = write_shared(confirm(star_pairs(members, labels, turn), sets, percent, tiles), "links")
        drop_shared(labels)
        links, labels = joined(links, found)
    before = labels
    links, labels = joined(links, rest_links(members, labels, reps, sets, percent))
    drop_shared(before, links, sets, members, involved)
    named = reps.select("fp", F.col("id").alias("class_id")).join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select("fp", "class_id", F.coalesce("component", "class_id").alias("component"))
    linked = F.col("doc_id").isNotNull() & F.col("n_shingles").cast("boolean")
    out = seen.select("doc_id", "n_shingles", F.when(linked, F.col("fp")).alias("fp")).join(named, "fp", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; rows without shingles or doc_id stay.

    Of a group the smallest doc_id stays, and one row of it where it is repeated. All columns are kept, whatever their names."""
    found = write_shared(near_duplicates(docs, words, percent), "near-duplicates")
    name = free("id", docs.columns)
    gone = found.filter("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias(name)).distinct()
    few = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(name), "left_anti")
    again = found.filter("kept AND n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(name))
    if again.isEmpty():
        return left
    once = left.join(again, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, F.col("doc_id") == F.col(name), "left_anti").unionByName(once)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)
