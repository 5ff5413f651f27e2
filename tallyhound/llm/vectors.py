"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors form one class. Classes are dealt to the shards of their nearest centres, several each, so that shards overlap. Centres are a
bounded sample, thinned until no two of them could be linked: a dense group has one centre and stays together. Every shard builds a graph;
the adjacency lists of a vector from all its shards are united; shards then search for each of their vectors from the medoid and spread over
everything in range. What is found is verified in double precision, and a pair that several shards hold is counted in the first. Shards
return a count and a component per vector, never pairs.

An audit measures recall: links of sampled classes against all vectors. While it is below the target the search is run again, wider; if that
doesn't help either, all pairs are compared in blocks, which is exact and grows with the square of the classes.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import drop_shared, read, write_shared
from tallyhound.llm.flatgraph import FlatGraph
from tallyhound.llm.graph import components

#: Classes that a shard of the graph should hold (larger ones are split into blocks that meet pairwise), and centres at most.
GROUP, MAX_CENTRES = 3000, 4096
#: Classes whose true links the audit counts, at random and among those with links; turns of the search, each twice as wide.
AUDIT, TURNS = 200, 3
#: Shards that hold a vector, and rows that a search keeps in view, in the first turn.
OVERLAP, BEAM = 2, 8
#: Classes and components (of all its vectors) that a block should hold at most, and rows of a tile.
SHARD, VALUES, TILE = 4096, 1 << 19, 1024


def usable(embedding) -> F.Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda v: v != 0), F.lit(False))


def unit(rows) -> np.ndarray:
    """Unit vectors in double precision; the largest component is scaled out first, so that no square over- or underflows."""
    x = np.array([np.asarray(r, np.float64) for r in rows])
    if not len(x):
        return x.reshape(0, 1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pack(classes: DataFrame, shard: int) -> DataFrame:
    """``dim, block, size, ids, copies, x``: one row per block, its classes as packed numbers (vectors in single precision if that holds them)."""
    sizes = classes.groupBy(F.col("dim").alias("_dim")).agg(F.count("*").alias("_n"))
    rows = F.greatest(F.lit(1), F.least(F.lit(shard), F.floor(F.lit(VALUES) / F.col("dim"))))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / rows)).cast("int")
    dealt = classes.join(sizes, F.col("dim") == F.col("_dim")).select("dim", block.alias("block"), "id", "copies", "x")

    def run(g: pa.Table) -> pa.Table:
        x = g.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            single = x.astype(np.float32)
        data = (single if (single == x).all() else x).tobytes()
        numbers = [g.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "copies")]
        return pa.table({"dim": [g.column("dim")[0].as_py()], "block": [g.column("block")[0].as_py()], "size": [g.num_rows], "ids": [numbers[0]], "copies": [numbers[1]], "x": [data]}, schema)

    schema = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("size", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("x", pa.binary())])
    return dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block int, size int, ids binary, copies binary, x binary")


def linked(x: np.ndarray, y: np.ndarray | None, cosine: float):
    """Row numbers of ``x`` and of ``y`` with at least ``cosine``, tile by tile; without ``y`` pairs within ``x``, each once."""
    other = x if y is None else y
    x32, y32 = x.astype(np.float32), other.astype(np.float32)
    slack = np.float32(1.2e-7 * (x.shape[1] + 8))  # more than single precision can err by
    for i in range(0, len(x), TILE):
        for j in range(i if y is None else 0, len(other), TILE):
            sim = x32[i : i + TILE] @ y32[j : j + TILE].T
            at = np.flatnonzero(sim >= np.float32(cosine) - slack)
            a, b = at // sim.shape[1] + i, at % sim.shape[1] + j
            near = np.flatnonzero(sim.ravel()[at] < np.float32(cosine) + slack)
            keep = np.ones(len(at), bool)
            keep[near] = np.einsum("ij,ij->i", x[a[near]], other[b[near]]) >= cosine
            if y is None:
                keep &= a < b
            if keep.any():
                yield a[keep], b[keep]


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (least row of each row's component, so far) with the links ``a, b`` added."""
    while True:
        a, b = root[a], root[b]
        open_ = a != b
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def exact_links(classes: DataFrame, cosine: float, shard: int) -> DataFrame:
    """``id, n, root`` for every class and pair of blocks in which it has links: copies of the classes linked to it there, and the least id
    of its component there."""
    blocks = write_shared(pack(classes, shard), "vector-blocks")
    first, second = blocks.alias("p"), blocks.hint("shuffle_replicate_nl").alias("q")
    met = first.join(second, (F.col("p.dim") == F.col("q.dim")) & (F.col("p.block") <= F.col("q.block")))
    met = met.select(F.col("p.dim").alias("dim"), *(F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "pq" for c in ("block", "size", "ids", "copies", "x")))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}

                def part(t, row=row):
                    x = np.frombuffer(row[f"{t}_x"], np.float32 if len(row[f"{t}_x"]) == 4 * row["dim"] * row[f"{t}_size"] else np.float64)
                    return np.frombuffer(row[f"{t}_ids"], np.int64), np.frombuffer(row[f"{t}_copies"], np.int64), unit(x.reshape(-1, row["dim"]))

                ids, copies, x = part("p")
                y, shift = None, 0
                if row["p_block"] != row["q_block"]:
                    more, copies_too, y = part("q")
                    shift, ids, copies = len(ids), np.concatenate((ids, more)), np.concatenate((copies, copies_too))
                order = np.argsort(ids, kind="stable")
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for a, b in linked(x, y, cosine):
                    a, b = a, b + shift
                    n += np.bincount(a, copies[b], len(ids)).astype(np.int64) + np.bincount(b, copies[a], len(ids)).astype(np.int64)
                    root = merge(root, rank[a], rank[b])
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(n[has]), pa.array(ids[order][root[rank[has]]])], names=["id", "n", "root"])

    return met.mapInArrow(run, "id long, n long, root long")


def centres(classes: DataFrame, count: int, cosine: float) -> dict[int, np.ndarray]:
    """At most ``count`` vectors by dimension, those with the least hashes of their ids, without those within ``cosine`` of one before."""
    by: dict[int, list] = {}
    for r in classes.select("dim", "x").orderBy(F.xxhash64("id")).limit(count).collect():  # a bounded sample
        by.setdefault(r.dim, []).append(r.x)
    out = {}
    for d, rows in by.items():
        x = unit(rows)
        free, kept = np.ones(len(x), bool), []
        for i in range(len(x)):
            if free[i]:
                kept.append(i)
                free &= x @ x[i] < cosine
        out[d] = x[kept]
    return out


def deal(classes: DataFrame, overlap: int, cosine: float, shard: int, count: int) -> DataFrame:
    """``dim, shard, lo, hi, side, id, x, copies, shards``: every class in the shards of its ``overlap`` nearest centres, and in all pairs of
    their blocks that hold it."""
    spark = classes.sparkSession
    known = spark.sparkContext.broadcast(centres(classes, min(MAX_CENTRES, max(1, -(-count * overlap // shard))), cosine))

    def run(batches):
        for b in batches:
            dims, out = np.array(b.column("dim").to_pylist()), [None] * b.num_rows
            values = b.column("x").to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                c = known.value.get(int(d))
                top = np.zeros((len(at), 1), int)  # a length that the sample doesn't have: one shard
                if c is not None:
                    top = np.sort(np.argsort(-(unit([values[i] for i in at]) @ c.T), axis=1, kind="stable")[:, :overlap], axis=1)
                for i, row in zip(at, top.tolist(), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "shards"])

    dealt = classes.select("id", "copies", "dim", "x").mapInArrow(run, "id long, copies long, dim int, x array<double>, shards array<int>")
    dealt = dealt.select("*", F.explode("shards").alias("shard"))
    blocks = dealt.groupBy("dim", "shard").agg(F.ceil(F.count("*") / (2 * shard)).cast("int").alias("blocks"))
    at = dealt.join(blocks, ["dim", "shard"]).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    at = at.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return at.select("dim", "shard", F.least("side", "j").alias("lo"), F.greatest("side", "j").alias("hi"), "side", "id", "x", "copies", "shards")


def graph_links(classes: DataFrame, cosine: float, overlap: int, shard: int, degree: int, beam: int, count: int) -> DataFrame:
    """``id, n, root`` for every class and shard: copies of the classes found to be linked to it there, and the least id of its component there."""
    dealt = write_shared(deal(classes, overlap, cosine, shard, count), "vector-shards")
    group = ["dim", "shard", "lo", "hi"]

    def build(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        ids = g["id"].to_numpy()
        near = FlatGraph(unit(g["x"]).astype(np.float32), degree, beam).build().near
        return pd.DataFrame({"id": ids, "near": [ids[r[r >= 0]] for r in near]})

    lists = dealt.select(*group, "id", "x").groupBy(*group).applyInPandas(build, "id long, near array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # one list a shard that holds it

    def search(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        ids, copies, side, own = g["id"].to_numpy(), g["copies"].to_numpy(), g["side"].to_numpy(), int(g["shard"].iloc[0])
        cross = bool(g["lo"].iloc[0] != g["hi"].iloc[0])
        x = unit(g["x"])
        lists = [np.asarray(v, np.int64) if v is not None else np.zeros(0, np.int64) for v in g["near"]]
        local = [np.searchsorted(ids, v) for v in lists]
        local = [p[(p < len(ids)) & (ids[np.minimum(p, len(ids) - 1)] == v)] for p, v in zip(local, lists, strict=True)]
        graph = FlatGraph(x.astype(np.float32), max(1, max(map(len, local), default=1)), beam)
        for i, p in enumerate(local):
            graph.near[i, : len(p)] = p
        held = np.full((len(g), max(map(len, g["shards"]))), -1, np.int64)
        for i, s in enumerate(g["shards"]):
            held[i, : len(s)] = s
        n, root = np.zeros(len(g), np.int64), np.arange(len(g))
        for p, q in graph.within(cosine):
            for at in range(0, len(p), 50_000):
                a, b = p[at : at + 50_000], q[at : at + 50_000]
                both = np.where((held[a][:, :, None] == held[b][:, None, :]) & (held[a][:, :, None] >= 0), held[a][:, :, None], np.iinfo(np.int64).max)
                keep = (both.min((1, 2)) == own) & (np.einsum("ij,ij->i", x[a], x[b]) >= cosine) & ((side[a] != side[b]) | (not cross))
                n += np.bincount(a[keep], copies[b[keep]], len(g)).astype(np.int64)
                root = merge(root, a[keep], b[keep])
        has = np.flatnonzero(n)
        return pd.DataFrame({"id": ids[has], "n": n[has], "root": ids[root[has]]})

    found = write_shared(dealt.join(united, "id", "left").groupBy(*group).applyInPandas(search, "id long, n long, root long"), "vector-links")
    drop_shared(dealt)
    return found


def audit_recall(classes: DataFrame, counts: DataFrame, cosine: float, sample: int = AUDIT) -> float:
    """Links found over true links, of ``sample`` classes at random and as many that have links; they are compared with all vectors. The lower
    of the share of all their links and the mean of their own shares."""
    spark = classes.sparkSession
    by_hash = F.xxhash64("id", F.lit(1))
    chosen = {r.id: r for df in (classes, classes.join(counts.select("id"), "id", "left_semi")) for r in df.select("id", "dim", "x").orderBy(by_hash).limit(sample).collect()}
    by: dict[int, list] = {}
    for r in chosen.values():
        by.setdefault(r.dim, []).append(r)
    known = spark.sparkContext.broadcast({d: ([r.id for r in v], unit([r.x for r in v])) for d, v in by.items()})

    def run(batches):
        for b in batches:
            dims, copies, values = np.array(b.column("dim").to_pylist()), np.array(b.column("copies").to_pylist()), b.column("x").to_pylist()
            own = np.array(b.column("id").to_pylist())
            ids, n = [], []
            for d, (q, x) in known.value.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    hit = (x @ unit([values[i] for i in at]).T >= cosine) & (np.array(q)[:, None] != own[at])
                    ids += q
                    n += (hit * copies[at]).sum(1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["id", "true_n"])

    truth = classes.select("id", "copies", "dim", "x").mapInArrow(run, "id long, true_n long").groupBy("id").agg(F.sum("true_n").alias("true_n"))
    hit = F.least("true_n", F.coalesce("n", F.lit(0)))
    whole, mean = truth.filter("true_n > 0").join(counts, "id", "left").agg(F.try_divide(F.sum(hit), F.sum("true_n")), F.avg(hit / F.col("true_n"))).first()
    return 1.0 if whole is None else min(whole, mean)


def find_links(classes: DataFrame, cosine: float, shard: int, group: int, recall: float, exact: bool) -> tuple[DataFrame, float]:
    """``id, n, root`` rows and the measured recall: the graph's if that reaches ``recall``, else those of all pairs."""
    log, count = logging.getLogger(__name__), classes.count()
    for turn in range(0 if exact else TURNS):
        found = graph_links(classes, cosine, OVERLAP << turn, group, 24, BEAM << turn, count)
        measured = audit_recall(classes, found.groupBy("id").agg(F.sum("n").alias("n")), cosine)
        log.info("recall %.4f with overlap %d and beam %d", measured, OVERLAP << turn, BEAM << turn)
        if measured >= recall:
            return found, measured
        drop_shared(found)
    return write_shared(exact_links(classes, cosine, shard), "vector-links"), 1.0


def near_vectors(vectors: DataFrame, cosine: float = 0.9, shard: int = SHARD, group: int = GROUP, recall: float = 0.98, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall`` for every row of ``vectors`` (``vec_id, embedding``).

    Vectors are linked by a cosine of at least ``cosine``. The graph search may miss links but adds none below it; ``recall`` in the result is
    what the audit measured, the parameter is the least that is taken from the graph. With ``exact``, or if the graph doesn't reach it, all
    pairs are compared, in blocks of at most about ``shard`` vectors, and ``recall`` is 1. Null, zero and non-finite vectors, and vectors of
    other lengths, aren't linked; a null vec_id has no links and isn't kept. Equal vectors are linked, each row counting as one. Other
    columns are ignored. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    good = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("x")))
    classes = good.groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = write_shared(classes.select("id", "copies", F.size("x").alias("dim"), "x"), "vector-classes")
    found, measured = find_links(classes, cosine, shard, group, recall, exact)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.select("x", "id", "copies").join(counts, "id", "left").join(labels, "id", "left")
    known = known.select("x", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    able = F.col("vec_id").isNotNull() & usable(F.col("x"))
    out = rows.withColumn("x", F.when(able, F.col("x"))).join(known, "x", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(float(measured)).alias("recall"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
