"""Exact top-k search by inner product: MaxScore over postings of integer components.

A dimension is a term, and a vector's component in it the weight of its posting there. Vectors are dealt to shards of their nearest centres, so
that what a term can add within a shard is bounded closely; a shard holds a list of postings for each term. The terms of a query are split by
those bounds: the smallest, as long as together they can't reach the query's k-th best score so far, are non-essential. The lists of
the essential terms are traversed; vectors that may still be among the best k are probed for the other terms, the largest bound first, and
leave as soon as they can't. A shard gives its best k of each query, and the shards' results are merged.

A query's first bar is its k-th best score in a bounded sample of the vectors: a bound from below that is always right, so that it saves work and
decides nothing. Queries meet all shards, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhound.llm.common import drop_shared, map_texts, read, write_shared

#: Vectors of a shard and queries of a block at most, and components of either, about.
SHARD, BLOCK, VALUES = 4096, 512, 1 << 19
#: Vectors that set the queries' first bars; the first of them are the centres of the shards, one for so many vectors as a shard holds.
SAMPLE = 2048
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
PACKED = "part int, row binary, id binary, bar binary, width int, x binary"
HITS = "query_row long, query_id long, row long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * component) of each component as long, those beyond a long at its ends."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * scale))


def dense(lists: list[np.ndarray], width: int) -> np.ndarray:
    """The lists as rows of ``width`` numbers; what a list lacks is 0."""
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def fits(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sums of products of the columns of both stay within a long."""
    largest = lambda a: [max(abs(int(c.max())), abs(int(c.min()))) for c in a.T]
    return sum(a * b for a, b in zip(largest(x), largest(y), strict=True)) <= _MOST if len(x) and len(y) else True


class Postings:
    """Vectors by term: for every term the places that have it and their weights, and the range of the weights over all places."""

    def __init__(self, x: np.ndarray):
        self.places = len(x)
        self.at = [np.flatnonzero(c) for c in x.T]
        self.weight = [np.ascontiguousarray(c[at]) for c, at in zip(x.T, self.at, strict=True)]
        self.most, self.least = x.max(0), x.min(0)

    def of(self, term: int, places: np.ndarray) -> np.ndarray:
        at, weight = self.at[term], self.weight[term]
        if len(at) == self.places:
            return weight[places]
        k = np.searchsorted(at, places)
        k[k == len(at)] = 0
        return np.where(at[k] == places, weight[k], 0) if len(at) else np.zeros(len(places), np.int64)

    def reach(self, query: np.ndarray, bar) -> tuple[np.ndarray, np.ndarray]:
        """Places that score at least ``bar``, and their scores."""
        bound = np.maximum(query * self.most, query * self.least)
        order = np.argsort(bound, kind="stable")
        total = np.cumsum(bound[order])
        below = np.flatnonzero(total < bar)
        alone = int(below[-1]) + 1 if len(below) else 0  # the bounds of so many terms sum up to less than the bar
        if alone == len(order) and len(order):
            return np.zeros(0, np.int64), np.zeros(0, query.dtype)
        score = np.zeros(self.places, query.dtype)
        for t in order[alone:]:
            if query[t]:
                if len(self.at[t]) == self.places:
                    score += query[t] * self.weight[t]
                else:
                    score[self.at[t]] += query[t] * self.weight[t]
        rest = total[alone - 1] if alone else 0
        held = np.flatnonzero(score + rest >= bar)
        score = score[held]
        for t in order[:alone][::-1]:
            if not len(held):
                break
            rest -= bound[t]
            score = score + query[t] * self.of(t, held)
            keep = score + rest >= bar
            held, score = held[keep], score[keep]
        return held, score


def first_bars(x: np.ndarray, rows: np.ndarray, sample: np.ndarray, sampled: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of every query in the sample without its own row; the least long where the sample has fewer."""
    width = min(x.shape[1], sample.shape[1])
    a, b = x[:, :width], sample[:, :width]
    out = np.full(len(x), _LEAST)
    if len(sample) > k and fits(a, b):
        for i in range(len(x)):
            out[i] = np.sort((b @ a[i])[sampled != rows[i]])[-k]
    return out


def packed(rows: DataFrame, sample: list, k: int | None) -> DataFrame:
    """One row for each ``part``: its rows, ids, first bars (with ``k``) and vectors as bytes."""
    known = rows.sparkSession.sparkContext.broadcast((np.array([r.row for r in sample], np.int64), [np.array(r.x, np.int64) for r in sample]) if k else None)

    def run(g: pa.Table) -> pa.Table:
        lists = [np.array(v, np.int64) for v in g.column("x").to_pylist()]
        x = dense(lists, max(map(len, lists)))
        row, ids = (g.column(c).to_numpy().astype(np.int64) for c in ("row", "vec_id"))
        bars = b""
        if k:
            sampled, vectors = known.value
            bars = first_bars(x, row, dense(vectors, max(map(len, vectors), default=0)), sampled, k).tobytes()
        return pa.table({"part": [g.column("part")[0].as_py()], "row": [row.tobytes()], "id": [ids.tobytes()], "bar": [bars], "width": [x.shape[1]], "x": [x.tobytes()]}, schema)

    schema = pa.schema([("part", pa.int32()), ("row", pa.binary()), ("id", pa.binary()), ("bar", pa.binary()), ("width", pa.int32()), ("x", pa.binary())])
    return rows.select("part", "row", "vec_id", "x").groupBy("part").applyInArrow(run, PACKED)


def dealt(vectors: DataFrame, count: int, sample: list, most: int) -> DataFrame:
    """``vectors`` with ``part``: shards of at most about ``most``, each of one nearest centre."""
    spark = vectors.sparkSession
    known = spark.sparkContext.broadcast([np.array(r.x, np.float64) for r in sample[: max(1, count // most)]] or [np.zeros(0)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(map(len, known.value))
        c = np.zeros((len(known.value), width))
        for i, v in enumerate(known.value):
            c[i, : len(v)] = v
        half = (c * c).sum(1) / 2
        for b in batches:
            x = np.zeros((b.num_rows, width))
            for i, v in enumerate(b.column("x").to_pylist()):
                x[i, : min(width, len(v))] = v[:width]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.argmax(x @ c.T - half, 1).astype(np.int32))], names=[*b.schema.names, "centre"])

    near = vectors.select("row", "vec_id", "x").mapInArrow(run, "row long, vec_id long, x array<long>, centre int")
    near = write_shared(near, "search-near")
    sizes = near.groupBy("centre").agg(F.ceil(F.count("*") / most).alias("parts"))
    before = F.sum("parts").over(Window.orderBy("centre").rowsBetween(Window.unboundedPreceding, -1))  # one row a centre, at most SAMPLE
    sizes = sizes.select("centre", "parts", F.coalesce(before, F.lit(0)).alias("before"))
    out = near.join(F.broadcast(sizes), "centre").withColumn("part", (F.col("before") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
    out.shared_path = near.shared_path
    return out


def exact_top_k(vectors: DataFrame, k: int, queries: Column, scale: int = 256, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` (``vec_id, embedding``) that ``queries`` holds for, the ``k`` other rows with the
    highest scores (all, if there are fewer), ties to the smaller ``vec_id``.

    The score is the inner product of floor(scale * component), in integers; a score beyond a long stands at its end. Rows without id, and vectors that
    are null or hold null or non-finite components, take no part. The shorter of two vectors counts as followed by zeros, so an empty one scores 0.
    Repeated rows, and rows that share an id, count one by one: each is a query of its own and a candidate for the others. Other columns are
    ignored. No rows, or no queries: no result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = write_shared(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole_numbers(F.col("v"), scale).alias("x"), "asked"), "search-rows")
    n, asked, width = rows.agg(F.count("*"), F.count_if("asked"), F.max(F.size("x"))).first()
    sample = rows.select("row", "x").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()  # bounded
    room = max(1, VALUES // max(1, width or 1))
    shards = dealt(rows, n, sample, min(shard, room))
    lists = write_shared(packed(shards, sample, None), "search-shards")
    blocks = max(1, -(-asked // min(block, room)))
    questions = rows.filter("asked").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    questions = write_shared(packed(questions, sample, k), "search-queries")
    s, q = lists.alias("s"), questions.hint("shuffle_replicate_nl").alias("q")
    met = s.crossJoin(q).select(*(F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "sq" for c in ("part", "row", "id", "bar", "width", "x")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, terms, best = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                m = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                row, ids, asker, asker_id = (np.frombuffer(m[c], np.int64) for c in ("s_row", "s_id", "q_row", "q_id"))
                x, y = (np.frombuffer(m[f"{t}_x"], np.int64).reshape(-1, m[f"{t}_width"]) if m[f"{t}_width"] else np.zeros((len(r), 0), np.int64) for t, r in (("s", row), ("q", asker)))
                both = min(x.shape[1], y.shape[1])
                x, y = x[:, :both], y[:, :both]
                small = fits(x, y)
                if not small:
                    x, y = x.astype(object), y.astype(object)
                if known != (m["s_part"], both, small):
                    known, terms = (m["s_part"], both, small), Postings(x)
                top = best.setdefault(m["q_part"], [np.full(k, _LEAST) for _ in asker])  # what this task has found for the block so far
                bars, out = np.frombuffer(m["q_bar"], np.int64), []
                for j in range(len(asker)):
                    bar = max(int(bars[j]), int(top[j][0]))
                    at, score = terms.reach(y[j], bar if small or bar > _LEAST else float("-inf"))
                    other = row[at] != asker[j]
                    at, score = at[other], score[other]
                    if not small:
                        score = np.array([min(max(int(v), _LEAST), _MOST) for v in score], np.int64)
                    order = np.lexsort((row[at], ids[at], ~score))[:k]
                    at, score = at[order], score[order]
                    top[j] = np.sort(np.concatenate((top[j], score)))[-k:]
                    out.append((np.full(len(at), asker[j]), np.full(len(at), asker_id[j]), row[at], ids[at], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["query_row", "query_id", "row", "vec_id", "score"])

    best_first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    out = map_texts(met, run, HITS).withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    drop_shared(shards, rows)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""
