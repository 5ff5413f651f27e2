"""Best-fit packing of token sequences by large-item matching.

A bin's content depends on piece lengths only, and there are at most ``capacity`` lengths. So the packing is decided on the histogram of
lengths (bounded, however many documents there are) and written as a plan of runs: the pieces of a length with ranks from ``rank_start``
on go to bins from ``bin_start`` on, ``per_bin`` in each, at ``offset_start``. Every piece then finds its run by its rank within its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhound.llm import encoding
from tallyhound.llm.common import map_texts, read, text_slices, write_shared

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The token pieces of every text: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian 32-bit).

    The ids are the library's, read from the rank file of the same vocabulary (:mod:`tallyhound.llm.encoding`; tests hold both against each
    other at every string of the vocabulary). Null and empty texts hold ``end_id`` alone. Longer documents than ``capacity`` are cut so that only the first piece is shorter.
    Repeated rows give their pieces again.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding.encoder(vocabulary)
        for part, texts in text_slices(batches):
            doc, number, start, length, crc, raw = [], [], [], [], [], []
            for d, t in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.append(encode(t), np.uint32(end_id)).astype("<u4")
                lo, hi = 0, len(ids) % capacity or min(capacity, len(ids))
                k = 0
                while lo < len(ids):
                    b = ids[lo:hi].tobytes()
                    doc.append(d)
                    number.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(b))
                    if with_ids:
                        raw.append(b)
                    lo, hi, k = hi, hi + capacity, k + 1
            columns = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECES + (", ids binary" if with_ids else ""))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs ``(length, rank_start, bin_start, per_bin, offset_start)`` and the number of bins, from a histogram of lengths.

    Items above a third of the capacity meet at most in pairs: from the largest down, each takes the largest partner that fits. Smaller
    ones, from the largest down, fill the tightest gap that holds them. Runs of equal bins move together, so the work depends on the number
    of lengths, not of pieces.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    next_rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first bin, number of bins)
    bins = 0

    def place(s: int, n: int, first: int, per_bin: int, offset: int) -> None:
        runs.append((s, next_rank[s], first, per_bin, offset))
        next_rank[s] += n
        left[s] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        for b in large:
            if b > min(a, capacity - a) or not left[a]:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                if a == b:
                    place(a, 2 * n, bins, 2, 0)
                else:
                    place(a, n, bins, 1, 0)
                    place(b, n, bins, 1, a)
                leave(capacity - a - b, bins, n)
                bins += n
        if left[a]:
            leave(capacity - a, bins, left[a])
            bins += left[a]
            place(a, left[a], bins - left[a], 1, 0)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s), default=0)
            if not gap:
                gap = capacity
                gaps[gap] = [(bins, -(-left[s] // (capacity // s)))]
                bins += gaps[gap][0][1]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            per_bin = gap // s
            full = min(n, left[s] // per_bin)
            if full:
                place(s, full * per_bin, first, per_bin, capacity - gap)
                leave(gap - per_bin * s, first, full)
            if full < n:
                first, n = first + full, n - full
                if rest := left[s]:  # fewer than one bin's worth
                    place(s, rest, first, per_bin, capacity - gap)
                    leave(gap - rest * s, first, 1)
                    first, n = first + 1, n - 1
                leave(gap, first, n)
    return runs, bins


def assign(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (``doc_id, piece, start, length, ids_crc32``, more may follow) with ``sequence_id`` and ``offset``.

    Ranks within a length come from counts of (length, salt) cells and a window within a cell, so that a length that a third of all pieces
    have is spread. ``parts`` must be a stored table: it is read three times. The plan has a few runs per length (bounded by the capacity).
    """
    spark = parts.sparkSession
    salts = min(65536, max(16, parts.count() // 20000))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    runs, _ = plan_bins(counts, capacity)
    local = spark.createDataFrame(runs, "_length long, rank_start long, bin_start long, per_bin long, offset_start long")
    runs_of = F.broadcast(local.groupBy("_length").agg(F.array_sort(F.collect_list(F.struct("rank_start", "bin_start", "per_bin", "offset_start"))).alias("_runs")))
    in_cell = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_in", F.row_number().over(in_cell) - 1).join(cells.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), "_ahead"), (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.withColumn("_rank", F.col("_ahead") + F.col("_in")).join(runs_of, F.col("length") == F.col("_length"))
    found = ranked.withColumn("_run", F.element_at(F.filter("_runs", lambda r: r["rank_start"] <= F.col("_rank")), -1))
    i = F.col("_rank") - F.col("_run.rank_start")
    return found.select(
        *parts.columns,
        (F.col("_run.bin_start") + F.floor(i / F.col("_run.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("_run.offset_start") + F.pmod(i, F.col("_run.per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """All documents as pieces with their place in sequences of at most ``capacity`` tokens. An empty table gives no rows.

    Null and empty texts are the end token alone, repeated rows are packed again, and columns besides doc_id and text are ignored."""
    return assign(write_shared(pieces(docs, capacity, end_id, vocabulary, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` with the pieces joined in place order; ``packed`` comes from :func:`pack` with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
