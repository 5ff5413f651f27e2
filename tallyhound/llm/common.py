"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallyhound.store import drop_shared, shared_dir, write_shared

__all__ = ["cores", "drop_shared", "free", "held", "map_texts", "read", "settle", "settled", "shared_dir", "text_slices", "token_file", "write_shared"]

#: Characters of text that a Python worker holds as one slice, and bytes of an Arrow batch, about.
SLICE_CHARS, BATCH_BYTES = 400_000, 4 << 20


def settle() -> None:
    """Gives what a worker has freed back to the system. Workers stay for later tasks, of other stages too, and their executor answers for their memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def settled(run: Callable) -> Callable:
    """``run`` over the batches of a partition, and then :func:`settle`."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        settle()

    return whole


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with Arrow batches that are bounded by bytes too, so that long texts don't add up in a worker; the worker is settled after each partition.

    Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session, unless the user has."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_BYTES)
    return df.mapInArrow(settled(run), schema)


def free(name: str, columns: Iterable[str]) -> str:
    """``name``, with as many signs before it as make it unlike all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the Arrow batches of about ``chars`` characters, each with its texts (null as empty)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first = held = 0
        for i, n in enumerate(sizes):
            if held + n > chars and i > first:
                part = batch.slice(first, i - first)
                yield part, [x or "" for x in part.column(text).to_pylist()]
                first, held = i, 0
            held += n
        if first < batch.num_rows:
            part = batch.slice(first)
            yield part, [x or "" for x in part.column(text).to_pylist()]


_HELD: dict = {}


def held(what: str, key, make: Callable):
    """``make()``, remembered by the worker until it is asked for another thing: a worker that serves one stage after another holds the large
    tables of one of them only."""
    if _HELD.get("key") != (what, key):
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD.update(value=make(), key=(what, key))
    return _HELD["value"]


def token_file(name: str, path: str | None = None) -> str:
    """Where a public vocabulary file lies: ``path`` if given, else as the installed ``public_tokenizers`` says."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
