"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where the setting is absent (tests in one process) a folder of this process is made and recorded in the session, but only for a local master.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Drops, at its end, all tables that :func:`write_shared` writes within. Results that are read from them have to be stored before that."""
    _SCOPES.append([])
    try:
        yield
    finally:
        drop_shared(*_SCOPES.pop())


def write_shared(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends there, and a lost executor costs no recomputation. It stays until it is dropped
    (:func:`drop_shared`, :func:`scope`)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.shared_path = path
    if _SCOPES:
        _SCOPES[-1].append(back)
    return back


#: Bytes of an Arrow batch that :func:`map_slices` hands to a Python worker, about.
BATCH_BYTES = 4 << 20


def map_slices(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` for rows of any length: Arrow batches are bounded by bytes too (``spark.sql.execution.arrow.maxBytesPerBatch`` of the session, unless the user has
    set it), and a worker gives what it has freed back after each partition."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_BYTES)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(whole, schema)


class Files:
    """The file system of a path, by whatever Spark reads and writes it with."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def write(self, path: str, text: str) -> None:
        """The whole file or none of it: written beside and renamed."""
        beside = self._path(path + ".tmp")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._path(path), False)
        self._fs.rename(beside, self._path(path))

    def read(self, path: str) -> str:
        src = self._fs.open(self._path(path))
        try:
            return bytes(src.readAllBytes()).decode()
        finally:
            src.close()


class BucketedTable:
    """A keyed table in hash buckets with versions, so that a batch reads and writes only the buckets that its keys fall in.

    Every write is a numbered version: Parquet of the touched buckets under ``v=<n>``, then a manifest ``_manifest/<n>.json`` that names the version
    each bucket is at. Readers see the newest manifest, so half-written versions don't count, and a write that is repeated after a failure replaces its own. Buckets that the
    last two manifests don't name are deleted. The number of buckets is kept in the manifest: it bounds the manifest and what a batch brings to the
    driver. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 256) -> None:
        self.spark, self.path, self.keys, self._files = spark, path, keys, Files(spark, path)
        found = self.manifest()
        self.buckets = found["buckets"] if found else buckets

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._files.names(f"{self.path}/_manifest") if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict | None:
        numbers = self._numbers()
        number = number if number is not None else numbers[-1] if numbers else None
        return None if number is None else json.loads(self._files.read(f"{self.path}/_manifest/{number}.json"))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folder(self, version: int, bucket: str) -> str:
        return f"{self.path}/v={version}/_bucket={bucket}"

    def read(self, of: list[int] | None = None) -> DataFrame | None:
        """The table as it is, or the buckets ``of`` it; None while nothing has been written to them."""
        found = self.manifest()
        at = {} if not found else found["at"]
        paths = [self._folder(v, b) for b, v in at.items() if of is None or int(b) in of]
        return self.spark.read.schema(found["schema"]).parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> list[int]:
        """Writes ``combine(stored rows of the touched buckets or None, batch)`` in their place, and returns those buckets. Combining a batch with what already holds it
        has to change nothing."""
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())  # at most as many as there are buckets
        if not touched:
            return []
        found = self.manifest() or {"number": -1, "at": {}}
        rows = combine(self.read(touched), batch)
        number = found["number"] + 1
        rows.withColumn("_bucket", self.bucket()).repartition(min(len(touched), self.spark.sparkContext.defaultParallelism * 4), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/v={number}")
        held = {int(n.split("=")[1]) for n in self._files.names(f"{self.path}/v={number}") if n.startswith("_bucket=")}
        at = {b: v for b, v in found["at"].items() if int(b) not in touched} | {str(b): number for b in held}
        self._files.write(f"{self.path}/_manifest/{number}.json", json.dumps({"number": number, "buckets": self.buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "at": at}))
        self._clean(found, touched)
        return touched

    def _clean(self, kept: dict, touched: list[int]) -> None:
        """Buckets that the manifest before ``kept`` named and neither ``kept`` nor the newest does."""
        numbers = self._numbers()
        for old in numbers[:-2]:
            before = self.manifest(old)["at"]
            for b, v in before.items():
                if kept["at"].get(b) != v and self.manifest()["at"].get(b) != v:
                    self._files.delete(self._folder(v, b))
            self._files.delete(f"{self.path}/_manifest/{old}.json")


def drop_shared(*tables: DataFrame) -> None:
    """Deletes tables of :func:`write_shared` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "shared_path", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
