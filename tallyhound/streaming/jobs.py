"""Structured Streaming jobs over landed files. Every job writes through an idempotent step, so a replayed batch changes nothing.

Event time is kept per key: a key's clock is the latest event time of its earlier batches, and rows more than the delay behind it are late. They go to a
side table; nothing is dropped silently, which a watermark of the whole query would do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from tallyhound.functions import columns as c
from tallyhound.operators.latest import latest
from tallyhound.store import BucketedTable

RECORD_KEYS = ["source_id", "source_record_id", "content_hash"]
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_landed(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_ingest(records: DataFrame, table: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, buckets: int = 256):
    """Keeps records whose ``source_id, source_record_id, content_hash`` the table (:class:`~tallyhound.store.BucketedTable`) doesn't have, the first of each; null keys are
    equal. A batch reads and writes the buckets of its own keys; a replayed one finds its rows there.

    ``on_batch`` gets the whole batch, each key once, also on a replay: what it does must bear being done twice."""
    spark = records.sparkSession

    def once(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        if stored is None:
            return batch
        same = [batch[k].eqNullSafe(stored[k]) for k in RECORD_KEYS]
        return stored.unionByName(batch.join(stored, same, "left_anti"))

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(RECORD_KEYS)
        BucketedTable(spark, table, RECORD_KEYS, buckets).merge(batch, once)
        if on_batch:
            on_batch(batch, number)

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


#: Shards of keys, unless a job is told another number; it stays that of the first batch as long as the checkpoint is used.
SHARDS = 512
#: The time of what has none yet; before all others.
NEVER = -(1 << 62)


#: Rows and bytes that a worker holds before it packs them by shard.
PACK_ROWS, PACK_BYTES = 250_000, 32 << 20


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard as one value, an Arrow stream of all columns but the shard. Times with a zone become local ones, as Spark gives them to Python."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = pa.table({n: pc.local_timestamp(v) if pa.types.is_timestamp(v.type) and v.type.tz else v for n, v in zip(rows.column_names, rows.columns, strict=True)}).combine_chunks()
        rows = rows.take(pc.sort_indices(rows["row_shard"]))
        shard, body = rows["row_shard"].to_numpy(), rows.drop_columns("row_shard")
        begin = np.flatnonzero(np.diff(shard, prepend=-1))
        values = []
        for at, end in zip(begin, [*begin[1:], len(shard)], strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, body.schema) as w:
                w.write_table(body.slice(at, end - at))
            values.append(out.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(shard[begin], pa.int32()), pa.array(values, pa.binary())], names=["row_shard", "packed"])

    held, rows, size = [], 0, 0
    for b in batches:
        if b.num_rows:
            held, rows, size = [*held, b], rows + b.num_rows, size + b.nbytes
        if rows >= PACK_ROWS or size >= PACK_BYTES:
            yield pack(held)
            held, rows, size = [], 0, 0
    if held:
        yield pack(held)


def _unpacked(frames: Iterable[pd.DataFrame]) -> pd.DataFrame:
    """A shard's rows of a batch, packed or as they are."""
    parts = list(frames)
    if "packed" not in parts[0]:
        return pd.concat(parts, ignore_index=True)
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for p in parts for x in p["packed"]).to_pandas(integer_object_nulls=True)


def _by_shard(rows: DataFrame, keys: list[str], shards: int, columns: list[str] | None = None) -> GroupedData:
    """Rows (all ``columns`` unless some are named) grouped by shards of their keys, with ``row_key``, a text of the keys, in which nulls are equal to each other alone. (Names that begin with an
    underscore don't reach the processor.) Rows of a shard go together as one packed value (:func:`_packed`): Spark hands a processor its rows one by one, in Python."""
    rows = rows.select(*(columns or rows.columns), F.to_json(F.struct(*keys)).alias("row_key")).withColumn("row_shard", F.pmod(F.xxhash64("row_key"), F.lit(shards)).cast("int"))
    return rows.mapInArrow(_packed, "row_shard int, packed binary").groupBy("row_shard")


def _of_key(columns: list[str], kinds: dict[str, str]) -> list[Column]:
    """The keys of ``row_key`` as columns again."""
    told = F.from_json("row_key", ", ".join(f"`{k}` {kinds[k]}" for k in columns))
    return [told[k].alias(k) for k in columns]


class _Sharded(StatefulProcessor):
    """Keys of a shard together: their state is a few small tables, packed into one value. It is read and written once a batch, whatever the number of keys
    and entries, and worked on by column; a state call for each entry costs more than all else."""

    tables: dict[str, pa.Schema]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", ", ".join(f"{n} binary" for n in self.tables))

    def load(self) -> list[pd.DataFrame]:
        packed = self.held.get() if self.held.exists() else None
        return [(pa.ipc.open_stream(bytes(packed[i])).read_all() if packed else kind.empty_table()).to_pandas() for i, kind in enumerate(self.tables.values())]

    def keep(self, *tables: pd.DataFrame) -> None:
        packed = []
        for kind, df in zip(self.tables.values(), tables, strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, kind, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                w.write_table(pa.Table.from_pandas(df, kind, preserve_index=False))
            packed.append(out.getvalue().to_pybytes())
        self.held.update(tuple(packed))

    def close(self) -> None:
        pass


CLOCKS = pa.schema([("row_key", pa.string()), ("clock", pa.int64())])


class _Clocked(_Sharded):
    """A clock in microseconds for each key. Subclasses get a batch's rows in time order (``_at``; ``_before`` and ``_now`` are their key's clock before and after the batch),
    late ones apart."""

    def __init__(self, time: str, delay: str) -> None:
        self.time, self.delay = time, int(pd.Timedelta(delay).total_seconds() * 1e6)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = _unpacked(rows)
        clocks, known = self.load()
        at = pd.to_datetime(seen[self.time])
        micros = at.astype("datetime64[us]").astype("int64").where(at.notna(), other=NEVER)
        before = seen[["row_key"]].merge(clocks, "left", "row_key")["clock"].fillna(NEVER).astype("int64")
        late = at.notna() & (micros < before - self.delay)
        told = micros.where(~late, other=NEVER).groupby(seen["row_key"]).transform("max")
        now = np.maximum(before, told)
        seen = seen.assign(_at=micros.where(at.notna(), other=now), _before=before, _now=now, late=late).sort_values("_at", kind="stable")
        clocks = pd.concat([clocks, seen[["row_key", "_now"]].rename(columns={"_now": "clock"})]).groupby("row_key", as_index=False)["clock"].max()
        found, known = self.work(seen[~seen["late"]], known, clocks)
        self.keep(clocks, known)
        yield from (x for x in (found, self.gone(seen[seen["late"]])) if len(x))


class _Once(_Clocked):
    """Remembers what companies' signals were within the delay, and passes each once."""

    columns = ("signal_type", "source", "source_url")
    tables = {"clocks": CLOCKS, "known": pa.schema([(n, pa.string()) for n in ("row_key", *columns)] + [("at", pa.int64())])}

    def work(self, rows: pd.DataFrame, known: pd.DataFrame, clocks: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        name = ["row_key", *self.columns]
        asked = rows[name].assign(**{x: rows[x].where(rows[x].notna(), "") for x in self.columns}, at=rows["_at"])
        every = pd.concat([known, asked]) if len(known) else asked
        first = ~every.duplicated(name)
        every, fresh = every[first], first.iloc[len(known) :].to_numpy()
        clock = every[["row_key"]].merge(clocks, "left", "row_key")["clock"].to_numpy()
        return self.gone(rows[fresh]), every[every["at"].to_numpy() >= clock - self.delay]

    def gone(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.drop(columns=["_at", "_before", "_now", "row_key", "row_shard"], errors="ignore")


def stream_dedupe_signals(signals: DataFrame, delay: str = "30 days", shards: int = SHARDS) -> DataFrame:
    """Signals once per company, type, source and URL (null as empty) within the delay, and late ones with ``late`` set; needs the RocksDB state store.

    The columns are those of ``signals``. State is what a company had within the delay. A null time counts as the company's latest."""
    schema = StructType([*signals.schema.fields, StructField("late", BooleanType())])
    return _by_shard(signals, ["company_id"], shards).transformWithStateInPandas(_Once("detected_at", delay), schema, "Append", "None")


class _Spikes(_Clocked):
    """Counts of boards' relevant roles by time. A time is settled once the clock has passed it by the delay; then its window is counted."""

    tables = {"clocks": CLOCKS, "counts": pa.schema([("row_key", pa.string()), ("at", pa.int64()), ("n", pa.int64())])}

    def __init__(self, least: int, window: str, delay: str) -> None:
        super().__init__("first_seen_at", delay)
        self.least, self.window = least, int(pd.Timedelta(window).total_seconds() * 1e6)

    def work(self, rows: pd.DataFrame, counts: pd.DataFrame, clocks: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        fresh = rows.loc[rows["first_seen_at"].notna(), ["row_key", "_at"]].rename(columns={"_at": "at"}).assign(n=1)
        counts = pd.concat([counts, fresh]).groupby(["row_key", "at"], as_index=False)["n"].sum().astype({"at": "int64", "n": "int64"})  # by key, then time
        before = rows.groupby("row_key", as_index=False)[["_before", "_now"]].max()
        own = counts[["row_key"]].merge(before, "left", "row_key")
        at, n, board = counts["at"].to_numpy(), counts["n"].to_numpy(), pd.factorize(counts["row_key"])[0]
        times = np.unique(at)  # a pair of board and place among all times is one number, in the order of the rows
        begin = np.searchsorted(board * len(times) + np.searchsorted(times, at), board * len(times) + np.searchsorted(times, at - self.window, "right"))
        total = np.concatenate([[0], np.cumsum(n)])
        job_count = total[1:] - total[begin]
        settled = ((at >= own["_before"] - self.delay) & (at < own["_now"] - self.delay) & (job_count >= self.least)).to_numpy()  # no board that has no row now
        stamp = lambda x: pd.Series(x.astype("datetime64[us]"))
        found = pd.DataFrame({"row_key": counts["row_key"][settled].to_numpy(), "window_start": stamp(at[settled] - self.window), "window_end": stamp(at[settled]), "job_count": job_count[settled].astype("int32"), "late": False})
        clock = counts[["row_key"]].merge(clocks, "left", "row_key")["clock"].to_numpy()
        return found, counts[at > clock - self.delay - self.window]

    def gone(self, rows: pd.DataFrame) -> pd.DataFrame:
        at = pd.to_datetime(rows["first_seen_at"])
        return pd.DataFrame({"row_key": rows["row_key"], "window_start": at, "window_end": at, "job_count": 1, "late": True})


def stream_spikes(jobs: DataFrame, least: int = 3, delay: str = "2 days", window: str = "30 days", shards: int = SHARDS) -> DataFrame:
    """``window_start, window_end, job_count`` for every time at which a board has at least ``least`` relevant roles first seen in the ``window`` up to it; needs the
    RocksDB state store.

    A time is counted once, when the board's clock has passed it by ``delay``, so the last times of a board wait for the next. Late roles come as rows with
    ``late`` set. State is a board's counts by time within window and delay: a role makes one entry, not one for each window that holds it. Roles without time are ignored."""
    keys = ["company_id", "ats_provider", "ats_board_id"]
    rows = jobs.filter(c.is_relevant_role(F.col("title"), F.col("department"))).select(*keys, "first_seen_at")
    kinds = dict(rows.dtypes)
    schema = f"row_key string, window_start {kinds['first_seen_at']}, window_end {kinds['first_seen_at']}, job_count int, late boolean"
    found = _by_shard(rows, keys, shards, ["first_seen_at"]).transformWithStateInPandas(_Spikes(least, window, delay), schema, "Append", "None")
    return found.select(*_of_key(keys, kinds), "window_start", "window_end", "job_count", "late")


def write_with_late(rows: DataFrame, table: str, late_table: str, checkpoint: str):
    """Writes a stream with a ``late`` column to two tables, each batch in its own folder, so that a replayed batch replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for late, path in ((False, table), (True, late_table)):
            batch.filter(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


class MissingJobs(_Sharded):
    """State of boards: each job's last sight and how many snapshots it has been missing from. A job comes back as soon as a snapshot has it."""

    tables = {"jobs": pa.schema([("row_key", pa.string()), ("external_job_id", pa.string()), ("missing_since", pa.int64()), ("missing_count", pa.int32())])}

    def __init__(self, threshold: int = 2) -> None:
        self.threshold = threshold

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = _unpacked(rows).drop_duplicates().dropna(subset="at")
        (known,) = self.load()
        job = ["row_key", "external_job_id"]
        turn = seen.groupby("row_key")["at"].rank("dense").astype("int64")  # of a board's snapshots in the batch
        for _, snapshot in seen.groupby(turn):  # the first one of each board, then the second
            at = known[["row_key"]].merge(snapshot[["row_key", "at"]].drop_duplicates(), "left", "row_key")["at"]  # null: the board has no snapshot now
            here = known[job].merge(snapshot[job].assign(_here=True), "left", job)["_here"].notna()
            gone = (at.notna() & ~here).to_numpy()
            lost = known[gone].assign(missing_since=known["missing_since"][gone].where(known["missing_count"][gone] > 0, at[gone]).astype("int64"), missing_count=known["missing_count"][gone] + 1)
            if len(lost):
                yield lost.assign(is_active=lost["missing_count"] < self.threshold)
            others = known[(at.isna() & ~here).to_numpy()]
            parts = [x for x in (others, lost, snapshot[job].assign(missing_since=0, missing_count=0)) if len(x)]
            known = pd.concat(parts, ignore_index=True)
        self.keep(known)


def stream_missing_jobs(snapshots: DataFrame, threshold: int = 2, shards: int = SHARDS) -> DataFrame:
    """Changes of missing jobs (``board, external_job_id, missing_since, missing_count, is_active``) from ``board, external_job_id, observed_at``; needs the RocksDB state store."""
    rows = snapshots.select("board", "external_job_id", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"))
    schema = "row_key string, external_job_id string, missing_since long, missing_count int, is_active boolean"
    found = _by_shard(rows, ["board"], shards, ["external_job_id", "at"]).transformWithStateInPandas(MissingJobs(threshold), schema, "Append", "None")
    return found.select(*_of_key(["board"], dict(rows.dtypes)), "external_job_id", F.timestamp_micros("missing_since").alias("missing_since"), "missing_count", "is_active")


def latest_scores(spark: SparkSession, table: str) -> DataFrame | None:
    """The table of :func:`stream_latest_score` as it is; None before the first batch."""
    return BucketedTable(spark, table, ["company_id"]).read()


def stream_latest_score(scores: DataFrame, table: str, checkpoint: str, buckets: int = 256):
    """Keeps the latest score per company in ``table`` (:class:`~tallyhound.store.BucketedTable`): a batch rewrites the buckets of its own companies. Merging a
    batch again changes nothing, so a replay, and a new checkpoint over an old table, give the same."""
    spark = scores.sparkSession

    def newest(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        return latest(batch if stored is None else stored.unionByName(batch), ["company_id"], F.col("calculated_at").desc(), F.col("id").desc())

    def step(batch: DataFrame, number: int) -> None:
        BucketedTable(spark, table, ["company_id"], buckets).merge(batch, newest)

    return scores.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
