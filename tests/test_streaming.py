"""Streaming jobs over files, run to their end."""

import os
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhound.store import BucketedTable
from tallyhound.streaming import jobs

SIGNALS = "company_id string, signal_type string, source string, source_url string, detected_at timestamp_ntz"
JOBS = "company_id string, ats_provider string, ats_board_id string, title string, department string, first_seen_at timestamp_ntz"
DAY = datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(*jobs.ROCKSDB)
    yield
    spark.conf.unset(jobs.ROCKSDB[0])


def play(spark, path, parts, schema, start):
    """Lands one file after another; the job is restarted for each."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        start(jobs.read_landed(spark, f"{path}/in", schema, files_per_batch=1)).trigger(availableNow=True).start().awaitTermination(200)


def test_ingest_is_idempotent(spark, tmp_path):
    kind = "source_id string, source_record_id string, content_hash string, n int"
    parts = [[("s", "1", "h1", 0), ("s", "1", "h1", 0), ("s", "2", "h2", 0), (None, "3", "h", 0)], [("s", "2", "h2", 1), (None, "3", "h", 1), ("s", "2", "h3", 1)]]
    heard = []
    for run in range(2):  # the second run replays all with a checkpoint of its own
        play(spark, tmp_path, parts if run == 0 else [], kind, lambda s: jobs.stream_ingest(s, f"{tmp_path}/table", f"{tmp_path}/check{run}", lambda df, k: heard.append(df.count())))  # noqa: B023
        if run:
            jobs.stream_ingest(jobs.read_landed(spark, f"{tmp_path}/in", kind), f"{tmp_path}/table", f"{tmp_path}/check1").trigger(availableNow=True).start().awaitTermination(200)
        got = BucketedTable(spark, f"{tmp_path}/table", jobs.RECORD_KEYS).read().collect()
        assert sorted(map(tuple, got), key=repr) == sorted([("s", "1", "h1", 0), ("s", "2", "h2", 0), (None, "3", "h", 0), ("s", "2", "h3", 1)], key=repr)
    assert heard == [3, 3]


def test_a_batch_touches_its_own_buckets(spark, tmp_path):
    """What a batch of one key reads and writes is one bucket, however many there are."""
    table = BucketedTable(spark, f"{tmp_path}/t", ["k"], 32)
    every = spark.range(5000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    read = []

    def newest(stored, batch):
        if stored is not None:
            read.append((len(stored.inputFiles()), stored.count()))
        return batch if stored is None else batch.unionByName(stored.join(batch, "k", "left_anti"))

    assert len(table.merge(every, newest)) == 32
    before = {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    touched = table.merge(spark.createDataFrame([(77, 1)], "k long, v int"), newest)
    assert len(touched) == 1 and read[0][0] == 1 and read[0][1] < 300
    fresh = [p for p in tmp_path.rglob("*.parquet") if str(p) not in before]
    assert len(fresh) == 1 and all(p in {str(x) for x in tmp_path.rglob("*.parquet")} for p in before)
    assert table.merge(spark.createDataFrame([(77, 1)], "k long, v int"), newest) == touched
    again = BucketedTable(spark, f"{tmp_path}/t", ["k"], 8)  # the table's own number of buckets counts
    assert again.buckets == 32 and again.read().count() == 5000 and [r.v for r in again.read().filter("k = 77").collect()] == [1]
    for i in range(3):
        again.merge(spark.createDataFrame([(77, i)], "k long, v int"), newest)
    assert len([d for d in os.listdir(f"{tmp_path}/t/_manifest") if d.endswith(".json")]) == 2 and len(list(tmp_path.rglob(f"_bucket={touched[0]}"))) == 2
    assert again.read([touched[0]]).count() == read[0][1] and again.merge(every.limit(0), newest) == []


def test_a_half_written_version_doesnt_count(spark, tmp_path):
    table = BucketedTable(spark, f"{tmp_path}/t", ["k"], 4)
    put = lambda stored, batch: batch
    table.merge(spark.createDataFrame([(1, 1)], "k long, v int"), put)
    spark.createDataFrame([(1, 9, 0)], "k long, v int, _bucket int").write.partitionBy("_bucket").parquet(f"{tmp_path}/t/v=1")  # a writer that died
    assert [tuple(r) for r in table.read().collect()] == [(1, 1)]
    table.merge(spark.createDataFrame([(1, 2)], "k long, v int"), put)
    assert [tuple(r) for r in table.read().collect()] == [(1, 2)]


def test_signals_once_and_late_ones_aside(spark, tmp_path, rocksdb):
    at = lambda d: DAY + timedelta(days=d)
    parts = [
        [("c", "T", "s", None, at(0)), ("c", "T", "s", "", at(1)), ("c", "U", "s", None, at(0)), ("d", "T", "s", None, at(0))],
        [("c", "T", "s", None, at(20)), ("c", "V", "s", None, at(40)), ("c", "W", "s", None, None), ("d", "T", "s", "u", at(-50))],
        [("c", "X", "s", None, at(5)), ("c", "T", "s", None, at(41)), ("d", "T", "s", None, at(1))],  # X is late for c; T of c is forgotten by now
    ]
    start = lambda s: jobs.write_with_late(jobs.stream_dedupe_signals(s), f"{tmp_path}/main", f"{tmp_path}/late", f"{tmp_path}/c")
    play(spark, tmp_path, parts, SIGNALS, start)
    got = sorted((r.company_id, r.signal_type, r.source_url, r.detected_at) for r in spark.read.parquet(f"{tmp_path}/main").filter("detected_at IS NOT NULL").collect())
    assert [(x[0], x[1], x[3]) for x in got] == [("c", "T", at(0)), ("c", "T", at(41)), ("c", "U", at(0)), ("c", "V", at(40)), ("d", "T", at(0))]
    assert [r.signal_type for r in spark.read.parquet(f"{tmp_path}/main").filter("detected_at IS NULL").collect()] == ["W"]
    assert sorted((r.company_id, r.signal_type) for r in spark.read.parquet(f"{tmp_path}/late").collect()) == [("c", "X"), ("d", "T")]


def test_spikes_and_late_roles(spark, tmp_path, rocksdb):
    at = lambda d: DAY + timedelta(days=d)
    job = lambda d, title="Engineer", board="b": ("c", "p", board, title, None, at(d))
    parts = [[job(0), job(1), job(2), job(2, "Cook"), job(0, board="e")], [job(1.5), job(40), job(31.9)], [job(10), job(50), job(39.5), job(60, board="e")]]
    start = lambda s: jobs.write_with_late(jobs.stream_spikes(s), f"{tmp_path}/main", f"{tmp_path}/late", f"{tmp_path}/c")
    play(spark, tmp_path, parts, JOBS, start)
    got = sorted((r.ats_board_id, r.window_end, r.job_count) for r in spark.read.parquet(f"{tmp_path}/main").collect())
    # settled by the end: days below 48 of b; each role counts in every window that it is in, once
    assert got == [("b", at(1.5), 3), ("b", at(2), 4), ("b", at(40), 3)]
    assert [(r.ats_board_id, r.window_end) for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [("b", at(10))]


def test_latest_score_over_batches_and_restarts(spark, tmp_path):
    kind = "id long, company_id string, total_score int, calculated_at timestamp"
    rows = [[(1, "c", 5, datetime(2024, 1, 1)), (3, "d", 1, datetime(2024, 1, 1))], [(2, "c", 7, datetime(2024, 1, 2))], [(4, "d", 9, datetime(2023, 1, 1)), (5, "e", 2, datetime(2024, 1, 1))]]
    assert jobs.latest_scores(spark, f"{tmp_path}/none") is None
    turn = iter(range(9))
    play(spark, tmp_path, rows, kind, lambda s: jobs.stream_latest_score(s, f"{tmp_path}/table", f"{tmp_path}/c{next(turn) // 2}"))  # the last starts anew: all batches come again
    got = {(r.company_id, r.total_score) for r in jobs.latest_scores(spark, f"{tmp_path}/table").collect()}
    assert got == {("c", 7), ("d", 1), ("e", 2)}


def test_missing_jobs(spark, tmp_path, rocksdb):
    days = [datetime(2024, 1, d) for d in (1, 2, 3)]
    seen = {0: ["a", "b"], 1: ["a"], 2: ["a"]}
    for i, at in enumerate(days):
        spark.createDataFrame([("board", j, at) for j in seen[i]], "board string, external_job_id string, observed_at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.read_landed(spark, f"{tmp_path}/in", "board string, external_job_id string, observed_at timestamp")
    jobs.stream_missing_jobs(stream).writeStream.format("memory").queryName("missing").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination(120)
    got = sorted((r.external_job_id, r.missing_count, r.is_active) for r in spark.table("missing").collect())
    assert got == [("b", 1, True), ("b", 2, False)]


class _Counted:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):  # as a handle, too
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


def batches(processor, *parts):
    """What a processor gives for each part, all of one shard, and the calls of its state."""
    state, out = _Counted(), []
    processor.init(state)
    for part in parts:
        found = list(processor.handleInputRows((0,), iter([part]), None))
        out.append(pd.concat(found) if found else pd.DataFrame())
    return out, state.calls


def test_signals_of_many_companies_take_few_state_calls():
    n = 3000
    frame = lambda *days: pd.concat([pd.DataFrame({"company_id": range(n), "signal_type": "T", "source": None, "source_url": "u", "detected_at": DAY + timedelta(days=d), "row_key": [f"k{i}" for i in range(n)], "row_shard": 0}) for d in days])
    out, calls = batches(jobs._Once("detected_at", "30 days"), frame(0, 1), frame(20, 40), frame(5, 41))
    assert [len(x) for x in out] == [n, 0, 2 * n] and calls < 12
    assert out[2].groupby("late").size().to_dict() == {False: n, True: n} and list(out[2].columns) == ["company_id", "signal_type", "source", "source_url", "detected_at", "late"]


def test_spikes_of_many_boards_take_few_state_calls():
    n = 2000
    frame = lambda *days: pd.concat([pd.DataFrame({"first_seen_at": DAY + timedelta(days=d), "row_key": [f"k{i}" for i in range(n)], "row_shard": 0}) for d in days])
    out, calls = batches(jobs._Spikes(3, "30 days", "2 days"), frame(0, 1, 2), frame(1.5, 31.5, 40), frame(10, 50))
    assert calls < 12 and len(out[0]) == 0
    tell = lambda df: sorted(set(zip((df["window_end"] - DAY) / timedelta(days=1), df["job_count"], df["late"], strict=True)))
    assert tell(out[1]) == [(1.5, 3, False), (2, 4, False)] and len(out[1]) == 2 * n
    assert tell(out[2]) == [(10, 1, True)] and len(out[2]) == n


def test_missing_jobs_of_many_boards_take_few_state_calls():
    n = 2000
    frame = lambda *told: pd.concat([pd.DataFrame({"external_job_id": j, "at": at, "row_key": [f"k{i}" for i in range(n)], "row_shard": 0}) for j, at in told])
    out, calls = batches(jobs.MissingJobs(2), frame(("a", 1), ("b", 1), ("a", 2)), frame(("a", 3)), frame(("b", 4), ("b", 4)))
    assert calls < 12
    tell = lambda df: sorted(set(zip(df["external_job_id"], df["missing_since"], df["missing_count"], df["is_active"], strict=True)))
    assert [tell(x) for x in out] == [[("b", 2, 1, True)], [("b", 2, 2, False)], [("a", 4, 1, True)]] and [len(x) for x in out] == [n] * 3


def test_rows_of_a_shard_reach_the_processor_together(spark):
    """Spark gives a processor its rows one by one in Python; so a shard's rows are few values, and hold what the rows hold."""
    rows = spark.range(5000, numPartitions=3).select((F.col("id") % 70).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") + 2**60).alias("n"), F.timestamp_seconds(F.col("id") * 3600).alias("at"), F.when(F.col("id") % 3 > 0, F.lit("ü")).alias("s"))
    handed = jobs._by_shard(rows, ["k"], 4)._df.toPandas()
    assert len(handed) == 12 and set(handed["row_shard"]) == set(range(4))
    parts = [jobs._unpacked([p, p.iloc[:0]]) for _, p in handed.groupby("row_shard")]
    assert all(len(p) for p in parts) and not set(parts[0]["row_key"]) & set(parts[1]["row_key"])
    got = pd.concat(parts).sort_values("at", ignore_index=True)
    want = rows.orderBy("at").toPandas()
    assert (got["at"] == want["at"]).all() and got["n"].dropna().tolist() == [i + 2**60 for i in range(5000) if i % 5] and got["s"].isna().sum() == 1667
    assert set(got["row_key"]) == {f'{{"k":{i}}}' for i in range(70)}
