"""Registered queries on streams: a table is landed in three parts, the job is started anew for each and runs to its end, and what it leaves is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.adapters import load, sql
from tallyhound.functions import terms as t
from tallyhound.queries import _any, query
from tallyhound.store import BucketedTable, drop_shared, shared_dir, write_shared
from tallyhound.streaming import jobs

PARTS = 3


def play(rows: DataFrame, part, start: Callable[[DataFrame, str], object]) -> str:
    """Lands the rows of ``part`` 0, 1 and 2 one after another; ``start`` (a stream and a folder) gives the writer that is run on each. Returns the folder."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    dealt = write_shared(rows.withColumn("_part", part), "dealt")  # what the rows are derived from is read once, not for each part
    before = spark.conf.get(jobs.ROCKSDB[0])
    spark.conf.set(*jobs.ROCKSDB)
    try:
        for k in range(PARTS):
            dealt.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{folder}/in")
            run = start(jobs.read_landed(spark, f"{folder}/in", rows.schema, files_per_batch=1_000_000), folder).trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(jobs.ROCKSDB[0], before)
        drop_shared(dealt)
    return folder


@query("SELECT DISTINCT source AS source_id, CAST(doc_id % 60 AS VARCHAR) AS source_record_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS content_hash FROM documents")
def streamed_records(spark, sf):
    """Records come up to three times, some without hash, and are kept once."""
    docs = load(spark, sf, "documents")[0].select(F.col("source").alias("source_id"), (F.col("doc_id") % 60).cast("string").alias("source_record_id"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("content_hash"), "doc_id")
    folder = play(docs, F.col("doc_id") % PARTS, lambda s, at: jobs.stream_ingest(s, f"{at}/table", f"{at}/check", buckets=16))
    return BucketedTable(spark, f"{folder}/table", jobs.RECORD_KEYS).read().drop("doc_id")


def _clocks(rows: str, keys: str, time: str, delay: str) -> str:
    """``late`` of each row of ``rows``: it is further behind its key's latest time of earlier parts than the delay."""
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    return f"timed AS (SELECT a.*, coalesce({time} < (SELECT max(b.{time}) FROM {rows} b WHERE {same} AND b.part < a.part) - INTERVAL {delay}, false) AS late FROM {rows} a)"


_SIGNALS = """, s AS (SELECT company_id, signal_type, source, coalesce(source_url, '') AS url, detected_at, CASE WHEN id % 10 = 9 THEN 2 ELSE CAST(floor(datediff('day', TIMESTAMP '2023-04-01', detected_at) / 110) AS INT) END AS part0 FROM signals),
r AS (SELECT * EXCLUDE part0, least(2, greatest(0, part0)) AS part FROM s), """ + _clocks("r", "company_id", "detected_at", "30 DAY") + """,
now AS (SELECT company_id, k, max(detected_at) AS clock FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE part <= k GROUP BY ALL),
f0 AS (SELECT company_id, signal_type, source, url, min(detected_at) AS seen FROM timed WHERE part = 0 AND NOT late GROUP BY ALL),
k0 AS (SELECT f.* FROM f0 f JOIN now n ON n.company_id = f.company_id AND n.k = 0 WHERE seen >= clock - INTERVAL 30 DAY),
f1 AS (SELECT company_id, signal_type, source, url, min(detected_at) AS seen FROM timed t WHERE part = 1 AND NOT late AND NOT EXISTS (SELECT 1 FROM k0 k WHERE (k.company_id, k.signal_type, k.source, k.url) = (t.company_id, t.signal_type, t.source, t.url)) GROUP BY ALL),
k1 AS (SELECT f.* FROM (SELECT * FROM k0 UNION ALL SELECT * FROM f1) f JOIN now n ON n.company_id = f.company_id AND n.k = 1
  WHERE seen >= clock - INTERVAL 30 DAY OR NOT EXISTS (SELECT 1 FROM r WHERE r.company_id = f.company_id AND r.part = 1)),
f2 AS (SELECT company_id, signal_type, source, url, min(detected_at) AS seen FROM timed t WHERE part = 2 AND NOT late AND NOT EXISTS (SELECT 1 FROM k1 k WHERE (k.company_id, k.signal_type, k.source, k.url) = (t.company_id, t.signal_type, t.source, t.url)) GROUP BY ALL)
SELECT *, false AS late FROM f0 UNION ALL SELECT *, false FROM f1 UNION ALL SELECT *, false FROM f2 UNION ALL SELECT company_id, signal_type, source, url, detected_at, true FROM timed WHERE late"""


@query(sql("signals", _SIGNALS))
def streamed_signals(spark, sf):
    """Signals once within 30 days of their company's time, and late ones, which a tenth of the last part are."""
    rows = load(spark, sf, "signals")[0].select("id", "company_id", "signal_type", "source", "source_url", F.col("detected_at").cast("timestamp_ntz").alias("detected_at"))
    day = F.floor(F.datediff(F.col("detected_at").cast("date"), F.lit("2023-04-01").cast("date")) / 110)
    part = F.when(F.col("id") % 10 == 9, 2).otherwise(F.least(F.lit(2), F.greatest(F.lit(0), day)))
    folder = play(rows, part, lambda s, at: jobs.write_with_late(jobs.stream_dedupe_signals(s.drop("id")), f"{at}/main", f"{at}/late", f"{at}/check"))
    both = [spark.read.parquet(f"{folder}/{name}/batch=*").withColumn("late", F.lit(late)) for name, late in (("main", False), ("late", True))]
    return both[0].unionByName(both[1]).select("company_id", "signal_type", "source", F.coalesce("source_url", F.lit("")).alias("url"), F.col("detected_at").alias("seen"), "late")


@query(sql("jobs", f""", r AS (SELECT ats_board_id AS board, CAST(first_seen_at AS TIMESTAMP) AS seen, least(2, CAST(floor((year(first_seen_at) - 1995) / 2) AS INT) + CASE WHEN l_quantity >= 48 THEN 1 ELSE 0 END) AS part FROM jobs
  WHERE {_any("lower(concat_ws(' ', title, department))", t.ROLE_KEYWORDS)}), """ + _clocks("r", "board", "seen", "2 DAY") + """,
n AS (SELECT DISTINCT board, seen, count(*) OVER (PARTITION BY board ORDER BY seen RANGE BETWEEN INTERVAL 2591999 SECOND PRECEDING AND CURRENT ROW) AS job_count, max(seen) OVER (PARTITION BY board) AS clock FROM timed WHERE NOT late)
SELECT board, seen, CAST(job_count AS INT) AS job_count, false AS late FROM n WHERE job_count >= 3 AND seen < clock - INTERVAL 2 DAY UNION ALL SELECT board, seen, 1, true FROM timed WHERE late"""))
def streamed_spikes(spark, sf):
    """Times at which a board had three relevant roles within 30 days, and roles that came too late."""
    rows = load(spark, sf, "jobs")[0].select(F.lit("c").alias("company_id"), F.lit("p").alias("ats_provider"), "ats_board_id", "title", "department", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"), "l_quantity")
    part = F.least(F.lit(2), F.floor((F.year("first_seen_at") - 1995) / 2) + F.when(F.col("l_quantity") >= 48, 1).otherwise(0))
    folder = play(rows, part, lambda s, at: jobs.write_with_late(jobs.stream_spikes(s), f"{at}/main", f"{at}/late", f"{at}/check"))
    both = [spark.read.parquet(f"{folder}/{name}/batch=*").withColumn("late", F.lit(late)) for name, late in (("main", False), ("late", True))]
    return both[0].unionByName(both[1]).select(F.col("ats_board_id").alias("board"), F.col("window_end").alias("seen"), "job_count", "late")


@query("""
WITH s AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS board, CAST(l_partkey % 90 AS VARCHAR) AS job, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS part FROM lineitem),
b AS (SELECT DISTINCT board, part FROM s), known AS (SELECT DISTINCT board, job FROM s),
x AS (SELECT k.board, k.job, b.part, EXISTS (SELECT 1 FROM s WHERE s.board = k.board AND s.job = k.job AND s.part = b.part) AS here, EXISTS (SELECT 1 FROM s WHERE s.board = k.board AND s.job = k.job AND s.part < b.part) AS before FROM known k JOIN b USING (board)),
m AS (SELECT *, coalesce(lag(NOT here AND before) OVER (PARTITION BY board, job ORDER BY part), false) AS again FROM x)
SELECT board, job, part, CASE WHEN again THEN 2 ELSE 1 END AS missing_count, NOT again AS is_active FROM m WHERE before AND NOT here""")
def streamed_missing_jobs(spark, sf):
    """Jobs that a board's snapshots, one for each return flag, have no longer."""
    part = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = load(spark, sf, "lineitem")[0].select(F.col("l_suppkey").cast("string").alias("board"), (F.col("l_partkey") % 90).cast("string").alias("external_job_id"), F.timestamp_seconds(86_400 * part).alias("observed_at"), part.alias("part"))

    def start(s, at):
        changes = jobs.stream_missing_jobs(s.drop("part"))
        return changes.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{at}/table/batch={k}")).option("checkpointLocation", f"{at}/check")

    found = spark.read.parquet(f"{play(rows, F.col('part'), start)}/table")
    return found.select("board", F.col("external_job_id").alias("job"), F.col("batch").cast("int").alias("part"), "missing_count", "is_active")


@query(sql("scores", " SELECT company_id, id, total_score FROM scores QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY calculated_at DESC, id DESC) = 1"))
def streamed_scores(spark, sf):
    """The latest score of each company, whatever the order in which scores come."""
    rows = load(spark, sf, "scores")[0].select("id", "company_id", "total_score", "calculated_at")
    folder = play(rows, F.col("id") % PARTS, lambda s, at: jobs.stream_latest_score(s, f"{at}/table", f"{at}/check", buckets=16))
    return jobs.latest_scores(spark, f"{folder}/table").select("company_id", "id", "total_score")
