"""Readers and writers of files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON files: an array, an object with ``items``, or a single object. Returns ``file, index, raw`` (JSON text) and the rejects
    ``file, index, reason``: entries that aren't objects, and files that aren't JSON."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("v"))
    items = F.try_variant_get("v", "$.items", "array<variant>")
    many = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), items, F.array("v"))
    rows = files.filter("v IS NOT NULL").select("file", F.posexplode(many).alias("index", "r"))
    is_object = F.schema_of_variant("r").startswith("OBJECT")
    bad = rows.filter(~F.coalesce(is_object, F.lit(False))).select("file", "index", F.lit("not_an_object").alias("reason"))
    bad = bad.unionByName(files.filter("v IS NULL").select("file", F.lit(0).alias("index"), F.lit("not_json").alias("reason")))
    return rows.filter(is_object).select("file", "index", F.to_json("r").alias("raw")), bad


def read_records_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as trimmed text columns; headers are trimmed and a byte-order mark is dropped."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    return raw.select(*(F.trim(F.col(f"`{n}`")).alias(n.strip().lstrip("﻿").strip()) for n in raw.columns))


def rehydrate_flattened(df: DataFrame, field: str, key: str) -> DataFrame:
    """``key`` and ``field``: columns ``field/0/name`` back as an array of maps, in numeric order; parts that are blank are dropped."""
    own = [n for n in df.columns if n.startswith(f"{field}/")]
    if not own:
        return df.select(key, F.array().cast("array<map<string,string>>").alias(field))
    long = df.select(key, *(F.col(f"`{n}`").cast("string").alias(n) for n in own)).unpivot([key], [f"`{n}`" for n in own], "path", "value").filter(F.length(F.trim("value")) > 0)
    part = F.split("path", "/")
    each = long.groupBy(key, F.get(part, 1).cast("int").alias("i")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.array_join(F.slice(part, 3, 9), "/"), "value")))).alias("m"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.to_json("m").alias("m")))).alias("_a")).select(key, F.transform("_a", lambda x: F.from_json(x["m"], "map<string,string>")).alias(field))


FEED = "title string, link string, guid string, pubDate string, description string, content string"


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS and entries of Atom feeds as one shape."""
    rss = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, pubDate string, description string").load(path)
    rss = rss.select("title", "link", "guid", F.col("pubDate").alias("published"), "description", F.lit(None).cast("string").alias("content"))
    atom = spark.read.format("xml").option("rowTag", "entry").schema("title string, link struct<_href:string>, id string, updated string, summary string, content string").load(path)
    atom = atom.select("title", F.col("link._href").alias("link"), F.col("id").alias("guid"), F.col("updated").alias("published"), F.col("summary").alias("description"), "content")
    return rss.unionByName(atom)


#: The columns of a send-ready export, in this order.
SEND_READY = ["company", "domain", "contact_name", "role", "email", "verified_at", "source", "score", "fit_score", "intent_score", "reason_to_write", "evidence_urls", "score_id", "company_id", "contact_id"]


def write_send_ready_csv(df: DataFrame, path: str) -> None:
    """The fixed columns of :func:`~tallyhound.plans.scoring.send_ready_export`, lists joined by semicolons."""
    arrays = {n for n, kind in df.dtypes if kind.startswith("array")}
    df.select(*(F.array_join(n, ";").alias(n) if n in arrays else F.col(n) for n in SEND_READY)).write.mode("overwrite").csv(path, header=True)


def write_datasheet(frames: dict[str, DataFrame], folder: str) -> None:
    """Named tables side by side."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_targets(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
