"""Canonical tables: checks, upserts by key, and buckets that a batch touches; null keys in every upsert."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhound.operators import upsert as u
from tallyhound.sources import files, tables

AT = datetime(2024, 1, 1)


def test_every_table_is_well_formed(spark):
    for name, spec in tables.TABLES.items():
        own = spark.createDataFrame([], spec.columns).columns
        assert {*spec.key, *spec.required, *(b[0] for b in spec.between), *(b[0] for b in spec.among)} <= set(own), name
        assert tables.checked(spark.createDataFrame([], spec.columns).withColumn("index", F.lit(0)), name)[0].columns == [*own, "index"]


def test_rows_are_checked(spark):
    rows = [(0, "1", "c", "50", AT), (1, None, "c", "50", AT), (2, "2", "c", "x", AT), (3, "3", "c", "101", AT), (4, "4", None, None, None), (5, "5", "c", None, AT)]
    df = spark.createDataFrame(rows, "index int, id string, company_id string, total_score string, calculated_at timestamp")
    good, bad = tables.checked(df, "scores")
    assert sorted((r["index"], r.total_score) for r in good.collect()) == [(0, 50), (5, None)]
    assert sorted(map(tuple, bad.collect())) == [(1, "id is missing"), (2, "total_score can't be read"), (3, "total_score is out of bounds"), (4, "company_id is missing")]
    with pytest.raises(ValueError, match="no columns extra"):
        tables.checked(df.withColumn("extra", F.lit(1)), "scores")
    wrong = spark.createDataFrame([(0, "o", "c", "GUESS", "f", "v")], "index int, id string, company_id string, evidence_kind string, field_name string, value string")
    assert [tuple(r) for r in tables.checked(wrong, "observations")[1].collect()] == [(0, "evidence_kind is out of bounds")]


def test_an_upsert_rewrites_what_it_touches(spark, tmp_path):
    table = tables.CanonicalTable(spark, str(tmp_path), "companies", buckets=32)
    assert table.read().count() == 0
    every = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("n"), "id").alias("canonical_name"), F.col("id").alias("index"))
    assert len(table.upsert(every)[0]) == 32
    before = {str(p) for p in tmp_path.rglob("*.parquet")}
    batch = spark.createDataFrame([(0, "7", "other", "seven.example"), (1, "7", "third", "late.example"), (2, None, "x", None)], "index int, id string, canonical_name string, canonical_domain string")
    touched, bad = table.upsert(batch)
    fresh = [p for p in tmp_path.rglob("*.parquet") if str(p) not in before]
    assert len(touched) == 1 and len(fresh) == 1 and [r.reason for r in bad.collect()] == ["id is missing"]
    got = table.read()
    assert got.count() == 2000 and [(r.canonical_name, r.canonical_domain) for r in got.filter("id = '7'").collect()] == [("n7", "seven.example")]
    assert [f.dataType for f in got.schema] == [f.dataType for f in spark.createDataFrame([], tables.TABLES["companies"].columns).schema]


def test_what_a_batch_does_to_stored_rows(spark, tmp_path):
    open_ = lambda name: tables.CanonicalTable(spark, str(tmp_path), name, buckets=4)
    put = lambda name, rows, kind: open_(name).upsert(spark.createDataFrame(rows, "index int, " + kind))
    for _ in range(2):  # again changes nothing
        put("source_records", [(0, "s", "1", "{}", "h1"), (1, "s", "1", "{}", "h2"), (2, "s", None, "{}", "h3"), (3, "s", None, "{}", "h4")], "source_id string, source_record_id string, raw_payload string, content_hash string")
        assert sorted(r.content_hash for r in open_("source_records").read().collect()) == ["h2", "h4"]
        put("signals", [(0, "c", "T", "d1", None), (1, "c", "T", "d2", None), (2, "c", "T", "d3", "")], "company_id string, signal_type string, description string, source_url string")
        assert sorted(r.description for r in open_("signals").read().collect()) == ["d1", "d3"]
        put("contacts", [(0, "c", "A@x.yz", None, 0.5), (1, "c", "a@x.yz", "Ann", 0.4), (2, "c", None, "No Mail", 0.1)], "company_id string, email string, full_name string, confidence double")
        assert sorted(((r.email, r.full_name, r.confidence) for r in open_("contacts").read().collect()), key=repr) == [("a@x.yz", "Ann", 0.5), (None, "No Mail", 0.1)]
    put("job_postings", [(0, "c", "p", "j", "Old", AT, False), (1, "c", "p", "k", "Kept", AT, False)], "company_id string, ats_provider string, external_job_id string, title string, first_seen_at timestamp, is_active boolean")
    put("job_postings", [(0, "c", "p", "j", "New", datetime(2025, 1, 1))], "company_id string, ats_provider string, external_job_id string, title string, first_seen_at timestamp")
    got = {r.external_job_id: r for r in open_("job_postings").read().collect()}
    assert (got["j"].title, got["j"].first_seen_at, got["j"].is_active) == ("New", AT, True) and got["k"].is_active is True


KEYED = "k string, v int, w int, first_seen_at timestamp, is_active boolean, missing_since_at timestamp, missing_observation_count int"


def test_null_keys_meet_in_every_upsert(spark):
    old = spark.createDataFrame([(None, 1, None, AT, False, AT, 2), ("", 5, None, AT, False, AT, 2)], KEYED)
    new = spark.createDataFrame([(None, 2, 3, datetime(2025, 1, 1), False, None, 0, 0), ("z", 9, 9, AT, True, None, 0, 1)], KEYED + ", index int")
    rows = lambda df: sorted(((r.k, r.v, r.w) for r in df.collect()), key=repr)
    assert rows(u.overwrite(new, old, ["k"])) == sorted([(None, 2, 3), ("", 5, None), ("z", 9, 9)], key=repr)
    assert rows(u.merge_fill_nulls(new, old, ["k"], ["v", "w"])) == sorted([(None, 1, 3), ("", 5, None), ("z", 9, 9)], key=repr)
    jobs = u.merge_jobs(new, old, ["k"])
    assert rows(jobs) == sorted([(None, 2, 3), ("", 5, None), ("z", 9, 9)], key=repr) and [r.first_seen_at for r in jobs.filter("k IS NULL").collect()] == [AT]
    assert rows(u.touch(new, old, ["k"], ["w"])) == sorted([(None, 1, 3), ("", 5, None), ("z", 9, 9)], key=repr)
    assert rows(u.insert_once(new, old, [F.col("k")])) == [("z", 9, 9)]
    assert {r.k: r.status for r in u.classify_changes(new, old, ["k"], "v").collect()} == {None: "updated", "z": "inserted"}


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "company string, score int")
    files.write_targets(df, f"{tmp_path}/targets")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{tmp_path}/targets").collect())) == [("a", 1), ("b", None)]
    files.write_datasheet({"Companies": df, "Notes": df.limit(0)}, f"{tmp_path}/sheet")
    assert spark.read.parquet(f"{tmp_path}/sheet/Companies").count() == 2 and spark.read.parquet(f"{tmp_path}/sheet/Notes").count() == 0
