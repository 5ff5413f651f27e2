"""The canonical tables: declared columns, checks at the time of writing, and upserts that rewrite only the buckets that a batch falls in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhound.operators import upsert as u
from tallyhound.store import BucketedTable

SCORE = ("company_fit", "opportunity_strength", "timing", "technical_capacity_gap", "commercial_potential", "source_confidence", "overall_score", "fit_score", "intent_score", "total_score")


@dataclass(frozen=True)
class Table:
    """``columns`` as DDL; ``key`` decides what is the same row; ``required`` may not be null; ``between`` and ``among`` bound values; ``on_key`` is what a batch does to a
    stored row: ``replace`` it, ``fill`` its nulls, be left out (``once``), or what postings and contacts do (``jobs``, ``contacts``)."""

    columns: str
    key: tuple[str, ...]
    required: tuple[str, ...]
    on_key: str = "replace"
    between: tuple[tuple[str, float, float], ...] = ()
    among: tuple[tuple[str, tuple[str, ...]], ...] = ()


_SURE = (("confidence", 0, 1),)
#: Tables, columns and bounds of the canonical store.
TABLES = {
    "companies": Table("id string, canonical_name string, canonical_domain string, description string, industry string, country string, city string, company_stage string, employee_estimate int, status string, created_at timestamp, updated_at timestamp", ("id",), ("id", "canonical_name"), "fill"),
    "sources": Table("id string, source_key string, name string, source_type string, base_url string, terms_url string, enabled boolean, created_at timestamp, updated_at timestamp", ("source_key",), ("source_key", "name", "source_type"), "once"),
    "source_records": Table("id string, source_id string, source_record_id string, company_id string, raw_payload string, source_url string, collected_at timestamp, content_hash string, created_at timestamp, processing_status string, processed_at timestamp, processing_notes string", ("source_id", "source_record_id"), ("source_id", "raw_payload")),
    "company_aliases": Table("id string, company_id string, alias string, alias_type string, source string, confidence double, created_at timestamp", ("company_id", "alias", "alias_type"), ("company_id", "alias", "alias_type"), "once", _SURE),
    "founders": Table("id string, full_name string, location string, bio string, created_at timestamp, updated_at timestamp", ("id",), ("id", "full_name"), "fill"),
    "company_founders": Table("company_id string, founder_id string, role string, source_id string, confidence double, created_at timestamp", ("company_id", "founder_id"), ("company_id", "founder_id"), "fill", _SURE),
    "observations": Table("id string, company_id string, research_run_id string, evidence_kind string, field_name string, value string, source string, source_url string, collected_at timestamp, confidence double, created_at timestamp", ("id",), ("id", "company_id", "evidence_kind", "field_name", "value"), "once", _SURE, (("evidence_kind", ("FACT", "OBSERVATION", "INFERENCE", "RECOMMENDATION")),)),
    "signals": Table("id string, company_id string, founder_id string, signal_type string, description string, source string, source_url string, detected_at timestamp, confidence double, raw_evidence string, created_at timestamp", ("company_id", "signal_type", "source", "source_url"), ("signal_type", "description"), "once", _SURE),
    "ats_boards": Table("id string, company_id string, domain string, ats_provider string, board_key string, board_token string, board_url string, careers_url string, evidence_url string, confidence double, raw_evidence string, status string, first_detected_at timestamp, last_detected_at timestamp", ("company_id", "ats_provider", "board_key"), ("company_id", "ats_provider", "board_key"), "replace", _SURE),
    "job_postings": Table("id string, company_id string, ats_board_id string, ats_provider string, external_job_id string, title string, department string, location string, remote_policy string, employment_type string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, url string, description_text string, stack_terms array<string>, seniority string, is_active boolean, raw_payload string, missing_since_at timestamp, missing_observation_count int", ("company_id", "ats_provider", "external_job_id"), ("company_id", "ats_provider", "external_job_id", "title"), "jobs"),
    "scores": Table("id string, company_id string, " + ", ".join(f"{s} int" for s in SCORE) + ", positive_reasons array<string>, penalties array<string>, score_version string, scoring_inputs string, calculated_at timestamp, model_version string", ("id",), ("id", "company_id", "calculated_at"), "once", tuple((s, 0, 100) for s in SCORE)),
    "contacts": Table("company_id string, email string, full_name string, role string, confidence double, contact_source string, verification_status string", ("company_id", "email"), ("company_id",), "contacts", _SURE),
}


def checked(df: DataFrame, table: str, index: str = "index") -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` in the table's columns and types, ``index`` besides; and ``index, reason`` of those that can't be stored: a required value is missing, one can't be
    read in its type, or one is out of bounds (the first by column). Columns that ``df`` lacks are null; one that the table doesn't have is an error."""
    spec = TABLES[table]
    fields = StructType.fromDDL(spec.columns).fields
    own = {f.name: f.dataType for f in fields}
    if unknown := [n for n in df.columns if n not in own and n != index]:
        raise ValueError(f"{table} has no columns {', '.join(unknown)}")
    kinds = dict(df.dtypes)

    def read(name: str):
        if name not in kinds:
            return F.lit(None).cast(own[name])
        return F.col(name) if kinds[name] == own[name].simpleString() else F.col(name).try_cast(own[name])

    reasons = []
    for n in own:
        if n in kinds:
            reasons.append(F.when(F.col(n).isNotNull() & read(n).isNull(), f"{n} can't be read"))
        if n in spec.required:
            reasons.append(F.when(read(n).isNull(), f"{n} is missing"))
    reasons += [F.when((read(n) < low) | (read(n) > high), f"{n} is out of bounds") for n, low, high in spec.between if n in kinds]
    reasons += [F.when(~read(n).isin(*values), f"{n} is out of bounds") for n, values in spec.among if n in kinds]
    rows = df.withColumn("_reason", F.coalesce(*reasons))
    return rows.filter("_reason IS NULL").select(*(read(n).alias(n) for n in own), index), rows.filter("_reason IS NOT NULL").select(index, F.col("_reason").alias("reason"))


class CanonicalTable:
    """One of :data:`TABLES` under ``root``, in hash buckets of its key (:class:`~tallyhound.store.BucketedTable`)."""

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = 256) -> None:
        self.spark, self.name, self.spec = spark, name, TABLES[name]
        self._table = BucketedTable(spark, f"{root}/{name}", list(self.spec.key), buckets)

    def read(self) -> DataFrame:
        """The table as it is; empty before the first write."""
        found = self._table.read()
        return found if found is not None else self.spark.createDataFrame([], self.spec.columns)

    def upsert(self, batch: DataFrame, index: str = "index") -> tuple[list[int], DataFrame]:
        """Stores the rows of ``batch`` that pass the checks, in the order of ``index``. Returns the buckets written and the rejects."""
        good, bad = checked(batch, self.name, index)
        return self._table.merge(good, self._combine(index)), bad

    def _combine(self, index: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
        key, how = list(self.spec.key), self.spec.on_key

        def run(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
            old = stored if stored is not None else batch.drop(index).limit(0)
            if how == "replace":
                return u.overwrite(batch, old, key, index)
            if how == "fill":
                return u.merge_fill_nulls(batch, old, key, [c for c in old.columns if c not in key], index)
            if how == "jobs":
                return u.merge_jobs(batch, old, key, index)
            if how == "contacts":
                return u.merge_contacts(batch, old, index)
            return old.unionByName(u.insert_once(batch, old, [F.col(k) for k in key], index).select(old.columns))

        return run
