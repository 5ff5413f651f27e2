"""Target lists: the companies and pages that a collector is to visit next.

Each is an anti join against what is there already, and an order; ``limit`` is the feature's own and None gives all rows. Ties are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import terms as t
from tallyhound.operators import latest as w
from tallyhound.operators import resolve


def _cut(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def _with_domain(companies: DataFrame) -> DataFrame:
    return companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("name"), F.col("canonical_domain").alias("domain")).filter("domain IS NOT NULL")


def _score(scores: DataFrame) -> DataFrame:
    return w.latest(scores, ["company_id"], F.col("calculated_at").desc(), F.col("id").desc()).select("company_id", F.col("total_score").alias("score"))


def _unseen_orgs(rows: DataFrame, signals: DataFrame) -> DataFrame:
    return resolve.without(rows, signals.filter(F.col("signal_type").isin(*t.ORG_TYPES)), key="company_id")


def org_probe_targets(companies: DataFrame, scores: DataFrame, signals: DataFrame, min_score: int, limit: int | None = None) -> DataFrame:
    """Companies above a score whose code organisation wasn't looked for yet, best first."""
    rows = _with_domain(companies).join(_score(scores).filter(F.col("score") >= min_score), "company_id")
    return _cut(_unseen_orgs(rows, signals), limit, F.col("score").desc(), "company_id").select("company_id", "domain", "score")


def stale_org_probe_targets(companies: DataFrame, signals: DataFrame, stale_days: int, limit: int | None = None) -> DataFrame:
    """Companies with a role that was open for ``stale_days`` or more and whose code organisation wasn't looked for yet."""
    age = F.get_json_object("raw_evidence", "$.signal.age_days").try_cast("int")
    rows = resolve.having(_with_domain(companies), signals, key="company_id", where=(F.col("signal_type") == "STALE_ENGINEERING_ROLE") & (age >= stale_days))
    return _cut(_unseen_orgs(rows, signals), limit, "company_id").select("company_id", "domain")


def classify_targets(companies: DataFrame, scores: DataFrame, classification: DataFrame, min_score: int = 0, shards: int = 1, shard: int = 0, limit: int | None = None) -> DataFrame:
    """Companies without a classification, best first; without a score they count as 0. One of ``shards`` parts by key."""
    rows = _with_domain(companies).join(_score(scores), "company_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    rows = resolve.without(rows.filter(F.col("score") >= min_score), classification, key="company_id")
    return _cut(w.shard(rows, "company_id", shards, shard), limit, F.col("score").desc(), "company_id").select("company_id", "domain", "score")


def enrich_targets(companies: DataFrame, scores: DataFrame, enrichment: DataFrame, method: str, min_score: int, limit: int | None = None) -> DataFrame:
    """Companies above a score that weren't enriched by ``method`` yet, best first."""
    rows = _with_domain(companies).join(_score(scores).filter(F.col("score") >= min_score), "company_id")
    rows = resolve.without(rows, enrichment.filter(F.col("extraction_method") == method), key="company_id")
    return _cut(rows, limit, F.col("score").desc(), "company_id").select("company_id", "domain", "score")


def capture_targets(companies: DataFrame, scores: DataFrame, classification: DataFrame, captured: DataFrame | None, min_score: int, domains: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Classified buyers above a score whose pages weren't captured yet, of the given ``domain``s if any, best first, then by name."""
    rows = _with_domain(companies).filter("domain <> ''").join(_score(scores).filter(F.col("score") >= min_score), "company_id")
    kinds = classification.filter(~F.col("company_type").isin("software_vendor", "agency")).select("company_id", "company_type")
    rows = rows.join(kinds, "company_id")
    if captured is not None:
        rows = resolve.without(rows, captured, key="company_id")
    if domains is not None:
        rows = resolve.having(rows, domains, key="domain", other="domain")
    return _cut(rows, limit, F.col("score").desc(), "name", "company_id").select("company_id", "name", "domain", "score", "company_type")


def parser_samples(boards: DataFrame, jobs: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Pages of generic boards, the latest detected first; with ``jobs``, of companies without any."""
    rows = boards.filter("ats_provider = 'generic'").withColumn("url", F.coalesce("careers_url", "board_url")).filter("url IS NOT NULL")
    if jobs is not None:
        rows = resolve.without(rows, jobs, key="company_id")
    return _cut(rows, limit, F.col("last_detected_at").desc(), "domain", "url").select("domain", "url")
