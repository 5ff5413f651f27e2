"""Ingestion plans: discovery batches, job snapshots, research."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.operators import signals as g
from tallyhound.operators import upsert as u
from tallyhound.operators.reports import ingest_summary
from tallyhound.operators.resolve import profiles_with_companies, resolve_company
from tallyhound.operators.validate import reject_without_domain_or_name
from tallyhound.store import write_shared

JOB_KEYS = ["company_id", "ats_provider", "external_job_id"]


def ingest_discovery(batch: DataFrame, records: DataFrame, companies: DataFrame, signals: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """A discovery batch (``index, source, source_record_id, source_url, company_name, website, domain, …``) against the stored tables:
    changed records, companies to create, new signals, rejects and the summary."""
    good, rejects = reject_without_domain_or_name(batch)
    good = good.withColumns({"domain": c.normalize_domain(F.coalesce(c.blank_to_null(F.col("domain")), F.col("website"))), "content_hash": F.sha2(F.to_json(F.struct(*[n for n in batch.columns if n != "index"])), 256)})
    changes = u.classify_changes(good, records, ["source", "source_record_id"], "content_hash")
    known = companies.filter("canonical_domain IS NOT NULL").groupBy(F.lower("canonical_domain").alias("domain")).agg(F.min(F.col("id").cast("string")).alias("_id"))
    linked = changes.join(known, "domain", "left").withColumn("company_id", F.coalesce("_id", c.surrogate_id(F.col("domain")))).drop("_id")
    created = linked.join(known, "domain", "left_anti").groupBy("domain", "company_id").agg(F.min_by("company_name", "index").alias("canonical_name"))
    fresh = g.insert_signal_once(g.discovery_signals(linked, as_of), signals)
    return {"records": linked, "companies": created, "signals": fresh, "rejects": rejects, "summary": ingest_summary(changes, rejects)}


def job_fingerprint() -> Column:
    """Hash of what makes a job another one; times of sight don't."""
    return F.sha2(F.to_json(F.struct("title", "department", "url", "description_text")), 256)


def ingest_job_snapshot(batch: DataFrame, jobs: DataFrame, companies: DataFrame, signals: DataFrame, as_of: Column, threshold: int = 2) -> dict[str, DataFrame]:
    """A snapshot of job boards: resolved, upserted, with job signals of new and changed jobs, spikes, missing jobs and the summary."""
    named, rejects = resolve_company(batch, companies)
    named = named.withColumn("company_id", F.col("resolved_id")).drop("resolved_id").withColumn("fingerprint", job_fingerprint())
    changes = u.classify_changes(named, jobs.withColumn("fingerprint", job_fingerprint()), JOB_KEYS, "fingerprint")
    stored = u.observe_jobs(named, jobs, JOB_KEYS, g.BOARD, as_of, threshold)
    fresh = g.job_signals(changes.filter("status <> 'duplicate'"), as_of)
    fresh = fresh.select("index", "company_id", "signal_type", F.lit("signal_enrichment").alias("source"), F.col("url").alias("source_url"), "description", "confidence")
    return {"jobs": stored, "changes": changes, "signals": g.insert_signal_once(fresh, signals), "spikes": g.hiring_spikes(stored, named, as_of), "rejects": rejects, "summary": ingest_summary(changes, rejects)}


def ingest_research(rows: DataFrame, companies: DataFrame, pages: DataFrame, fields: list[str]) -> dict[str, DataFrame]:
    """Research rows (``index, company_id, domain`` and fields) and their pages: observations and raw pages, each once per URL and hash."""
    named, rejects = resolve_company(rows, companies)
    facts = u.explode_observations(named, "resolved_id", fields)
    hashed = pages.filter("coalesce(url, '') <> '' AND coalesce(body, '') <> ''").withColumn("content_hash", F.coalesce("content_hash", F.sha2("body", 256)))
    return {"observations": facts, "pages": hashed.dropDuplicates(["company_id", "url", "content_hash"]), "rejects": rejects}


def backfill_contacts_from_profiles(profiles: DataFrame, founders: DataFrame, links: DataFrame, contacts: DataFrame, index: str = "index") -> DataFrame:
    """Contacts after those of founder profiles (``index, company_id, founder_id, email, profile_url, confidence``) are merged in; a profile
    without a confidence counts 0.8."""
    rows = profiles_with_companies(profiles, founders, links)
    rows = rows.select("company_id", "email", "full_name", "role", F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.lit("trusted_source_payload").alias("contact_source"), F.lit("source_published").alias("verification_status"), index)
    return u.merge_contacts(rows, contacts, index)


def process_source_records(records: DataFrame, companies: DataFrame, aliases: DataFrame, identities: DataFrame, allow_name_only: bool = False) -> dict[str, DataFrame]:
    """All that a batch of source records writes.

    ``records``: ``id, source_id, external_id, source_url, created_at, company_id, name, domain, former_names, founders``; ``aliases`` and
    ``identities`` are the stored ones. Gives the resolved ``records`` with their status, new ``companies``, new ``aliases`` and
    ``identities``, ``founders`` with ``links`` and ``profiles``, ``reviews`` with their reason, and a ``summary`` of
    ten counters.
    """
    rows = write_shared(u.resolve_identities(records, companies, allow_name_only), "identities")  # all that follows are projections of it
    rows = rows.withColumn("status", F.when(F.col("resolved_id").isNull(), "review_required").otherwise("linked"))
    linked = rows.filter("resolved_id IS NOT NULL")
    created = rows.filter("action = 'create'").select(F.col("resolved_id").alias("id"), c.display_name(F.col("name")).alias("canonical_name"), c.blank_to_null(F.lower("domain")).alias("canonical_domain"), "created_at")
    named = u.aliases(linked.filter("action <> 'backfill'").select(F.col("resolved_id").alias("id"), F.col("name").alias("canonical_name"), "former_names"))
    fresh = named.join(aliases.select(F.col("company_id").cast("string").alias("company_id"), "alias", "alias_type").distinct(), ["company_id", "alias", "alias_type"], "left_anti")
    seen = u.insert_once(linked.select("id", F.col("resolved_id").alias("company_id"), "source_id", "external_id", "source_url", "created_at"), identities, [F.col("source_id"), F.col("external_id")], "id").drop("id")
    people, links, profiles = u.founders(linked.select(F.col("resolved_id").alias("company_id"), "founders"))
    reasons = F.when(F.col("action") == "review_missing_name", "missing_company_name").otherwise("missing_domain")
    reviews = rows.filter("resolved_id IS NULL").select("id", reasons.alias("reason"), c.display_name(F.col("name")).alias("normalized_name"), c.blank_to_null(F.lower("domain")).alias("normalized_domain"))
    n = lambda *actions: F.count_if(F.col("action").isin(*actions))
    counts = rows.agg(F.count("*").alias("scanned"), n("create").alias("companies_created"), n("match_domain", "match_name").alias("companies_matched"), n("review_missing_name", "review_missing_domain").alias("review_items_created"), n("backfill").alias("skipped_already_linked"))
    written = [(fresh, "aliases_created"), (seen, "source_identities_created"), (people, "founders_created"), (links, "founder_links_created"), (profiles, "founder_profiles_created")]
    long = [counts.unpivot([], counts.columns, "counter", "n"), *(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n") for df, name in written)]
    summary = long[0]
    for part in long[1:]:
        summary = summary.unionByName(part)
    return {"records": rows, "companies": created, "aliases": fresh, "identities": seen, "founders": people, "links": links, "profiles": profiles, "reviews": reviews, "summary": summary}
