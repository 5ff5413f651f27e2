"""Scoring, export and report queries: compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.functions import terms as t
from tallyhound.operators import latest as w
from tallyhound.operators import reports, resolve, scoring
from tallyhound.operators.validate import is_provider_target


def score_companies(companies: DataFrame, signals: DataFrame, jobs: DataFrame, contacts: DataFrame, classification: DataFrame, suppression: DataFrame, as_of: Column) -> DataFrame:
    """Every company with a signal, scored: fit, intent, total, reasons and penalties. Each input is aggregated per company first, then joined once."""
    org = signals.filter(F.col("signal_type").isin(*t.ORG_TYPES[:2])).withColumn("_rank", F.when(F.col("signal_type") == t.ORG_TYPES[0], 0).otherwise(1))
    org = w.latest(org, ["company_id"], F.col("_rank"), F.col("detected_at").desc(), F.col("id").desc()).select("company_id", F.col("signal_type").alias("org_type"), F.col("description").alias("org_description"))
    barred = suppression.select(F.lower("domain").alias("_barred")).filter("_barred IS NOT NULL").distinct()
    base = companies.withColumnRenamed("id", "company_id").join(scoring.intent(signals, as_of), "company_id")
    base = resolve.star(base, scoring.active_relevant_jobs(jobs), org, classification.select("company_id", "company_type", "sector"), reports.verified_contact_count(contacts))
    base = base.join(barred, c.normalize_domain(F.col("canonical_domain")) == F.col("_barred"), "left").withColumn("suppressed", F.col("_barred").isNotNull()).drop("_barred")
    return scoring.totals(scoring.fit(base))


def send_ready_export(companies: DataFrame, scores: DataFrame, contacts: DataFrame, suppression: DataFrame, evidence: DataFrame, min_score: int, statuses: tuple[str, ...], limit: int) -> DataFrame:
    """Verified contacts of companies above a score, best first; suppressed addresses and domains never. Rows without evidence or reason are
    dropped before the limit, so the limit always fills. Beside the inputs' columns the result has those of
    :data:`tallyhound.sources.files.SEND_READY`; what no input has is null."""
    score = w.latest(scores, ["company_id"], F.col("calculated_at").desc(), F.col("id").desc()).filter(F.col("total_score") >= min_score)
    has = lambda df, name, kind: F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    score = score.withColumn("intent_score", has(scores, "intent_score", "int"))
    contacts = contacts.withColumns({"contact_name": has(contacts, "full_name", "string"), "role": has(contacts, "role", "string"), "verified_at": has(contacts, "verified_at", "timestamp"), "source": has(contacts, "contact_source", "string"), "confidence": has(contacts, "confidence", "double")})
    rows = contacts.filter((F.coalesce("email", F.lit("")) != "") & F.col("verification_status").isin(*statuses)).withColumnRenamed("id", "contact_id")
    rows = rows.join(score.select("company_id", "total_score", F.col("total_score").alias("score"), "fit_score", "intent_score", F.col("id").alias("score_id")), "company_id").join(companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company"), F.col("canonical_domain").alias("domain")), "company_id")
    rows = resolve.drop_suppressed(rows, suppression, "email", "domain").join(evidence, "company_id")
    rows = rows.withColumns({"evidence_urls": c.ordered_urls(F.col("trigger_evidence")), "reason_to_write": c.reason_to_write(F.col("trigger_evidence"), F.array().cast("array<string>"))})
    rows = rows.filter((F.size("evidence_urls") > 0) & (F.col("reason_to_write") != ""))
    return rows.orderBy(F.col("total_score").desc(), F.coalesce("confidence", F.lit(0)).desc(), "company", "email").limit(limit)


def ranked_datasheet(companies: DataFrame, scores: DataFrame, classification: DataFrame, signals: DataFrame, contacts: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies with summaries and tier; and leads, ranked over the whole table by tier, kind of contact, score, name and address."""
    score = w.latest(scores, ["company_id"], F.col("calculated_at").desc(), F.col("id").desc()).select("company_id", "fit_score", "total_score")
    ranked = signals.filter(F.col("signal_type").isin(*t.TRIGGER_RANK)).withColumn("_rank", w.by_rank_list("signal_type", t.TRIGGER_RANK))
    trigger = w.latest(ranked, ["company_id"], F.col("_rank"), F.col("confidence").desc(), F.col("detected_at").desc(), F.col("id")).select("company_id", F.col("signal_type").alias("primary_trigger_type"), F.col("description").alias("primary_trigger"))
    base = companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company"), F.col("canonical_domain").alias("domain"), "country", "industry").join(score, "company_id").join(classification.select("company_id", "company_type"), "company_id")
    base = resolve.star(base, reports.signal_summary(signals), trigger, reports.contact_summary(contacts), reports.active_job_counts(jobs), reports.engineering_flag(signals))
    base = base.fillna(0, ["signal_count", "contact_count", "active_jobs"]).fillna(False, ["has_person_contact", "has_role_contact", "has_engineering_org"])
    words = lambda f: F.split(F.coalesce(f, F.lit("")), ", ")
    tier = scoring.tier_company(F.col("company_type"), words("signal_types"), words("contact_kinds"), F.col("has_engineering_org"), F.array().cast("array<string>"))
    base = base.withColumn("_t", tier).select("*", "_t.tier", "_t.tier_sort").drop("_t")
    leads = contacts.select("company_id", "email", "contact_kind").join(base.select("company_id", "company", "tier", "tier_sort", "total_score", "primary_trigger_type"), "company_id")
    kind = w.by_rank_list("contact_kind", ("person", "role_inbox", "generic", "unknown"))
    leads = w.global_rank(leads, F.col("tier_sort"), kind, F.col("total_score").desc(), F.col("company"), F.col("email"))
    return base, leads


def datasheet_frames(companies: DataFrame, leads: DataFrame, contacts: DataFrame, sources: DataFrame, presence: DataFrame, min_score: int, generated_at: str) -> dict[str, DataFrame]:
    """The tables of a datasheet, for :func:`~tallyhound.sources.files.write_datasheet`: ``companies`` of :func:`ranked_datasheet` are dealt to
    ``Companies`` and, in tier X, to ``Excluded``; ``Sources`` has those and the counts of each kind of web presence; ``Notes`` has the figures."""
    out = F.col("tier") == "X"
    kept, excluded = companies.filter(~out), companies.filter(out).orderBy(F.coalesce("total_score", F.lit(0)).desc(), "company")
    kinds = presence.groupBy("presence_kind").agg(F.count("*").alias("records")).select(F.lit("web_presence").alias("part"), F.col("presence_kind").alias("source_key"), "records", F.lit(None).cast("long").alias("companies"))
    every = sources.select(F.lit("source").alias("part"), "source_key", "records", "companies").unionByName(kinds).orderBy("part", F.col("records").desc(), "source_key")
    n = lambda df, item: df.agg(F.count("*").cast("string").alias("note")).select(F.lit(item).alias("item"), "note")
    told = companies.sparkSession.createDataFrame([("Score threshold", str(min_score)), ("Generated at", generated_at)], "item string, note string")
    notes = told.unionByName(n(companies, "Companies exported")).unionByName(n(kept, "Companies sheet rows")).unionByName(n(excluded, "Excluded companies")).unionByName(n(leads, "Lead/contact rows")).unionByName(n(contacts, "Contact rows"))
    return {"Leads": leads, "Companies": kept.orderBy("tier_sort", F.coalesce("total_score", F.lit(0)).desc(), "company"), "Contacts": contacts, "Excluded": excluded, "Sources": every, "Notes": notes}


def provider_targets(companies: DataFrame, scores: DataFrame, suppression: DataFrame, signals: DataFrame, min_score: int, limit: int) -> DataFrame:
    """Companies above a score with a clean, unsuppressed domain, and the roles to look for."""
    score = w.latest(scores, ["company_id"], F.col("calculated_at").desc(), F.col("id").desc()).filter(F.col("total_score") >= min_score)
    rows = companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company"), c.normalize_domain(F.col("canonical_domain")).alias("domain")).filter(is_provider_target(F.col("domain")))
    rows = resolve.drop_suppressed(rows, suppression, None, "domain").join(score.select("company_id", "total_score"), "company_id")
    kinds = signals.groupBy("company_id").agg(F.array_sort(F.collect_set("signal_type")).alias("kinds"))
    rows = rows.join(kinds, "company_id")
    return rows.withColumn("target_roles", F.array_join(c.target_roles(F.col("kinds")), "; ")).orderBy(F.col("total_score").desc(), "company").limit(limit)


def review_queue(candidates: DataFrame) -> DataFrame:
    """Contact candidates (``company, company_domain, email, full_name, role, extraction, score``) with quality, decision and rank, in queue order."""
    generic = c.generic_local_part(F.substring_index(F.lower("email"), "@", 1), t.ROLE_LOCAL_PARTS, ("career", "employ", "recruit"))
    own = F.coalesce(c.email_domain(F.col("email")) == F.lower("company_domain"), F.lit(False))
    kind = F.when(~own, "external_email").when(generic.isin("info", "contact", "hello", "careers", "team"), "generic_inbox").when(generic != "", "low_value_generic_inbox").otherwise("direct_person")
    rows = candidates.withColumn("candidate_type", kind)
    rows = rows.withColumn("candidate_quality", scoring.candidate_quality(F.col("candidate_type"), F.coalesce("full_name", F.lit("")) != "", F.coalesce("role", F.lit("")) != "", F.col("extraction")))
    return scoring.queue_labels(rows).orderBy("priority_rank", F.col("score").desc(), F.lower("company"), F.lower("email"))


def published_queue(texts: DataFrame) -> DataFrame:
    """Self-published addresses in texts (``id, company_id, domain, text, score``): each address once over all texts (the first by id)."""
    rows = texts.select("id", "company_id", "domain", "score", F.explode(c.extract_emails(F.col("text"))).alias("raw")).withColumn("email", c.published_email(F.col("raw"))).filter("email IS NOT NULL")
    rows = w.latest(rows, ["email"], F.col("id"), F.col("raw"))
    own = F.coalesce(c.email_domain(F.col("email")) == F.col("domain"), F.lit(False))
    generic = c.local_part(F.col("email")).isin(*t.ROLE_LOCAL_PARTS)
    best = own & ~generic
    return rows.select("id", "company_id", "email", "score", own.alias("is_company_domain_email"), generic.alias("is_generic_email"), F.when(best, "approve").otherwise("review").alias("suggested_decision"), F.when(best, "personal_company_domain").when(own, "generic_company_domain").otherwise("off_domain").alias("candidate_quality"), F.when(best, 0.9).otherwise(0.7).alias("confidence"))


def send_ready_sheet(queue: DataFrame, mx_records: DataFrame) -> DataFrame:
    """Export rows (``email, reason_to_write, is_generic_email, is_company_domain_email, score``) with deliverability, tier and rank."""
    rows = resolve.with_deliverability(queue, mx_records).withColumn("trigger_type", scoring.trigger_label(F.col("reason_to_write")))
    tier = scoring.tier_send_ready(F.col("trigger_type"), ~F.col("is_generic_email"), F.col("is_company_domain_email"), F.col("deliverability"))
    rows = rows.withColumn("_t", tier).select("*", "_t.tier", "_t.tier_sort").drop("_t")
    return w.global_rank(rows, F.col("tier_sort"), F.col("score").desc(), F.col("email"))


def all_contacts(captured: DataFrame, contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """Captured contacts and those of the contacts table in one shape (``company_id, company, domain, email, full_name, role, phone,
    contact_kind, on_company_domain, deliverability, source_type, source_url, raw_evidence``)."""
    email = F.lower("email")
    kind = F.when(F.col("full_name").isNotNull() | F.col("role").isNotNull(), "person").when(F.substring_index(email, "@", 1).isin(*t.ROLE_LOCAL_PARTS), "role_inbox").otherwise("generic")
    own = F.coalesce(c.email_domain(email) == F.lower("domain"), F.lit(False))
    named = companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company"), F.col("canonical_domain").alias("domain"))
    evidence = c.build_object(collector=F.lit("legacy_contacts_table"), contact_source=F.col("contact_source"), verification_status=F.col("verification_status"), confidence=F.col("confidence"))
    legacy = contacts.join(named, "company_id").select("company_id", "company", "domain", "email", "full_name", "role", F.lit(None).cast("string").alias("phone"), kind.alias("contact_kind"), own.alias("on_company_domain"), F.col("verification_status").alias("deliverability"), F.lit("legacy_contacts").alias("source_type"), F.concat(F.lit("legacy_contacts_table:"), F.coalesce("contact_source", F.lit("unknown"))).alias("source_url"), evidence.alias("raw_evidence"))
    return captured.select(*legacy.columns).unionByName(legacy)


def company_workbook(companies: DataFrame, scores: DataFrame, signals: DataFrame, contacts: DataFrame, jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every company with its latest score, best trigger and counts; companies without any stay."""
    score = w.latest(scores, ["company_id"], F.col("calculated_at").desc(), F.col("id").desc()).select("company_id", "total_score")
    newest = w.latest(signals, ["company_id"], F.col("confidence").desc(), F.col("detected_at").desc(), F.col("id")).select("company_id", F.col("signal_type").alias("best_signal"))
    n = lambda df, name: df.groupBy("company_id").agg(F.count("*").alias(name))
    base = companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company"))
    out = resolve.star(base, score, newest, n(signals, "signals"), n(contacts, "contacts"), n(jobs, "jobs"), n(outcomes, "outcomes"))
    return out.fillna(0, ["signals", "contacts", "jobs", "outcomes"])


def probe_targets(companies: DataFrame, signals: DataFrame, jobs: DataFrame) -> DataFrame:
    """Companies with a discovery or funding signal and no jobs yet, with the domain to probe; first of each domain by id."""
    from tallyhound.operators.validate import classify_probe_domain

    rows = resolve.having(companies, signals, where=F.col("signal_type").isin("HIRING_DISCOVERY", "FUNDING_EVENT"))
    rows = classify_probe_domain(resolve.without(rows, jobs).select("id", F.col("canonical_domain").alias("host")))
    return w.latest(rows.filter("probe_domain IS NOT NULL"), ["probe_domain"], F.col("id"))


def message_facts(observations: DataFrame, companies: DataFrame, fields: list[str], keys: tuple[str, ...] = ("company_id",)) -> DataFrame:
    """The latest observation of each field per company (or finer ``keys``) as columns, with the draft's opening sentence."""
    wide = w.pivot_latest(observations, list(keys), "field", "value", fields, F.col("observed_at").desc(), F.col("id").desc())
    rows = wide.join(companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company")), "company_id")
    opening = F.format_string("%s: %s", F.col("company"), c.trim_sentence(F.coalesce(*(F.col(f) for f in fields)), 120))
    return rows.withColumns({"opening": opening, "opening_words": c.word_count(opening)})
