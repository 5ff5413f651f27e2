"""Fit and intent scores with explainable reasons, tiers and queue labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.functions import terms as t


def decay(detected_at: Column, as_of: Column) -> Column:
    age = c.age_days(detected_at, as_of)
    return F.when(detected_at.isNull(), 0.8).when(age <= 30, 1.0).when(age <= 90, 0.8).when(age <= 180, 0.55).otherwise(0.25)


def contributions(signals: DataFrame, as_of: Column) -> DataFrame:
    """Signals with a ``contribution`` (null for types without a weight)."""
    weight = c.lookup(F.col("signal_type"), t.INTENT_WEIGHTS)
    return signals.withColumn("contribution", c.half_even(weight * decay(F.col("detected_at"), as_of)))


def intent(signals: DataFrame, as_of: Column) -> DataFrame:
    """Per company: ``intent_score, signal_count, tender_count, signal_types`` and the evidence, newest first.

    The best contribution counts whole and the next three a quarter; repeated tenders, whatever their age, add up to 25. Only the top four
    are ranked, by a window that limits each task's groups before the shuffle; all else is one aggregation.
    """
    rows = contributions(signals, as_of)
    top = rows.filter("contribution > 0").withColumn("_n", F.row_number().over(Window.partitionBy("company_id").orderBy(F.col("contribution").desc(), "id"))).filter("_n <= 4")
    parts = top.groupBy("company_id").agg(F.max("contribution").alias("_first"), F.sum(F.when(F.col("_n") > 1, F.col("contribution")).otherwise(0)).alias("_next"))
    counted = rows.groupBy("company_id").agg(F.count("*").alias("signal_count"), F.count_if(F.col("signal_type").isin(*t.TENDER_TYPES)).alias("tender_count"), F.array_sort(F.collect_set(F.when(F.col("contribution") > 0, F.col("signal_type")))).alias("signal_types"))
    bonus = F.when(F.col("tender_count") > 1, F.least(F.lit(25), 5 * (F.col("tender_count") - 1))).otherwise(0)
    base = F.least(F.lit(100), F.col("_first") + c.half_even(F.col("_next") * 0.25))
    score = F.when(F.col("_first").isNotNull(), c.clamp(F.least(F.lit(100), base + bonus))).otherwise(0).cast("int")
    return counted.join(parts, "company_id", "left").withColumn("intent_score", score).drop("_first", "_next")


def trigger_evidence(signals: DataFrame, as_of: Column, most: int | None = None) -> DataFrame:
    """Per company the evidence of weighted signals, newest first: all of it, or on request the newest ``most``."""
    rows = contributions(signals, as_of).filter("contribution > 0")
    urls = F.coalesce(F.from_json(F.get_json_object("raw_evidence", "$.job_urls"), "array<string>"), F.when(F.col("source_url").isNotNull(), F.array("source_url")), F.array().cast("array<string>"))
    order = Window.partitionBy("company_id").orderBy(F.col("detected_at").desc_nulls_last(), "id")
    rows = rows.withColumns({"job_urls": urls, "_n": F.row_number().over(order)})
    rows = rows if most is None else rows.filter(F.col("_n") <= most)
    item = F.struct("_n", "signal_type", "description", "source_url", "detected_at", "confidence", "job_urls")
    sorted_ = F.array_sort(F.collect_list(item))
    return rows.groupBy("company_id").agg(F.transform(sorted_, lambda e: F.struct(*(e[f].alias(f) for f in ("signal_type", "description", "source_url", "detected_at", "confidence", "job_urls")))).alias("trigger_evidence"))


def active_relevant_jobs(jobs: DataFrame, words: tuple[str, ...] = ("engineer", "developer", "software", "platform", "data", "product", "automation")) -> DataFrame:
    """Active jobs per company whose text has one of the words."""
    text = c.joined_lower(F.col("title"), F.col("department"), F.col("description_text"))
    return jobs.groupBy("company_id").agg(F.count_if(F.col("is_active") & c.has_any(text, words)).alias("active_jobs"))


def fit(companies: DataFrame) -> DataFrame:
    """``companies`` (joined with ``active_jobs, org_type, org_description, company_type, sector, suppressed, verified_contacts``) with
    ``fit_raw``, ``disqualified``, ``positive_reasons`` and ``penalties``. All adjustments are expressions over one row."""
    col = F.col
    companies = companies.withColumn("_domain", c.normalize_domain(col("canonical_domain")))
    name, domain = col("canonical_name"), col("_domain")
    gap = lambda *x: F.lower(F.concat_ws(" ", *(F.coalesce(v, F.lit("")) for v in x)))
    whole = gap(name, col("canonical_domain"), col("description"), col("industry"), col("country"), col("city"), col("company_stage"))
    identity = gap(name, col("canonical_domain"), col("industry"))
    companies = companies.withColumns({"_industries": c.matched_terms(whole, t.INDUSTRY_TERMS), "_identity": identity})
    industries, identity = col("_industries"), col("_identity")
    fits = F.size(industries) > 0
    staff, jobs = col("employee_estimate"), F.coalesce(col("active_jobs"), F.lit(0))
    engineering, small = F.coalesce(col("org_type") == t.ORG_TYPES[0], F.lit(False)), F.coalesce(col("org_type") == t.ORG_TYPES[1], F.lit(False))
    builds, buys = F.coalesce(col("company_type").isin("software_vendor", "agency"), F.lit(False)), F.coalesce(col("company_type") == "non_technical_buyer", F.lit(False))
    free_mail, barred = F.coalesce(domain.isin(*t.SCORING_FREE_MAIL), F.lit(False)), F.coalesce(col("suppressed"), F.lit(False))
    rival = c.has_any(identity, t.COMPETITOR_TERMS) & ~c.has_any(identity, t.PUBLIC_BODY_TERMS)
    crypto = c.has_any(identity, t.CRYPTO_TERMS) & ~fits
    verified = F.coalesce(col("verified_contacts"), F.lit(0)) > 0
    good_size, large, tiny = (F.coalesce(x, F.lit(False)) for x in (staff.between(10, 250), staff > 500, staff < 5))
    many = jobs >= 15
    on = lambda cond, points: F.when(cond, points).otherwise(0)
    raw = (
        F.lit(45) + F.when(domain.isNotNull(), 10).otherwise(-30) + on(free_mail, -30) + on(barred, -40) + F.when(fits, 18).otherwise(-6)
        + on(good_size, 12) + on(large, -6) + on(tiny, -8) + F.least(F.lit(12), 3 * jobs) + on(many, -22)
        + F.when(engineering, -35).when(small, 14).otherwise(0) + F.when(builds, -40).when(buys, 20).otherwise(0)
        + on(rival, -35) + on(crypto, -25) + on(verified, 5)
    )
    positive = c.reasons(
        (domain.isNotNull(), "Company has a resolvable domain."),
        (fits, F.concat(F.lit("Industry fit matches "), F.array_join(F.slice(industries, 1, 3), ", "), F.lit("."))),
        (good_size, "Company size fits serviceable SMB/mid-market."),
        (jobs > 0, F.concat(jobs.cast("string"), F.lit(" active relevant hiring signal(s) support service fit."))),
        (~engineering & small, "GitHub shows no substantial in-house engineering footprint."),
        (buys, F.concat(F.lit("Classified as a non-technical buyer"), F.coalesce(F.concat(F.lit(" ("), c.blank_to_null(col("sector")), F.lit(")")), F.lit("")), F.lit("."))),
        (verified, "Verified contact evidence already exists."),
    )
    negative = c.reasons(
        (domain.isNull(), "No accessible company domain."),
        (free_mail, "Company domain is a free-mail domain."),
        (barred, "Domain is suppressed."),
        (~fits, "No explicit target-industry fit found."),
        (large, "Large company; verify engineering capacity before outreach."),
        (tiny, "Company may be too small for paid engineering help."),
        (many, "Large active engineering hiring footprint may indicate strong in-house team."),
        (engineering, F.concat(F.lit("GitHub shows substantial in-house engineering: "), F.coalesce(col("org_description"), F.lit("")))),
        (builds, F.concat(F.lit("Classified as "), col("company_type"), F.lit(": builds software rather than buying it."))),
        (rival, "Agency/consultancy competitor."),
        (crypto, "Crypto-only or unclear business."),
    )
    out = domain.isNull() | free_mail | barred | many | engineering | builds | rival | crypto
    return companies.withColumns({"fit_raw": raw, "disqualified": out, "positive_reasons": positive, "penalties": negative}).drop("_domain", "_industries", "_identity")


def totals(df: DataFrame) -> DataFrame:
    """``fit_score, intent_score, total_score`` from ``fit_raw``, ``intent_score`` (null: no signals) and ``disqualified``."""
    fit_, intent_ = c.clamp(F.col("fit_raw")), F.coalesce("intent_score", F.lit(0))
    out = df.withColumns({"fit_score": F.when(F.col("disqualified"), F.least(fit_, F.lit(35))).otherwise(fit_), "intent_score": F.when(F.col("disqualified"), F.least(intent_, F.lit(45))).otherwise(intent_)})
    return out.withColumn("total_score", c.half_even(F.col("fit_score") * F.col("intent_score") / 100))


def sub_scores(tech_evidence: Column, evidence_count: Column) -> tuple[Column, Column]:
    """Capacity gap (85 with technical triggers, 50 with others, 0 without) and source confidence by the amount of evidence."""
    gap = F.when(tech_evidence > 0, 85).when(evidence_count > 0, 50).otherwise(0)
    confidence = F.when(evidence_count >= 3, 90).when(evidence_count == 2, 75).when(evidence_count == 1, 60).otherwise(0)
    return gap, confidence


def tier_company(company_type: Column, signal_types: Column, contact_kinds: Column, has_engineering_org: Column, penalties: Column) -> Column:
    """``struct<tier_sort, tier>``: X for builders and in-house engineering, A to C for buyers with evidence, D for the rest."""
    buyer = F.coalesce(company_type, F.lit("unclear")) == "non_technical_buyer"
    live = F.arrays_overlap(signal_types, c.lits(t.LIVE_FUNDED_TYPES))
    history = F.array_contains(signal_types, "PROCUREMENT_HISTORY")
    out = F.coalesce(company_type, F.lit("unclear")).isin("software_vendor", "agency") | has_engineering_org | F.lower(F.array_join(penalties, " ")).contains("in-house engineering")
    key = (
        F.when(out, 9).when(buyer & live & F.array_contains(contact_kinds, "person"), 0)
        .when(buyer & live & F.array_contains(contact_kinds, "role_inbox"), 1).when(buyer & history, 2).when(buyer & live, 3).otherwise(4)
    )
    return F.struct(key.alias("tier_sort"), F.element_at(F.create_map(*(F.lit(x) for kv in {9: "X", 0: "A", 1: "B", 2: "C", 3: "D", 4: "D"}.items() for x in kv)), key).alias("tier"))


def trigger_label(reason: Column) -> Column:
    low = F.lower(reason)
    out = F.when(low.contains("appears open for"), "stale_role")
    for text, label in (("relevant roles appeared", "hiring_spike"), ("suggests internal tooling", "operations_need"), ("mentions stack", "tech_stack_need")):
        out = out.when(low.contains(text), label)
    return out.when(reason.contains("published this address in Ask HN"), "hn_post_only").otherwise("other")


def tier_send_ready(trigger: Column, personal: Column, on_domain: Column, deliverability: Column) -> Column:
    """``struct<tier_sort, tier>`` of an export row; addresses that can't receive mail come last."""
    real = ~trigger.isin("hn_post_only", "other")
    names = ["A_trigger_personal_ondomain", "B_trigger_generic_ondomain", "C_trigger_offdomain", "D_personal_ondomain_no_trigger", "E_weak"]
    key = F.when(~F.coalesce(deliverability.isin(*t.SENDABLE), F.lit(False)), 9).when(real & personal & on_domain, 0).when(real & on_domain, 1).when(real, 2).when(personal & on_domain, 3).otherwise(4)
    return F.struct(key.alias("tier_sort"), F.when(key == 9, "Z_undeliverable").otherwise(F.get(c.lits(names), key)).alias("tier"))


def candidate_quality(candidate_type: Column, has_name: Column, has_role: Column, extraction: Column) -> Column:
    return (
        F.when(candidate_type == "external_email", "reject_external_domain")
        .when(candidate_type == "low_value_generic_inbox", "reject_low_value_generic")
        .when(candidate_type == "generic_inbox", "fallback_generic_inbox")
        .when(has_name & has_role, "strong_direct_person")
        .when(has_role, "role_backed_direct_email")
        .when(extraction == "mailto_link", "mailto_direct_email")
        .otherwise("direct_email_needs_context")
    )


def queue_labels(df: DataFrame, quality: str = "candidate_quality") -> DataFrame:
    """``priority_rank`` and ``suggested_decision`` of a candidate's quality."""
    q = F.col(quality)
    decision = F.when(q == "strong_direct_person", "inspect_source_then_approve").when(q == "fallback_generic_inbox", "fallback_only").when(q.startswith("reject_"), "reject").otherwise("inspect_source")
    return df.withColumns({"priority_rank": c.lookup(q, t.QUALITY_RANK, F.lit(99)), "suggested_decision": decision})


def source_decision(legacy: Column, replies: Column, meetings: Column, records: Column, score20: Column, verified: Column) -> Column:
    return (
        F.when(legacy, "legacy_archived_source")
        .when((replies > 0) | (meetings > 0), "scale_commercially")
        .when((score20 >= 20) & (verified == 0), "scale_source_fix_contacts")
        .when((records >= 20) & (score20 < 5), "drop_or_rework_source")
        .when(records < 20, "needs_more_sample")
        .when(verified > 0, "ready_for_small_outreach")
        .otherwise("keep_testing")
    )


#: What to do with a contact candidate, and why.
REVIEW_HINTS = {
    "external_email": ("reject", "External-domain email. Approve only if the source proves this person represents the target company."),
    "low_value_generic_inbox": ("reject", "Generic inbox with low outreach value."),
    "generic_inbox": ("needs_review", "Generic company inbox. Use only as fallback when no named decision maker exists."),
    "named": ("approve_candidate", "Named person with role evidence and direct company email."),
    "role": ("needs_review", "Role evidence found, but person name is missing."),
    "mailto": ("needs_review", "Direct company email from mailto link. Confirm it belongs to a useful person or team."),
    "other": ("needs_review", "Direct company email found. Confirm source evidence before approving."),
}


def review_hint(candidate_type: Column, has_name: Column, has_role: Column, extraction: Column) -> Column:
    """``struct<recommended_status, hint>`` of a contact candidate."""
    case = F.when(candidate_type.isin("external_email", "low_value_generic_inbox", "generic_inbox"), candidate_type).when(has_name & has_role, "named").when(has_role, "role").when(extraction == "mailto_link", "mailto").otherwise("other")
    return c.let(case, lambda k: F.struct(c.lookup(k, {n: v[0] for n, v in REVIEW_HINTS.items()}).alias("recommended_status"), c.lookup(k, {n: v[1] for n, v in REVIEW_HINTS.items()}).alias("hint")))


def candidate_confidence(full_name: Column, role: Column, email: Column) -> Column:
    named, placed, reached = (F.coalesce(x, F.lit("")) != "" for x in (full_name, role, email))
    return F.when(named & placed & reached, 0.9).when(placed & reached, 0.82).otherwise(0.72)


def validated_confidence(populated: Column, routes: Column, notes: Column) -> Column:
    base = F.least(F.lit(0.95), 0.4 + 0.1 * populated + 0.05 * routes)
    return F.round(F.when(notes > 0, F.greatest(F.lit(0.2), base - 0.1 * notes)).otherwise(base), 4)


def classifier_confidence(confidence: Column, notes: Column) -> Column:
    return F.when(notes > 0, F.round(F.greatest(F.lit(0.1), confidence - 0.15 * notes), 4)).otherwise(confidence)
