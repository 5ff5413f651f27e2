"""Aggregations for reports and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.functions import terms as t
from tallyhound.operators.latest import latest
from tallyhound.operators.scoring import source_decision


def listing(column: str) -> Column:
    """Sorted distinct values, separated by commas."""
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def signal_summary(signals: DataFrame) -> DataFrame:
    return signals.groupBy("company_id").agg(F.count("*").alias("signal_count"), listing("signal_type").alias("signal_types"))


def contact_summary(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("company_id").agg(F.count("*").alias("contact_count"), listing("contact_kind").alias("contact_kinds"), F.bool_or(F.col("contact_kind") == "person").alias("has_person_contact"), F.bool_or(F.col("contact_kind") == "role_inbox").alias("has_role_contact"))


def presence_summary(presence: DataFrame) -> DataFrame:
    return presence.groupBy("company_id").agg(F.count("*").alias("web_presence_count"), listing("presence_kind").alias("web_presence_kinds"))


def source_summary(records: DataFrame, sources: DataFrame) -> DataFrame:
    return records.join(sources.select(F.col("id").alias("source_id"), "source_key"), "source_id").groupBy("company_id").agg(listing("source_key").alias("sources"))


def active_job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("company_id").agg(F.count_if("is_active").alias("active_jobs"))


def engineering_flag(signals: DataFrame) -> DataFrame:
    rows = signals.filter(F.col("signal_type").isin(*t.ORG_TYPES))
    return rows.groupBy("company_id").agg(F.bool_or(F.col("signal_type") == t.ORG_TYPES[0]).alias("has_engineering_org"))


def verified_contact_count(contacts: DataFrame, statuses: tuple[str, ...] = ("manual_verified", "provider_verified")) -> DataFrame:
    return contacts.groupBy("company_id").agg(F.count_if(F.col("verification_status").isin(*statuses)).alias("verified_contacts"))


def stale_roles(signals: DataFrame, min_days: int) -> DataFrame:
    """Stale roles per company: the greatest age, their number, and title and URL of the oldest (least id of several)."""
    age = F.get_json_object("raw_evidence", "$.signal.age_days").try_cast("int")
    rows = signals.filter(F.col("signal_type") == "STALE_ENGINEERING_ROLE").withColumn("age_days", age).filter(F.col("age_days") >= min_days)
    oldest = F.struct(F.col("age_days"), (-F.col("id").cast("long")).alias("_o"))
    return rows.groupBy("company_id").agg(F.max("age_days").alias("max_age_days"), F.count("*").alias("stale_roles"), F.max_by(F.get_json_object("raw_evidence", "$.title"), oldest).alias("oldest_role"), F.max_by("source_url", oldest).alias("evidence_url"))


def engineering_presence(signal_type: Column) -> Column:
    return F.when(signal_type == t.ORG_TYPES[0], "has_in_house_engineering").when(signal_type.isNull(), "unknown_not_checked").otherwise("no_substantial_in_house_engineering")


def gate_report(signals: DataFrame, companies: DataFrame, scores: DataFrame, min_days: int) -> DataFrame:
    """Companies with stale roles, whether they have engineers of their own, and their latest score."""
    org = latest(signals.filter(F.col("signal_type").isin(*t.ORG_TYPES)), ["company_id"], F.col("detected_at").desc(), F.col("id").desc()).select("company_id", "signal_type")
    score = latest(scores, ["company_id"], F.col("calculated_at").desc(), F.col("id").desc()).select("company_id", "total_score")
    named = companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company"), F.col("canonical_domain").alias("domain"))
    rows = stale_roles(signals, min_days).join(named, "company_id").join(org, "company_id", "left").join(score, "company_id", "left")
    return rows.select("company", "domain", "max_age_days", "stale_roles", "oldest_role", "evidence_url", F.coalesce("total_score", F.lit(0)).alias("score"), engineering_presence(F.col("signal_type")).alias("engineering_presence"))


def gate_order() -> list[Column]:
    rank = F.when(F.col("engineering_presence") == "has_in_house_engineering", 2).when(F.col("engineering_presence") == "unknown_not_checked", 1).otherwise(0)
    return [rank, F.col("score").desc(), F.col("max_age_days").desc(), F.col("company")]


def counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per value, most first; serves presence, reason, tier, suppression and reject counts."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), key)


def source_rows(sources: DataFrame, records: DataFrame) -> DataFrame:
    per = records.groupBy("source_id").agg(F.count("*").alias("records"), F.countDistinct("company_id").alias("companies"), F.max("collected_at").alias("latest_collected_at"))
    return sources.join(per, F.col("id") == F.col("source_id"), "left").select("source_key", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("companies", F.lit(0)).alias("companies"), "latest_collected_at")


def source_companies(sources: DataFrame, records: DataFrame, signals: DataFrame) -> DataFrame:
    """Distinct ``source_key, company_id`` of linked records and of signals."""
    linked = records.filter("company_id IS NOT NULL").join(sources.select(F.col("id").alias("source_id"), "source_key"), "source_id").select("source_key", "company_id")
    told = signals.filter("company_id IS NOT NULL AND coalesce(source, '') <> ''").select(F.col("source").alias("source_key"), "company_id")
    return linked.unionByName(told).distinct()


def funnel(sources: DataFrame, records: DataFrame, signals: DataFrame, scores: DataFrame, boards: DataFrame, jobs: DataFrame, contacts: DataFrame, outcomes: DataFrame, legacy: tuple[str, ...] = ()) -> DataFrame:
    """Counts per source from records to outcomes, rates and a decision.

    Boards, jobs, contacts and outcomes are counted per company first and then added over a source's companies, so no join multiplies rows.
    """
    pairs = source_companies(sources, records, signals)
    per_record = sources.join(records, F.col("id") == F.col("source_id"), "left") if "id" not in records.columns else sources.select(F.col("id").alias("source_id"), "source_key", "source_type").join(records.select("source_id", "company_id", F.lit(1).alias("_r")), "source_id", "left")
    per_record = per_record.groupBy("source_key", "source_type").agg(F.count("_r").alias("source_records"), F.countDistinct("company_id").alias("linked_companies"))
    per_signal = signals.filter("coalesce(source, '') <> ''").groupBy(F.col("source").alias("source_key")).agg(F.count("*").alias("signals"), F.countDistinct("company_id").alias("signal_companies"))
    score = latest(scores, ["company_id"], F.col("calculated_at").desc(), F.col("id").desc()).select("company_id", "total_score")
    n = lambda df, name, cond=None: df.groupBy("company_id").agg((F.count("*") if cond is None else F.count_if(cond)).alias(name))
    status, event = F.col("verification_status"), F.col("event")
    per_contact = contacts.groupBy("company_id").agg(F.count_if(status == "manual_verified").alias("manual_verified_contacts"), F.count_if(status == "provider_verified").alias("provider_verified_contacts"))
    per_outcome = outcomes.groupBy("company_id").agg(*(F.count_if(event == e).alias(a) for e, a in (("sent", "sent"), ("positive_reply", "positive_replies"), ("meeting_booked", "meetings"), ("bounced", "bounces"))))
    joined = pairs.join(score, "company_id", "left").join(n(boards, "ats_boards"), "company_id", "left").join(n(jobs, "job_postings"), "company_id", "left").join(per_contact, "company_id", "left").join(per_outcome, "company_id", "left")
    sums = ["ats_boards", "job_postings", "manual_verified_contacts", "provider_verified_contacts", "sent", "positive_replies", "meetings", "bounces"]
    per_source = joined.groupBy("source_key").agg(F.count_if(F.col("total_score") >= 20).alias("score_20_companies"), F.count_if(F.col("total_score") >= 50).alias("score_50_companies"), *(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums))
    out = per_record.join(per_signal, "source_key", "full_outer").join(per_source, "source_key", "left")
    numbers = ["source_records", "linked_companies", "signals", "signal_companies", "score_20_companies", "score_50_companies", *sums]
    out = out.fillna(0, numbers).withColumn("source_type", F.coalesce("source_type", F.lit("signal")))
    verified = F.col("manual_verified_contacts") + F.col("provider_verified_contacts")
    decision = source_decision(F.col("source_key").isin(*legacy) if legacy else F.lit(False), F.col("positive_replies"), F.col("meetings"), F.col("source_records"), F.col("score_20_companies"), verified)
    out = out.withColumns({"verified_contacts": verified, "decision": decision})
    return out.withColumns({
        "record_rate": c.percent(F.col("signal_companies"), F.col("source_records")),
        "score20_rate": c.percent(F.col("score_20_companies"), F.col("signal_companies")),
        "contact_rate": c.percent(F.col("verified_contacts"), F.col("score_20_companies")),
        "action": c.lookup(F.col("decision"), t.SOURCE_ACTIONS, F.lit("Review manually.")),
    })


def accuracy_report(reviews: DataFrame) -> DataFrame:
    """Verdicts per method, and the accurate share of reviewed rows (null where none is)."""
    v = F.col("review_verdict")
    out = reviews.groupBy("method").agg(F.count("*").alias("rows"), F.count_if(v.isNotNull()).alias("reviewed"), F.count_if(v == "accurate").alias("accurate"))
    return out.withColumn("accuracy", F.round(F.try_divide("accurate", F.nullif("reviewed", F.lit(0))), 4))


def spend_report(usage: DataFrame) -> DataFrame:
    """Cost, calls and companies per purpose, and the cost per company."""
    out = usage.groupBy("purpose").agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"), F.countDistinct("company_id").alias("companies"))
    return out.withColumn("cost_per_company", F.round(F.try_divide(F.col("cost").cast("double"), F.nullif("companies", F.lit(0))), 6))


def ingest_summary(changes: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row of counts of a batch."""
    done = changes.agg(F.count("*").alias("accepted"), *(F.count_if(F.col("status") == s).alias(a) for s, a in (("inserted", "inserted"), ("updated", "updated"), ("duplicate", "duplicates"))))
    out = done.crossJoin(rejects.agg(F.count("*").alias("rejected")))  # one row by one row
    return out.withColumn("received", F.col("accepted") + F.col("rejected"))


def probe_coverage(rows: DataFrame, fields: list[str], people: str | None = None) -> DataFrame:
    """Rows with each field, and the people in them."""
    have = [F.count_if(c.blank_to_null(F.col(f).cast("string")).isNotNull()).alias(f"with_{f}") for f in fields]
    extra = [F.sum(F.size(people)).alias("people"), F.sum(F.size(F.filter(people, lambda p: p["linkedin_url"].isNotNull()))).alias("people_with_linkedin")] if people else []
    return rows.agg(F.count("*").alias("rows"), *have, *extra)


def parser_health(runs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Success rate per parser, unmeasured ones first."""
    out = runs.groupBy("source_key").agg(F.avg(F.col("ok").cast("double")).alias("success_rate"), F.count("ok").alias("sample_size"))
    return out.withColumn("degraded", F.coalesce(F.col("success_rate") < threshold, F.lit(True))).orderBy(F.asc_nulls_first("success_rate"), "source_key")


def research_rollup(pages: DataFrame) -> DataFrame:
    """Page facts (``company_id, page_number, positioning, technologies, routes``) per company: the first positioning that isn't blank and
    distinct unions, cut to 20 and 10 (the feature's limits). Values are ranked by first sight and cut before they are collected."""
    said = c.blank_to_null(F.col("positioning"))
    out = pages.groupBy("company_id").agg(F.min_by("positioning", F.when(said.isNotNull(), F.col("page_number"))).alias("positioning"), F.count("*").alias("pages"))
    for field, most in (("technologies", 20), ("routes", 10)):
        each = pages.select("company_id", "page_number", F.posexplode(field).alias("_at", "_v")).groupBy("company_id", "_v").agg(F.min(F.struct("page_number", "_at")).alias("_first"))
        top = each.withColumn("_n", F.row_number().over(Window.partitionBy("company_id").orderBy("_first"))).filter(F.col("_n") <= most)
        lists = top.groupBy(F.col("company_id").alias("_c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"]).alias(field))
        out = out.join(lists, F.col("company_id").eqNullSafe(F.col("_c")), "left").drop("_c").withColumn(field, F.coalesce(field, F.array().cast("array<string>")))
    return out
