"""Registered queries over the given tables, each with an independent SQL version where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.adapters import load, spread, sql
from tallyhound.functions import columns as c
from tallyhound.functions import terms as t
from tallyhound.operators import capture, reports, resolve, scoring, validate
from tallyhound.operators import latest as w
from tallyhound.operators import signals as g
from tallyhound.operators import upsert as u
from tallyhound.plans import scoring as plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}



def _halves(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to the mean of ``order``, and those that came in later."""
    middle = F.lit(rows.agg(F.avg(order)).first()[0])
    early = F.coalesce(F.col(order) <= middle, F.lit(True))
    return rows.filter(early), rows.filter(~early)


def as_of() -> Column:
    """The moment that stands for now in queries on signals."""
    return F.lit("2024-02-15 00:00:00").cast("timestamp")


def jobs_as_of() -> Column:
    return F.lit("2001-12-01 00:00:00").cast("timestamp")



def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _terms(text: str, words) -> str:
    return f"list_filter({_list(words)}, lambda w: contains({text}, w))"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in words) + ")"


def _case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + " END"


_LATEST = "latest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY calculated_at DESC, id DESC) = 1)"
_AGE = "greatest(0, floor((epoch_us(TIMESTAMP '2024-02-15') - epoch_us(detected_at)) / 86400000000.0))"
_CONTRIBUTION = f"CAST(round_even(CAST({_case('signal_type', t.INTENT_WEIGHTS)} * CASE WHEN {_AGE} <= 30 THEN 1.0::DOUBLE WHEN {_AGE} <= 90 THEN 0.8::DOUBLE WHEN {_AGE} <= 180 THEN 0.55::DOUBLE ELSE 0.25::DOUBLE END AS DECIMAL(18, 6))::DOUBLE, 0) AS INTEGER)"
_INTENT = f""",
k AS (SELECT *, {_CONTRIBUTION} AS contribution FROM signals),
n AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY contribution DESC NULLS LAST, id) AS nth FROM k WHERE contribution > 0),
p AS (SELECT company_id, max(contribution) AS a, sum(CASE WHEN nth BETWEEN 2 AND 4 THEN contribution ELSE 0 END) AS b FROM n GROUP BY company_id),
q AS (SELECT company_id, count(*) AS signal_count, count(*) FILTER (signal_type IN {_in(t.TENDER_TYPES)}) AS tender_count,
             array_to_string(list_sort(list(DISTINCT signal_type) FILTER (contribution > 0)), ', ') AS signal_types FROM k GROUP BY company_id),
intent AS (
  SELECT q.*, CASE WHEN a IS NULL THEN 0 ELSE least(100, least(100, a + round_even(b * 0.25, 0)) + CASE WHEN tender_count > 1 THEN least(25, 5 * (tender_count - 1)) ELSE 0 END) END::INTEGER AS intent_score
  FROM q LEFT JOIN p USING (company_id))"""
_HOST = "CASE WHEN regexp_matches(canonical_domain, '\\.([a-z]{2,24})$') THEN canonical_domain END"


@query(sql("signals", _INTENT + " SELECT company_id, signal_count, tender_count, coalesce(signal_types, '') AS signal_types, intent_score FROM intent"))
def intent_scores(spark, sf):
    out = scoring.intent(load(spark, sf, "signals")[0], as_of())
    return out.select("company_id", "signal_count", "tender_count", F.array_join("signal_types", ", ").alias("signal_types"), "intent_score")


_WHOLE = "lower(concat_ws(' ', coalesce(canonical_name, ''), coalesce(canonical_domain, ''), coalesce(description, ''), coalesce(industry, ''), coalesce(country, ''), coalesce(city, ''), coalesce(company_stage, '')))"
_IDENTITY = "lower(concat_ws(' ', coalesce(canonical_name, ''), coalesce(canonical_domain, ''), coalesce(industry, '')))"
_JOB_WORDS = ("engineer", "developer", "software", "platform", "data", "product", "automation")
_SCORE = _INTENT + f""",
org AS (SELECT company_id, signal_type AS org_type, description AS org_description FROM signals WHERE signal_type IN {_in(t.ORG_TYPES[:2])}
        QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY signal_type = '{t.ORG_TYPES[1]}', detected_at DESC, id DESC) = 1),
j AS (SELECT company_id, count(*) FILTER (is_active AND {_any("lower(concat_ws(' ', title, department, description_text))", _JOB_WORDS)}) AS active_jobs FROM jobs GROUP BY company_id),
v AS (SELECT company_id, count(*) FILTER (verification_status IN ('manual_verified', 'provider_verified')) AS verified FROM contacts GROUP BY company_id),
bar AS (SELECT DISTINCT lower(domain) AS barred FROM suppression WHERE domain IS NOT NULL),
base AS (
  SELECT c.*, c.id AS company_id, i.intent_score, coalesce(j.active_jobs, 0) AS active_jobs, org_type, org_description, company_type, sector, coalesce(verified, 0) > 0 AS verified,
         barred IS NOT NULL AS suppressed, {_terms(_WHOLE, t.INDUSTRY_TERMS)} AS industries,
         {_any(_IDENTITY, t.COMPETITOR_TERMS)} AND NOT {_any(_IDENTITY, t.PUBLIC_BODY_TERMS)} AS rival, {_any(_IDENTITY, t.CRYPTO_TERMS)} AS crypto
  FROM companies c JOIN intent i ON i.company_id = c.id LEFT JOIN j ON j.company_id = c.id LEFT JOIN org ON org.company_id = c.id
  LEFT JOIN classification k ON k.company_id = c.id LEFT JOIN v ON v.company_id = c.id LEFT JOIN bar ON barred = canonical_domain),
f AS (
  SELECT *, coalesce(canonical_domain IN {_in(t.SCORING_FREE_MAIL)}, false) AS free_mail, coalesce(company_type IN ('software_vendor', 'agency'), false) AS builds,
         coalesce(company_type = 'non_technical_buyer', false) AS buys, coalesce(org_type = '{t.ORG_TYPES[0]}', false) AS eng, coalesce(org_type = '{t.ORG_TYPES[1]}', false) AS small, len(industries) > 0 AS fits FROM base),
s AS (
  SELECT *, greatest(0, least(100, 45 + CASE WHEN canonical_domain IS NULL THEN -30 ELSE 10 END - 30 * free_mail::INT - 40 * suppressed::INT + CASE WHEN fits THEN 18 ELSE -6 END
         + CASE WHEN employee_estimate BETWEEN 10 AND 250 THEN 12 WHEN employee_estimate > 500 THEN -6 WHEN employee_estimate < 5 THEN -8 ELSE 0 END + least(12, 3 * active_jobs)
         - 22 * (active_jobs >= 15)::INT + CASE WHEN eng THEN -35 WHEN small THEN 14 ELSE 0 END + CASE WHEN builds THEN -40 WHEN buys THEN 20 ELSE 0 END
         - 35 * rival::INT - 25 * (crypto AND NOT fits)::INT + 5 * verified::INT)) AS fit,
         canonical_domain IS NULL OR free_mail OR suppressed OR active_jobs >= 15 OR eng OR builds OR rival OR (crypto AND NOT fits) AS disqualified FROM f),
z AS (SELECT *, CASE WHEN disqualified THEN least(fit, 35) ELSE fit END AS fit_score, CASE WHEN disqualified THEN least(intent_score, 45) ELSE intent_score END AS capped FROM s)
SELECT company_id, fit_score::INTEGER AS fit_score, capped::INTEGER AS intent_score, CAST(round_even(CAST(fit_score * capped / 100 AS DECIMAL(18, 6))::DOUBLE, 0) AS INTEGER) AS total_score, disqualified,
  array_to_string(list_filter([
    CASE WHEN canonical_domain IS NOT NULL THEN 'Company has a resolvable domain.' END,
    CASE WHEN fits THEN 'Industry fit matches ' || array_to_string(industries[:3], ', ') || '.' END,
    CASE WHEN employee_estimate BETWEEN 10 AND 250 THEN 'Company size fits serviceable SMB/mid-market.' END,
    CASE WHEN active_jobs > 0 THEN active_jobs || ' active relevant hiring signal(s) support service fit.' END,
    CASE WHEN small AND NOT eng THEN 'GitHub shows no substantial in-house engineering footprint.' END,
    CASE WHEN buys THEN 'Classified as a non-technical buyer' || coalesce(' (' || sector || ')', '') || '.' END,
    CASE WHEN verified THEN 'Verified contact evidence already exists.' END], lambda x: x IS NOT NULL), ' | ') AS positive_reasons,
  array_to_string(list_filter([
    CASE WHEN canonical_domain IS NULL THEN 'No accessible company domain.' END,
    CASE WHEN free_mail THEN 'Company domain is a free-mail domain.' END,
    CASE WHEN suppressed THEN 'Domain is suppressed.' END,
    CASE WHEN NOT fits THEN 'No explicit target-industry fit found.' END,
    CASE WHEN employee_estimate > 500 THEN 'Large company; verify engineering capacity before outreach.' END,
    CASE WHEN employee_estimate < 5 THEN 'Company may be too small for paid engineering help.' END,
    CASE WHEN active_jobs >= 15 THEN 'Large active engineering hiring footprint may indicate strong in-house team.' END,
    CASE WHEN eng THEN 'GitHub shows substantial in-house engineering: ' || org_description END,
    CASE WHEN builds THEN 'Classified as ' || company_type || ': builds software rather than buying it.' END,
    CASE WHEN rival THEN 'Agency/consultancy competitor.' END,
    CASE WHEN crypto AND NOT fits THEN 'Crypto-only or unclear business.' END], lambda x: x IS NOT NULL), ' | ') AS penalties
FROM z"""


@query(sql("companies signals jobs contacts classification suppression", _SCORE))
def score_companies(spark, sf):
    out = plans.score_companies(*load(spark, sf, "companies", "signals", "jobs", "contacts", "classification", "suppression"), as_of())
    return out.select("company_id", "fit_score", "intent_score", "total_score", "disqualified", F.array_join("positive_reasons", " | ").alias("positive_reasons"), F.array_join("penalties", " | ").alias("penalties"))


@query(sql("companies signals scores contacts suppression", f""", {_LATEST},
e AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY detected_at DESC, id) AS nth FROM (SELECT *, {_CONTRIBUTION} AS contribution FROM signals) WHERE contribution > 0),
d AS (SELECT company_id, arg_min(description, nth) AS reason_to_write FROM e GROUP BY company_id),
h AS (SELECT company_id, string_agg(source_url, ';' ORDER BY first_at) AS evidence_urls FROM (SELECT company_id, source_url, min(nth) AS first_at FROM e WHERE source_url IS NOT NULL GROUP BY ALL) x GROUP BY company_id)
SELECT k.id AS contact_id, k.company_id, k.email, l.total_score, d.reason_to_write, h.evidence_urls
FROM contacts k JOIN latest l USING (company_id) JOIN companies c ON c.id = k.company_id JOIN d USING (company_id) JOIN h USING (company_id)
WHERE l.total_score >= 20 AND verification_status IN ('manual_verified', 'provider_verified')
  AND NOT EXISTS (SELECT 1 FROM suppression s WHERE lower(s.email) = lower(k.email)) AND NOT EXISTS (SELECT 1 FROM suppression s WHERE lower(s.domain) = lower(c.canonical_domain))
ORDER BY l.total_score DESC, k.confidence DESC, c.canonical_name, k.email LIMIT 200"""))
def send_ready_export(spark, sf):
    companies, signals, scores, contacts, suppression = load(spark, sf, "companies", "signals", "scores", "contacts", "suppression")
    out = plans.send_ready_export(companies, scores, contacts, suppression, scoring.trigger_evidence(signals, as_of()), 20, ("manual_verified", "provider_verified"), 200)
    return out.select("contact_id", "company_id", "email", "total_score", "reason_to_write", F.array_join("evidence_urls", ";").alias("evidence_urls"))


_RANK = "list_position(" + _list(t.TRIGGER_RANK) + ", signal_type)"
_SHEET = f""", {_LATEST},
sg AS (SELECT company_id, count(*) AS signal_count, string_agg(DISTINCT signal_type, ', ' ORDER BY signal_type) AS signal_types FROM signals GROUP BY company_id),
tr AS (SELECT company_id, signal_type AS primary_trigger_type, description AS primary_trigger FROM signals WHERE signal_type IN {_in(t.TRIGGER_RANK)}
       QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY {_RANK}, confidence DESC, detected_at DESC, id) = 1),
cs AS (SELECT company_id, count(*) AS contact_count, string_agg(DISTINCT contact_kind, ', ' ORDER BY contact_kind) AS contact_kinds, bool_or(contact_kind = 'person') AS person, bool_or(contact_kind = 'role_inbox') AS inbox FROM contacts GROUP BY company_id),
aj AS (SELECT company_id, count(*) FILTER (is_active) AS active_jobs FROM jobs GROUP BY company_id),
gh AS (SELECT company_id, bool_or(signal_type = '{t.ORG_TYPES[0]}') AS eng FROM signals WHERE signal_type IN {_in(t.ORG_TYPES)} GROUP BY company_id),
sheet AS (
  SELECT c.id AS company_id, c.canonical_name AS company, l.total_score, k.company_type, coalesce(signal_count, 0) AS signal_count, signal_types, primary_trigger_type, primary_trigger, coalesce(contact_count, 0) AS contact_count,
    coalesce(active_jobs, 0) AS active_jobs, coalesce(eng, false) AS has_engineering_org,
    CASE WHEN k.company_type IN ('software_vendor', 'agency') OR coalesce(eng, false) THEN 9 WHEN k.company_type <> 'non_technical_buyer' THEN 4
      WHEN live AND coalesce(person, false) THEN 0 WHEN live AND coalesce(inbox, false) THEN 1 WHEN past THEN 2 WHEN live THEN 3 ELSE 4 END AS tier_sort
  FROM companies c JOIN latest l ON l.company_id = c.id JOIN classification k ON k.company_id = c.id LEFT JOIN sg ON sg.company_id = c.id LEFT JOIN tr ON tr.company_id = c.id LEFT JOIN cs ON cs.company_id = c.id
  LEFT JOIN aj ON aj.company_id = c.id LEFT JOIN gh ON gh.company_id = c.id
  LEFT JOIN (SELECT company_id AS lc, bool_or(signal_type IN {_in(t.LIVE_FUNDED_TYPES)}) AS live, bool_or(signal_type = 'PROCUREMENT_HISTORY') AS past FROM signals GROUP BY company_id) ON lc = c.id)"""


@query(sql("companies scores classification signals contacts jobs", _SHEET + " SELECT *, CASE tier_sort WHEN 9 THEN 'X' WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS tier FROM sheet"))
def datasheet_companies(spark, sf):
    out, _ = plans.ranked_datasheet(*load(spark, sf, "companies", "scores", "classification", "signals", "contacts", "jobs"))
    return out.select("company_id", "company", "total_score", "company_type", "signal_count", "signal_types", "primary_trigger_type", "primary_trigger", "contact_count", "active_jobs", "has_engineering_org", "tier_sort", "tier")


@query(sql("companies scores classification signals contacts jobs", _SHEET + """ SELECT k.email, s.company_id, s.tier_sort,
  row_number() OVER (ORDER BY tier_sort, list_position(['person', 'role_inbox', 'generic', 'unknown'], contact_kind), total_score DESC, company, k.email) AS rank FROM contacts k JOIN sheet s USING (company_id)"""))
def datasheet_leads(spark, sf):
    _, leads = plans.ranked_datasheet(*load(spark, sf, "companies", "scores", "classification", "signals", "contacts", "jobs"))
    return leads.select("email", "company_id", "tier_sort", "rank")


@query(sql("sources records signals scores boards jobs contacts outcomes", f""", {_LATEST},
pairs AS (SELECT source_id AS source_key, company_id FROM records WHERE company_id IS NOT NULL UNION SELECT source, company_id FROM signals WHERE company_id IS NOT NULL AND source <> ''),
src AS (SELECT source_key, source_type, count(r.id) AS source_records, count(DISTINCT r.company_id) AS linked_companies FROM sources s LEFT JOIN records r ON r.source_id = s.id GROUP BY ALL),
sig AS (SELECT source AS source_key, count(*) AS signals, count(DISTINCT company_id) AS signal_companies FROM signals WHERE source <> '' GROUP BY source),
sc AS (SELECT source_key, count(*) FILTER (total_score >= 20) AS score_20_companies, count(*) FILTER (total_score >= 50) AS score_50_companies FROM pairs JOIN latest USING (company_id) GROUP BY source_key),
b AS (SELECT source_key, count(*) AS ats_boards FROM pairs JOIN boards USING (company_id) GROUP BY source_key),
j AS (SELECT source_key, count(*) AS job_postings FROM pairs JOIN jobs USING (company_id) GROUP BY source_key),
k AS (SELECT source_key, count(*) FILTER (verification_status = 'manual_verified') AS manual_verified_contacts, count(*) FILTER (verification_status = 'provider_verified') AS provider_verified_contacts FROM pairs JOIN contacts USING (company_id) GROUP BY source_key),
o AS (SELECT source_key, count(*) FILTER (event = 'sent') AS sent, count(*) FILTER (event = 'positive_reply') AS positive_replies, count(*) FILTER (event = 'meeting_booked') AS meetings, count(*) FILTER (event = 'bounced') AS bounces FROM pairs JOIN outcomes USING (company_id) GROUP BY source_key),
a AS (
  SELECT coalesce(src.source_key, sig.source_key) AS source_key, coalesce(source_type, 'signal') AS source_type, coalesce(source_records, 0) AS source_records, coalesce(linked_companies, 0) AS linked_companies, coalesce(signals, 0) AS signals, coalesce(signal_companies, 0) AS signal_companies
  FROM src FULL JOIN sig ON src.source_key = sig.source_key),
m AS (
  SELECT a.*, coalesce(score_20_companies, 0) AS score_20_companies, coalesce(score_50_companies, 0) AS score_50_companies, coalesce(ats_boards, 0) AS ats_boards, coalesce(job_postings, 0) AS job_postings, coalesce(manual_verified_contacts, 0) AS manual_verified_contacts,
    coalesce(provider_verified_contacts, 0) AS provider_verified_contacts, coalesce(sent, 0) AS sent, coalesce(positive_replies, 0) AS positive_replies, coalesce(meetings, 0) AS meetings, coalesce(bounces, 0) AS bounces
  FROM a LEFT JOIN sc USING (source_key) LEFT JOIN b USING (source_key) LEFT JOIN j USING (source_key) LEFT JOIN k USING (source_key) LEFT JOIN o USING (source_key))
SELECT *, CASE WHEN positive_replies > 0 OR meetings > 0 THEN 'scale_commercially' WHEN score_20_companies >= 20 AND manual_verified_contacts + provider_verified_contacts = 0 THEN 'scale_source_fix_contacts'
  WHEN source_records >= 20 AND score_20_companies < 5 THEN 'drop_or_rework_source' WHEN source_records < 20 THEN 'needs_more_sample' WHEN manual_verified_contacts + provider_verified_contacts > 0 THEN 'ready_for_small_outreach' ELSE 'keep_testing' END AS decision
FROM m"""))
def source_funnel(spark, sf):
    sources, records, signals, scores, boards, jobs, contacts, outcomes = load(spark, sf, "sources", "records", "signals", "scores", "boards", "jobs", "contacts", "outcomes")
    out = reports.funnel(sources, records, signals, scores, boards, jobs, contacts, outcomes)
    return out.drop("verified_contacts", "record_rate", "score20_rate", "contact_rate", "action")


@query(sql("companies signals scores", f""", {_LATEST},
st AS (SELECT *, CAST(raw_evidence->'signal'->>'age_days' AS INTEGER) AS age FROM signals WHERE signal_type = 'STALE_ENGINEERING_ROLE'),
g AS (SELECT company_id, max(age) AS max_age_days, count(*) AS stale_roles, arg_max(raw_evidence->>'title', age::BIGINT * 1000000000 - id) AS oldest_role, arg_max(coalesce(source_url, ''), age::BIGINT * 1000000000 - id) AS evidence_url FROM st WHERE age >= 75 GROUP BY company_id),
o AS (SELECT company_id, signal_type FROM signals WHERE signal_type IN {_in(t.ORG_TYPES)} QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY detected_at DESC, id DESC) = 1)
SELECT canonical_name AS company, canonical_domain AS domain, max_age_days, stale_roles, oldest_role, nullif(evidence_url, '') AS evidence_url, coalesce(total_score, 0) AS score,
  CASE WHEN o.signal_type = '{t.ORG_TYPES[0]}' THEN 'has_in_house_engineering' WHEN o.signal_type IS NULL THEN 'unknown_not_checked' ELSE 'no_substantial_in_house_engineering' END AS engineering_presence
FROM g JOIN companies c ON c.id = g.company_id LEFT JOIN o ON o.company_id = g.company_id LEFT JOIN latest l ON l.company_id = g.company_id"""))
def stale_no_engineering_gate(spark, sf):
    signals, companies, scores = load(spark, sf, "signals", "companies", "scores")
    return reports.gate_report(signals, companies, scores, 75).orderBy(*reports.gate_order())


@query(sql("companies scores suppression signals", f""", {_LATEST},
ty AS (SELECT company_id, list(DISTINCT signal_type) AS k FROM signals GROUP BY company_id),
ro AS (SELECT company_id, k, list_concat(CASE WHEN list_has_any(k, ['STALE_ENGINEERING_ROLE', 'AGING_ENGINEERING_ROLE']) THEN ['CTO', 'VP Engineering', 'Head of Product', 'Founder'] ELSE [] END,
  list_concat(CASE WHEN list_contains(k, 'HIRING_SPIKE') THEN ['CTO', 'VP Engineering', 'COO', 'Founder'] ELSE [] END, CASE WHEN list_contains(k, 'OPERATIONS_SOFTWARE_NEED') THEN ['COO', 'Head of Operations', 'Head of Digital', 'Founder'] ELSE [] END)) AS r FROM ty)
SELECT c.id AS company_id, canonical_name AS company, canonical_domain AS domain, total_score,
  array_to_string(list_sort(list_distinct(list_concat(r, list_concat(CASE WHEN len(r) = 0 AND list_contains(k, 'HIRING_DISCOVERY') THEN ['CTO', 'VP Engineering', 'Head of Talent', 'Founder'] ELSE [] END, CASE WHEN list_contains(k, 'FUNDING_EVENT') THEN ['Founder'] ELSE [] END)))), '; ') AS target_roles
FROM companies c JOIN latest l ON l.company_id = c.id JOIN ro ON ro.company_id = c.id
WHERE total_score >= 20 AND canonical_domain <> 'gmail.com' AND NOT EXISTS (SELECT 1 FROM suppression s WHERE lower(s.domain) = canonical_domain)
ORDER BY total_score DESC, company LIMIT 300"""))
def provider_targets(spark, sf):
    companies, scores, suppression, signals = load(spark, sf, "companies", "scores", "suppression", "signals")
    return plans.provider_targets(companies, scores, suppression, signals, 20, 300).select("company_id", "company", "domain", "total_score", "target_roles")


@query(sql("companies contacts scores", f""", {_LATEST},
q AS (
  SELECT k.id, k.company_id, k.email, total_score AS score, CASE WHEN split_part(email, '@', 2) <> canonical_domain OR canonical_domain IS NULL THEN 'external_email' WHEN split_part(email, '@', 1) IN ('info', 'contact', 'hello', 'careers', 'team') THEN 'generic_inbox'
    WHEN split_part(email, '@', 1) IN {_in(t.ROLE_LOCAL_PARTS)} THEN 'low_value_generic_inbox' ELSE 'direct_person' END AS candidate_type, full_name, role
  FROM contacts k JOIN companies c ON c.id = k.company_id JOIN latest l ON l.company_id = c.id),
x AS (SELECT *, CASE candidate_type WHEN 'external_email' THEN 'reject_external_domain' WHEN 'low_value_generic_inbox' THEN 'reject_low_value_generic' WHEN 'generic_inbox' THEN 'fallback_generic_inbox'
  ELSE CASE WHEN full_name IS NOT NULL AND role IS NOT NULL THEN 'strong_direct_person' WHEN role IS NOT NULL THEN 'role_backed_direct_email' WHEN id % 2 = 0 THEN 'mailto_direct_email' ELSE 'direct_email_needs_context' END END AS candidate_quality FROM q)
SELECT id, email, score, candidate_type, candidate_quality, {_case('candidate_quality', t.QUALITY_RANK)} AS priority_rank,
  CASE WHEN candidate_quality = 'strong_direct_person' THEN 'inspect_source_then_approve' WHEN candidate_quality = 'fallback_generic_inbox' THEN 'fallback_only' WHEN candidate_quality LIKE 'reject%' THEN 'reject' ELSE 'inspect_source' END AS suggested_decision FROM x"""))
def manual_review_queue(spark, sf):
    companies, contacts, scores = load(spark, sf, "companies", "contacts", "scores")
    score = w.latest(scores, ["company_id"], F.col("calculated_at").desc(), F.col("id").desc()).select("company_id", F.col("total_score").alias("score"))
    rows = contacts.join(companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company"), F.col("canonical_domain").alias("company_domain")), "company_id").join(score, "company_id")
    rows = rows.withColumn("extraction", F.when(F.col("id") % 2 == 0, "mailto_link").otherwise("page_text"))
    return plans.review_queue(rows).select("id", "email", "score", "candidate_type", "candidate_quality", "priority_rank", "suggested_decision")


@query(sql("records", r""",
e AS (SELECT id, company_id, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS raw FROM records),
m AS (SELECT id, company_id, lower(regexp_replace(raw, '[.,;:)]+$', '')) AS email FROM e)
SELECT email, min(id) AS id FROM m WHERE NOT contains(email, '..') AND regexp_matches(email, '\.[a-z]{2,24}$') GROUP BY email"""))
def published_contact_queue(spark, sf):
    rows = load(spark, sf, "records")[0].withColumns({"domain": F.lit("corp.example.com"), "score": F.lit(10)})
    return plans.published_queue(rows).select("email", "id")


@query(sql("companies contacts scores signals", f""", {_LATEST},
d AS (SELECT company_id, CASE min(id) % 6 WHEN 0 THEN 'A role appears open for 70 days.' WHEN 1 THEN '3 relevant roles appeared within 30 days: x.' WHEN 2 THEN 'x suggests internal tooling or' WHEN 3 THEN 'x mentions stack or' WHEN 4 THEN 'x published this address in Ask HN: y' ELSE 'else' END AS reason FROM signals GROUP BY company_id),
mx AS (SELECT DISTINCT split_part(email, '@', 2) AS domain, company_id % 5 AS n FROM contacts),
q AS (
  SELECT k.id, k.email, total_score AS score, reason, k.contact_kind = 'role_inbox' AS generic, coalesce(split_part(k.email, '@', 2) = canonical_domain, false) AS own,
    CASE WHEN k.company_id % 5 = 4 THEN 'dns_error' WHEN k.company_id % 5 = 0 THEN 'no_mx_record' WHEN split_part(k.email, '@', 1) = 'info' THEN 'role_address' ELSE 'deliverable_domain' END AS deliverability,
    CASE WHEN contains(lower(reason), 'appears open for') THEN 'stale_role' WHEN contains(lower(reason), 'relevant roles appeared') THEN 'hiring_spike' WHEN contains(lower(reason), 'suggests internal tooling') THEN 'operations_need' WHEN contains(lower(reason), 'mentions stack') THEN 'tech_stack_need' WHEN contains(reason, 'published this address in Ask HN') THEN 'hn_post_only' ELSE 'other' END AS trigger_type
  FROM contacts k JOIN companies c ON c.id = k.company_id JOIN latest l ON l.company_id = c.id JOIN d ON d.company_id = c.id),
x AS (SELECT *, CASE WHEN deliverability NOT IN ('deliverable_domain', 'role_address') THEN 9 WHEN trigger_type NOT IN ('hn_post_only', 'other') THEN CASE WHEN own AND NOT generic THEN 0 WHEN own THEN 1 ELSE 2 END WHEN own AND NOT generic THEN 3 ELSE 4 END AS tier_sort FROM q)
SELECT id, deliverability, trigger_type, tier_sort, row_number() OVER (ORDER BY tier_sort, score DESC, email) AS rank FROM x"""))
def send_ready_sheet(spark, sf):
    companies, contacts, scores, signals = load(spark, sf, "companies", "contacts", "scores", "signals")
    score = w.latest(scores, ["company_id"], F.col("calculated_at").desc(), F.col("id").desc()).select("company_id", F.col("total_score").alias("score"))
    says = ("A role appears open for 70 days.", "3 relevant roles appeared within 30 days: x.", "x suggests internal tooling or", "x mentions stack or", "x published this address in Ask HN: y", "else")
    reason = signals.groupBy("company_id").agg(F.get(c.lits(says), (F.min("id") % 6).cast("int")).alias("reason_to_write"))
    mx = contacts.select(F.col("email"), F.col("company_id")).select(c.email_domain(F.col("email")).alias("domain"), (F.col("company_id") % 5).cast("int").alias("mx_count"), F.when(F.col("company_id") % 5 == 4, "timeout").alias("error")).distinct()
    rows = contacts.join(companies.select(F.col("id").alias("company_id"), "canonical_domain"), "company_id").join(score, "company_id").join(reason, "company_id")
    rows = rows.withColumns({"is_generic_email": F.col("contact_kind") == "role_inbox", "is_company_domain_email": F.coalesce(c.email_domain(F.col("email")) == F.col("canonical_domain"), F.lit(False))})
    return plans.send_ready_sheet(rows, mx).select("id", "deliverability", "trigger_type", "tier_sort", "rank")


@query(sql("companies scores signals contacts jobs outcomes", f""", {_LATEST},
b AS (SELECT company_id, signal_type AS best_signal FROM signals QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY confidence DESC, detected_at DESC, id) = 1)
SELECT c.id AS company_id, canonical_name AS company, total_score, best_signal, (SELECT count(*) FROM signals x WHERE x.company_id = c.id) AS signals, (SELECT count(*) FROM contacts x WHERE x.company_id = c.id) AS contacts,
  (SELECT count(*) FROM jobs x WHERE x.company_id = c.id) AS jobs, (SELECT count(*) FROM outcomes x WHERE x.company_id = c.id) AS outcomes
FROM companies c LEFT JOIN latest l ON l.company_id = c.id LEFT JOIN b ON b.company_id = c.id"""))
def company_workbook(spark, sf):
    return plans.company_workbook(*load(spark, sf, "companies", "scores", "signals", "contacts", "jobs", "outcomes"))


@query(sql("companies signals jobs", """
SELECT min(id) AS id, canonical_domain AS probe_domain, 'ok' AS reason FROM companies c
WHERE canonical_domain IS NOT NULL AND EXISTS (SELECT 1 FROM signals s WHERE s.company_id = c.id AND signal_type IN ('HIRING_DISCOVERY', 'FUNDING_EVENT')) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.company_id = c.id)
GROUP BY canonical_domain"""))
def probe_targets(spark, sf):
    """Companies without any job."""
    return plans.probe_targets(*load(spark, sf, "companies", "signals", "jobs")).select("id", "probe_domain", "reason")


@query(sql("companies", """
SELECT company_id, company, part, "0" AS turn_0, "1" AS turn_1, "2" AS turn_2 FROM (
  SELECT conv_id AS company_id, canonical_name AS company, turn // 3 AS part, max(text) FILTER (turn % 3 = 0) AS "0", max(text) FILTER (turn % 3 = 1) AS "1", max(text) FILTER (turn % 3 = 2) AS "2"
  FROM (SELECT conv_id, turn, arg_max(text, role || text) AS text FROM conversations GROUP BY ALL) JOIN companies ON id = conv_id GROUP BY ALL)"""))
def message_facts(spark, sf):
    """All turns, a row for every three."""
    companies, lines = load(spark, sf, "companies", "conversations")
    facts = lines.select(F.col("conv_id").alias("company_id"), F.floor(F.col("turn") / 3).alias("part"), F.concat(F.lit("turn_"), (F.col("turn") % 3).cast("string")).alias("field"), F.col("text").alias("value"), F.lit(0).alias("observed_at"), F.concat("role", "text").alias("id"))
    return plans.message_facts(facts, companies, ["turn_0", "turn_1", "turn_2"], ("company_id", "part")).select("company_id", "company", "part", "turn_0", "turn_1", "turn_2")


_TITLE = "lower(concat_ws(' ', title, department))"
_TEXT = "lower(concat_ws(' ', title, department, description_text))"
_JOBAGE = "CAST(greatest(0, floor((epoch_us(TIMESTAMP '2001-12-01') - epoch_us(coalesce(posted_at, first_seen_at))) / 86400000000.0)) AS INTEGER)"
_ABLE = f"NOT {_any('lower(title)', t.NON_TECHNICAL_TITLES)}"


@query(sql("jobs", f""",
j AS (SELECT *, {_JOBAGE} AS age, {_ABLE} AS able, {_any(_TITLE, t.ROLE_KEYWORDS)} AS relevant, {_terms(_TEXT, t.TECH_STACK_TERMS)} AS stack, {_terms(_TEXT, t.OPERATIONS_TERMS)} AS needs, {_any(_TITLE, t.OPERATIONS_TITLES)} AS ops FROM jobs),
s AS (
  SELECT external_job_id, company_id, CASE WHEN age >= 90 THEN 'STALE_ENGINEERING_ROLE' ELSE 'AGING_ENGINEERING_ROLE' END AS signal_type, CASE WHEN age >= 90 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence, title || ' role appears open for ' || age || ' days.' AS description FROM j WHERE able AND relevant AND age >= 60
  UNION ALL SELECT external_job_id, company_id, 'TECH_STACK_NEED', 0.7::DOUBLE, title || ' mentions stack or integration needs: ' || array_to_string(stack[:5], ', ') || '.' FROM j WHERE able AND relevant AND len(stack) > 0
  UNION ALL SELECT external_job_id, company_id, 'OPERATIONS_SOFTWARE_NEED', 0.75::DOUBLE, title || ' suggests internal tooling or operations software need: ' || array_to_string(needs[:5], ', ') || '.' FROM j WHERE able AND ops AND len(needs) > 0)
SELECT * FROM s"""))
def job_signals(spark, sf):
    jobs = spread(load(spark, sf, "jobs")[0]).withColumn("stack_terms", F.array().cast("array<string>"))
    return g.job_signals(jobs, jobs_as_of()).select("external_job_id", "company_id", "signal_type", "confidence", "description")


@query(sql("jobs", f"""
SELECT company_id, ats_provider, ats_board_id, count(*) AS job_count FROM jobs
WHERE is_active AND {_any(_TITLE, t.ROLE_KEYWORDS)} AND floor((epoch_us(TIMESTAMP '2001-12-01') - epoch_us(first_seen_at)) / 86400000000.0) <= 900
GROUP BY ALL HAVING count(*) >= 2"""))
def hiring_spikes(spark, sf):
    jobs = load(spark, sf, "jobs")[0]
    return g.hiring_spikes(jobs, jobs, jobs_as_of(), days=900, least=2).select("company_id", "ats_provider", "ats_board_id", "job_count")


@query(sql("jobs", """,
p AS (SELECT DISTINCT company_id, ats_provider, ats_board_id, external_job_id, is_active, 0 AS missing_observation_count FROM jobs WHERE l_returnflag <> 'N'),
n AS (SELECT DISTINCT company_id, ats_provider, ats_board_id, external_job_id FROM jobs WHERE l_returnflag = 'N')
SELECT external_job_id, ats_board_id, CASE WHEN miss THEN 1 ELSE 0 END AS missing_observation_count, is_active AND NOT miss AS is_active FROM (
  SELECT p.*, is_active AND (company_id, ats_board_id) IN (SELECT company_id, ats_board_id FROM n) AND (company_id, ats_board_id, external_job_id) NOT IN (SELECT company_id, ats_board_id, external_job_id FROM n) AS miss FROM p)"""))
def missing_jobs(spark, sf):
    jobs = load(spark, sf, "jobs")[0]
    keys = ["company_id", "ats_provider", "ats_board_id", "external_job_id"]
    stored = jobs.filter("l_returnflag <> 'N'").select(*keys, "is_active").distinct().withColumns({"missing_observation_count": F.lit(0), "missing_since_at": F.lit(None).cast("timestamp")})
    out = g.missing_observations(stored, jobs.filter("l_returnflag = 'N'").select(*keys), jobs_as_of(), threshold=1)
    return out.select("external_job_id", "ats_board_id", "missing_observation_count", "is_active")


@query(sql("jobs", """,
o AS (SELECT *, row_number() OVER (PARTITION BY company_id, ats_provider, external_job_id ORDER BY l_partkey, ats_board_id, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, first_seen_at) AS nth,
  lag(title) OVER (PARTITION BY company_id, ats_provider, external_job_id ORDER BY l_partkey, ats_board_id, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, first_seen_at) AS before FROM jobs WHERE l_returnflag <> 'A'),
a AS (SELECT company_id, ats_provider, external_job_id, arg_max(title, l_partkey * 100000 + ats_board_id) AS title FROM jobs WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT status, count(*) AS jobs FROM (
  SELECT CASE WHEN old IS NULL THEN 'inserted' WHEN old = title THEN 'duplicate' ELSE 'updated' END AS status
  FROM (SELECT o.title, CASE WHEN nth > 1 THEN before ELSE a.title END AS old FROM o LEFT JOIN a USING (company_id, ats_provider, external_job_id))) GROUP BY status"""))
def job_changes(spark, sf):
    jobs = load(spark, sf, "jobs")[0]
    keys = ["company_id", "ats_provider", "external_job_id"]
    stored = jobs.filter("l_returnflag = 'A'").groupBy(*keys).agg(F.max_by("title", F.col("l_partkey") * 100000 + F.col("ats_board_id")).alias("title"))
    order = F.struct("l_partkey", "ats_board_id", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "first_seen_at")
    new = jobs.filter("l_returnflag <> 'A'").withColumn("index", order)
    return u.classify_changes(new, stored, keys, "title").groupBy("status").agg(F.count("*").alias("jobs"))


@query(sql("jobs", f"""
SELECT external_job_id, title,
  CASE WHEN regexp_matches({_TEXT}, '\\b(engineering|developer|software|backend|frontend|platform|devops|qa|sre)\\b') THEN 'Engineering' WHEN regexp_matches({_TEXT}, '\\b(product manager|product designer|product)\\b') THEN 'Product'
    WHEN regexp_matches({_TEXT}, '\\b(data|analytics|machine learning|ai)\\b') THEN 'Data' WHEN regexp_matches({_TEXT}, '\\b(operations|automation|ops)\\b') THEN 'Operations' END AS inferred_department,
  nullif(regexp_extract(concat_ws(' ', title, department, description_text), '(?i)\\b(remote|hybrid|onsite|on-site|new york|london|san francisco|berlin|paris|amsterdam|antwerp|ontario|canada|united states|usa|us)\\b', 1), '') AS inferred_location,
  CASE WHEN contains({_TEXT}, 'remote') THEN 'remote' WHEN contains({_TEXT}, 'hybrid') THEN 'hybrid' WHEN contains({_TEXT}, 'onsite') OR contains({_TEXT}, 'on-site') THEN 'onsite' END AS remote_policy,
  CASE WHEN contains({_TEXT}, 'part-time') OR contains({_TEXT}, 'part time') THEN 'part_time' WHEN contains({_TEXT}, 'contract') THEN 'contract' WHEN regexp_matches({_TEXT}, '\\bintern(ship)?\\b') THEN 'internship' WHEN contains({_TEXT}, 'full-time') OR contains({_TEXT}, 'full time') THEN 'full_time' END AS employment_type,
  CASE WHEN regexp_matches(lower(title), '\\b(staff|principal|lead)\\b') THEN 'staff' WHEN regexp_matches(lower(title), '\\b(senior|sr\\.?)\\b') THEN 'senior' WHEN regexp_matches(lower(title), '\\b(junior|jr\\.?|entry)\\b') THEN 'junior' END AS seniority,
  array_to_string(list_sort({_terms(_TEXT, t.TECH_STACK_TERMS)}), ',') AS stack, length(title) BETWEEN 4 AND 120 AND regexp_matches(title, '(?i)\\b(engineer|developer|designer|product|data|platform|backend|frontend|full[- ]?stack|devops|qa|manager|analyst|architect|operations|automation)\\b') AS is_title
FROM jobs"""))
def job_inference(spark, sf):
    jobs = spread(load(spark, sf, "jobs")[0])
    text = F.concat_ws(" ", "title", "department", "description_text")
    return jobs.select("external_job_id", "title", c.infer_department(text).alias("inferred_department"), c.infer_location(text).alias("inferred_location"), c.infer_remote_policy(text).alias("remote_policy"), c.infer_employment_type(text).alias("employment_type"), c.infer_seniority(F.col("title")).alias("seniority"), F.array_join(c.stack_terms(text), ",").alias("stack"), c.looks_like_job_title(F.col("title")).alias("is_title"))


@query("""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:/?#]*://([^/?#:]*)', 1)), '^www\\.', '') AS host, array_to_string(string_split(regexp_replace(lower(regexp_extract(url, '^[^:/?#]*://([^/?#:]*)', 1)), '^www\\.', ''), '.')[-2:], '.') AS root,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS base, CASE WHEN regexp_matches(url, '(?i)/(blog|news|insights)') THEN 'blog' WHEN regexp_matches(url, '(?i)(docs\\.|/docs|/documentation)') THEN 'docs' END AS kind FROM pages""")
def page_hosts(spark, sf):
    pages = load(spark, sf, "pages")[0]
    host = c.normalize_domain(F.col("url"))
    return pages.select("page_id", host.alias("host"), c.root_domain(host).alias("root"), c.base_url(F.col("url")).alias("base"), c.presence_kind(F.col("url")).alias("kind"))


@query(sql("contacts", f"""
SELECT id, split_part(email, '@', 1) AS local, split_part(email, '@', 2) AS domain, CASE WHEN split_part(email, '@', 1) IN {_in(t.ROLE_LOCAL_PARTS)} THEN 'role_inbox' WHEN regexp_matches(split_part(email, '@', 1), '^[a-z]{{2,}}([._-][a-z]{{2,}})?$') THEN 'person' ELSE 'generic' END AS kind,
  CASE WHEN split_part(email, '@', 1) IN {_in(t.ROLE_LOCAL_PARTS)} THEN 'role_address' ELSE 'deliverable_domain' END AS label FROM contacts"""))
def email_labels(spark, sf):
    e = F.col("email")
    return load(spark, sf, "contacts")[0].select("id", c.local_part(e).alias("local"), c.email_domain(e).alias("domain"), c.classify_local_part(e).alias("kind"), c.deliverability(e, F.lit(1), F.lit(None).cast("string")).alias("label"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda e: lower(e)))), ',') AS emails,
  length(regexp_replace(text, '\\S+', 'x', 'g')) - length(regexp_replace(regexp_replace(text, '\\S+', 'x', 'g'), 'x', '', 'g')) AS words, sha256(text) AS hash FROM documents""")
def text_facts(spark, sf):
    docs = load(spark, sf, "documents")[0]
    return docs.select("doc_id", F.array_join(c.extract_emails(F.col("text")), ",").alias("emails"), c.word_count(F.col("text")).cast("long").alias("words"), F.sha2("text", 256).alias("hash"))


@query(sql("records", """,
h AS (SELECT *, sha256(text) AS hash FROM records)
SELECT source_id, count(*) AS accepted, count(*) FILTER (old IS NULL) AS inserted, count(*) FILTER (old = hash) AS duplicates, count(*) FILTER (old <> hash) AS updated FROM (
  SELECT n.source_id, n.hash, coalesce(lag(n.hash) OVER (PARTITION BY n.source_id, n.company_id ORDER BY n.id), o.hash) AS old
  FROM (SELECT * FROM h WHERE id % 2 = 1 AND company_id IS NOT NULL) n LEFT JOIN (SELECT source_id, company_id, arg_max(hash, id) AS hash FROM h WHERE id % 2 = 0 AND company_id IS NOT NULL GROUP BY ALL) o ON n.source_id = o.source_id AND n.company_id = o.company_id) GROUP BY source_id"""))
def record_changes(spark, sf):
    rows = load(spark, sf, "records")[0].filter("company_id IS NOT NULL").withColumn("hash", F.sha2("text", 256))
    old = rows.filter("id % 2 = 0").groupBy("source_id", "company_id").agg(F.max_by("hash", "id").alias("hash"))
    out = u.classify_changes(rows.filter("id % 2 = 1"), old, ["source_id", "company_id"], "hash", "id")
    n = lambda s: F.count_if(F.col("status") == s)
    return out.groupBy("source_id").agg(F.count("*").alias("accepted"), n("inserted").alias("inserted"), n("duplicate").alias("duplicates"), n("updated").alias("updated"))


@query(sql("records", """
SELECT company_id, coalesce(max(lang) FILTER (id = l), NULL) AS lang, coalesce(max(source_id) FILTER (id = s), NULL) AS source_id FROM (
  SELECT *, min(id) FILTER (lang IS NOT NULL) OVER (PARTITION BY company_id) AS l, min(id) FILTER (source_id <> 'src0') OVER (PARTITION BY company_id) AS s FROM records WHERE company_id IS NOT NULL) GROUP BY company_id"""))
def merged_records(spark, sf):
    rows = load(spark, sf, "records")[0].filter("company_id IS NOT NULL").withColumn("source_id", F.nullif("source_id", F.lit("src0")))
    keys, fields = ["company_id"], ["lang", "source_id"]
    first, second = _halves(rows, "id")
    stored = u.merge_fill_nulls(first, first.select(*keys, *fields).limit(0), keys, fields, "id")
    return u.merge_fill_nulls(second, stored, keys, fields, "id")


@query(sql("companies records", """,
c AS (SELECT * FROM companies WHERE country < 'J'),
r AS (SELECT x.id, canonical_name AS name, canonical_domain AS domain FROM records x LEFT JOIN companies y ON y.id = x.company_id)
SELECT id, CASE WHEN name IS NULL THEN 'review_missing_name' WHEN domain IS NULL THEN 'review_missing_domain' WHEN EXISTS (SELECT 1 FROM c WHERE canonical_domain = domain) THEN 'match_domain'
  WHEN id = min(id) FILTER (name IS NOT NULL) OVER (PARTITION BY domain) THEN 'create' ELSE 'match_domain' END AS action FROM r"""))
def identity_resolution(spark, sf):
    """Every record under its own company, or none; companies of countries before J are stored, the others come in by records alone."""
    companies, records = load(spark, sf, "companies", "records")
    named = companies.select(F.col("id").alias("k"), F.col("canonical_name").alias("name"), F.col("canonical_domain").alias("domain"))
    rows = records.select("id", F.col("id").alias("created_at"), F.col("company_id").alias("k")).join(named, "k", "left").withColumn("company_id", F.lit(None).cast("long"))
    return u.resolve_identities(rows, companies.filter("country < 'J'")).select("id", "action")


@query(sql("sources records", """
SELECT source_key, count(r.id) AS records, count(DISTINCT r.company_id) AS companies, max(r.id) AS latest_collected_at FROM sources s LEFT JOIN records r ON r.source_id = s.id GROUP BY source_key"""))
def source_rows(spark, sf):
    sources, records = load(spark, sf, "sources", "records")
    return reports.source_rows(sources, records.withColumn("collected_at", F.col("id")))


@query(sql("scores", "SELECT company_id, id, total_score FROM scores s WHERE calculated_at = (SELECT max(calculated_at) FROM scores x WHERE x.company_id = s.company_id)"))
def latest_scores_with_ties(spark, sf):
    return w.latest_with_ties(load(spark, sf, "scores")[0], ["company_id"], "calculated_at").select("company_id", "id", "total_score")


@query(sql("boards companies", f"""
SELECT b.id, CASE WHEN board_token LIKE '%5' THEN 'quarantine' WHEN canonical_domain IS NULL THEN 'quarantine' WHEN regexp_replace(board_token, '[^a-z0-9]', '', 'g')[1:5] = regexp_replace(split_part(canonical_domain, '.', 1), '[^a-z0-9]', '', 'g')[1:5]
  OR contains(regexp_replace(board_token, '[^a-z0-9]', '', 'g'), regexp_replace(split_part(canonical_domain, '.', 1), '[^a-z0-9]', '', 'g')) THEN 'keep' ELSE 'quarantine' END AS bucket,
  CASE WHEN board_token LIKE '%5' THEN 'invalid_board_token' WHEN canonical_domain IS NULL THEN 'board_token_does_not_match_domain' WHEN regexp_replace(board_token, '[^a-z0-9]', '', 'g')[1:5] = regexp_replace(split_part(canonical_domain, '.', 1), '[^a-z0-9]', '', 'g')[1:5] THEN 'token_matches_domain' ELSE 'board_token_does_not_match_domain' END AS reason
FROM (SELECT id, company_id, CASE WHEN id % 2 = 0 THEN replace(board_token, 'supplier', 'customer') ELSE board_token END AS board_token FROM boards) b JOIN companies c ON c.id = b.company_id"""))
def board_triage(spark, sf):
    boards, companies = load(spark, sf, "boards", "companies")
    token = F.when(F.col("id") % 2 == 0, F.replace("board_token", F.lit("supplier"), F.lit("customer"))).otherwise(F.col("board_token"))
    rows = boards.withColumn("board_token", F.when(F.col("board_token").endswith("5"), F.concat(token, F.lit(".js"))).otherwise(token)).join(companies.select(F.col("id").alias("company_id"), F.col("canonical_domain").alias("domain")), "company_id")
    return validate.triage_board_detections(rows.withColumn("record_type", F.lit("board"))).select("id", "bucket", "reason")


@query(sql("companies contacts", """,
r AS (SELECT k.id AS row_number, canonical_name AS company, coalesce(canonical_domain, '') AS domain, k.email, k.role FROM contacts k JOIN companies c ON c.id = k.company_id)
SELECT row_number, 'domain' AS field, 'is required' AS message FROM r WHERE domain = ''
UNION ALL SELECT row_number, 'domain', 'must be a company domain' FROM r WHERE domain = ''
UNION ALL SELECT row_number, 'target_person', 'target_person or target_role is required' FROM r WHERE role IS NULL
UNION ALL SELECT row_number, 'email', 'must be a person-level email' FROM r WHERE email LIKE 'info@%'
UNION ALL SELECT row_number, 'email', 'email domain must match company domain' FROM r WHERE domain <> '' AND split_part(email, '@', 2) <> domain
UNION ALL SELECT row_number, 'role_age_days', 'must be at least 60' FROM r WHERE row_number % 100 < 60"""))
def campaign_issues(spark, sf):
    companies, contacts = load(spark, sf, "companies", "contacts")
    rows = contacts.join(companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company"), F.col("canonical_domain").alias("domain")), "company_id")
    text = {f: F.lit("x") for f in ("segment", "trigger_summary", "message_angle", "email_source", "email_verification")}
    rows = rows.withColumns(text | {"row_number": F.col("id"), "trigger_type": F.lit("stale_hiring"), "trigger_url": F.lit("https://x.example/y"), "target_person": F.lit(""), "target_role": F.col("role"), "role_age_days": (F.col("id") % 100).cast("string")})
    return validate.campaign_issues(rows, {})


@query(sql("outcomes contacts", """
SELECT event, count(*) AS outcomes, count(k.id) AS with_contact FROM outcomes o LEFT JOIN contacts k ON k.company_id = o.company_id AND k.contact_kind = 'person' GROUP BY event"""))
def outcome_targets(spark, sf):
    outcomes, contacts, companies = load(spark, sf, "outcomes", "contacts", "companies")
    contacts = contacts.withColumn("created_at", F.col("id"))
    email = F.concat(F.lit("JANE.DOE@customer-"), F.lpad(F.col("company_id").cast("string"), 9, "0"), F.lit(".com"))
    rows = outcomes.withColumns({"contact_id": F.lit(None).cast("long"), "email": email})
    out = resolve.resolve_outcome_target(rows, contacts, companies)
    return out.groupBy("event").agg(F.count("*").alias("outcomes"), F.count("target_contact").alias("with_contact"))


@query(sql("jobs", """
SELECT 'unique_job' AS "constraint", count(*) - count(DISTINCT (company_id, external_job_id)) AS violations FROM jobs
UNION ALL SELECT 'discount_range', count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) FROM jobs UNION ALL SELECT 'active_has_url', count(*) FILTER (is_active AND url IS NULL) FROM jobs"""))
def constraint_audit(spark, sf):
    jobs = load(spark, sf, "jobs")[0]
    return validate.audit_constraints(jobs, {"unique_job": ["company_id", "external_job_id"]}, {"discount_range": F.col("l_discount").between(0, 0.05), "active_has_url": ~F.col("is_active") | F.col("url").isNotNull()})


@query(sql("suppression", "SELECT reason, count(*) AS rows FROM suppression GROUP BY reason"))
def suppression_by_reason(spark, sf):
    return reports.counts(load(spark, sf, "suppression")[0], "reason")


@query(sql("suppression", """,
n AS (SELECT lower(email) AS email, lower(domain) AS domain FROM suppression WHERE coalesce(email, domain) IS NOT NULL)
SELECT DISTINCT email, domain FROM n WHERE coalesce(email, '') NOT IN (SELECT lower(email) FROM suppression WHERE email IS NOT NULL AND reason = 'opt_out') AND coalesce(domain, '') NOT IN (SELECT lower(domain) FROM suppression WHERE domain IS NOT NULL AND reason = 'opt_out')"""))
def new_suppressions(spark, sf):
    rows = load(spark, sf, "suppression")[0]
    return u.add_suppression(rows.withColumn("index", F.coalesce("email", "domain")), rows.filter("reason = 'opt_out'")).select("email", "domain")


@query("SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_line FROM conversations")
def previous_lines(spark, sf):
    return w.previous_line(load(spark, sf, "conversations")[0], "conv_id", "turn", "text").select("conv_id", "turn", "text", "previous_line")


@query("""
SELECT company_id, unnest(['n_chars', 'lang', 'source']) AS field, unnest([n_chars::VARCHAR, lang, source]) AS value FROM (SELECT doc_id AS company_id, n_chars, lang, source FROM documents)""")
def observations(spark, sf):
    docs = load(spark, sf, "documents")[0].withColumnRenamed("doc_id", "company_id")
    return u.explode_observations(docs, "company_id", ["n_chars", "lang", "source"])


@query("""
WITH q AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark), d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)
SELECT item_id, doc_id FROM q JOIN d ON contains(t, q) WHERE q <> ''""")
def attested_quotes(spark, sf):
    """Every benchmark text in every document, both whole."""
    return validate.attested_quotes(*load(spark, sf, "benchmark", "documents"))


@query()
def page_contacts(spark, sf):
    """Addresses and phones of saved pages, parsed once."""
    pages = load(spark, sf, "pages")[0]
    parsed = capture.parse_html(pages).withColumn("domain", c.normalize_domain(F.col("url")))
    mx = parsed.select("domain", F.lit(1).alias("mx_count"), F.lit(None).cast("string").alias("error")).distinct()
    emails = capture.capture_emails(parsed, mx).select("page_id", F.col("email").alias("value"), F.lit("email").alias("kind"), "extraction")
    phones = capture.capture_phones(parsed).select("page_id", F.col("phone").alias("value"), F.lit("phone").alias("kind"), "extraction")
    return emails.unionByName(phones)


@query()
def page_facts(spark, sf):
    """Facts of saved pages: heading, links, technologies."""
    parsed = capture.parse_html(load(spark, sf, "pages")[0])
    return capture.page_facts(parsed, ("contact", "team", "about")).select("page_id", "title", "positioning", "n_links", F.array_join("technologies", ",").alias("technologies"))


@query()
def review_sample(spark, sf):
    """A reproducible sample for review: 25 documents, the feature's size."""
    return w.sample_rows(load(spark, sf, "documents")[0].select("doc_id", "lang", "source"), "doc_id", 25)


_DISCOVERY = """,
b AS (
  SELECT doc_id AS "index", source, doc_id % 300 AS source_record_id, 'https://feed.example/' || (doc_id % 40) AS source_url, CASE WHEN doc_id % 37 = 0 THEN NULL ELSE 'Company ' || lang END AS company_name,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 'site-' || (doc_id % 90) || '.com' END AS domain, ['funding', 'tender', 'hiring_post', 'past_tender', 'other'][doc_id % 5 + 1] AS event_type FROM documents)"""


def _discovery_batch(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    kinds = c.lits(("funding", "tender", "hiring_post", "past_tender", "other"))
    return load(spark, sf, "documents")[0].select(
        i.alias("index"), "source", (i % 300).cast("string").alias("source_record_id"), text("https://feed.example/", i % 40).alias("source_url"),
        F.when(i % 37 != 0, F.concat(F.lit("Company "), "lang")).alias("company_name"), F.when(i % 29 != 0, text("https://www.Site-", i % 90, ".com/jobs")).alias("website"),
        F.lit(None).cast("string").alias("domain"), F.get(kinds, (i % 5).cast("int")).alias("event_type"), F.lit(None).cast("string").alias("event_summary"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("date").alias("event_date"),
    )


def _ingest(spark, sf) -> dict[str, DataFrame]:
    """What the earlier half of the batch and then, against all that it stored, the later half bring in."""
    from tallyhound.plans.ingest import ingest_discovery

    first, second = _halves(_discovery_batch(spark, sf), "index")
    keys = ["source", "source_record_id"]
    companies = load(spark, sf, "companies")[0].select(F.col("id").cast("string").alias("id"), "canonical_domain")
    signals = load(spark, sf, "signals")[0].select(F.col("company_id").cast("string").alias("company_id"), "signal_type", "source", "source_url")
    a = ingest_discovery(first, first.select(*keys, F.lit("").alias("content_hash")).limit(0), companies, signals, as_of())
    records = a["records"].groupBy(*keys).agg(F.max_by("content_hash", "index").alias("content_hash"))
    companies = companies.unionByName(a["companies"].select(F.col("company_id").alias("id"), F.col("domain").alias("canonical_domain")))
    signals = signals.unionByName(a["signals"].select(*signals.columns))
    b = ingest_discovery(second, records, companies, signals, as_of())
    return {name: a[name].unionByName(b[name]) for name in a}


@query("WITH x AS (SELECT 1)" + _DISCOVERY + """
SELECT "index", signal_type, confidence, description FROM (
  SELECT *, CASE event_type WHEN 'funding' THEN 'FUNDING_EVENT' WHEN 'tender' THEN 'PROCUREMENT_NOTICE' WHEN 'hiring_post' THEN 'HIRING_DISCOVERY' WHEN 'past_tender' THEN 'PROCUREMENT_HISTORY' END AS signal_type,
    CASE event_type WHEN 'funding' THEN 0.8::DOUBLE WHEN 'tender' THEN 0.9::DOUBLE WHEN 'hiring_post' THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END AS confidence, company_name || ' discovered from ' || source || '.' AS description
  FROM b WHERE domain IS NOT NULL AND company_name IS NOT NULL) WHERE signal_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain, signal_type, source, source_url ORDER BY "index") = 1""")
def discovery_signals(spark, sf):
    return _ingest(spark, sf)["signals"].select("index", "signal_type", "confidence", "description")


@query("WITH x AS (SELECT 1)" + _DISCOVERY + " SELECT CASE WHEN domain IS NULL THEN 'missing_domain' ELSE 'missing_company_name' END AS reason, count(*) AS rows FROM b WHERE domain IS NULL OR company_name IS NULL GROUP BY ALL")
def discovery_rejects(spark, sf):
    return reports.counts(_ingest(spark, sf)["rejects"], "reason")


@query("WITH x AS (SELECT 1)" + _DISCOVERY + " SELECT domain, arg_min(company_name, \"index\") AS canonical_name FROM b WHERE domain IS NOT NULL AND company_name IS NOT NULL GROUP BY domain")
def discovery_companies(spark, sf):
    return _ingest(spark, sf)["companies"].select("domain", "canonical_name")


@query(sql("contacts", """
SELECT company_id, count(*) AS contact_count, string_agg(DISTINCT contact_kind, ', ' ORDER BY contact_kind) AS contact_kinds, bool_or(contact_kind = 'person') AS has_person_contact, bool_or(contact_kind = 'role_inbox') AS has_role_contact FROM contacts GROUP BY company_id"""))
def contact_summary(spark, sf):
    return reports.contact_summary(load(spark, sf, "contacts")[0])


@query(sql("records sources", "SELECT company_id, string_agg(DISTINCT source_key, ', ' ORDER BY source_key) AS sources FROM records r JOIN sources s ON s.id = r.source_id WHERE company_id IS NOT NULL GROUP BY company_id"))
def source_summary(spark, sf):
    records, sources = load(spark, sf, "records", "sources")
    return reports.source_summary(records.filter("company_id IS NOT NULL"), sources)


@query(sql("scores", """
SELECT id, company_id, total_score, row_number() OVER (ORDER BY total_score DESC, id) AS rank FROM scores"""))
def score_ranks(spark, sf):
    return w.global_rank(load(spark, sf, "scores")[0], F.col("total_score").desc(), F.col("id")).select("id", "company_id", "total_score", "rank")


@query(sql("signals", """
SELECT id, company_id, signal_type FROM signals QUALIFY row_number() OVER (PARTITION BY company_id, signal_type, source, coalesce(source_url, '') ORDER BY id) = 1"""))
def signals_once(spark, sf):
    signals = load(spark, sf, "signals")[0]
    first, second = _halves(signals, "id")
    stored = g.insert_signal_once(first, first.limit(0), "id")
    return stored.unionByName(g.insert_signal_once(second, stored, "id")).select("id", "company_id", "signal_type")


@query(sql("outcomes companies", """
SELECT c.id AS company_id, canonical_name FROM companies c WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.company_id = c.id AND o.event = 'bounced')"""))
def companies_without_bounces(spark, sf):
    outcomes, companies = load(spark, sf, "outcomes", "companies")
    return resolve.without(companies, outcomes.filter("event = 'bounced'")).select(F.col("id").alias("company_id"), "canonical_name")


@query(sql("contacts", """
SELECT company_id, id, email FROM contacts QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY confidence DESC, id) <= 2"""))
def contacts_capped(spark, sf):
    """Two contacts per company, the feature's cap."""
    return w.top_per_key(load(spark, sf, "contacts")[0], ["company_id"], 2, F.col("confidence").desc(), F.col("id")).select("company_id", "id", "email")


from tallyhound import queries_intake, queries_pages, queries_records, queries_streams, queries_targets  # noqa: E402,F401  register their queries
