"""Registered queries on intake: validation, resolution, upserts against stored rows, summaries; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.adapters import load, spread, sql
from tallyhound.functions import columns as c
from tallyhound.functions import terms as t
from tallyhound.operators import latest as w
from tallyhound.operators import reports, resolve, scoring, validate
from tallyhound.operators import signals as g
from tallyhound.operators import upsert as u
from tallyhound.plans import ingest
from tallyhound.plans import scoring as plans
from tallyhound.queries import QUERIES, SQL, query
from tallyhound.sources import tables
from tallyhound.store import shared_dir


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _outcome(good: DataFrame, rejects: DataFrame) -> DataFrame:
    """All rows of a validation: ``index`` and the reason, null for good ones."""
    return good.select("index", F.lit(None).cast("string").alias("reason")).unionByName(rejects)


# --- validation -------------------------------------------------------------------------------------------------------------------


@query("""
SELECT doc_id AS "index", CASE WHEN source IS NULL OR source = 'src1' THEN 'missing_source' WHEN source <> 'src0' THEN 'source_mismatch' WHEN doc_id % 11 = 0 THEN 'missing_source_url' WHEN doc_id % 13 = 0 THEN 'missing_source_record_id'
  WHEN lang IS NULL OR lang = 'fr' THEN 'missing_company_name' WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN 'missing_website_or_domain' END AS reason FROM documents""")
def discovery_validation(spark, sf):
    i = F.col("doc_id")
    rows = load(spark, sf, "documents")[0].select(i.alias("index"), F.nullif("source", F.lit("src1")).alias("source"), F.when(i % 11 == 0, "  ").otherwise("https://x.example").alias("source_url"), F.when(i % 13 != 0, i).alias("source_record_id"), F.nullif("lang", F.lit("fr")).alias("company_name"), F.when(i % 7 != 0, "x.example").alias("website"), F.when(i % 5 == 0, "x.example").alias("domain"))
    return _outcome(*validate.validate_discovery(rows, "src0"))


_BOARD_ROWS = """,
r AS (SELECT id AS "index", CASE WHEN id % 7 <> 0 THEN company_id END AS company_id, CASE WHEN id % 14 <> 0 THEN 'x.com' END AS domain, (id % 12) / 10.0 AS confidence,
  CASE id % 5 WHEN 0 THEN 'unheard' WHEN 1 THEN NULL ELSE ats_provider END AS ats_provider, CASE WHEN id % 3 = 0 THEN ' ' ELSE board_token END AS board_token, CASE WHEN id % 6 = 0 THEN 'https://x.com/jobs' END AS board_url FROM boards)"""
_BOARD_COMMON = "WHEN company_id IS NULL AND domain IS NULL THEN 'missing_company_reference' WHEN confidence > 1 THEN 'confidence_out_of_range'"


def _board_rows(spark, sf) -> DataFrame:
    i = F.col("id")
    return load(spark, sf, "boards")[0].select(
        i.alias("index"), F.when(i % 7 != 0, F.col("company_id")).alias("company_id"), F.when(i % 14 != 0, "x.com").alias("domain"), ((i % 12) / 10).alias("confidence"),
        F.when(i % 5 == 0, "unheard").when(i % 5 != 1, F.col("ats_provider")).alias("ats_provider"), F.when(i % 3 == 0, " ").otherwise(F.col("board_token")).alias("board_token"),
        F.when(i % 6 == 0, "https://x.com/jobs").alias("board_url"), F.lit(None).cast("string").alias("careers_url"), F.concat(F.lit("j"), i.cast("string")).alias("external_job_id"), F.when(i % 4 != 0, "Engineer").alias("title"),
    )


@query(sql("boards", _BOARD_ROWS + f""" SELECT "index", CASE {_BOARD_COMMON} WHEN ats_provider IS NULL OR ats_provider = 'unheard' THEN 'unknown_provider' WHEN trim(board_token) = '' AND board_url IS NULL THEN 'missing_board_reference' END AS reason FROM r"""))
def board_validation(spark, sf):
    return _outcome(*validate.validate_boards(_board_rows(spark, sf)))


@query(sql("boards", _BOARD_ROWS + f""" SELECT "index", CASE {_BOARD_COMMON} END AS reason FROM r"""))
def miss_validation(spark, sf):
    return _outcome(*validate.validate_misses(_board_rows(spark, sf)))


@query(sql("boards", _BOARD_ROWS + """ SELECT "index", CASE WHEN company_id IS NULL AND domain IS NULL THEN 'missing_company_reference' WHEN ats_provider IS NULL OR ats_provider = 'unheard' THEN 'unknown_provider' WHEN "index" % 4 = 0 THEN 'missing_title' END AS reason FROM r"""))
def job_validation(spark, sf):
    return _outcome(*validate.validate_jobs(_board_rows(spark, sf)))


@query(sql("contacts", """
SELECT id AS "index", CASE WHEN id % 10 = 0 THEN 'missing_email' WHEN id % 9 = 0 THEN 'invalid_email' WHEN contact_kind = 'generic' THEN 'unknown_source_type' WHEN verification_status = 'unverified' THEN 'unknown_verification_status' END AS reason FROM contacts"""))
def contact_evidence_validation(spark, sf):
    i = F.col("id")
    rows = load(spark, sf, "contacts")[0].withColumns({"index": i, "email": F.when(i % 10 == 0, " ").when(i % 9 == 0, F.replace("email", F.lit("@"), F.lit(" at "))).otherwise(F.col("email")), "source_type": F.col("contact_kind"), "source_url": F.lit(" ")})
    return _outcome(*validate.validate_contact_evidence(rows, ("role_inbox", "person"), ("manual_verified", "provider_verified")))


@query(sql("outcomes", """
SELECT id AS "index", CASE WHEN event = 'opened' AND id % 2 = 0 THEN 'unknown_event' WHEN id % 5 = 0 THEN 'invalid_email' WHEN id % 3 = 0 THEN 'missing_target' END AS reason FROM outcomes"""))
def outcome_validation(spark, sf):
    i = F.col("id")
    rows = load(spark, sf, "outcomes")[0].select(i.alias("index"), F.when((F.col("event") == "opened") & (i % 2 == 0), "seen").otherwise(F.col("event")).alias("event"), F.when(i % 5 == 0, "no address").when(i % 3 != 0, "a@b.co").alias("email"), F.lit(None).cast("long").alias("contact_id"), F.lit(None).cast("long").alias("company_id"))
    return _outcome(*validate.validate_outcomes(rows))


_CLEAN = """, latest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY calculated_at DESC, id DESC) = 1),
clean AS (SELECT c.id AS position, canonical_name AS company, canonical_domain AS domain, total_score AS score FROM companies c JOIN latest l ON l.company_id = c.id
  WHERE total_score >= 5 AND canonical_domain <> 'gmail.com' AND lower(canonical_domain) NOT IN (SELECT lower(domain) FROM suppression WHERE domain IS NOT NULL))"""


@query(sql("companies scores suppression", _CLEAN + " SELECT * FROM clean ORDER BY position OFFSET 3 LIMIT 50"))
def clean_target_list(spark, sf):
    """Targets after the first three, fifty at most: the feature's paging."""
    companies, scores, suppression = load(spark, sf, "companies", "scores", "suppression")
    score = w.latest(scores, ["company_id"], F.col("calculated_at").desc(), F.col("id").desc()).select("company_id", F.col("total_score").alias("score"))
    rows = companies.join(score, F.col("id") == F.col("company_id")).select(F.col("id").alias("position"), F.col("canonical_name").alias("company"), F.col("canonical_domain").alias("domain"), "score")
    return validate.clean_targets(rows, 5, 3, 50, suppression.filter("domain IS NOT NULL"))


@query(sql("contacts", """
SELECT id FROM contacts WHERE id % 8 <> 0 AND email <> '' AND contact_kind <> 'generic' AND verification_status <> 'unverified'"""))
def importable_contacts(spark, sf):
    i = F.col("id")
    rows = load(spark, sf, "contacts")[0].withColumns({"record_type": F.when(i % 8 == 0, "error").otherwise("contact_candidate"), "source_url": F.when(F.col("contact_kind") != "generic", "https://x.example"), "review_status": F.when(F.col("verification_status") == "manual_verified", "Approved").when(F.col("verification_status") == "provider_verified", "YES")})
    return validate.importable(rows).select("id")


@query(sql("contacts companies", "SELECT k.id FROM contacts k JOIN companies c ON c.id = k.company_id WHERE canonical_domain IS NOT NULL AND full_name IS NOT NULL"))
def contactable_contacts(spark, sf):
    contacts, companies = load(spark, sf, "contacts", "companies")
    rows = contacts.join(companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company"), F.col("canonical_domain").alias("domain")), "company_id")
    return validate.contactable(rows.withColumn("contact", F.col("full_name"))).select("id")


@query(sql("contacts companies", f"""
SELECT id, own AND NOT generic AS kept, NOT generic AS kept_anywhere, own AS kept_generic FROM (
  SELECT k.id, split_part(email, '@', 2) = canonical_domain AS own, k.id % 4 IN (1, 2) OR split_part(email, '@', 1) IN {_in(t.ROLE_LOCAL_PARTS)} AS generic
  FROM contacts k JOIN companies c ON c.id = k.company_id WHERE canonical_domain IS NOT NULL)"""))
def kept_emails(spark, sf):
    """Addresses of contacts, every fourth with a generic word glued into it, every fourth named like the company's domain."""
    contacts, companies = load(spark, sf, "contacts", "companies")
    rows = contacts.join(companies.select(F.col("id").alias("company_id"), F.col("canonical_domain").alias("domain")), "company_id").filter("domain IS NOT NULL")
    local = F.when(F.col("id") % 4 == 1, "x.careers.glued.words").when(F.col("id") % 4 == 2, F.substring_index("domain", ".", 1)).otherwise(c.local_part(F.col("email")))
    email = F.concat(local, F.lit("@"), c.email_domain(F.col("email")))
    keep = lambda **x: c.keep_email(email, F.col("domain"), **x)
    return rows.select("id", keep().alias("kept"), keep(include_external=True).alias("kept_anywhere"), keep(include_generic=True).alias("kept_generic"))


@query(f"""SELECT count(DISTINCT row_number) AS failed_rows, count(*) AS issues, (SELECT count(*) FROM customer) * 3 AS rows_seen, (SELECT count(*) FROM customer) * 3 - count(DISTINCT row_number) AS send_ready FROM ({SQL['campaign_issues']})""")
def campaign_summary(spark, sf):
    return validate.validation_summary(load(spark, sf, "contacts")[0], QUERIES["campaign_issues"](spark, sf))


# --- resolution -------------------------------------------------------------------------------------------------------------------


@query(sql("contacts companies", """,
d AS (SELECT lower(canonical_domain) AS domain, min(id) AS id FROM companies WHERE canonical_domain IS NOT NULL GROUP BY 1)
SELECT k.id AS "index", coalesce(CASE WHEN k.id % 3 = 0 THEN NULL WHEN k.id % 5 = 0 THEN NULL ELSE k.company_id END, d.id) AS resolved_id,
  CASE WHEN coalesce(CASE WHEN k.id % 3 = 0 THEN NULL WHEN k.id % 5 = 0 THEN NULL ELSE k.company_id END, d.id) IS NULL THEN 'company_not_found' END AS reason
FROM contacts k LEFT JOIN d ON d.domain = split_part(k.email, '@', 2)"""))
def resolved_contacts(spark, sf):
    """Contacts by company id, else by domain; ids that are missing or unknown fall to the domain."""
    contacts, companies = load(spark, sf, "contacts", "companies")
    i = F.col("id")
    rows = spread(contacts).select(i.alias("index"), F.when(i % 3 == 0, None).when(i % 5 == 0, -1).otherwise(F.col("company_id")).cast("long").alias("company_id"), F.concat(F.lit("https://www."), F.upper(c.email_domain(F.col("email")))).alias("domain"))
    found = resolve.with_company(rows, companies)
    return found.select("index", "resolved_id", F.when(F.col("resolved_id").isNull(), "company_not_found").alias("reason"))


@query(sql("boards", "SELECT id, CASE WHEN id % 4 <> 0 THEN id END AS ats_board_id FROM boards"))
def resolved_boards(spark, sf):
    boards = load(spark, sf, "boards")[0].withColumn("board_key", c.board_key(F.col("board_token"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    asked = boards.select(F.col("id").alias("asked"), "company_id", "ats_provider", F.when(F.col("id") % 4 == 0, "unheard").otherwise(F.col("board_key")).alias("board_key"))
    return resolve.resolve_board(asked, boards).select(F.col("asked").alias("id"), "ats_board_id")


@query(sql("companies", """,
f AS (SELECT id, lower(industry) AS name, id % 40 AS company_id FROM companies),
q AS (SELECT id, CASE WHEN id % 5 = 0 THEN id END AS wanted, lower(CASE WHEN id % 7 = 0 THEN 'Nobody' ELSE industry END) AS name, id % 60 AS company_id FROM companies),
own AS (SELECT company_id, name, min(id) AS id FROM f GROUP BY ALL), anyone AS (SELECT name, min(id) AS id FROM f GROUP BY name)
SELECT q.id, coalesce(wanted, own.id, anyone.id) AS founder_id, CASE WHEN wanted IS NOT NULL THEN 'id' WHEN own.id IS NOT NULL THEN 'company_name' WHEN anyone.id IS NOT NULL THEN 'name' END AS matched_by
FROM q LEFT JOIN own ON own.company_id = q.company_id AND own.name = q.name LEFT JOIN anyone ON anyone.name = q.name"""))
def resolved_founders(spark, sf):
    """Founders named like industries, so that names are shared: by id, by name in the company, by name alone."""
    companies = load(spark, sf, "companies")[0]
    founders = companies.select("id", F.col("industry").alias("full_name"))
    links = companies.select((F.col("id") % 40).alias("company_id"), F.col("id").alias("founder_id"))
    i = F.col("id")
    asked = companies.select("id", F.when(i % 5 == 0, i).alias("founder_id"), F.when(i % 7 == 0, "Nobody").otherwise(F.upper("industry")).alias("full_name"), (i % 60).alias("company_id"))
    return resolve.resolve_founder(asked.withColumnRenamed("id", "asked"), founders, links).select(F.col("asked").alias("id"), "founder_id", "matched_by")


@query(sql("contacts", "SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE id END AS contact_id FROM contacts"))
def resolved_contact_ids(spark, sf):
    """Contacts by company, founder and address, or by company, address and name."""
    contacts = load(spark, sf, "contacts")[0].withColumn("founder_id", F.when(F.col("contact_kind") == "person", F.col("company_id")))
    asked = contacts.select(F.col("id").alias("asked"), "company_id", "founder_id", F.upper("email").alias("email"), "full_name")
    asked = asked.withColumn("email", F.when(F.col("asked") % 6 == 0, "none@x.yz").otherwise(F.col("email")))
    return resolve.resolve_contact(asked, contacts).select(F.col("asked").alias("id"), "contact_id")


@query(sql("records", "SELECT id FROM records WHERE source_id = 'src0' AND lang = 'en' ORDER BY id DESC LIMIT 40"))
def pending_batch(spark, sf):
    """The next forty pending records of a source, the feature's batch."""
    records, sources = load(spark, sf, "records", "sources")
    rows = records.withColumns({"processing_status": F.when(F.col("lang") == "en", "pending").otherwise("linked"), "created_at": -F.col("id")})
    return resolve.pending_records(rows, sources, "src0", 40).select("id")


# --- upserts against stored rows --------------------------------------------------------------------------------------------------


@query(sql("boards", """,
n AS (SELECT *, CASE WHEN id % 3 = 0 THEN board_token || '-new' ELSE board_token END AS now FROM boards WHERE id % 5 <> 0 OR id % 2 = 1)
SELECT b.id, coalesce(n.now, b.board_token) AS board_token, CASE WHEN n.id IS NULL THEN NULL WHEN b.id % 2 = 1 THEN 'inserted' WHEN b.id % 3 = 0 THEN 'updated' ELSE 'duplicate' END AS status
FROM boards b LEFT JOIN n USING (id)"""))
def upserted_boards(spark, sf):
    """Even boards are stored; a batch of the odd ones and most even ones brings new tokens for every third. Table and status of each."""
    boards = load(spark, sf, "boards")[0]
    stored = boards.filter("id % 2 = 0")
    batch = boards.filter("id % 5 <> 0 OR id % 2 = 1").withColumns({"board_token": F.when(F.col("id") % 3 == 0, F.concat("board_token", F.lit("-new"))).otherwise(F.col("board_token")), "index": F.col("id")})
    table, changes = u.upsert_boards(batch, stored, ["id"], ["company_id", "ats_provider", "board_token"])
    return table.select("id", "board_token").join(changes.select("id", "status"), "id", "left")


@query(sql("boards", """
SELECT id AS "index", 'ATS_BOARD_DETECTED' AS signal_type, 'Detected ' || ats_provider || ' board for x.com.' AS description FROM boards WHERE id % 2 = 1 OR id % 5 <> 0 AND id % 3 = 0"""))
def board_detected_signals(spark, sf):
    boards = load(spark, sf, "boards")[0]
    batch = boards.filter("id % 5 <> 0 OR id % 2 = 1").withColumns({"board_token": F.when(F.col("id") % 3 == 0, F.concat("board_token", F.lit("-new"))).otherwise(F.col("board_token")), "index": F.col("id"), "domain": F.lit("x.com"), "board_url": F.lit("https://b.example"), "confidence": F.lit(0.9)})
    stored = boards.filter("id % 2 = 0").withColumns({"domain": F.lit("x.com"), "board_url": F.lit("https://b.example"), "confidence": F.lit(0.9)})
    _, changes = u.upsert_boards(batch, stored, ["id"], ["company_id", "ats_provider", "board_token"])
    return g.board_signals(changes).select("index", "signal_type", "description")


@query(sql("contacts", """,
k AS (SELECT *, id % 3 <> 0 OR id % 2 = 1 AS now FROM contacts)
SELECT k.company_id, k.email, coalesce(CASE WHEN k.id % 2 = 0 THEN k.full_name END, CASE WHEN now THEN 'Later Name' END) AS full_name,
  CASE WHEN now THEN 'provider' ELSE 'page' END AS contact_source, CASE WHEN now THEN 0.95 ELSE k.confidence::DOUBLE END::DOUBLE AS confidence, k.verification_status
FROM k"""))
def merged_contacts(spark, sf):
    """Even contacts are stored; a batch of the odd ones and most even ones names all and is surer. The first known name stays, the greatest confidence counts."""
    contacts = load(spark, sf, "contacts")[0]
    stored = contacts.filter("id % 2 = 0").select("company_id", "email", "full_name", "role", F.col("confidence").cast("double").alias("confidence"), F.lit("page").alias("contact_source"), "verification_status")
    batch = contacts.filter("id % 3 <> 0 OR id % 2 = 1").select("company_id", F.upper("email").alias("email"), F.lit("Later Name").alias("full_name"), "role", F.lit(0.95).alias("confidence"), F.lit("provider").alias("contact_source"), "verification_status", F.col("id").alias("index"))
    return u.merge_contacts(batch, stored).select("company_id", "email", "full_name", "contact_source", "confidence", "verification_status")


_FIVE = "company_id, coalesce(founder, ''), source, coalesce(source_url, ''), signal_type"


@query(sql("signals", f""",
e AS (SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE 'f' || id % 3 END AS founder, id % 10 < 4 AS stored FROM signals)
SELECT id FROM e WHERE NOT stored AND ({_FIVE}) NOT IN (SELECT ({_FIVE}) FROM e WHERE stored) QUALIFY row_number() OVER (PARTITION BY {_FIVE} ORDER BY id) = 1"""))
def evidence_once(spark, sf):
    """Evidence whose five-part key isn't stored; missing parts equal each other."""
    rows = load(spark, sf, "signals")[0].withColumn("founder", F.when(F.col("id") % 4 != 0, F.concat(F.lit("f"), (F.col("id") % 3).cast("string"))))
    key = [F.col(k) for k in ("company_id", "founder", "source", "source_url", "signal_type")]
    return u.insert_once(rows.filter("id % 10 >= 4"), rows.filter("id % 10 < 4"), key, "id").select("id")


_SIX = "company_id, lower(full_name), lower(coalesce(role, '')), lower(coalesce(email, '')), lower(source), lower(kind)"


@query(sql("contacts", f""",
e AS (SELECT id, company_id % 500 AS company_id, CASE WHEN id % 2 = 0 THEN 'JO DOE' ELSE 'Jo Doe' END AS full_name, role, CASE WHEN id % 3 = 0 THEN NULL ELSE contact_kind END AS email, verification_status AS source, 'page' AS kind, id % 7 = 0 AS stored FROM contacts)
SELECT id FROM e WHERE NOT stored AND ({_SIX}) NOT IN (SELECT ({_SIX}) FROM e WHERE stored) QUALIFY row_number() OVER (PARTITION BY {_SIX} ORDER BY id) = 1"""))
def decision_makers_once(spark, sf):
    """Decision makers whose six-part key, case aside, isn't stored."""
    i = F.col("id")
    rows = load(spark, sf, "contacts")[0].select("id", (F.col("company_id") % 500).alias("company_id"), F.when(i % 2 == 0, "JO DOE").otherwise("Jo Doe").alias("full_name"), "role", F.when(i % 3 != 0, F.col("contact_kind")).alias("email"), F.col("verification_status").alias("source"), F.lit("page").alias("kind"))
    key = [F.col("company_id"), *(F.lower(k) for k in ("full_name", "role", "email", "source", "kind"))]
    return u.insert_once(rows.filter("id % 7 <> 0"), rows.filter("id % 7 = 0"), key, "id").select("id")


@query(sql("contacts", """
SELECT id, CASE WHEN now THEN 2 ELSE 1 END AS last_seen, CASE WHEN id % 2 = 0 THEN 'stored' ELSE 'batch' END AS noted, CASE WHEN now THEN 'ok' ELSE 'unknown' END AS deliverability FROM (SELECT *, id % 3 <> 0 OR id % 2 = 1 AS now FROM contacts)"""))
def touched_contacts(spark, sf):
    """Known contacts are seen again, with their deliverability; other columns stay, unknown ones are added."""
    ids = load(spark, sf, "contacts")[0].select("id")
    stored = ids.filter("id % 2 = 0").withColumns({"last_seen": F.lit(1), "noted": F.lit("stored"), "deliverability": F.lit("unknown")})
    batch = ids.filter("id % 3 <> 0 OR id % 2 = 1").withColumns({"last_seen": F.lit(2), "noted": F.lit("batch"), "deliverability": F.lit("ok"), "index": F.col("id")})
    return u.touch(batch, stored, ["id"], ["last_seen", "deliverability"])


@query(sql("companies", """
SELECT DISTINCT company_id, alias, alias_type, confidence FROM (
  SELECT id AS company_id, canonical_name AS alias, 'name' AS alias_type, 1.0::DOUBLE AS confidence FROM companies
  UNION ALL SELECT id, unnest([industry, industry, country]), 'former_name', 0.95::DOUBLE FROM companies WHERE id % 2 = 0)"""))
def company_aliases(spark, sf):
    companies = load(spark, sf, "companies")[0]
    former = F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("  "), "industry"), "industry", F.lit(" "), "country")).otherwise(F.array().cast("array<string>"))
    return u.aliases(companies.withColumn("former_names", former))


@query(sql("records", """,
e AS (SELECT source_id, id % 40 AS external_id, company_id, id FROM records WHERE company_id IS NOT NULL)
SELECT source_id, external_id, min(id) AS first_seen_at, max(id) AS last_seen_at, arg_max(company_id, id) AS company_id FROM e GROUP BY source_id, external_id"""))
def source_identity_table(spark, sf):
    """First and last sight of external ids, those of the later half merged into what the earlier half stored."""
    rows = load(spark, sf, "records")[0].filter("company_id IS NOT NULL").select("source_id", (F.col("id") % 40).alias("external_id"), "company_id", F.col("id").alias("collected_at"), "id")
    middle = F.lit(rows.agg(F.avg("id")).first()[0])
    return u.source_identities(rows.filter(F.col("id") > middle), u.source_identities(rows.filter(F.col("id") <= middle)))


@query(sql("companies", """,
f AS (SELECT id AS company_id, unnest([{'n': industry, 'r': 'CEO', 'p': 'https://p/' || id}, {'n': country, 'r': NULL, 'p': NULL}, {'n': ' ', 'r': 'x', 'p': 'y'}]) AS f FROM companies)
SELECT lower(f.n) AS name, min(f.n) AS full_name, count(DISTINCT company_id) AS companies, count(DISTINCT CASE WHEN f.p IS NOT NULL THEN company_id END) AS profiles FROM f WHERE trim(f.n) <> '' GROUP BY 1"""))
def founder_tables(spark, sf):
    """Founders of companies, their links and their profiles, counted by founder."""
    companies = load(spark, sf, "companies")[0]
    fields = "struct<name:string,role:string,profile_url:string,linkedin_url:string,x_url:string,bio:string,email:string>"
    nothing = [F.lit(None).cast("string")] * 4
    one = lambda name, role, url: F.struct(*(v.alias(k) for k, v in zip(("name", "role", "profile_url", "linkedin_url", "x_url", "bio", "email"), (name, role, url, *nothing), strict=True))).cast(fields)
    none = F.lit(None).cast("string")
    rows = companies.select(F.col("id").alias("company_id"), F.array(one(F.col("industry"), F.lit("CEO"), F.concat(F.lit("https://p/"), F.col("id").cast("string"))), one(F.concat(F.lit(" "), "country"), none, none), one(F.lit(" "), F.lit("x"), F.lit("y"))).alias("founders"))
    people, links, profiles = u.founders(rows)
    n = lambda df, name: df.groupBy("founder_id").agg(F.countDistinct("company_id").alias(name))
    out = people.join(n(links, "companies"), "founder_id").join(n(profiles, "profiles"), "founder_id", "left")
    return out.select(F.lower("full_name").alias("name"), "full_name", "companies", F.coalesce("profiles", F.lit(0)).alias("profiles"))


@query(sql("sources", "SELECT source_key FROM sources WHERE length(source_key) = 5"))
def new_sources(spark, sf):
    """Sources of two digits, of which none is stored; each is in the batch twice."""
    rows = load(spark, sf, "sources")[0].select("source_key")
    batch = rows.unionByName(rows).withColumn("index", F.col("source_key"))
    return u.ensure_source(batch, rows.filter("length(source_key) <> 5")).select("source_key")


@query(sql("jobs", """,
k AS (SELECT company_id, ats_provider, external_job_id, l_returnflag = 'A' AS old, max(ats_board_id) AS board, bool_or(is_active) AS active FROM jobs GROUP BY ALL),
s AS (SELECT * FROM k WHERE old), n AS (SELECT * FROM k WHERE NOT old)
SELECT coalesce(s.company_id, n.company_id) AS company_id, coalesce(s.external_job_id, n.external_job_id) AS external_job_id,
  CASE WHEN n.company_id IS NOT NULL THEN true WHEN s.active AND (s.company_id, s.ats_provider, s.board) IN (SELECT (company_id, ats_provider, board) FROM n) THEN false ELSE s.active END AS is_active,
  CASE WHEN n.company_id IS NOT NULL THEN 0 WHEN s.active AND (s.company_id, s.ats_provider, s.board) IN (SELECT (company_id, ats_provider, board) FROM n) THEN 1 ELSE 0 END AS missing_observation_count
FROM s FULL JOIN n ON s.company_id = n.company_id AND s.ats_provider = n.ats_provider AND s.external_job_id = n.external_job_id"""))
def job_snapshot(spark, sf):
    """Postings after a snapshot: returned lines are stored, all others observed; a job that its observed board lacks is missing at once."""
    jobs, companies = load(spark, sf, "jobs", "companies")
    keys = ["company_id", "ats_provider", "external_job_id"]
    old = F.col("l_returnflag") == "A"
    one = jobs.groupBy(*keys, old.alias("old")).agg(F.max("ats_board_id").alias("ats_board_id"), F.bool_or("is_active").alias("is_active"), *(F.min(f).alias(f) for f in ("title", "department", "url", "description_text", "posted_at", "first_seen_at")))
    one = one.withColumns({"missing_observation_count": F.lit(0), "missing_since_at": F.lit(None).cast("timestamp"), "stack_terms": F.array().cast("array<string>")})
    stored = one.filter("old").drop("old")
    batch = one.filter("NOT old").drop("old").withColumns({"index": F.xxhash64(*keys), "domain": F.lit(None).cast("string")})
    out = ingest.ingest_job_snapshot(batch, stored, companies, load(spark, sf, "signals")[0], F.lit("2001-12-01").cast("timestamp"), threshold=1)
    return out["jobs"].select("company_id", "external_job_id", "is_active", "missing_observation_count")


@query("""
WITH p AS (SELECT page_id % 40 AS company_id, url, sha256(html) AS content_hash FROM pages WHERE coalesce(html, '') <> '' AND coalesce(url, '') <> '')
SELECT DISTINCT company_id, url, content_hash FROM (SELECT * FROM p UNION ALL SELECT * FROM p)""")
def research_pages(spark, sf):
    """Raw pages of a research run, which brings all of them twice, once per company, URL and hash."""
    pages, companies = load(spark, sf, "pages", "companies")
    rows = pages.select((F.col("page_id") % 40).alias("company_id"), "url", F.col("html").alias("body"), F.lit(None).cast("string").alias("content_hash"))
    asked = companies.select(F.col("id").alias("index"), F.col("id").alias("company_id"), F.col("canonical_domain").alias("domain"), "industry")
    return ingest.ingest_research(asked, companies, rows.unionByName(rows), ["industry"])["pages"].select("company_id", "url", "content_hash")


@query(sql("companies", """
SELECT * FROM (SELECT id AS company_id, unnest(['industry', 'description']) AS field, unnest([industry, description]) AS value FROM companies WHERE id % 4 <> 0) WHERE value IS NOT NULL"""))
def research_observations(spark, sf):
    """Fields of research rows as observations; every fourth row names no known company and is rejected."""
    companies = load(spark, sf, "companies")[0]
    asked = companies.select(F.col("id").alias("index"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("company_id"), F.lit("none.example").alias("domain"), "industry", "description")
    out = ingest.ingest_research(asked, companies, load(spark, sf, "pages")[0].select(F.col("page_id").alias("company_id"), "url", F.col("html").alias("body"), F.lit(None).cast("string").alias("content_hash")), ["industry", "description"])
    return out["observations"].select(F.col("resolved_id").alias("company_id"), "field", "value")


# --- summaries --------------------------------------------------------------------------------------------------------------------


@query("SELECT source_key, printf('%.1f%%', 100 * CASE WHEN source_records > 0 THEN signal_companies / source_records ELSE 0.0 END) AS record_rate, printf('%.1f%%', 100 * CASE WHEN signal_companies > 0 THEN score_20_companies / signal_companies ELSE 0.0 END) AS score20_rate, printf('%.1f%%', 100 * CASE WHEN score_20_companies > 0 THEN (manual_verified_contacts + provider_verified_contacts) / score_20_companies ELSE 0.0 END) AS contact_rate FROM (" + SQL["source_funnel"] + ")")
def source_rates(spark, sf):
    frames = load(spark, sf, "sources", "records", "signals", "scores", "boards", "jobs", "contacts", "outcomes")
    return reports.funnel(*frames).select("source_key", "record_rate", "score20_rate", "contact_rate")


@query("SELECT tier, count(*) AS rows FROM (" + SQL["datasheet_companies"] + ") GROUP BY tier")
def tier_counts(spark, sf):
    return reports.counts(QUERIES["datasheet_companies"](spark, sf), "tier")


@query("""
SELECT method, count(*) AS rows, count(v) AS reviewed, count(*) FILTER (v = 'accurate') AS accurate, round(count(*) FILTER (v = 'accurate') / nullif(count(v), 0), 4) AS accuracy
FROM (SELECT 'm' || doc_id % 3 AS method, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN quality = 1 THEN 'accurate' WHEN toxic = 1 THEN 'inaccurate' END AS v FROM labels) GROUP BY method""")
def review_accuracy(spark, sf):
    i = F.col("doc_id")
    rows = load(spark, sf, "labels")[0].select(F.concat(F.lit("m"), (i % 3).cast("string")).alias("method"), F.when(i % 3 == 2, None).when(F.col("quality") == 1, "accurate").when(F.col("toxic") == 1, "inaccurate").alias("review_verdict"))
    return reports.accuracy_report(rows)


@query("""
SELECT purpose, sum(cost) AS cost, count(*) AS calls, count(DISTINCT company_id) AS companies, round(sum(cost)::DOUBLE / count(DISTINCT company_id), 6) AS cost_per_company
FROM (SELECT event_type AS purpose, CAST(value AS DECIMAL(12, 2)) AS cost, user_id AS company_id FROM events) GROUP BY purpose""")
def model_spend(spark, sf):
    return reports.spend_report(load(spark, sf, "events")[0].select(F.col("event_type").alias("purpose"), F.col("value").cast("decimal(12,2)").alias("cost"), F.col("user_id").alias("company_id")))


@query("SELECT sum(accepted)::BIGINT AS accepted, sum(inserted)::BIGINT AS inserted, sum(updated)::BIGINT AS updated, sum(duplicates)::BIGINT AS duplicates, (SELECT count(*) FROM documents WHERE doc_id % 6 = 5) AS rejected, sum(accepted)::BIGINT + (SELECT count(*) FROM documents WHERE doc_id % 6 = 5) AS received FROM (" + SQL["record_changes"] + ")")
def record_summary(spark, sf):
    """Counts of a batch of records against stored ones; records without company are the rejects."""
    rows = load(spark, sf, "records")[0].withColumn("hash", F.sha2("text", 256))
    good = rows.filter("company_id IS NOT NULL")
    old = good.filter("id % 2 = 0").groupBy("source_id", "company_id").agg(F.max_by("hash", "id").alias("hash"))
    return reports.ingest_summary(u.classify_changes(good.filter("id % 2 = 1"), old, ["source_id", "company_id"], "hash", "id"), rows.filter("company_id IS NULL"))


@query(sql("companies", "SELECT count(*) AS rows, count(canonical_domain) AS with_canonical_domain, count(description) AS with_description, count(city) AS with_city FROM companies"))
def field_coverage(spark, sf):
    return reports.probe_coverage(load(spark, sf, "companies")[0], ["canonical_domain", "description", "city"])


@query("""
SELECT source_key, avg(ok) AS success_rate, count(ok) AS sample_size, coalesce(avg(ok) < 0.7, true) AS degraded
FROM (SELECT 'p' || user_id % 20 AS source_key, CASE WHEN user_id % 20 = 3 THEN NULL WHEN event_type = 'error' AND user_id % 3 <> 0 OR event_type = 'view' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ok FROM events) GROUP BY source_key""")
def parser_rates(spark, sf):
    i, kind = F.col("user_id"), F.col("event_type")
    return reports.parser_health(load(spark, sf, "events")[0].select(F.concat(F.lit("p"), (i % 20).cast("string")).alias("source_key"), F.when(i % 20 != 3, ~(((kind == "error") & (i % 3 != 0)) | (kind == "view"))).alias("ok")))


@query("""
WITH v AS (SELECT event_id AS id, 'p' || event_id % 50 AS source_key, event_id % 6 AS sample_size, (event_id % 11) / 10.0 AS rate, ts FROM events),
s AS (SELECT *, sample_size >= 3 AND rate >= 0.7 AS fine FROM v)
SELECT id, CASE WHEN NOT fine THEN 'failed' WHEN row_number() OVER (PARTITION BY source_key, fine ORDER BY ts DESC, id DESC) > 1 THEN 'retired' WHEN source_key IN ('p1', 'p7') THEN 'failed' ELSE 'active' END AS status,
  CASE WHEN fine AND row_number() OVER (PARTITION BY source_key, fine ORDER BY ts DESC, id DESC) = 1 AND source_key IN ('p1', 'p7') THEN ' retired below 70% threshold;' END AS notes FROM s""")
def parser_versions(spark, sf):
    """The latest good version of a parser is active, unless its source is degraded."""
    i = F.col("event_id")
    rows = load(spark, sf, "events")[0].select(i.alias("id"), F.concat(F.lit("p"), (i % 50).cast("string")).alias("source_key"), (i % 6).alias("sample_size"), ((i % 11) / 10).alias("success_rate"), F.col("ts").alias("generated_at"), F.lit(None).cast("string").alias("notes"))
    health = rows.select("source_key", F.col("source_key").isin("p1", "p7").alias("degraded")).distinct()
    return u.retire_degraded(u.activate_parsers(rows), health).select("id", "status", "notes")


@query("""
SELECT conv_id AS company_id, arg_min(text, turn) FILTER (text IS NOT NULL AND role <> 'user') AS positioning, count(*) AS pages, array_to_string(list_sort(list(DISTINCT role)), ',') AS technologies, array_to_string(list_sort(list(DISTINCT 'r' || turn % 3)), ',') AS routes
FROM conversations GROUP BY conv_id""")
def research_summary(spark, sf):
    """Turns stand for a company's pages: the first positioning, and the union of what they name."""
    rows = load(spark, sf, "conversations")[0].select(F.col("conv_id").alias("company_id"), F.col("turn").alias("page_number"), F.when(F.col("role") == "user", " ").otherwise(F.col("text")).alias("positioning"), F.array("role", "role").alias("technologies"), F.array(F.concat(F.lit("r"), (F.col("turn") % 3).cast("string"))).alias("routes"))
    join = lambda f: F.array_join(F.array_sort(f), ",").alias(f)
    return reports.research_rollup(rows).select("company_id", "positioning", "pages", join("technologies"), join("routes"))


@query(sql("scores", "SELECT id, total_score FROM scores ORDER BY total_score DESC, id OFFSET 20 LIMIT 30"))
def score_page(spark, sf):
    """The page after the first twenty, thirty at most: the feature's paging."""
    return w.page_of(load(spark, sf, "scores")[0], 20, 30, F.col("total_score").desc(), F.col("id")).select("id", "total_score")


@query(sql("companies", "SELECT id, 1::BIGINT AS shards FROM companies"))
def company_shards(spark, sf):
    """Every company is in one of four shards."""
    rows = load(spark, sf, "companies")[0].select("id")
    parts = [w.shard(rows, "id", 4, i) for i in range(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("id").agg(F.count("*").alias("shards"))


@query(sql("contacts companies", f""",
x AS (SELECT k.*, coalesce(canonical_domain = split_part(email, '@', 2), false) AS own, CASE WHEN canonical_domain IS NULL OR canonical_domain <> split_part(email, '@', 2) THEN 'external_email' WHEN contact_kind = 'role_inbox' THEN 'generic_inbox' ELSE 'direct_person' END AS candidate_type FROM contacts k JOIN companies c ON c.id = k.company_id)
SELECT id, CASE WHEN candidate_type = 'external_email' THEN 'reject' WHEN candidate_type <> 'generic_inbox' AND full_name IS NOT NULL AND role IS NOT NULL THEN 'approve_candidate' ELSE 'needs_review' END AS recommended_status,
  CASE WHEN candidate_type = 'external_email' THEN '{scoring.REVIEW_HINTS["external_email"][1]}' WHEN candidate_type = 'generic_inbox' THEN '{scoring.REVIEW_HINTS["generic_inbox"][1]}' WHEN full_name IS NOT NULL AND role IS NOT NULL THEN '{scoring.REVIEW_HINTS["named"][1]}'
    WHEN id % 2 = 0 THEN '{scoring.REVIEW_HINTS["mailto"][1]}' ELSE '{scoring.REVIEW_HINTS["other"][1]}' END AS hint, CASE WHEN full_name IS NOT NULL AND role IS NOT NULL THEN 0.9::DOUBLE ELSE 0.72::DOUBLE END AS confidence FROM x"""))
def review_hints(spark, sf):
    contacts, companies = load(spark, sf, "contacts", "companies")
    rows = contacts.join(companies.select(F.col("id").alias("company_id"), F.col("canonical_domain").alias("domain")), "company_id")
    own = F.coalesce(c.email_domain(F.col("email")) == F.col("domain"), F.lit(False))
    kind = F.when(~own, "external_email").when(F.col("contact_kind") == "role_inbox", "generic_inbox").otherwise("direct_person")
    hint = scoring.review_hint(kind, F.col("full_name").isNotNull(), F.col("role").isNotNull(), F.when(F.col("id") % 2 == 0, "mailto_link").otherwise("page_text"))
    return rows.select("id", hint.alias("h"), scoring.candidate_confidence(F.col("full_name"), F.col("role"), F.col("email")).alias("confidence")).select("id", "h.*", "confidence")


@query(sql("contacts companies", """
SELECT k.company_id, canonical_name AS company, email, CASE WHEN k.id % 2 = 0 THEN contact_kind WHEN full_name IS NOT NULL OR role IS NOT NULL THEN 'person' WHEN contact_kind = 'role_inbox' THEN 'role_inbox' ELSE 'generic' END AS contact_kind,
  CASE WHEN k.id % 2 = 0 THEN 'captured' ELSE 'legacy_contacts' END AS source_type, CASE WHEN k.id % 2 = 0 THEN '{}' ELSE '{"collector":"legacy_contacts_table","contact_source":null,"verification_status":"' || verification_status || '"}' END AS raw_evidence
FROM contacts k JOIN companies c ON c.id = k.company_id"""))
def all_contacts(spark, sf):
    """Even contacts were captured, odd ones come from the contacts table."""
    contacts, companies = load(spark, sf, "contacts", "companies")
    named = companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company"), F.col("canonical_domain").alias("domain"))
    captured = contacts.filter("id % 2 = 0").join(named, "company_id").withColumns({"phone": F.lit(None).cast("string"), "on_company_domain": F.lit(True), "deliverability": F.lit("ok"), "source_type": F.lit("captured"), "source_url": F.lit("https://x.example"), "raw_evidence": F.lit("{}")})
    legacy = contacts.filter("id % 2 = 1").withColumn("contact_source", F.lit(None).cast("string"))
    out = plans.all_contacts(captured, legacy, companies)
    return out.select("company_id", "company", "email", "contact_kind", "source_type", F.regexp_replace("raw_evidence", ',"confidence":[0-9.]+', "").alias("raw_evidence"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{}' WHEN event_id % 7 = 0 THEN '{}' ELSE replace(props, ': ', ':') END AS loaded, '{"id":' || event_id || ',"kind":' || CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END || '}' AS built FROM events""")
def json_objects(spark, sf):
    """JSON texts as objects, with a default for nulls and for what is none; and objects of named values."""
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, None).when(i % 7 == 0, "{not json").otherwise(F.col("props"))
    return load(spark, sf, "events")[0].select("event_id", F.to_json(c.load_json(raw)).alias("loaded"), c.build_object(id=i, kind=F.nullif("event_type", F.lit("view"))).alias("built"))


# --- canonical tables -------------------------------------------------------------------------------------------------------------


@query(sql("companies", """
SELECT CAST(id AS VARCHAR) AS id, canonical_name, CASE WHEN id % 3 = 0 THEN coalesce(canonical_domain, industry) ELSE canonical_domain END AS canonical_domain, CASE WHEN id % 5 = 0 THEN NULL ELSE industry END AS industry, CASE WHEN id % 2 = 0 THEN 'new' END AS status
FROM companies WHERE canonical_name NOT LIKE '%7'"""))
def stored_companies(spark, sf):
    """Companies in the canonical store: all but a tenth without a name are stored, then every second one comes again under another name, with a status, and every third with a domain."""
    rows = load(spark, sf, "companies")[0].select(F.col("id").cast("string").alias("id"), F.when(~F.col("canonical_name").endswith("7"), F.col("canonical_name")).alias("canonical_name"), "canonical_domain", F.when(F.col("id") % 5 != 0, F.col("industry")).alias("industry"), F.col("industry").alias("_i"), F.col("id").alias("index"))
    table = tables.CanonicalTable(spark, f"{shared_dir(spark)}/canonical-{uuid.uuid4().hex}", "companies", buckets=16)
    table.upsert(rows.drop("_i"))
    again = rows.filter("index % 2 = 0 OR index % 3 = 0").filter("canonical_name IS NOT NULL")
    table.upsert(again.select("id", F.lit("Other").alias("canonical_name"), F.when(F.col("index") % 3 == 0, F.col("_i")).alias("canonical_domain"), F.when(F.col("index") % 2 == 0, "new").alias("status"), "index"))
    return table.read().select("id", "canonical_name", "canonical_domain", "industry", "status")


@query(sql("scores", """
SELECT CAST(id AS VARCHAR) AS id, CAST(company_id AS VARCHAR) AS company_id, total_score FROM scores WHERE total_score <= 100"""))
def stored_scores(spark, sf):
    """The history of scores: append-only, each id once though half of them come twice; scores over 100 are rejected."""
    rows = load(spark, sf, "scores")[0].select(F.col("id").cast("string").alias("id"), F.col("company_id").cast("string").alias("company_id"), "total_score", F.col("calculated_at").cast("timestamp").alias("calculated_at"), F.col("id").alias("index"))
    table = tables.CanonicalTable(spark, f"{shared_dir(spark)}/canonical-{uuid.uuid4().hex}", "scores", buckets=16)
    table.upsert(rows.filter("index % 2 = 0"))
    table.upsert(rows)
    return table.read().select("id", "company_id", "total_score")


@query(sql("scores", """
SELECT id, CASE WHEN id % 9 = 0 THEN 'id is missing' WHEN id % 7 = 0 THEN 'total_score can''t be read' WHEN total_score > 100 THEN 'total_score is out of bounds' END AS reason FROM scores WHERE id % 9 = 0 OR id % 7 = 0 OR total_score > 100"""))
def stored_scores_rejects(spark, sf):
    rows = load(spark, sf, "scores")[0]
    rows = rows.select(F.when(F.col("id") % 9 != 0, F.col("id").cast("string")).alias("id"), F.col("company_id").cast("string").alias("company_id"), F.when(F.col("id") % 7 == 0, "seven").otherwise(F.col("total_score").cast("string")).alias("total_score"), F.col("calculated_at").cast("timestamp").alias("calculated_at"), F.col("id").alias("index"))
    return tables.checked(rows, "scores")[1].select(F.col("index").alias("id"), "reason")
