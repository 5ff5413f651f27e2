"""Registered queries on target lists, drafts, boards, routes and the writes of identity resolution; each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.adapters import load, sql
from tallyhound.functions import columns as c
from tallyhound.functions import terms as t
from tallyhound.operators import capture
from tallyhound.operators import signals as g
from tallyhound.plans import drafts, ingest, targets
from tallyhound.plans import scoring as plans
from tallyhound.queries import QUERIES, SQL, query

_BEST = ", latest AS (SELECT company_id, total_score AS score FROM scores QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY calculated_at DESC, id DESC) = 1)"
_ORGS = "(" + ", ".join(f"'{x}'" for x in t.ORG_TYPES) + ")"
_UNSEEN = f"NOT EXISTS (SELECT 1 FROM signals s WHERE s.company_id = c.id AND s.signal_type IN {_ORGS})"
_NO_WORDS = "|".join(t.NO_LAST_WORDS)


# --- target lists -----------------------------------------------------------------------------------------------------------------


@query(sql("companies scores signals", _BEST + f"""
SELECT c.id AS company_id, canonical_domain AS domain, score FROM companies c JOIN latest l ON l.company_id = c.id WHERE canonical_domain IS NOT NULL AND score >= 20 AND {_UNSEEN}"""))
def org_probe_targets(spark, sf):
    return targets.org_probe_targets(*load(spark, sf, "companies", "scores", "signals"), min_score=20)


@query(sql("companies signals", f"""
SELECT c.id AS company_id, canonical_domain AS domain FROM companies c WHERE canonical_domain IS NOT NULL AND {_UNSEEN}
  AND EXISTS (SELECT 1 FROM signals s WHERE s.company_id = c.id AND s.signal_type = 'STALE_ENGINEERING_ROLE' AND CAST(raw_evidence->'signal'->>'age_days' AS INT) >= 90)"""))
def stale_org_probe_targets(spark, sf):
    return targets.stale_org_probe_targets(*load(spark, sf, "companies", "signals"), stale_days=90)


@query(sql("companies scores classification", _BEST + """
SELECT c.id AS company_id, canonical_domain AS domain, coalesce(score, 0) AS score FROM companies c LEFT JOIN latest l ON l.company_id = c.id
WHERE canonical_domain IS NOT NULL AND c.id NOT IN (SELECT company_id FROM classification WHERE company_type = 'unclear')"""))
def classify_targets(spark, sf):
    """Unclear companies count as classified here; all others are still to be."""
    companies, scores, kinds = load(spark, sf, "companies", "scores", "classification")
    return targets.classify_targets(companies, scores, kinds.filter("company_type = 'unclear'"))


@query(sql("companies scores classification", _BEST + """
SELECT c.id AS company_id, canonical_domain AS domain, score FROM companies c JOIN latest l ON l.company_id = c.id
WHERE canonical_domain IS NOT NULL AND score >= 15 AND c.id NOT IN (SELECT company_id FROM classification WHERE company_type = 'non_technical_buyer')"""))
def enrich_targets(spark, sf):
    companies, scores, kinds = load(spark, sf, "companies", "scores", "classification")
    return targets.enrich_targets(companies, scores, kinds.withColumnRenamed("company_type", "extraction_method"), "non_technical_buyer", 15)


@query(sql("companies scores classification contacts", _BEST + """
SELECT c.id AS company_id, canonical_name AS name, canonical_domain AS domain, score, company_type FROM companies c JOIN latest l ON l.company_id = c.id JOIN classification k ON k.company_id = c.id
WHERE canonical_domain IS NOT NULL AND score >= 10 AND company_type NOT IN ('software_vendor', 'agency') AND c.id NOT IN (SELECT company_id FROM contacts WHERE verification_status = 'manual_verified')"""))
def capture_targets(spark, sf):
    companies, scores, kinds, contacts = load(spark, sf, "companies", "scores", "classification", "contacts")
    return targets.capture_targets(companies, scores, kinds, contacts.filter("verification_status = 'manual_verified'"), 10)


@query(sql("boards jobs", """
SELECT 'c' || b.company_id || '.com' AS domain, 'https://b.example/' || board_token AS url FROM boards b WHERE ats_provider = 'lever' AND company_id NOT IN (SELECT company_id FROM jobs WHERE posted_at IS NOT NULL AND is_active AND department = 'Engineering')"""))
def parser_samples(spark, sf):
    """Boards of the second provider stand for generic ones; those of companies without a dated, open engineering role."""
    boards, jobs = load(spark, sf, "boards", "jobs")
    rows = boards.select("company_id", F.when(F.col("ats_provider") == "lever", "generic").otherwise(F.col("ats_provider")).alias("ats_provider"), F.concat(F.lit("c"), F.col("company_id").cast("string"), F.lit(".com")).alias("domain"), F.lit(None).cast("string").alias("careers_url"), F.concat(F.lit("https://b.example/"), "board_token").alias("board_url"), F.col("id").alias("last_detected_at"))
    return targets.parser_samples(rows, jobs.filter("posted_at IS NOT NULL AND is_active AND department = 'Engineering'"))


# --- boards, routes ---------------------------------------------------------------------------------------------------------------


@query(sql("boards", """,
l AS (SELECT company_id, 'https://c' || company_id || '.com/' || CASE WHEN company_id % 3 = 0 THEN 'careers' ELSE 'about' END AS page_url, ats_provider,
  CASE WHEN id % 5 = 0 THEN NULL WHEN ats_provider = 'greenhouse' THEN board_token WHEN id % 4 = 1 THEN NULL ELSE board_token END AS board_token FROM boards),
b AS (SELECT DISTINCT company_id, ats_provider, board_token, 0.92::DOUBLE AS confidence FROM l WHERE board_token IS NOT NULL),
x AS (SELECT DISTINCT company_id, CASE WHEN company_id % 3 = 0 THEN 'generic' END AS ats_provider, CASE WHEN company_id % 3 = 0 THEN 'c' || company_id || '.com/careers' END AS board_token, CASE WHEN company_id % 3 = 0 THEN 0.55::DOUBLE END AS confidence FROM l WHERE company_id NOT IN (SELECT company_id FROM b))
SELECT * FROM b UNION ALL SELECT * FROM x"""))
def detected_boards(spark, sf):
    """Boards among links of two providers, some of scripts or to elsewhere; careers pages of companies without one; the rest have none."""
    i, company = F.col("id"), F.col("company_id").cast("string")
    page = F.concat(F.lit("https://c"), company, F.lit(".com/"), F.when(F.col("company_id") % 3 == 0, "careers").otherwise("about"))
    href = F.when(i % 5 == 0, "https://elsewhere.example/x").when(F.col("ats_provider") == "greenhouse", F.concat(F.lit("https://www.Boards.greenhouse.io/"), F.upper("board_token"))).when(i % 4 == 1, "https://jobs.lever.co/embed").otherwise(F.concat(F.lit("http://jobs.lever.co/"), F.replace("board_token", F.lit("-"), F.lit("%2D")), F.lit("/apply?x=1")))
    links = load(spark, sf, "boards")[0].select("company_id", F.concat(F.lit("c"), company, F.lit(".com")).alias("domain"), page.alias("page_url"), href.alias("href"))
    found, misses = g.board_detections(links)
    none = F.lit(None).cast("string")
    return found.select("company_id", "ats_provider", "board_token", "confidence").unionByName(misses.select("company_id", none.alias("ats_provider"), none.alias("board_token"), F.lit(None).cast("double").alias("confidence")))


@query()
def contact_routes(spark, sf):
    """Every saved page with its routes in order: itself, if it is a contact page, linked and printed addresses; null where it has none."""
    pages = load(spark, sf, "pages")[0]
    found = capture.contact_routes(capture.parse_html(pages)).withColumn("r", F.struct("index", F.concat_ws(":", "route_type", "value").alias("route")))
    routes = found.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["route"]), ", ").alias("routes"))
    return pages.select("page_id", "url").join(routes, "page_id", "left")


@query()
def page_summaries(spark, sf):
    """One line on each saved page, and the decision makers it names."""
    parsed = capture.parse_html(load(spark, sf, "pages")[0]).withColumn("reason_to_write", F.lit(None).cast("string"))
    names = capture.decision_maker_names(parsed).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))
    return capture.research_summary(parsed).join(names, "page_id", "left")


# --- drafts -----------------------------------------------------------------------------------------------------------------------


@query(rf"""
WITH s AS (SELECT doc_id, trim(text) AS w, regexp_extract(trim(text), '^(.+?[.!?])(?:\s|$)', 1) AS first FROM documents),
n AS (SELECT *, len(regexp_extract_all(first, '\S+')) BETWEEN 5 AND 24 AS ends, regexp_split_to_array(w, '\s+') AS words FROM s)
SELECT doc_id, CASE WHEN ends THEN regexp_replace(first, '\.+$', '') WHEN len(words) <= 24 THEN regexp_replace(w, '\.+$', '')
  ELSE regexp_replace(regexp_replace(array_to_string(words[1:24], ' '), '((^|\s+)({_NO_WORDS})[.,;:]*)+$', '', 'i'), '[.,;:]+$', '') END AS short FROM n""")
def trimmed_texts(spark, sf):
    """Whole texts cut to a sentence of at most 24 words."""
    return load(spark, sf, "documents")[0].select("doc_id", c.trim_to_words(F.col("text"), 24).alias("short"))


@query(sql("contacts companies classification", """,
f AS (SELECT c.id AS company_id, description AS positioning, industry AS fit, country AS tech, sector FROM companies c LEFT JOIN classification k ON k.company_id = c.id),
q AS (SELECT k.id, k.company_id, canonical_name AS company, email, coalesce(full_name, CASE split_part(email, '@', 1) WHEN 'info' THEN 'Info' ELSE 'X' END) AS contact_name, f.* EXCLUDE (company_id),
  CASE WHEN lower(industry) LIKE '%machine%' AND regexp_matches(lower(industry), 'machines') THEN 'plant workflow and systems integration' WHEN sector IS NOT NULL THEN 'operations workflow automation' ELSE 'the open engineering work' END AS project_area
  FROM contacts k JOIN companies c ON c.id = k.company_id JOIN f ON f.company_id = k.company_id)
SELECT id, contact_name, 'Quick thought on ' || project_area AS subject,
  'Hi ' || contact_name || ',' || chr(10) || chr(10) || 'I saw that ' || company || ' is hiring. ' || CASE WHEN positioning IS NOT NULL THEN 'Your site says: ' || positioning ELSE 'The site points to ' || fit END || '.' || chr(10) || chr(10)
    || 'We build integrations.' || chr(10) || chr(10) || 'Shall I send two or three concrete ideas on ' || project_area || '?' || chr(10) || chr(10) || 'Best,' || chr(10) || 'Sam' AS body,
  concat_ws(' | ', 'positioning: ' || positioning, 'tech: ' || tech, 'fit: ' || fit) AS personalization_basis
FROM q"""))
def message_drafts(spark, sf):
    """Drafts to all contacts, from what the tables say of their companies."""
    contacts, companies, kinds = load(spark, sf, "contacts", "companies", "classification")
    queue = contacts.join(companies.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company")), "company_id").select("id", "company_id", "company", "email", F.col("full_name").alias("contact_name"))
    known = companies.select(F.col("id").alias("company_id"), F.col("description").alias("positioning"), F.array("industry").alias("service_fit_evidence"), F.array(F.lit(" "), "country").alias("technology_mentions"))
    facts = known.join(kinds.select("company_id", F.when(F.col("sector").isNotNull(), F.array(F.lit("Operations teams"))).alias("customer_terms")), "company_id", "left")
    return drafts.message_drafts(queue, facts, "We build integrations.", "Sam").select("id", "contact_name", "subject", "body", "personalization_basis")


# --- identities -------------------------------------------------------------------------------------------------------------------


@query(sql("companies records", """,
st AS (SELECT * FROM companies WHERE country < 'J'),
r AS (SELECT r.id, source_id, r.id % 40 AS external_id, c.id AS k, canonical_name AS name, canonical_domain AS domain, c.country, industry FROM records r LEFT JOIN companies c ON c.id = r.company_id),
d AS (SELECT canonical_domain AS domain, min(id) AS id FROM st WHERE canonical_domain IS NOT NULL GROUP BY 1),
x AS (SELECT r.*, source_id = 'src0' AND k IS NOT NULL AS linked, coalesce(r.domain, r.name) AS key, CASE WHEN r.domain IS NULL THEN s.id ELSE d.id END AS stored FROM r LEFT JOIN d ON d.domain = r.domain LEFT JOIN st s ON s.canonical_name = r.name),
y AS (SELECT *, CASE WHEN linked THEN CAST(k AS VARCHAR) WHEN name IS NOT NULL THEN coalesce(CAST(stored AS VARCHAR), key) END AS resolved FROM x),
al AS (SELECT DISTINCT resolved, name AS alias, 'name' AS kind FROM y WHERE resolved IS NOT NULL AND NOT coalesce(linked, false) UNION SELECT resolved, country, 'former_name' FROM y WHERE resolved IS NOT NULL AND NOT coalesce(linked, false)),
n AS (SELECT count(*) AS scanned, count(DISTINCT key) FILTER (NOT coalesce(linked, false) AND stored IS NULL AND name IS NOT NULL) AS created, count(*) FILTER (NOT coalesce(linked, false) AND name IS NOT NULL) AS named, count(*) FILTER (name IS NULL) AS reviews, count(*) FILTER (linked) AS skipped FROM y)
SELECT 'scanned' AS counter, scanned AS n FROM n UNION ALL SELECT 'companies_created', created FROM n UNION ALL SELECT 'companies_matched', named - created FROM n UNION ALL SELECT 'review_items_created', reviews FROM n UNION ALL SELECT 'skipped_already_linked', skipped FROM n
UNION ALL SELECT 'aliases_created', count(*) FROM al WHERE (resolved, alias, kind) NOT IN (SELECT (CAST(id AS VARCHAR), canonical_name, 'name') FROM st)
UNION ALL SELECT 'source_identities_created', (SELECT count(*) FROM (SELECT DISTINCT source_id, external_id FROM y WHERE resolved IS NOT NULL AND source_id IS DISTINCT FROM 'src1'))
UNION ALL SELECT 'founders_created', count(DISTINCT lower(industry)) FROM y WHERE resolved IS NOT NULL
UNION ALL SELECT 'founder_links_created', (SELECT count(*) FROM (SELECT DISTINCT resolved, lower(industry) FROM y WHERE resolved IS NOT NULL))
UNION ALL SELECT 'founder_profiles_created', (SELECT count(*) FROM (SELECT DISTINCT resolved, lower(industry), k FROM y WHERE resolved IS NOT NULL AND k % 2 = 0))"""))
def identity_writes(spark, sf):
    """What all records write under their companies' names and domains, names alone allowed. Companies of countries before J are stored with
    their names, identities of the second source too; records of the first source are linked already."""
    companies, records = load(spark, sf, "companies", "records")
    stored = companies.filter("country < 'J'")
    named = companies.select(F.col("id").alias("k"), F.col("canonical_name").alias("name"), F.col("canonical_domain").alias("domain"), "country", "industry")
    text = F.lit(None).cast("string")
    rows = records.select("id", "source_id", (F.col("id") % 40).alias("external_id"), F.col("company_id").alias("k")).join(named, "k", "left")
    one = F.struct(F.col("industry").alias("name"), text.alias("role"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("https://p.example/"), F.col("k").cast("string"))).alias("profile_url"), *(text.alias(x) for x in ("linkedin_url", "x_url", "bio", "email")))
    rows = rows.withColumns({"created_at": F.col("id"), "source_url": text, "company_id": F.when((F.col("source_id") == "src0") & F.col("name").isNotNull(), F.col("k")), "former_names": F.array("country"), "founders": F.array(one)})
    aliases = stored.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("alias"), F.lit("name").alias("alias_type"))
    return ingest.process_source_records(rows, stored, aliases, rows.filter("source_id = 'src1'").select("source_id", "external_id"), allow_name_only=True)["summary"]


@query(sql("contacts companies", """
SELECT k.company_id, email, CASE contact_kind WHEN 'role_inbox' THEN full_name WHEN 'person' THEN full_name ELSE canonical_name END AS full_name,
  CASE contact_kind WHEN 'role_inbox' THEN role WHEN 'person' THEN role WHEN 'generic' THEN CASE WHEN k.company_id % 2 = 0 THEN 'CEO' END END AS role,
  CASE contact_kind WHEN 'role_inbox' THEN k.confidence::DOUBLE ELSE 0.8::DOUBLE END AS confidence, CASE contact_kind WHEN 'role_inbox' THEN 'page' ELSE 'trusted_source_payload' END AS contact_source
FROM contacts k JOIN companies c ON c.id = k.company_id"""))
def backfilled_contacts(spark, sf):
    """Inboxes and persons are stored; persons and the others also come as founder profiles."""
    contacts, companies = load(spark, sf, "contacts", "companies")
    stored = contacts.filter("contact_kind <> 'generic'").select("company_id", "email", "full_name", "role", F.col("confidence").cast("double").alias("confidence"), F.lit("page").alias("contact_source"), "verification_status")
    profiles = contacts.filter("contact_kind <> 'role_inbox'").select(F.col("id").alias("index"), "company_id", F.col("company_id").alias("founder_id"), F.upper("email").alias("email"), F.lit("https://p.example").alias("profile_url"), F.lit(None).cast("double").alias("confidence"))
    founders = companies.select("id", F.col("canonical_name").alias("full_name"))
    links = companies.select(F.col("id").alias("company_id"), F.col("id").alias("founder_id"), F.when(F.col("id") % 2 == 0, "CEO").alias("role")).filter("role IS NOT NULL")
    return ingest.backfill_contacts_from_profiles(profiles, founders, links, stored).select("company_id", "email", "full_name", "role", "confidence", "contact_source")


# --- datasheet --------------------------------------------------------------------------------------------------------------------


def _frames(spark, sf):
    names = ("companies", "scores", "classification", "signals", "contacts", "jobs")
    companies, leads = plans.ranked_datasheet(*load(spark, sf, *names))
    presence = QUERIES["page_hosts"](spark, sf).filter("kind IS NOT NULL").withColumnRenamed("kind", "presence_kind")
    return plans.datasheet_frames(companies, leads, load(spark, sf, "contacts")[0], QUERIES["source_rows"](spark, sf), presence, 20, "2024-02-15")


@query("SELECT company_id, company, total_score FROM (" + SQL["datasheet_companies"] + ") WHERE tier = 'X'")
def datasheet_excluded(spark, sf):
    return _frames(spark, sf)["Excluded"].select("company_id", "company", "total_score")


@query("WITH sheet AS (" + SQL["datasheet_companies"] + """), told AS (SELECT count(*) AS n, count(*) FILTER (tier = 'X') AS x FROM sheet)
SELECT 'Score threshold' AS item, '20' AS note UNION ALL SELECT 'Generated at', '2024-02-15' UNION ALL SELECT 'Companies exported', n::VARCHAR FROM told UNION ALL SELECT 'Companies sheet rows', (n - x)::VARCHAR FROM told
UNION ALL SELECT 'Excluded companies', x::VARCHAR FROM told UNION ALL SELECT 'Lead/contact rows', (SELECT count(*)::VARCHAR FROM (""" + SQL["datasheet_leads"] + """)) UNION ALL SELECT 'Contact rows', (SELECT 3 * count(*) FROM customer)::VARCHAR""")
def datasheet_notes(spark, sf):
    return _frames(spark, sf)["Notes"]


@query("SELECT 'source' AS part, source_key, records, companies FROM (" + SQL["source_rows"] + ") UNION ALL SELECT 'web_presence', kind, count(*), NULL FROM (" + SQL["page_hosts"] + ") WHERE kind IS NOT NULL GROUP BY kind")
def datasheet_sources(spark, sf):
    return _frames(spark, sf)["Sources"]
