"""Registered queries on landed records: vendors' companies and posts, directories, notices, model profiles, evidence, and the counts that meet them; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.adapters import load, spread, sql
from tallyhound.operators import capture, reports, resolve, scoring, signals, validate
from tallyhound.operators import latest as w
from tallyhound.queries import query
from tallyhound.sources import normalize


def _none():
    return F.lit(None).cast("string")


def _json(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


_VENDOR = """, n AS (SELECT id, canonical_name AS name, 'site' || (id % 400) || '.com' AS host, CASE id % 4 WHEN 0 THEN 'Freight' WHEN 1 THEN 'Software Development for retail' WHEN 2 THEN 'Retail' ELSE 'Gaming' END AS industry FROM companies),
r AS (SELECT *, CASE WHEN id % 19 = 0 THEN 'not_an_object' WHEN id % 11 = 0 THEN 'no_company_name' WHEN id % 13 = 0 THEN 'no_resolvable_domain' END AS bad, id % 4 IN (0, 2) AS fine FROM n),
f AS (SELECT *, min(CASE WHEN bad IS NULL AND fine THEN id END) OVER (PARTITION BY host, bad IS NULL) AS first FROM r)
SELECT id AS index, CASE WHEN bad IS NOT NULL THEN bad WHEN id > first THEN 'duplicate_domain' WHEN NOT fine THEN 'not_non_technical' END AS reason, CASE WHEN bad IS NULL AND fine AND id = first THEN host END AS domain,
  CASE WHEN bad IS NULL AND fine AND id = first THEN CASE WHEN id % 2 = 0 THEN 201 ELSE 50 END END AS employee_count FROM f"""


@query(sql("companies", _VENDOR))
def vendor_companies(spark, sf):
    """A vendor's item for each company, 400 sites among them: every item as it is taken or rejected."""
    rows = spread(load(spark, sf, "companies")[0])
    i = F.col("id")
    industry = F.when(i % 4 == 0, "Freight").when(i % 4 == 1, "Software Development for retail").when(i % 4 == 2, "Retail").otherwise("Gaming")
    site = F.when(i % 13 == 0, "https://www.linkedin.com/company/x").otherwise(F.concat(F.lit("https://www.site"), (i % 400).cast("string"), F.lit(".com/about")))
    name = F.when(i % 11 != 0, F.col("canonical_name"))
    one = _json(name=F.when(i % 3 == 0, name), companyName=F.when(i % 3 != 0, name), website=F.when(i % 5 == 0, site), url=F.when(i % 5 != 0, site), industry=industry, employeeCount=F.when(i % 2 == 0, "201-500").otherwise("50"))
    items = rows.select(i.alias("index"), F.when(i % 19 == 0, F.lit("[1]")).otherwise(one).alias("raw"))
    good, bad = normalize.normalize_vendor_companies(items)
    return good.select("index", _none().alias("reason"), "domain", "employee_count").unionByName(bad, allowMissingColumns=True)


@query(sql("records", """, n AS (SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 't.co' ELSE 'post' || (id % 97) || '.org' END AS host FROM records),
f AS (SELECT *, CASE WHEN host IS NULL THEN 'no_resolvable_domain' WHEN host = 't.co' THEN 'non_company_host' WHEN id > min(id) OVER (PARTITION BY host) THEN 'duplicate_domain' END AS reason FROM n)
SELECT id AS index, reason, CASE WHEN reason IS NULL THEN host END AS domain, CASE WHEN reason IS NULL THEN CASE WHEN id % 2 = 0 THEN 'Author ' || id ELSE 'Post' || (id % 97) END END AS company_name FROM f"""))
def vendor_posts(spark, sf):
    """A post for each record, as it is taken or rejected; every second one has no author."""
    i = F.col("id")
    link = F.when(i % 5 == 1, "https://t.co/abc").when(i % 5 != 0, F.concat(F.lit("https://post"), (i % 97).cast("string"), F.lit(".org/x")))
    author = F.struct(F.when(i % 2 == 0, F.concat(F.lit("Author "), i.cast("string"))).alias("name"), F.when(i % 3 == 0, link).alias("website"))
    items = load(spark, sf, "records")[0].select(i.alias("index"), _json(text=F.col("text"), expandedUrl=F.when(i % 3 != 0, link), author=author).alias("raw"))
    good, bad = normalize.normalize_vendor_posts(items)
    return good.select("index", _none().alias("reason"), "domain", "company_name").unionByName(bad, allowMissingColumns=True)


@query(sql("companies", """
SELECT id AS index, canonical_name AS company_name, lower(canonical_domain) AS domain, employee_estimate AS employee_count FROM companies WHERE canonical_domain IS NOT NULL AND employee_estimate >= 200 AND (country LIKE '%A%' OR country LIKE '%IND%')"""))
def directory_companies(spark, sf):
    """Companies of a directory in regions whose names hold an A, with 200 staff or more."""
    rows = load(spark, sf, "companies")[0].select(F.col("id").alias("index"), F.col("canonical_name").alias("name"), F.concat(F.lit("https://"), "canonical_domain", F.lit("/")).alias("website"), F.array(F.lit("zzz"), F.lower("country")).alias("regions"), F.col("employee_estimate").alias("team_size"), _none().alias("batch"), F.col("description").alias("one_liner"))
    return normalize.normalize_directory_companies(rows, regions=("a", "ind"), min_employees=200).select("index", "company_name", "domain", "employee_count")


@query(sql("records", """, n AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'buyer' || (id % 50) || '.org' WHEN id % 3 = 1 THEN 'mail' || (id % 50) || '.org' END AS domain, 'pub' || (id % 20) AS publication, CASE WHEN id % 7 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'English ' || id ELSE lang || ' ' || id END END AS name FROM records)
SELECT id AS index, domain, publication, name AS company_name FROM n WHERE domain IS NOT NULL AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain, publication ORDER BY id) = 1"""))
def tender_notices(spark, sf):
    """A multilingual notice for each record, once for each buyer's domain and publication: by its site, else by its address."""
    i = F.col("id")
    text = i.cast("string")
    own = F.create_map(F.lit("xxx"), F.array(F.concat("lang", F.lit(" "), text)))
    name = F.when(i % 7 != 0, F.when(i % 2 == 0, F.map_concat(own, F.create_map(F.lit("eng"), F.array(F.concat(F.lit("English "), text))))).otherwise(own))
    rows = load(spark, sf, "records")[0].select(i.alias("index"), F.concat(F.lit("pub"), (i % 20).cast("string")).alias("publication"), name.alias("buyer_name"), own.alias("title"), F.when(i % 3 == 0, F.concat(F.lit("http://www.buyer"), (i % 50).cast("string"), F.lit(".org/a"))).alias("url"), F.when(i % 3 == 1, F.concat(F.lit("x@mail"), (i % 50).cast("string"), F.lit(".org"))).alias("email"))
    return normalize.normalize_tenders_ted(rows).select("index", "domain", "publication", "company_name")


@query(sql("companies", """, n AS (SELECT id, canonical_domain AS domain, 1 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS told, CASE WHEN id % 3 = 0 AND domain IS NOT NULL THEN 1 ELSE 0 END AS routes,
  CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 3 = 0 AND domain IS NULL THEN 1 ELSE 0 END + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS notes FROM companies)
SELECT id AS index, CASE WHEN id % 17 = 0 THEN 'positioning isn''t a text of at most 600 characters' WHEN id % 23 = 0 THEN 'not_an_object' END AS reason, CASE WHEN id % 17 <> 0 AND id % 23 <> 0 THEN notes END AS n_notes, CASE WHEN id % 17 <> 0 AND id % 23 <> 0 THEN routes END AS n_routes,
  CASE WHEN id % 17 <> 0 AND id % 23 <> 0 THEN round(CASE WHEN notes > 0 THEN greatest(0.2::DOUBLE, 0.4::DOUBLE + 0.1::DOUBLE * told + 0.05::DOUBLE * routes - 0.1::DOUBLE * notes) ELSE 0.4::DOUBLE + 0.1::DOUBLE * told + 0.05::DOUBLE * routes END, 4) END AS confidence FROM n"""))
def validated_profiles(spark, sf):
    """A model's profile of each company: notes on what was dropped, routes kept, and confidence, or why it was rejected."""
    i = F.col("id")
    routes = F.array_compact(F.array(F.when(i % 3 == 0, F.concat(F.lit("Jane@"), F.coalesce("canonical_domain", F.lit("gone.example")))), F.when(i % 5 == 0, "ceo@totally-different.com"), F.when(i % 7 == 0, "not-an-email")))
    people = F.array_compact(F.array(F.struct(F.lit("Dana Reed").alias("name"), F.lit("CTO").alias("role")), F.when(i % 4 == 0, F.struct(F.lit("Invented Person").alias("name"), _none().alias("role")))))
    payload = _json(positioning=F.lit("Sells"), business_model=F.when(i % 2 == 0, "B2B"), technology_mentions=F.array(F.lit("Python"), F.lit("Python")), contact_routes=routes, decision_makers=people)
    payload = F.when(i % 17 == 0, F.lit('{"positioning":{"nested":"object"}}')).when(i % 23 == 0, F.lit("[]")).otherwise(payload)
    rows = load(spark, sf, "companies")[0].select(i.alias("index"), F.col("canonical_domain").alias("domain"), F.lit("Our CTO is dana reed.").alias("page_text"), payload.alias("payload"))
    good, bad = validate.validate_profile(rows)
    return good.select("index", _none().alias("reason"), F.size("notes").alias("n_notes"), F.size("contact_routes").alias("n_routes"), "confidence").unionByName(bad, allowMissingColumns=True)


@query(sql("contacts", """
SELECT id, email, ['company_website', 'verified_provider', 'manual_review', 'other'][id % 4 + 1] AS source_type, CASE WHEN id % 5 = 0 THEN 0.35::DOUBLE ELSE [0.75::DOUBLE, 0.95::DOUBLE, 0.9::DOUBLE, NULL][id % 4 + 1] END AS confidence,
  CASE WHEN id % 3 = 0 THEN 'checked' ELSE ['public_source', 'provider_verified', 'manual_verified', NULL][id % 4 + 1] END AS verification_status FROM contacts"""))
def evidence_defaults(spark, sf):
    """Contact evidence with the confidence and status of its source type, where it says none that can be used."""
    i = F.col("id")
    rows = load(spark, sf, "contacts")[0].withColumns({"company_id": i, "source_type": F.get(F.array(*map(F.lit, ("company_website", "verified_provider", "manual_review", "other"))), (i % 4).cast("int")), "email": F.upper("email"), "evidence_urls": F.lit("https://e.example/1"), "confidence": F.when(i % 5 == 0, "0.35").when(i % 5 == 1, "high").when(i % 5 == 2, "7"), "verification_status": F.when(i % 3 == 0, "checked").when(i % 3 == 1, " ")})
    return capture.evidence_rows(rows).select(F.col("company_id").alias("id"), "email", "source_type", "confidence", "verification_status")


@query(sql("contacts", """, v AS (SELECT id, company_id, email, id AS i FROM contacts WHERE contact_kind <> 'generic' AND company_id % 9 <> 0 UNION ALL SELECT id, company_id + 1, email, id + 1000000 FROM contacts WHERE contact_kind = 'person' AND company_id % 9 <> 0),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY email ORDER BY i) = 1)
SELECT id, company_id, email FROM f QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY i) <= 1"""))
def provider_rows(spark, sf):
    """Verified addresses of a provider, once each and one a company (the feature's cap); persons come again under another company."""
    contacts = load(spark, sf, "contacts")[0]
    rows = contacts.select("id", "company_id", F.when(F.col("contact_kind") == "generic", F.replace("email", F.lit("@"), F.lit(" at "))).otherwise(F.upper("email")).alias("email"), F.when(F.col("company_id") % 9 == 0, "guessed").otherwise("Verified").alias("email_status"), F.col("id").alias("index"))
    again = rows.join(contacts.filter("contact_kind = 'person'").select("id"), "id").withColumns({"company_id": F.col("company_id") + 1, "index": F.col("index") + 1_000_000})
    return capture.verified_provider_rows(rows.unionByName(again), 1).select("id", "company_id", "email")


@query(sql("contacts companies", "SELECT c.id AS page_id, email FROM contacts k JOIN companies c ON c.id = k.company_id WHERE contact_kind <> 'role_inbox' AND split_part(email, '@', 2) = canonical_domain"))
def page_email_evidence(spark, sf):
    """Personal addresses of the company in the text of a page for each company that names all its contacts, one twice."""
    contacts, companies = load(spark, sf, "contacts", "companies")
    text = contacts.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_list("email")), ", ").alias("text"))
    parsed = text.join(companies.select(F.col("id").alias("company_id"), F.col("canonical_domain").alias("domain")), "company_id").select(F.col("company_id").alias("page_id"), F.lit("u").alias("url"), "domain", F.concat("text", F.lit(" "), "text").alias("text"))
    return capture.page_email_evidence(parsed).select("page_id", "email")


@query(sql("companies boards", """, stored AS (SELECT id FROM companies WHERE id % 5 = 0)
SELECT c.id AS company_id, 'NO_ATS_BOARD_FOUND' AS signal_type, CASE WHEN c.id % 2 = 0 THEN 'https://c.example/' || c.id END AS source_url FROM companies c WHERE c.id NOT IN (SELECT company_id FROM boards) AND c.id NOT IN (SELECT id FROM stored)"""))
def board_misses(spark, sf):
    """A signal for each company without a board, once though misses come twice; a fifth of the companies has it stored, with and without URL."""
    companies, boards = load(spark, sf, "companies", "boards")
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://c.example/"), F.col("id").cast("string")))
    gone = resolve.without(companies, boards).select(F.col("id").alias("company_id"), F.col("id").alias("index"), url.alias("careers_url"))
    misses = gone.unionByName(gone.withColumn("index", F.col("index") + 1_000_000))
    old = companies.filter("id % 5 = 0").select(F.col("id").alias("company_id"), F.lit("NO_ATS_BOARD_FOUND").alias("signal_type"), F.lit("signal_enrichment").alias("source"), F.coalesce(url, F.lit("")).alias("source_url"))
    return signals.no_board_signals(misses, old).select("company_id", "signal_type", "source_url")


@query(sql("signals", """, n AS (SELECT company_id, count(*) AS n, count(*) FILTER (signal_type IN ('STALE_ENGINEERING_ROLE', 'AGING_ENGINEERING_ROLE', 'HIRING_SPIKE', 'OPERATIONS_SOFTWARE_NEED', 'TECH_STACK_NEED')) AS tech FROM signals GROUP BY 1)
SELECT company_id, CASE WHEN tech > 0 THEN 85 WHEN n > 0 THEN 50 ELSE 0 END AS technical_capacity_gap, CASE WHEN n >= 3 THEN 90 WHEN n = 2 THEN 75 WHEN n = 1 THEN 60 ELSE 0 END AS source_confidence FROM n"""))
def score_parts(spark, sf):
    """Capacity gap and source confidence of each company with signals."""
    from tallyhound.functions import terms as t

    n = load(spark, sf, "signals")[0].groupBy("company_id").agg(F.count("*").alias("n"), F.count_if(F.col("signal_type").isin(*t.TECH_TYPES)).alias("tech"))
    gap, sure = scoring.sub_scores(F.col("tech"), F.col("n"))
    return n.select("company_id", gap.alias("technical_capacity_gap"), sure.alias("source_confidence"))


@query(sql("records signals", """, a AS (SELECT company_id, count(*) AS records FROM records WHERE company_id IS NOT NULL GROUP BY 1), b AS (SELECT company_id, count(*) AS signals FROM signals GROUP BY 1)
SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(records, 0) AS records, coalesce(signals, 0) AS signals FROM a FULL JOIN b ON a.company_id = b.company_id"""))
def record_and_signal_counts(spark, sf):
    """Records and signals of each company that has either."""
    records, found = load(spark, sf, "records", "signals")
    a = records.filter("company_id IS NOT NULL").groupBy("company_id").agg(F.count("*").alias("records"))
    return resolve.outer_counts(a, found.groupBy("company_id").agg(F.count("*").alias("signals")), "company_id")


@query("""
WITH o AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
t AS (SELECT page_id, list_concat([origin || '/', origin || '/about'], list_transform(regexp_extract_all(nav, 'href="(/[^"]*)"', 1), lambda h: origin || replace(h, '&amp;', '&'))) AS u FROM o),
i AS (SELECT page_id, u[k] AS url, min(k) AS k FROM (SELECT *, unnest(range(1, len(u) + 1)) AS k FROM t) GROUP BY ALL)
SELECT page_id, array_to_string(list(url ORDER BY k)[1:6], ' ') AS targets FROM i GROUP BY page_id""")
def page_fetch_targets(spark, sf):
    """Pages to fetch for each saved page: its host's front and about pages, then what its menu links to, each once and six at most (the feature's limit)."""
    pages = load(spark, sf, "pages")[0]
    menu = F.regexp_extract_all(F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1), F.lit(r'href="(/[^"]*)"'), F.lit(1))
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    targets = w.page_targets(F.array(F.concat(origin, F.lit("/")), F.concat(origin, F.lit("/about"))), F.transform(menu, lambda h: F.concat(origin, F.replace(h, F.lit("&amp;"), F.lit("&")))), 6)
    return pages.select("page_id", F.array_join(targets, " ").alias("targets"))


@query("""
WITH k AS (SELECT page_id % 40 AS company_id, CASE WHEN regexp_matches(url, '(?i)/(blog|news|insights)') THEN 'blog' WHEN regexp_matches(url, '(?i)(docs\\.|/docs|/documentation)') THEN 'docs' ELSE 'website' END AS kind FROM pages)
SELECT company_id, count(*) AS web_presence_count, array_to_string(list_sort(list_distinct(list(kind))), ', ') AS web_presence_kinds FROM k GROUP BY 1""")
def web_presence(spark, sf):
    from tallyhound.functions import columns as c

    rows = load(spark, sf, "pages")[0].select((F.col("page_id") % 40).alias("company_id"), F.coalesce(c.presence_kind(F.col("url")), F.lit("website")).alias("presence_kind"))
    return reports.presence_summary(rows)
