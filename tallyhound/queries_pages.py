"""Registered queries on pages and threads: stored selectors, markup, founders, portfolios, published contacts, comment trees; each with its SQL where
SQL can say it.

Saved pages have neither job cards nor founders nor portfolios. Selectors are played on what they have; the others read pages that Spark writes from the
companies' rows, one for each company or country.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhound.adapters import load, spread, sql
from tallyhound.operators import capture, elements, portfolio
from tallyhound.queries import query
from tallyhound.sources import normalize
from tallyhound.store import write_shared

_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


def _plain(x: str) -> str:
    """A text of markup without entities and outer blanks, null if empty. HTML reads these entities without their semicolon too."""
    for name, sign in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{sign}', 'g')"
    return f"nullif(trim({x}), '')"


# --- stored selectors -------------------------------------------------------------------------------------------------------------


def _rules(spark, sf):
    """Two rules for every host, and for some a broken or an incomplete one."""
    pages = load(spark, sf, "pages")[0]
    hosts = pages.select(elements.host_of(F.col("url")).alias("page_host")).filter("page_host <> ''").distinct()
    none = F.lit(None).cast("string")

    def rule(key, container, title, url, location=none, department=none):
        values = (F.lit(x) if isinstance(x, str) else x for x in (container, title, url, location, department))
        return F.struct(F.concat(F.lit(f"{key}:"), "page_host").alias("source_key"), "page_host", *(v.alias(f) for f, v in zip(elements.FIELDS, values, strict=True)))

    odd = F.length("page_host") % 2 == 1
    every = F.array(rule("menu", "nav ul > li", "a", "a[href]"), rule("page", "body", "article > h1", "nav a, article a", "footer", "div.ad"))
    broken = F.when(odd, F.array(rule("broken", "li[", "a", "a"))).otherwise(F.array(rule("partial", "li", "a", " ")))
    return pages, hosts.select(F.explode(F.concat(every, broken)).alias("r")).select("r.*")


_MENU = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_ORIGIN} AS origin, html FROM pages),
nav AS (SELECT *, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM p),
li AS (SELECT page_id, host, origin, unnest(regexp_extract_all(nav, '<li><a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(nav, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS said FROM nav),
menu AS (SELECT 'menu:' || host AS source_key, page_id, {_plain("said")} AS title, origin || {_plain("href")} AS url, NULL AS location, NULL AS department FROM li),
page AS (SELECT 'page:' || host, page_id, {_plain("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, origin || {_plain('''regexp_extract(nav, 'href="([^"]*)"', 1)''')}, {_plain("regexp_extract(html, '<footer>([^<]*)</footer>', 1)")},
  {_plain('''regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)''')} FROM nav),
found AS (SELECT * FROM menu UNION ALL SELECT * FROM page)"""


@query(_MENU + " SELECT * FROM found WHERE title IS NOT NULL AND url IS NOT NULL")
def selector_jobs(spark, sf):
    """What two stored rules for each host find on all its pages: menu entries, and the heading with the first link, the footer and the ad."""
    pages, rules = _rules(spark, sf)
    nodes = write_shared(elements.element_table(pages), "elements")
    fine, _ = elements.checked_rules(rules)
    return elements.apply_selectors(nodes, fine).drop("container")


@query(_MENU + """, n AS (SELECT source_key, page_id, count(*) AS jobs FROM found WHERE title IS NOT NULL AND url IS NOT NULL GROUP BY ALL),
asked AS (SELECT 'menu:' || host AS source_key, page_id, NULL AS error FROM p UNION ALL SELECT 'page:' || host, page_id, NULL FROM p
  UNION ALL SELECT CASE WHEN length(host) % 2 = 1 THEN 'broken:' ELSE 'partial:' END || host, page_id, 'x' FROM p),
results AS (SELECT source_key, coalesce(jobs, 0) >= 2 AND error IS NULL AS ok FROM asked LEFT JOIN n USING (source_key, page_id))
SELECT source_key, count(*) AS sample_size, count(*) FILTER (ok) / count(*) AS success_rate, CASE WHEN count(*) >= 5 AND count(*) FILTER (ok) / count(*) >= 0.8 THEN 'active' ELSE 'failed' END AS status FROM results GROUP BY 1""")
def judged_parsers(spark, sf):
    """How each stored rule does on the pages of its host, two finds a page asked for, and whether it may be used."""
    pages, rules = _rules(spark, sf)
    nodes = write_shared(elements.element_table(pages), "elements")
    fine, _ = elements.checked_rules(rules)
    jobs = elements.apply_selectors(nodes, fine)
    return elements.judge_parsers(elements.validate_selectors(pages, rules, jobs, 2))


@query()
def cleaned_markup(spark, sf):
    """Markup of every saved page without noise, up to the budget of a prompt."""
    return elements.condense_html(write_shared(elements.element_table(load(spark, sf, "pages")[0]), "elements"))


# --- founders and portfolios ------------------------------------------------------------------------------------------------------

_FOUNDED = """, n AS (SELECT id, canonical_name AS name, lower(replace(canonical_name, '#', '-')) AS slug FROM companies)
SELECT id AS page_id, name || ' A' AS name, 'CEO' AS role, 'https://' || slug || '.example/people/' || id AS profile_url, 'json' AS found_in FROM n WHERE id % 3 = 0
UNION ALL SELECT id, 'B ' || name, 'CTO', NULL, 'json' FROM n WHERE id % 3 = 0
UNION ALL SELECT id, 'Ann ' || slug, 'Founder', 'https://' || slug || '.example/people/' || id, 'links' FROM n WHERE id % 3 = 1"""


@query(sql("companies", _FOUNDED))
def page_founders(spark, sf):
    """Founders of a page for each company: in JSON under a path that depends on the company, in links, or none. A second one of a name in other letters is left out."""
    slug = F.lower(F.replace("canonical_name", F.lit("#"), F.lit("-")))
    rows = spread(load(spark, sf, "companies")[0]).select("id", "canonical_name", slug.alias("slug"), "country")
    person = lambda **f: F.to_json(F.struct(*(v.alias(k) for k, v in f.items())))
    a = person(full_name=F.concat("canonical_name", F.lit(" A")), role=F.lit("CEO"), path=F.concat(F.lit("/people/"), F.col("id").cast("string")))
    b = person(name=F.concat(F.lit("B "), F.col("canonical_name")), position=F.lit("CTO"))
    again = person(name=F.upper(F.concat("canonical_name", F.lit(" A"))))
    data = F.concat(F.lit('{"props":[{"'), F.col("country"), F.lit('":{"TheFounders":{"list":['), a, F.lit(","), b, F.lit(","), again, F.lit(']},"staff":[{"name":"No Founder"}]}}]}'))
    cards = F.concat(F.lit('<ul><li><a href="/people/'), F.col("id").cast("string"), F.lit('">Ann '), F.col("slug"), F.lit('</a> <b>Founder</b></li><li><a href="/people/0">ANN '), F.upper("slug"), F.lit("</a></li></ul>"))
    html = F.when(F.col("id") % 3 == 0, F.concat(F.lit("<div data-page='"), data, F.lit("'></div>"), cards)).when(F.col("id") % 3 == 1, cards).otherwise("<p>nothing</p>")
    pages = rows.select(F.col("id").alias("page_id"), F.concat(F.lit("https://"), F.col("slug"), F.lit(".example/c/x")).alias("url"), html.alias("html"))
    nodes = write_shared(elements.element_table(pages), "elements")
    return portfolio.extract_founders(nodes, pages).select("page_id", "name", "role", "profile_url", "found_in")


#: Company numbers that share pages of a portfolio; companies whose pages a task puts together.
PAGED, GATHERED = 5_000, 30_000


def _portfolio_pages(spark, sf):
    """Pages of cards for each country and layout, one for each block of company numbers, as long lists are paged; each company stands twice on its page, in other letters the
    second time."""
    slug = F.lower(F.replace("canonical_name", F.lit("#"), F.lit("-")))
    rows = load(spark, sf, "companies")[0].withColumn("slug", slug).withColumn("site", F.concat(F.lit("https://"), "slug", F.lit(".example")))
    text = lambda *parts: F.concat(*(F.lit(x) if "<" in x or ">" in x else F.col(x) for x in parts))
    tiles = text('<div class="tile tile--company" data-companyname="', "canonical_name", '"><div class="tile__description">', "industry", "</div><a class=locationtag>", "country", '</a><div class="meta__row__role">CEO</div><a class="text-link" href="https://www.linkedin.com/in/', "slug", '">', "slug", "</a></div>")
    mix = text('<div class="company__item mix fin-tech 2024"><a href="https://x.com/<"></a><a href="', "site", '"><span class="company__item__name">', "canonical_name", '</span><div class="company__item__description__content">', "industry", "</div></a></div>")
    cms = text('<div role="listitem"><a href="', "site", '"><b fs-cmsfilter-field="name">', "canonical_name", '</b><i fs-cmsfilter-field="location">', "country", '</i><i fs-cmsfilter-field="sector">', "industry", "</i></a></div>")
    tasks = max(spark.sparkContext.defaultParallelism, -(-load(spark, sf, "customer")[0].count() // GATHERED))  # by rows: merged by their packed bytes, one task would hold all pages
    for k, (layout, card) in enumerate((("tiles", tiles), ("mix_items", mix), ("cms_list", cms))):
        own = rows.filter(F.col("id") % 3 == k).select("country", F.floor(F.col("id") / PAGED).alias("block"), "id", card.alias("card")).repartition(tasks, "country", "block")
        whole = own.groupBy("country", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "card"))), lambda x: F.concat(x["card"], F.regexp_replace(x["card"], "Customer#", "CUSTOMER#"))), "").alias("html"))
        yield layout, whole.select(F.xxhash64("country", "block").alias("page_id"), "country", F.lit("https://portfolio.example/").alias("url"), "html")


def _portfolio(spark, sf):
    frames = []
    for layout, pages in _portfolio_pages(spark, sf):
        nodes = write_shared(elements.element_table(pages), "elements")
        found = portfolio.parse_portfolio_pages(nodes, pages, layout)
        found = found.join(pages.select("page_id", F.col("country").alias("page_country")), "page_id").withColumn("layout", F.lit(layout))
        frames.append(write_shared(found, "portfolio"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


_CARDS = """, n AS (SELECT *, id % 3 AS k, lower(replace(canonical_name, '#', '-')) AS slug FROM companies),
cards AS (SELECT country AS page_country, ['tiles', 'mix_items', 'cms_list'][k + 1] AS layout, canonical_name AS company_name, CASE WHEN k = 0 THEN slug END AS source_record_id, CASE WHEN k > 0 THEN 'https://' || slug || '.example' END AS website,
  CASE WHEN k < 2 THEN industry END AS description, CASE WHEN k <> 1 THEN country END AS location, CASE k WHEN 1 THEN 'fin tech' WHEN 2 THEN industry END AS industry, CASE WHEN k = 0 THEN slug || ':CEO' END AS people FROM n)"""


@query(sql("companies", _CARDS + " SELECT * FROM cards"))
def portfolio_companies(spark, sf):
    people = F.nullif(F.array_join(F.transform("people", lambda p: F.concat_ws(":", p["name"], p["role"])), ","), F.lit(""))
    return _portfolio(spark, sf).select("page_country", "layout", "company_name", "source_record_id", "website", "description", "location", "industry", people.alias("people"))


@query(sql("companies", _CARDS + """
SELECT layout, count(*) AS companies, count(website) AS websites, count(people) AS people,
  CAST(round(25 * count(website) / count(*) + 15 * count(description) / count(*) + 10 * count(industry) / count(*) + 10 * count(location) / count(*) + 30 * count(people) / count(*)) AS INT) AS quality_score FROM cards GROUP BY layout"""))
def portfolio_coverage(spark, sf):
    return portfolio.coverage_score(_portfolio(spark, sf), ["layout"]).select("layout", "companies", "websites", "people", "quality_score")


# --- published contacts -----------------------------------------------------------------------------------------------------------


@query(sql("records companies", """, r AS (
  SELECT r.id, r.company_id, c.canonical_domain AS domain, source_id, CASE WHEN r.id % 7 = 3 THEN NULL ELSE (CASE WHEN r.id % 5 < 3 THEN 'buyer' ELSE 'tender' || r.id % 9 END) || '@' || (CASE WHEN r.id % 2 = 0 THEN lower(replace(canonical_name, '#', '-')) || '.com' ELSE 'gmail.com' END) END AS email,
    CASE WHEN r.id % 3 = 0 THEN 'Name ' || lang END AS full_name, CASE WHEN r.id % 4 = 0 THEN '+44 20 ' || (r.company_id % 50) END AS phone, 'https://t.example/' || (r.id % 3) AS source_url
  FROM records r JOIN companies c ON c.id = r.company_id WHERE length(source_id) % 2 = 0),
k AS (SELECT * FROM r WHERE coalesce(email, full_name, phone) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id, email, phone, source_url ORDER BY id DESC) = 1)
SELECT company_id, email, full_name, phone, source_url, CASE WHEN full_name IS NOT NULL THEN 'person' WHEN email IS NOT NULL THEN 'role_inbox' ELSE 'unknown' END AS contact_kind, coalesce(split_part(email, '@', 2) = lower(domain), false) AS on_company_domain,
  CASE WHEN email IS NULL THEN 'no_email' WHEN email LIKE '%@gmail.com' THEN 'free_mail_domain' WHEN domain IS NULL OR split_part(email, '@', 2) <> domain THEN 'no_mx_record' ELSE 'deliverable_domain' END AS deliverability FROM k"""))
def procurement_contacts(spark, sf):
    """Contacts in tender records whose payloads come from all records; addresses repeat within a company, and some records name none."""
    records, companies = load(spark, sf, "records", "companies")
    named = companies.select(F.col("id").alias("company_id"), F.col("canonical_domain").alias("domain"), F.concat(F.lower(F.replace("canonical_name", F.lit("#"), F.lit("-"))), F.lit(".com")).alias("host"))
    i = F.col("id")
    text = lambda x: x.cast("string")
    email = F.concat(F.when(i % 5 < 3, "Buyer").otherwise(F.concat(F.lit("tender"), text(i % 9))), F.lit("@"), F.when(i % 2 == 0, F.col("host")).otherwise("gmail.com"))
    payload = F.to_json(F.struct(F.when(i % 7 != 3, email).alias("contact_email"), F.when(i % 3 == 0, F.concat(F.lit(" Name "), "lang")).otherwise(" ").alias("contact_name"), F.when(i % 4 == 0, F.concat(F.lit("+44 20 "), text(F.col("company_id") % 50))).alias("contact_phone")))
    rows = records.join(named, "company_id").select("id", "company_id", "domain", F.col("source_id").alias("source_key"), F.when(F.length("source_id") % 2 == 0, "procurement_discovery").otherwise("feed").alias("source_type"), F.concat(F.lit("https://t.example/"), text(i % 3)).alias("source_url"), payload.alias("raw_payload"))
    mx = companies.filter("canonical_domain IS NOT NULL").select(F.col("canonical_domain").alias("domain"), F.lit(1).alias("mx_count"), F.lit(None).cast("string").alias("error"))
    return capture.procurement_contacts(rows, mx).drop("source_type", "raw_evidence")


@query(sql("contacts companies", f"""
, p AS (SELECT k.company_id, canonical_domain AS domain, email, k.id, contact_kind, split_part(email, '@', 2) = canonical_domain AS own FROM contacts k JOIN companies c ON c.id = k.company_id WHERE canonical_domain IS NOT NULL),
x AS (SELECT *, CASE WHEN NOT own THEN 'external_email' WHEN contact_kind = 'role_inbox' THEN 'low_value_generic_inbox' ELSE 'direct_person' END AS candidate_type FROM p)
SELECT company_id, email, CASE contact_kind WHEN 'person' THEN 'Jane Doe' END AS full_name, CASE contact_kind WHEN 'person' THEN 'CTO' WHEN 'generic' THEN 'Head Of Product' END AS role,
  CASE contact_kind WHEN 'generic' THEN 'mailto_link' ELSE 'email_regex' END AS extraction, candidate_type, CASE WHEN candidate_type <> 'direct_person' THEN 'reject' WHEN contact_kind = 'person' THEN 'approve_candidate' ELSE 'needs_review' END AS recommended_status,
  CASE contact_kind WHEN 'person' THEN 0.9::DOUBLE WHEN 'generic' THEN 0.82::DOUBLE ELSE 0.72::DOUBLE END AS confidence FROM x QUALIFY row_number() OVER (PARTITION BY domain, email ORDER BY company_id) = 1"""))
def contact_candidates(spark, sf):
    """Candidates on a page for each company that holds its contacts: a link, a line with name and role, and a bare address; all kinds are kept."""
    contacts, companies = load(spark, sf, "contacts", "companies")
    of = contacts.groupBy("company_id").agg(*(F.max(F.when(F.col("contact_kind") == k, F.col("email"))).alias(k) for k in ("generic", "person", "role_inbox")))
    gap = "<p>" + "x " * 200 + "</p>"
    html = F.concat(F.lit('<p>Team</p><p>Head of Product</p><a href="mailto:'), F.upper("generic"), F.lit(f'?subject=a">mail</a>{gap}<p>Jane Doe, our CTO: '), F.col("person"), F.lit(f"</p>{gap}<p>write to "), F.col("role_inbox"), F.lit("</p>"))
    html = F.concat(F.lit("<p>Head of Product: "), F.col("generic"), F.lit("</p>"), html)
    pages = of.join(companies.select(F.col("id").alias("company_id"), F.col("canonical_domain").alias("domain")), "company_id").filter("domain IS NOT NULL").select(F.col("company_id").alias("page_id"), F.concat(F.lit("https://"), "domain").alias("url"), "domain", html.alias("html"))
    parsed = capture.parse_html(pages).join(pages.select("page_id", "domain"), "page_id")
    found = capture.contact_candidates(parsed, include_generic=True, include_external=True)
    return found.select(F.col("page_id").alias("company_id"), "email", "full_name", "role", "extraction", "candidate_type", "recommended_status", "confidence")


# --- threads ----------------------------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE c AS (SELECT conv_id * 100000 + turn AS id, CASE WHEN turn % 31 = 30 THEN -1 WHEN turn % 17 = 16 THEN conv_id * 100000 + turn ELSE conv_id * 100000 + turn // 2 END AS up, turn, conv_id FROM conversations),
firsts AS (SELECT conv_id, min(turn) AS t FROM c GROUP BY conv_id),
e AS (SELECT id, CASE WHEN c.turn = t THEN NULL WHEN up = id AND turn % 17 <> 16 THEN NULL ELSE up END AS up FROM c JOIN firsts USING (conv_id)),
tree AS (SELECT id AS root, id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM e WHERE up IS NULL UNION ALL SELECT root, e.id, depth + 1, path || '/' || CAST(e.id AS VARCHAR) FROM tree JOIN e ON e.up = tree.id),
lost AS (SELECT id FROM e WHERE up = -1 UNION ALL SELECT e.id FROM lost JOIN e ON e.up = lost.id)
SELECT root, id, depth, path, NULL AS reason FROM tree
UNION ALL SELECT NULL, id, NULL, NULL, CASE WHEN id IN (SELECT id FROM lost) THEN 'missing_parent' ELSE 'cycle' END FROM e WHERE id NOT IN (SELECT id FROM tree)""")
def comment_threads(spark, sf):
    """Turns as comments under the turn of half their number: paths from the root. Some turns answer themselves or a comment that isn't there; these, and what hangs on them, have no path."""
    turns = load(spark, sf, "conversations")[0]
    key, own = F.col("conv_id") * 100_000, F.col("turn")
    up = F.when(own % 31 == 30, F.lit(-1).cast("long")).when(own % 17 == 16, key + own).otherwise(key + F.floor(own / 2))
    least = turns.groupBy("conv_id").agg(F.min("turn").alias("_t"))
    rows = turns.join(least, "conv_id").select((key + own).alias("id"), F.when((own == F.col("_t")) | ((up == key + own) & (own % 17 != 16)), F.lit(None)).otherwise(up).alias("parent"))
    good, bad = normalize.flatten_comment_tree(rows)
    return good.select("root", "id", "depth", F.array_join("path", "/").alias("path")).unionByName(bad, allowMissingColumns=True)
