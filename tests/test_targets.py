"""Boards, routes, drafts and identity writes on small inputs."""

from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.operators import capture, signals, upsert
from tallyhound.plans import drafts, ingest

RECORD = "id int, created_at int, company_id string, name string, domain string"
COMPANY = "id string, canonical_name string, canonical_domain string"


def test_trim_to_words(spark):
    texts = ["Just one. And more of it", "This sentence has five words. The rest goes.", "one two three four five six and of the", "a b c d e f g, and the other", "  short.  ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(c.trim_to_words(F.col("x"), 6)).collect()]
    assert got == ["Just one. And more of it", "This sentence has five words", "one two three four five six", "a b c d e f", "short", "", None]
    assert df.filter("i = 3").select(c.trim_to_words(F.col("x"), 9)).first()[0] == "a b c d e f g"


def test_board_tokens(spark):
    urls = ["https://jobs.lever.co/Acme%2DOne/1", "https://jobs.lever.co/embed.js", "https://jobs.lever.co/widget", "https://jobs.lever.co/x", "https://jobs.lever.co/", "https://jobs.lever.co//two?x", None, "https://jobs.lever.co/bad%ZZ"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r[0] for r in df.orderBy("i").select(c.board_token(F.col("u"))).collect()] == ["acme-one", None, None, None, None, "two", None, None]


def test_boards(spark):
    rows = [
        (1, "a.com", "https://a.com/careers", "https://www.jobs.lever.co/acme"),
        (1, "a.com", "https://jobs.lever.co/acme", "https://a.com"),
        (2, "b.com", "https://www.b.com/careers/", "https://jobs.lever.co/embed"),
        (3, "c.com", "https://c.com/about", None),
        (None, None, None, None),
    ]
    found, misses = signals.board_detections(spark.createDataFrame(rows, "company_id int, domain string, page_url string, href string"))
    assert sorted(map(tuple, found.select("company_id", "ats_provider", "board_token", "confidence").collect())) == [(1, "lever", "acme", 0.98), (2, "generic", "b.com/careers", 0.55)]
    assert {r.company_id for r in misses.collect()} == {3, None}


def test_routes_and_names(spark):
    html = """<h1>Acme</h1><a href="mailto:Jane%40acme.com?subject=x">Mail</a><p>Jane Doe, CEO and John Roe, founder</p><p>write to bob@acme.com</p><p>Mary Major sings</p>"""
    pages = spark.createDataFrame([(1, "https://acme.com/contact", html), (2, "https://acme.com/", None)], "page_id long, url string, html string")
    parsed = capture.parse_html(pages).withColumn("reason_to_write", F.lit("new role"))
    routes = [tuple(r) for r in capture.contact_routes(parsed).orderBy("page_id", "index").select("page_id", "route_type", "value").collect()]
    assert routes == [(1, "page", "https://acme.com/contact"), (1, "mailto", "jane@acme.com"), (1, "email_text", "bob@acme.com")]
    assert {tuple(r) for r in capture.decision_maker_names(parsed).collect()} == {(1, "Jane Doe - CEO"), (1, "John Roe - CEO")}
    assert [r.summary for r in capture.research_summary(parsed).orderBy("page_id").collect()] == ["Acme Trigger: new role", "Trigger: new role"]


def test_drafts(spark):
    queue = spark.createDataFrame([(1, "Acme", "jo.bloggs@a.com", None, "x"), (2, None, "1@b.com", " ", "y"), (3, "C", "c@c.com", "Cy", "z")], "company_id int, company string, email string, contact_name string, extra string")
    facts = spark.createDataFrame([(1, "We run ERP for plants.", ["erp rollout"], ["  ", "Automation"], None), (3, None, None, ["Workflow", "b", "c", "d"], [])], "company_id int, positioning string, service_fit_evidence array<string>, technology_mentions array<string>, customer_terms array<string>")
    got = {r.company_id: r for r in drafts.message_drafts(queue, facts, "Pitch.", "Sam").collect()}
    assert [got[i].contact_name for i in (1, 2, 3)] == ["Jo", "there", "Cy"]
    assert [got[i].project_area for i in (1, 2, 3)] == ["plant workflow and systems integration", "the open engineering work", "agent workflow integrations"]
    assert got[1].personalization_basis == "positioning: We run ERP for plants | tech: Automation | fit: erp rollout"
    assert got[2].personalization_basis == "" and "your team is hiring. The open roles" in got[2].body
    assert "The site mentions Workflow, b, c." in got[3].body and got[3].extra == "z"
    assert drafts.outcome_template(drafts.message_drafts(queue, facts, "Pitch.", "Sam")).count() == 3


def test_names_alone(spark):
    companies = spark.createDataFrame([("c1", "Known", "known.com")], COMPANY)
    rows = [(1, 1, None, "Fresh", None), (2, 2, None, "FRESH", None), (3, 3, None, "Known", None), (4, 4, None, "Later", "later.com"), (5, 5, None, "later", None), (6, 6, None, None, None), (7, 7, None, " ", "later.com"), (8, 0, None, "Later", None)]
    got = {r.id: r for r in upsert.resolve_identities(spark.createDataFrame(rows, RECORD), companies, True).collect()}
    assert [got[i].action for i in range(1, 9)] == ["create", "match_name", "match_name", "create", "match_name", "review_missing_name", "review_missing_name", "create"]
    assert got[1].resolved_id == got[2].resolved_id and got[3].resolved_id == "c1"
    assert got[5].resolved_id == got[8].resolved_id != got[4].resolved_id  # the earliest company of that name


def test_identity_writes(spark):
    companies = spark.createDataFrame([("c1", "Known", "known.com")], COMPANY)
    person = "struct<name:string,role:string,profile_url:string,linkedin_url:string,x_url:string,bio:string,email:string>"
    records = spark.createDataFrame(
        [
            (1, "s", "e1", None, 1, None, "Known", "known.com", ["Old"], [("Jo Doe", "CEO", "https://p", None, None, None, None)]),
            (2, "s", "e2", None, 2, None, "New", "new.com", None, None),
            (3, "s", "e2", None, 3, None, "New", "new.com", [], []),
            (4, "s", "e4", None, 4, None, "Bare", None, None, None),
            (5, "s", "e5", None, 5, "c9", None, None, None, [("jo doe", None, None, None, None, None, None)]),
        ],
        f"id int, source_id string, external_id string, source_url string, created_at int, company_id string, name string, domain string, former_names array<string>, founders array<{person}>",
    )
    aliases = spark.createDataFrame([("c1", "Known", "name")], "company_id string, alias string, alias_type string")
    stored = spark.createDataFrame([("s", "e1")], "source_id string, external_id string")
    out = ingest.process_source_records(records, companies, aliases, stored)
    assert {r.counter: r.n for r in out["summary"].collect()} == {
        "scanned": 5, "companies_created": 1, "companies_matched": 2, "review_items_created": 1, "skipped_already_linked": 1, "aliases_created": 2,
        "source_identities_created": 2, "founders_created": 1, "founder_links_created": 2, "founder_profiles_created": 1,
    }
    assert [(r.id, r.reason) for r in out["reviews"].collect()] == [(4, "missing_domain")]
    assert [r.canonical_domain for r in out["companies"].collect()] == ["new.com"]
    none = ingest.process_source_records(records.limit(0), companies, aliases, stored)
    assert {r.n for r in none["summary"].collect()} == {0}


def test_backfill_from_profiles(spark):
    profiles = spark.createDataFrame([(1, 1, 7, "A@x.com", None, "https://p", None), (2, 1, 7, "b@x.com", None, " ", 0.9), (3, None, 7, "c@x.com", None, "https://p", 0.9), (4, 1, 8, " ", None, "https://p", 0.9), (5, 1, 8, "d@x.com", "https://s", None, 0.3)], "index int, company_id int, founder_id int, email string, source_url string, profile_url string, confidence double")
    founders = spark.createDataFrame([(7, "Jo Doe"), (8, "Al Roe")], "id int, full_name string")
    links = spark.createDataFrame([(1, 7, "CEO")], "company_id int, founder_id int, role string")
    stored = spark.createDataFrame([(1, "a@x.com", None, "CTO", 0.5, "page", "unverified")], "company_id int, email string, full_name string, role string, confidence double, contact_source string, verification_status string")
    got = {r.email: r for r in ingest.backfill_contacts_from_profiles(profiles, founders, links, stored).collect()}
    assert set(got) == {"a@x.com", "d@x.com"}
    assert (got["a@x.com"].full_name, got["a@x.com"].role, got["a@x.com"].confidence) == ("Jo Doe", "CTO", 0.8)
    assert (got["d@x.com"].full_name, got["d@x.com"].role, got["d@x.com"].confidence) == ("Al Roe", None, 0.3)
