"""Page queries without SQL, published contacts and comment trees on cases read off by hand."""

import re
from types import SimpleNamespace

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyhound.functions import terms as t
from tallyhound import queries_pages
from tallyhound.operators import capture
from tallyhound.queries import QUERIES, SQL
from tallyhound.sources import normalize
from tests.test_elements import Tree, plain_condensed

SF = "/root/testdata/sf0.001"


def test_cleaned_markup_of_given_pages(spark):
    got = {r.page_id: r.condensed for r in QUERIES["cleaned_markup"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        want = plain_condensed(r.html, 1 << 30)
        have = re.sub(r"\s+", " ", re.sub(r"<!--.*?-->|^<!DOCTYPE html>\s*", "", got[r.page_id], flags=re.S))
        assert len(got[r.page_id]) <= 24_000 and want.startswith(re.sub(r"\s+", " ", have).rstrip()[:20_000])


def test_procurement_contacts(spark):
    rows = [
        (1, 7, "acme.com", "a", "procurement_discovery", "https://t/1", '{"contact_email":" Buyer@ACME.com ","contact_name":"Ann","contact_phone":"020","contact_is_portal":false,"source_record_id":"r1"}'),
        (2, 7, "acme.com", "b", "procurement_discovery", "https://t/1", '{"contact_email":"buyer@acme.com","contact_phone":"020"}'),  # the same contact, later
        (3, 7, "acme.com", "a", "procurement_discovery", None, '{"contact_email":"not an address","contact_phone":"12","source_url":"https://t/own"}'),
        (4, 7, "acme.com", "a", "procurement_discovery", "https://t/2", '{"contact_name":"Only Name"}'),
        (5, 7, "acme.com", "a", "feed", "https://t/3", '{"contact_email":"x@acme.com"}'),
        (6, 7, "acme.com", "a", "procurement_discovery", "https://t/4", '{"contact_email":5,"contact_name":" "}'),
        (7, 8, None, "a", "procurement_discovery", "https://t/5", '{"contact_email":"y@gmail.com"}'),
        (8, 8, None, "a", "procurement_discovery", "https://t/6", "broken"),
        (9, 8, None, "a", "procurement_discovery", "https://t/7", None),
    ]
    df = spark.createDataFrame(rows, "id long, company_id long, domain string, source_key string, source_type string, source_url string, raw_payload string")
    mx = spark.createDataFrame([("acme.com", 1, None)], "domain string, mx_count int, error string")
    got = {r.source_url: r for r in capture.procurement_contacts(df, mx).collect()}
    assert set(got) == {"https://t/1", "https://t/own", "https://t/2", "https://t/5"}
    one = got["https://t/1"]
    assert (one.email, one.full_name, one.contact_kind, one.on_company_domain, one.deliverability) == ("buyer@acme.com", None, "role_inbox", True, "deliverable_domain") and '"source":"b"' in one.raw_evidence
    assert (got["https://t/own"].email, got["https://t/own"].contact_kind, got["https://t/own"].deliverability) == (None, "unknown", "no_email")
    assert got["https://t/2"].contact_kind == "person" and (got["https://t/5"].deliverability, got["https://t/5"].on_company_domain) == ("free_mail_domain", False)
    assert capture.procurement_contacts(df.limit(0), mx).count() == 0


def candidates(spark, html, **options):
    pages = spark.createDataFrame([(1, "https://acme.com/team", html)], "page_id long, url string, html string")
    return capture.contact_candidates(capture.parse_html(pages).withColumn("domain", F.lit("acme.com")), **options).collect()


def test_contact_candidates(spark):
    html = """<p>Jane Doe, Chief Technology Officer, jane.doe@acme.com</p><a href="mailto:Bob%40acme.com?subject=x">Write</a><p>careers2@acme.com</p><p>info@acme.com</p><p>acme@acme.com</p>
    <p>ann@other.com</p><p>contactcareersteam@acme.com</p><p>jane.doe@acme.com again</p>"""
    got = {r.email: r for r in candidates(spark, html)}
    assert set(got) == {"jane.doe@acme.com", "bob@acme.com", "careers2@acme.com"}
    jane, bob, careers = got["jane.doe@acme.com"], got["bob@acme.com"], got["careers2@acme.com"]
    assert (jane.full_name, jane.role, jane.candidate_type, jane.recommended_status, jane.confidence) == ("Jane Doe", "Chief Technology Officer", "direct_person", "approve_candidate", 0.9)
    assert (bob.extraction, bob.full_name, bob.role, bob.confidence) == ("mailto_link", None, None, 0.72) and "mailto" in bob.review_hint
    assert (careers.candidate_type, careers.is_generic_email, careers.recommended_status) == ("generic_inbox", True, "needs_review")
    every = {r.email: r for r in candidates(spark, html, include_generic=True, include_external=True)}
    assert set(every) >= {"info@acme.com", "acme@acme.com", "ann@other.com"} and every["ann@other.com"].candidate_type == "external_email" and every["info@acme.com"].candidate_type == "low_value_generic_inbox"
    assert candidates(spark, None) == []


def threads(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, parent long, at int")
    good, bad = normalize.flatten_comment_tree(df, **options)
    return good.orderBy("root", "place").collect(), sorted(((r.id, r.reason) for r in bad.collect()), key=repr)


def test_comment_trees(spark):
    rows = [(1, None, 0), (2, 1, 5), (3, 1, 4), (4, 2, 0), (5, 3, 0), (9, None, 0), (20, 21, 0), (21, 22, 0), (22, 20, 0), (23, 20, 0), (30, 99, 0), (31, 30, 0), (32, 31, 0), (None, 1, 0), (4, 1, 9), (40, 40, 0)]
    good, bad = threads(spark, rows, position="at")
    assert [(r.root, r.id, r.depth) for r in good] == [(1, 1, 0), (1, 3, 1), (1, 5, 2), (1, 2, 1), (1, 4, 2), (9, 9, 0)]
    assert bad == sorted([(None, "missing_id"), (4, "repeated_id"), (20, "cycle"), (21, "cycle"), (22, "cycle"), (23, "cycle"), (40, "cycle"), (30, "missing_parent"), (31, "missing_parent"), (32, "missing_parent")], key=repr)
    assert threads(spark, []) == ([], [])


@pytest.mark.parametrize("depth", [200])
def test_a_deep_chain_takes_few_steps(spark, monkeypatch, depth):
    written, write = [], normalize.write_shared
    monkeypatch.setattr(normalize, "write_shared", lambda df, what: written.append(what) or write(df, what))
    good, bad = threads(spark, [(i, i - 1 if i else None, 0) for i in range(depth)])
    assert [r.id for r in good] == list(range(depth)) and [r.depth for r in good] == list(range(depth)) and bad == [] and len(written) <= 2 + depth.bit_length()


# --- queries on given pages against a walk over a plain tree ----------------------------------------------------------------------

BLOCKS = {"p", "div", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "article", "section", "nav", "header", "footer", "ul", "ol", "table"}
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def read_off(source):
    """Lines, title, first heading and links of a page."""
    parts, title, heads, links = [], [], [], []

    def visit(node):
        for kid in node["kids"]:
            if isinstance(kid, str):
                if node["tag"] not in ("script", "style", "title"):
                    parts.append(kid)
                if node["tag"] == "title":
                    title.append(kid)
                continue
            if kid["tag"] == "a" and kid["attrs"].get("href"):
                links.append(kid["attrs"]["href"])
            if kid["tag"] in BLOCKS:
                parts.append("\n")
            begin = len(parts)
            visit(kid)
            if kid["tag"] == "h1":
                heads.append("".join(parts[begin:]))
            if kid["tag"] in BLOCKS:
                parts.append("\n")

    visit(Tree(source).root)
    lines = [x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x]
    return lines, " ".join("".join(title).split()), " ".join((heads or [""])[0].split()), links


@pytest.fixture(scope="module")
def given(spark):
    return {r.page_id: (r.url, *read_off(r.html)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_page_facts(spark, given):
    got = {r.page_id: (r.title, r.positioning, r.n_links, r.technologies) for r in QUERIES["page_facts"](spark, SF).collect()}
    terms = lambda lines: ",".join(sorted(w for w in t.TECH_STACK_TERMS if w in " ".join(lines).lower()))
    assert got == {i: (title, h1 or None, len(links), terms(lines)) for i, (_, lines, title, h1, links) in given.items()}


def test_page_contacts(spark, given):
    got = sorted((r.page_id, r.value) for r in QUERIES["page_contacts"](spark, SF).filter("kind = 'email'").collect())
    mails = {(i, re.sub(r"[.,;:)]+$", "", m.lower())) for i, (_, lines, *_) in given.items() for m in re.findall(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " ".join(lines))}
    assert got == sorted(m for m in mails if m[1].split("@")[0].split("+")[0] not in t.JUNK_LOCAL_PARTS and not re.search(r"\.(png|jpg|gif|svg|webp)$", m[1]))
    phones = {(r.page_id, r.value) for r in QUERIES["page_contacts"](spark, SF).filter("kind = 'phone'").collect()}
    digits = lambda p: len(re.sub(r"\D", "", p))
    found = {(i, p) for i, (_, lines, *_) in given.items() for p in re.findall(r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)", " ".join(lines)) if 8 <= digits(p) <= 16}
    assert {(i, re.sub(r"\s+", " ", p).strip(" .,:;()")) for i, p in found} == phones


def test_contact_routes(spark, given):
    got = {r.page_id: r.routes for r in QUERIES["contact_routes"](spark, SF).collect()}
    want = {}
    for i, (url, lines, *_) in given.items():
        routes = [f"page:{url}"] if re.search("(?i)contact|career|job", url) else []
        routes += [f"email_text:{m}" for line in lines for m in sorted({re.sub(r"[.,;:)]+$", "", m.lower()) for m in MAIL.findall(line)}) if ".." not in m]
        want[i] = ", ".join(routes) or None
    assert got == want


def test_page_summaries(spark, given):
    got = {r.page_id: r.summary for r in QUERIES["page_summaries"](spark, SF).collect()}
    for i, (url, lines, _, h1, _) in given.items():
        text = " ".join(lines).lower()
        bits = [h1] if h1 else []
        bits += ["Developer or API surface found."] if "api" in text or "developer" in text else []
        bits += ["Automation or workflow language found."] if "automation" in text or "workflow" in text else []
        bits += ["Careers content is visible."] if re.search("(?i)career|job", url) else []
        assert got[i] == " ".join(bits)


def test_entities_without_semicolon(spark, tmp_path):
    """A text that is cut within an entity is read as HTML reads it, by the query and by its SQL."""
    html = '<body><nav><ul><li><a href="/a">A &amp;amp; B &lt</a></li></ul></nav><article><h1>One&amp;&amp;&amp</h1></article><footer>&copy x</footer></body>'
    spark.createDataFrame([(1, "https://a.example/p", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["selector_jobs"](spark, str(tmp_path)).select("source_key", "title", "location").collect()
    assert sorted(map(tuple, got)) == [("menu:a.example", "A &amp; B <", None), ("page:a.example", "One&&&", "© x")]
    want = duckdb.sql(f"WITH pages AS (SELECT * FROM '{tmp_path}/pages.parquet/*.parquet') SELECT source_key, title, location FROM ({SQL['selector_jobs']})").fetchall()
    assert sorted(want) == sorted(map(tuple, got))


def test_pages_are_parsed_in_slices(spark, monkeypatch):
    """A worker holds about ``SLICE_CHARS`` of markup as rows, whatever the number of pages in an Arrow batch."""
    asked = []
    monkeypatch.setattr(capture, "map_slices", lambda df, run, schema: asked.append(run))
    capture.parse_html(SimpleNamespace(select=lambda *c: None))
    html = ["<h1>A</h1><a href='/b'>b</a>" + "<p>word</p>" * 5_000, None] * 50
    batch = pa.RecordBatch.from_pydict({"page_id": [*range(99), None], "url": ["https://a.example/"] * 99 + [None], "html": html})
    out = list(asked[0](iter([batch, batch.slice(0, 1)])))
    assert len(out) > 4 and max(b.num_rows for b in out) < 30 and sum(b.num_rows for b in out) == 101
    rows = [r for b in out for r in b.to_pylist()]
    assert rows[0]["links"] == [{"href": "https://a.example/b", "text": "b", "tag": "a", "css": ""}] and rows[0]["h1"] == "A" and len(rows[0]["lines"]) == 5_002
    assert (rows[99]["page_id"], rows[99]["url"], rows[99]["lines"], rows[99]["text"]) == (None, None, [], "")


def test_founders_pages_are_dealt_to_all_cores(spark, monkeypatch):
    """Pages that Spark writes from a table of few files aren't parsed by a task for each file."""
    dealt, whole = [], queries_pages.elements.element_table
    monkeypatch.setattr(queries_pages.elements, "element_table", lambda pages: dealt.append(pages.rdd.getNumPartitions()) or whole(pages))
    rows = queries_pages.page_founders(spark, "/root/testdata/sf0.001")
    assert dealt == [spark.sparkContext.defaultParallelism] and rows.count() == 150


def test_portfolio_pages_are_put_together_by_more_tasks_as_they_grow(spark, monkeypatch):
    """Tasks follow the number of companies, not the packed bytes of their cards."""
    monkeypatch.setattr(queries_pages, "GATHERED", 10)
    assert [p.rdd.getNumPartitions() for _, p in queries_pages._portfolio_pages(spark, "/root/testdata/sf0.001")] == [15] * 3
