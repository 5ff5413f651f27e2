"""Founders and portfolio cards on small pages; each case is read off by hand."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.operators import elements, portfolio
from tallyhound.store import write_shared


def frames(spark, pages):
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    return write_shared(elements.element_table(p), "elements"), p


def page(value):
    return f"<div id=app data-page='{json.dumps(value).replace(chr(39), '&#39;')}'></div>"


LINKS = """<ul><li><a href="/people/ann">Ann Lee</a> CEO of it, ann@one.example <a href="https://x.com/ann">X</a></li>
<li><a href="https://www.linkedin.com/in/bob"><img alt="Bob Ray"></a><p>Co-Founder</p></li><li><a href="https://www.linkedin.com/in/cy"> </a>Cy Pol - CTO</li><li><a href="/people/ann2">ANN LEE</a></li></ul>"""


def test_founders_anywhere_in_json(spark):
    deep = {"props": [{"a": {"companyFounders": {"list": [{"full_name": "Deep One", "linkedin": "https://www.linkedin.com/in/d"}, {"name": ""}, 5, None]}}}]}
    for _ in range(12):
        deep = {"wrap": [deep]}
    pages = [
        (1, "https://one.example/c/1", page({"company": {"founders": [{"name": "Ann Lee", "title": "CEO", "path": "/people/ann", "twitter": "https://x.com/ann", "founder_bio": "Bio ann@one.example"}, {"name": "ann lee"}, {"title": "Only Title"}]}})),
        (2, "https://one.example/c/2", page(deep)),
        (3, "https://one.example/c/3", page({"team": [{"name": "No Founder"}]}) + LINKS),
        (4, "https://one.example/c/4", '<div data-page="{broken"></div>' + LINKS),
        (5, "https://one.example/c/5", page({"founders": [{"name": "Json Wins"}]}) + LINKS),
        (6, "https://one.example/c/6", "<p>nothing</p>"),
        (7, "https://one.example/c/7", page({"founders": {"first": [{"name": "In Object"}], "other": [[{"name": "Too Deep"}]]}})),
        (8, "https://one.example/c/8", None),
    ]
    got = portfolio.extract_founders(*frames(spark, pages)).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, {})[r.name] = r
    assert {k: sorted(v) for k, v in by.items()} == {1: ["Ann Lee", "Only Title"], 2: ["Deep One"], 3: ["Ann Lee", "Bob Ray", "Cy Pol -"], 4: ["Ann Lee", "Bob Ray", "Cy Pol -"], 5: ["Json Wins"], 7: ["In Object"]}
    ann, told = by[1]["Ann Lee"], by[3]["Ann Lee"]
    assert (ann.role, ann.profile_url, ann.x_url, ann.email, ann.found_in) == ("CEO", "https://one.example/people/ann", "https://x.com/ann", "ann@one.example", "json")
    assert (told.role, told.profile_url, told.linkedin_url, told.x_url, told.email, told.found_in) == ("CEO", "https://one.example/people/ann", None, "https://x.com/ann", "ann@one.example", "links")
    assert (by[3]["Bob Ray"].role, by[3]["Bob Ray"].linkedin_url, by[3]["Cy Pol -"].role) == ("Co-Founder", "https://www.linkedin.com/in/bob", "CTO")


TILES = """<div class="tile tile--company" data-companyname="Acme &amp; Co"><div class="tile__description">Reads <b>claims</b>.</div><a class='locationtag'>London</a><a class='locationtag'>Paris</a>
<a class='categorytag'>AI</a><div><span>Founded</span> <span>2015</span></div><div class="meta__row__role text-xs">Founding CEO</div><a class="text-link" href="https://www.linkedin.com/in/al">Al  Day</a>
<div class="meta__row__role">CTO</div><div class="meta__row__role">Board</div><a class="text-link" href="https://me.example/raz">Raz Ran</a><a class="text-link" href="/x">Loose</a><a href="mailto:Hi@acme.example">mail</a></div>
<div class="tile tile--company" data-companyname="ACME &amp; co"></div><div class="tile tile--company" data-companyslug="b-1" data-companyname="Beta"></div><div class="tile tile--company"></div>"""
MIX = """<div class="company__item mix ai dev-tools 2024 visible"><a href="https://www.linkedin.com/company/e"></a><a href="https://example.ai" class="noline"><span class="company__item__name">Example AI</span>
<span class="company__item__year">2024</span><div class="company__item__description__content"> Builds practical <i>tools</i>. </div></a></div><div class="company__item mix"><a href="https://x.example">no name</a></div>"""
CMS = """<div role="listitem"><a href="https://www.company.example"><div fs-cmsfilter-field="name">Company Example</div><div fs-cmsfilter-field="description">Workflows.</div><div fs-cmsfilter-field="location">Berlin</div>
<div fs-cmsfilter-field="sector">B2B</div><div fs-cmsfilter-field="stage">Seed</div></a></div><div role="listitem"><div fs-cmsfilter-field="name">Second</div><div fs-cmsfilter-field="year">2025</div><div fs-cmsfilter-field="stage">Seed</div></div>"""
BARE = '<h3 fs-cmsfilter-field="name">One</h3><p fs-cmsfilter-field="location">Rome</p><h3 fs-cmsfilter-field="name">Two</h3><p fs-cmsfilter-field="location">Oslo</p><a href="https://two.example">site</a>'
JSON = r"""<script>x("{\"id\":\"7f6e-1\",\"name\":\"Chain &amp; Co\",\"vertical\":\"Fintech\", \"stage\":\"Seed\",\"description\":\"Blocks\", \"website\":\"https:\/\/www.chain.example\",\"linkedin_url\":\"https://www.linkedin.com/company/chain\", \"session_year\":2014}
{\"id\":\"7f6e-2\",\"name\":\"Null Year\",\"stage\":\"A\",\"session_year\":null}")</script>"""
PLAIN = '[{"id":"1","name":"Plain","website":"https://plain.example","updatedAt":"x"}]'


@pytest.mark.parametrize(
    ("layout", "html", "want"),
    [
        ("tiles", TILES, [("Acme & Co", "acme-co", None, "Reads claims.", "London, Paris", "AI", "2015", None), ("Beta", "b-1", None, None, None, None, None, None)]),
        ("mix_items", MIX, [("Example AI", None, "https://example.ai", "Builds practical tools.", None, "ai, dev tools", "2024", None)]),
        ("cms_list", CMS, [("Company Example", None, "https://www.company.example", "Workflows.", "Berlin", "B2B", "Seed", None), ("Second", None, None, None, None, None, "2025", None)]),
        ("cms_list", BARE, [("One", None, None, None, "Rome", None, None, None), ("Two", None, "https://two.example", None, "Oslo", None, None, None)]),
        ("json", JSON, [("Chain & Co", None, "https://www.chain.example", "Blocks", None, "Fintech", "2014", "https://www.linkedin.com/company/chain"), ("Null Year", None, None, None, None, None, "A", None)]),
        ("json", PLAIN, [("Plain", None, "https://plain.example", None, None, None, None, None)]),
    ],
)
def test_layouts(spark, layout, html, want):
    got = portfolio.parse_portfolio_pages(*frames(spark, [(1, "https://p.example/", html), (2, "https://p.example/", "<p>none</p>"), (3, "u", None)]), layout).collect()
    assert sorted(tuple(r[n] for n in portfolio.COMPANY) for r in got) == sorted(want) and {r.page_id for r in got} == {1}
    if layout == "tiles":
        acme = next(r for r in got if r.company_name.startswith("Acme"))
        assert [tuple(p) for p in acme.people] == [("Al Day", "Founding CEO", "https://www.linkedin.com/in/al"), ("Raz Ran", "CTO", None)] and acme.emails == ["hi@acme.example"]


def test_coverage_score(spark):
    person = [{"name": "A", "role": None, "linkedin_url": "l"}, {"name": "B", "role": None, "linkedin_url": None}]
    rows = [("a", "w", "d", None, "i", None, None, person, ["x@y.zz"]), ("a", None, "d", None, None, "2020", "u", [], []), ("b", None, " ", None, None, None, None, [], [])]
    df = spark.createDataFrame(rows, f"source string, website string, description string, location string, industry string, year_or_stage string, company_linkedin_url string, people {portfolio.PEOPLE}, emails array<string>")
    got = {r.source: r for r in portfolio.coverage_score(df, ["source"]).collect()}
    assert got["a"].quality_score == round(0.5 * 25 + 15 + 5 + 0 + 5 + 20 + 5) and got["b"].quality_score == 0 and (got["a"].people, got["a"].people_with_profile, got["a"].industries) == (2, 1, 1)


def test_absolute_urls(spark):
    pairs = [("https://a.example/b/c?q#f", r) for r in ("d", "/d", "//e.example/x", "?q=1", "#g", "../d", "./d", "../../../d", "..", "mailto:x@y.zz", "https://z.example/../q", "d/./e/../f?x=../y")] + [("https://a.example", "d"), ("https://a.example", "/d")]
    df = spark.createDataFrame(pairs, "b string, r string")
    got = [x[0] for x in df.select(c.absolute_url(F.col("b"), F.col("r"))).collect()]
    want = [urljoin(b, r) for b, r in pairs]
    want[4] = "https://a.example/b/c#g"
    assert got == want


def test_pages_of_a_portfolio_dont_grow_with_the_companies(spark):
    """A block of company numbers makes a page, so three times the companies make three times the pages."""
    from tallyhound.queries_pages import PAGED, _portfolio_pages

    customers = spark.read.parquet("/root/testdata/sf0.1/customer.parquet").count()
    assert customers > 2 * PAGED
    for _, pages in _portfolio_pages(spark, "/root/testdata/sf0.1"):
        rows = pages.selectExpr("page_id", "length(html) AS n").collect()
        assert len({r.page_id for r in rows}) == len(rows) > 60 and max(r.n for r in rows) < 100_000
