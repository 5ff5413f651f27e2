"""Element table, stored rules and cleaned markup against a plain tree walk."""

import html as markup
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from tallyhound.operators import elements
from tallyhound.store import write_shared

CAREERS = """
<html><body>
  <div class="jobs">
    <div class="job"><a href="/jobs/1"><h3>Senior Backend <b>Engineer</b></h3></a><span class="loc">Berlin</span><span class="dept">Engineering</span></div>
    <div class="job first"><a href="/jobs/2"><h3>Product Manager</h3></a><span class="loc">Remote</span></div>
    <div class="job"><h3>No link</h3></div><div class="job"><a href="/jobs/4"> </a></div>
    <div class="jobless"><a href="/x"><h3>Other</h3></a></div>
  </div>
</body></html>"""
BASE = {"job_container": "div.job", "title": "h3", "url": "a", "location": "span.loc", "department": "span.dept"}


class Tree(HTMLParser):
    """A plain tree of dictionaries."""

    def __init__(self, source):
        super().__init__()
        self.root = {"tag": None, "attrs": {}, "kids": [], "up": None}
        self.at = self.root
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "kids": [], "up": self.at}
        self.at["kids"].append(node)
        if tag not in elements.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at["kids"].append({"tag": tag, "attrs": dict(attrs), "kids": [], "up": self.at})

    def handle_endtag(self, tag):
        node = self.at
        while node["up"] and node["tag"] != tag:
            node = node["up"]
        if node["up"]:
            self.at = node["up"]

    def handle_data(self, data):
        kids = self.at["kids"]
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def walk(node):
    for kid in node["kids"]:
        if not isinstance(kid, str):
            yield kid
            yield from walk(kid)


def text(node):
    out = []
    for kid in node["kids"]:
        if isinstance(kid, str):
            out += [kid.strip()] if node["tag"] not in elements.CODE and kid.strip() else []
        elif t := text(kid):
            out.append(t)
    return " ".join(out)


def simple(node, token):
    m = re.fullmatch(r"([\w-]+|\*)?((?:\.[\w-]+)*)((?:#[\w-]+)?)((?:\[[^\]]+\])*)", token)
    if m[1] not in (None, "*", node["tag"]) or not set(re.findall(r"\.([\w-]+)", m[2])) <= set(node["attrs"].get("class", "").split()) or (m[3] and node["attrs"].get("id") != m[3][1:]):
        return False
    for name, how, want in re.findall(r"\[([\w-]+)(?:([*^$]?=)\"?([^\"\]]*)\"?)?\]", m[4]):
        have = node["attrs"].get(name)
        if have is None or not {"": lambda: True, "=": lambda: have == want, "*=": lambda: want in have, "^=": lambda: have.startswith(want), "$=": lambda: have.endswith(want)}[how]():  # noqa: B023
            return False
    return True


def matches(node, tokens):
    if not simple(node, tokens[-1].lstrip(">")):
        return False
    if len(tokens) == 1:
        return True
    up = node["up"]
    while up and up["tag"]:
        if matches(up, tokens[:-1]):
            return True
        if tokens[-1].startswith(">"):
            return False
        up = up["up"]
    return False


def select(node, rule):
    ways = [re.sub(r"\s*>\s*", " >", w.strip()).split() for w in (rule or "").split(",")]
    return [x for x in walk(node) if rule and any(matches(x, w) for w in ways)]


def plain_jobs(url, source, rule):
    for card in select(Tree(source).root, rule["job_container"]):
        found = {f: (select(card, rule[f]) or [None])[0] for f in elements.FIELDS[1:]}
        said = {f: (text(n) or None) if n else None for f, n in found.items()}
        href = found["url"] and found["url"]["attrs"].get("href")
        if said["title"] and href:
            yield said["title"], urljoin(url, href), said["location"], said["department"]


RULES = [
    BASE,
    {**BASE, "job_container": "div.jobs > div.job.first, div.jobless", "title": "a h3", "location": None},
    {"job_container": "body div", "title": "h3 b, h3", "url": 'a[href^="/jobs"]', "location": "div span[class]", "department": ""},
    {"job_container": "nav li", "title": "a", "url": "a", "location": None, "department": None},
    {"job_container": "body", "title": "h1", "url": "*[href]", "location": "p > b", "department": "p"},
    {"job_container": "ul ul, article p", "title": "b", "url": "a", "location": "p p", "department": "p b"},
]


def frames(spark, pages, rules):
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    r = spark.createDataFrame([(k, h, *(rule.get(f) for f in elements.FIELDS)) for k, h, rule in rules], "source_key string, page_host string, " + ", ".join(f"{f} string" for f in elements.FIELDS))
    return p, r, write_shared(elements.element_table(p), "elements")


def test_rules_against_a_tree_walk(spark, monkeypatch):
    monkeypatch.setattr(elements, "CELL", 8)
    given = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()][:40]
    pages = [(i, re.sub(r"^https?://[^/]+", "https://site.example", u), h) for i, u, h in given] + [(1000, "https://site.example/careers", CAREERS), (1001, "https://site.example/c", None), (1002, "https://site.example/c", ""), (1003, "https://other.example/c", CAREERS)]
    rules = [(f"r{i}", "site.example", rule) for i, rule in enumerate(RULES)]
    p, r, nodes = frames(spark, pages, rules)
    got = elements.apply_selectors(nodes, r).select("source_key", "page_id", "title", "url", "location", "department").collect()
    want = [(k, i, *job) for k, h, rule in rules for i, u, s in pages if s and h in u for job in plain_jobs(u, s, rule)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and {w[0] for w in want} >= {"r0", "r1", "r2", "r3", "r4"}


def test_a_title_a_link_and_a_place(spark):
    p, r, nodes = frames(spark, [(1, "https://example.com/careers", CAREERS)], [("s", "example.com", BASE)])
    got = [tuple(x)[3:] for x in elements.apply_selectors(nodes, r).orderBy("container").collect()]
    assert got == [("Senior Backend Engineer", "https://example.com/jobs/1", "Berlin", "Engineering"), ("Product Manager", "https://example.com/jobs/2", "Remote", None)]


def test_rules_are_judged(spark):
    pages = [(i, f"https://h{i % 4}.example/careers/{i}", CAREERS) for i in range(22)] + [(50, "https://h9.example/", CAREERS)]
    rules = [("good", "h0.example", BASE), ("nothing", "h1.example", {**BASE, "job_container": "div.nonexistent"}), ("broken", "h2.example", {**BASE, "job_container": "div["}), ("missing", "h3.example", {**BASE, "url": " "}), ("few", "h9.example", BASE), ("unseen", "none.example", BASE)]
    p, r, nodes = frames(spark, pages, rules)
    fine, bad = elements.checked_rules(r)
    assert {(x.source_key, x.reason) for x in bad.collect()} == {("broken", "not a selector: job_container"), ("missing", "missing url")}
    results = elements.validate_selectors(p, r, elements.apply_selectors(nodes, fine))
    assert results.count() == 23 and {x.error for x in results.filter("source_key = 'broken'").collect()} == {"not a selector: job_container"}
    got = {x.source_key: (x.sample_size, x.success_rate, x.status) for x in elements.judge_parsers(results).collect()}
    assert got == {"good": (6, 1.0, "active"), "nothing": (6, 0.0, "failed"), "broken": (5, 0.0, "failed"), "missing": (5, 0.0, "failed"), "few": (1, 1.0, "failed")}


@pytest.mark.parametrize("form", ["div[", "a:hover", "a > ", "", "> a", "a ~ b", "a + b", "div..x", "[title=a b]"])
def test_forms_that_arent_read(spark, form):
    df = spark.createDataFrame([(form,)], "s string")
    assert df.select(elements.steps_of(df.s)).first()[0] is None


def plain_condensed(source, budget):
    """Cleaned markup by a walk over the tree, without comments and declarations."""

    def out(node):
        if isinstance(node, str):
            return markup.escape(node, quote=False)
        if node["tag"] in elements.NOISY_ELEMENTS:
            return ""
        attrs = "".join(f' {k}="{markup.escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in node["attrs"].items() if k not in elements.NOISY_ATTRIBUTES and not k.startswith("data-"))
        inner = "".join(map(out, node["kids"]))
        return inner if node["tag"] is None else f"<{node['tag']}{attrs}/>" if node["tag"] in elements.VOID else f"<{node['tag']}{attrs}>{inner}</{node['tag']}>"

    return re.sub(r"\s+", " ", out(Tree(source).root))[:budget]


def test_markup_survives_the_budget(spark):
    noisy = "<html><head>" + "<style>.a{color:red}</style>" * 400 + "</head><body><script>" + "var x=1;" * 400 + '</script><div class="job" data-reactid="xyz" style="color:red"><a href=\'/jobs/1\'><h3>Backend Engineer</h3></a></div></body></html>'
    pages = [(1, "u", noisy), (2, "u", CAREERS), (3, "u", "<p>a &lt; b<br>c<svg><path d='1'/></svg><p title='x \"y\"'>d"), (4, "u", "<head><title>x</title></head>"), (5, "u", None)]
    _, _, nodes = frames(spark, pages, [])
    got = {r.page_id: r.condensed for r in elements.condense_html(nodes, 4000).collect()}
    assert got[1] == '<html><body><div class="job"><a href="/jobs/1"><h3>Backend Engineer</h3></a></div></body></html>'
    assert got == {i: plain_condensed(s, 4000) for i, _, s in pages if s and plain_condensed(s, 4000)}
    assert {r.page_id: r.condensed for r in elements.condense_html(nodes, 20).collect()} == {i: s[:20] for i, s in got.items()}


def test_intervals_in_plan(spark):
    """Rows meet by page and cell, never by the interval alone."""
    p, r, nodes = frames(spark, [(1, "https://example.com/careers", CAREERS)], [("s", "example.com", BASE)])
    plan = elements.apply_selectors(nodes, r)._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in plan and "Cartesian" not in plan


def test_a_long_page_of_open_elements(spark):
    """Ten thousand elements that are never closed, and a long list: no pairs by the square."""
    source = "<div class=jobs>" * 10_000 + "<ul class=jobs>" + "".join(f"<li class=job><a href=/j/{i}><h3>Job {i}</h3></a>" for i in range(3000))
    p, r, nodes = frames(spark, [(1, "https://example.com/", source)], [("s", "example.com", {**BASE, "job_container": "div.jobs ul.jobs li.job"})])
    assert elements.apply_selectors(nodes, r).count() == 3000 and nodes.count() == 10_001 + 4 * 3000


def test_a_page_fed_in_parts_is_held_by_its_open_elements_only():
    html = '<!DOCTYPE html><body><div class="a b"><p>x &amp; y<br>z</p><a href="/q?a=1&amp;b">l</a><!-- c --><script>if (a < b) "</p>"</script><p>open</div></body> end'
    html = html + "<ul>" + "".join(f'<li id="{i}"><a href="/{i}">t&lt;{i}</a></li>' for i in range(2000))
    whole = []
    tree = elements._Tree("https://a.example/x", whole)
    tree.feed(html)
    tree.close()
    done = []
    tree = elements._Tree("https://a.example/x", done)
    for at in range(0, len(html), 7):
        tree.feed(html[at : at + 7])
        assert tree.count - len(done) <= 4
    assert len(tree.open) == 1
    tree.close()
    assert done == whole and len(done) > 6000
