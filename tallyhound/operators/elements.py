"""Pages as tables of elements: every element and text is a row with the interval of its descendants, so that "inside" is a join.

Nodes are numbered in document order from 0 within their page; ``last`` is the number of a node's last descendant, and a node lies inside
another if its number is greater than the other's and not above the other's ``last``. Stored rules, cleaned markup and cards of portfolio pages
are DataFrame work on this table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.store import map_slices, write_shared

NODES = "page_id long, host string, node int, last int, parent int, depth int, tag string, id string, classes array<string>, attributes map<string,string>, link string, content string"
#: Elements without an end tag; elements whose text isn't prose.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
CODE = frozenset(("script", "style", "template"))
#: Nodes of a page that share a cell of the interval join; characters of markup that a worker turns into nodes at a time.
CELL, SLICE_CHARS = 64, 500_000


class _Tree(HTMLParser):
    """Nodes of one page. An end tag closes the innermost open element of its name with all that is open inside; others are ignored.

    A node goes to ``done`` as soon as its last descendant is known, so of a page that is fed in parts only the open elements are held."""

    def __init__(self, url: str | None, done: list[tuple]) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.done, self.count, self.open, self.names, self.said = url or "", done, 0, [], Counter(), []

    def start(self, tag, attributes=None, content=None) -> tuple:
        node, self.count = self.count, self.count + 1
        return node, self.open[-1][0] if self.open else None, len(self.open), tag, attributes or {}, content

    def end(self, node: tuple) -> None:
        self.done.append((*node, self.count - 1, self.link(node[4].get("href"))))

    def flush(self) -> None:
        if self.said:
            text, self.said = "".join(self.said), []
            self.end(self.start("#code" if self.open and self.open[-1][3] in CODE else "#text", content=text))

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = self.start(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self.end(node)
        else:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.end(self.start(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.flush()
        while self.names[tag]:
            node = self.open.pop()
            self.names[node[3]] -= 1
            self.end(node)
            if node[3] == tag:
                break

    def handle_data(self, data):
        self.said.append(data)

    def handle_comment(self, data):
        self.flush()
        self.end(self.start("#comment", content=data))

    def handle_decl(self, decl):
        self.flush()
        self.end(self.start("#doctype", content=decl))

    def close(self):
        super().close()
        self.flush()
        while self.open:
            self.end(self.open.pop())

    def link(self, href: str | None) -> str | None:
        try:
            return urljoin(self.url, href.strip()) if href else None
        except ValueError:
            return None


def element_table(pages: DataFrame) -> DataFrame:
    """One row for each node of ``page_id, url, html``: its page's host, interval, tag (``#text``, ``#code`` for text of scripts and styles, ``#comment`` and
    ``#doctype`` besides elements), classes, attributes, absolute link and own text.

    ``page_id`` is unique and not null; pages without it, and null and empty pages, have no nodes. Other columns are ignored.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("host", pa.string()), ("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
        ("classes", pa.list_(pa.string())), ("attributes", pa.map_(pa.string(), pa.string())), ("link", pa.string()), ("content", pa.string()),
    ])

    def table(page: list, host: list, done: list[tuple]) -> pa.RecordBatch:
        node, parent, depth, tag, own, content, last, link = zip(*done, strict=True)
        classes, items = [a.get("class", "").split() for a in own], [list(a.items()) for a in own]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((page, host, node, last, parent, depth, tag, [a.get("id") for a in own], classes, items, link, content), schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages_of, hosts, done, size = [], [], [], 0
        for b in batches:
            for row in range(b.num_rows):  # one page at a time as Python text
                page, host, url, text = (b.column(c)[row].as_py() for c in ("page_id", "host", "url", "html"))
                tree = _Tree(url, done)
                for at in range(0, len(text), SLICE_CHARS):
                    tree.feed(part := text[at : at + SLICE_CHARS])
                    size += len(part)
                    if at + SLICE_CHARS >= len(text):
                        tree.close()
                    pages_of += [page] * (len(done) - len(pages_of))
                    hosts += [host] * (len(done) - len(hosts))
                    if size > SLICE_CHARS and done:
                        yield table(pages_of, hosts, done)
                        size = 0
                        for held in (pages_of, hosts, done):
                            held.clear()
        if done:
            yield table(pages_of, hosts, done)

    url = F.col("url").cast("string")
    rows = pages.filter("page_id IS NOT NULL AND html <> ''").select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), url.alias("url"), "html")
    return map_slices(rows, run, NODES)


def inside(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """``inner`` (``node``) joined with the intervals of ``outer`` (``outer, outer_last`` and any other columns) that it lies in, itself not counted.

    An interval enters every cell of nodes that it touches, so rows meet by an equal cell and only then by the interval: disjoint intervals make at most a
    cell's worth of pairs a node, nested ones their depth more, however large the page.
    """
    spans = outer.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("outer") / CELL), F.floor(F.col("outer_last") / CELL))))
    rows = inner.withColumn("_cell", F.floor(F.col("node") / CELL))
    return rows.join(spans, [*keys, "_cell"]).filter("node > outer AND node <= outer_last").drop("_cell")


def enclosed(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``inner`` (``node``) that lie inside any of ``outer`` (``outer, outer_last``). Intervals never cross, so the furthest end of those begun before decides: one
    pass in order and no pairs, however deep they nest."""
    own = inner.withColumn("_end", F.lit(None).cast("int"))
    ends = outer.select(*keys, F.col("outer").alias("node"), F.col("outer_last").alias("_end"))
    both = own.withColumn("_own", F.lit(True)).unionByName(ends.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("node", F.desc("_own")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_upto", F.max("_end").over(before)).filter("_own AND _upto >= node").select(inner.columns)


def stripped(text: Column) -> Column:
    """Without white space at both ends, of any alphabet."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def texts_in(nodes: DataFrame, wanted: DataFrame, raw: bool = False) -> DataFrame:
    """``page_id, outer, text`` of the ``wanted`` (``page_id, outer, outer_last``): their texts in order, stripped and joined by a blank; with ``raw`` joined as they
    are, white space collapsed. What holds no text has no row."""
    said = stripped(F.col("content"))
    said = nodes.filter("tag = '#text'").select("page_id", "node", (F.col("content") if raw else said).alias("said"), said.alias("_s")).filter("_s <> ''" if not raw else "said <> ''").drop("_s")
    wanted = wanted.select("page_id", "outer", "outer_last").distinct()
    parts = inside(said, wanted, ["page_id"]).groupBy("page_id", "outer").agg(F.array_sort(F.collect_list(F.struct("node", "said"))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["said"]), "" if raw else " ")
    return parts.select("page_id", "outer", (stripped(F.regexp_replace(text, r"(?U)\s+", " ")) if raw else text).alias("text"))


# --- stored rules -----------------------------------------------------------------------------------------------------------------

FIELDS = ("job_container", "title", "url", "location", "department")
_PART = r"^>?(?:[A-Za-z][\w-]*|\*)?(?:[.#][\w-]+|\[[\w-]+(?:[~^$*|]?=(?:\"[^\"\]]*\"|'[^'\]]*'|[\w-]+))?\])*$"


def steps_of(rule: Column) -> Column:
    """A stored selector as alternatives of steps: tag, id, classes and attribute tests, inside (or directly inside) what the step before finds.
    Null if any part is of another form."""

    def step(token: Column) -> Column:
        bare = F.regexp_replace(token, r"\[[^\]]*\]", "")
        tests = F.transform(F.regexp_extract_all(token, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda a: F.struct(F.lower(F.regexp_extract(a, r"^([\w-]+)", 1)).alias("name"), F.regexp_extract(a, r"^[\w-]+([~^$*|]?=)", 1).alias("how"), F.regexp_replace(F.regexp_replace(a, r"^[\w-]+(?:[~^$*|]?=)?", ""), r"^[\"']|[\"']$", "").alias("value")))
        tag = F.nullif(F.lower(F.regexp_extract(bare, r"^>?([A-Za-z][\w-]*)", 1)), F.lit(""))
        return F.struct(token.startswith(">").alias("direct"), tag.alias("tag"), F.nullif(F.regexp_extract(bare, r"#([\w-]+)", 1), F.lit("")).alias("id"), F.regexp_extract_all(bare, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"), tests.alias("tests"))

    tokens = F.transform(F.split(rule, r"\s*,\s*"), lambda a: F.split(F.regexp_replace(F.trim(a), r"\s*>\s*", " >"), r"\s+"))
    fine = F.forall(tokens, lambda a: F.forall(a, lambda x: x.rlike(_PART) & ~x.isin("", ">")) & ~F.get(a, 0).startswith(">"))
    return F.when(fine, F.transform(tokens, lambda a: F.transform(a, step)))


def _fits(s: str) -> Column:
    """Whether the node at hand is what step ``s`` asks for."""

    def test(a: Column) -> Column:
        value, want, how = F.col("attributes")[a["name"]], a["value"], a["how"]
        words = F.split(value, r"\s+")
        found = (
            F.when(how == "", value.isNotNull()).when(how == "=", value == want).when(how == "^=", (want != "") & value.startswith(want)).when(how == "$=", (want != "") & value.endswith(want))
            .when(how == "*=", (want != "") & value.contains(want)).when(how == "~=", F.array_contains(words, want)).otherwise((value == want) | value.startswith(F.concat(want, F.lit("-"))))
        )
        return F.coalesce(found, F.lit(False))

    c = lambda n: F.col(f"{s}.{n}")
    return (c("tag").isNull() | (c("tag") == F.col("tag"))) & (c("id").isNull() | F.coalesce(c("id") == F.col("id"), F.lit(False))) & (F.size(F.array_except(c("classes"), F.col("classes"))) == 0) & F.forall(c("tests"), test)


def find(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, source_key, field, node, last``: the nodes that the stored selectors of ``rules`` (``host, source_key, field, steps``) find on their host's pages, each once."""
    paths = rules.select("host", "source_key", "field", F.posexplode("steps").alias("way", "path")).select("host", "source_key", "field", "way", F.size("path").alias("length"), F.posexplode("path").alias("k", "s"))
    longest = paths.agg(F.max("length")).first()[0] or 0
    keys = ["page_id", "source_key", "field", "way"]
    hits = nodes.filter("tag NOT LIKE '#%'").join(paths, "host").filter(_fits("s")).select(*keys, "k", "length", F.col("s.direct").alias("direct"), "node", "last", "parent")
    if longest > 1:
        hits = write_shared(hits, "selector-hits")
    now = hits.filter("k = 0")
    out = now.filter("length = 1")
    for k in range(1, longest):  # as many as the longest selector has steps
        above = now.select(*keys, F.col("node").alias("outer"), F.col("last").alias("outer_last"))
        own = hits.filter(F.col("k") == k)
        deep = enclosed(own.filter("NOT direct"), above, keys)
        near = own.filter("direct").join(above.select(*keys, F.col("outer").alias("parent")), [*keys, "parent"], "left_semi")
        now = deep.unionByName(near.select(deep.columns))
        out = out.unionByName(now.filter(F.col("length") == k + 1).select(out.columns))
    return out.select("page_id", "source_key", "field", "node", "last").distinct()


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1))


def apply_selectors(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Jobs that stored rules find on the pages of their host: ``source_key, page_id, container, title, url, location, department``.

    ``rules`` (``source_key, page_host``, then one selector each for :data:`FIELDS`, the last two optional) are known to be well-formed
    (:func:`checked_rules`); ``nodes`` is the stored element table. Each container gives the first element inside that a field's selector finds,
    in document order (a pass over what the selectors found, without pairs); its text, or for ``url`` its link made absolute. Containers without a title or a link are no jobs. Containers may lie in
    each other.
    """
    every = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), steps_of(F.nullif(F.trim(F.col(f)), F.lit(""))).alias("steps")) for f in FIELDS)))
    asked = rules.select("source_key", F.lower("page_host").alias("host"), every.alias("r")).select("source_key", "host", "r.*").filter("steps IS NOT NULL")
    found = write_shared(find(nodes, asked), "selector-finds")
    back = Window.partitionBy("page_id", "source_key").orderBy(F.desc("node"), "_field").rowsBetween(Window.unboundedPreceding, -1)
    follows = [F.last(F.when(F.col("field") == f, F.struct("node", "last")), ignorenulls=True).over(back).alias(f) for f in FIELDS[1:]]  # the first one after the container's begin
    cards = found.withColumn("_field", F.col("field") != "job_container").select("*", *follows).filter("NOT _field")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}.node").alias("node"), F.col(f"{f}.last").alias("last")) for f in FIELDS[1:])))
    first = cards.select("page_id", "source_key", F.col("node").alias("container"), F.col("last").alias("_end"), each.alias("n")).select("page_id", "source_key", "container", "_end", "n.*").filter("node <= _end").drop("_end")
    said = texts_in(nodes, first.filter("field <> 'url'").select("page_id", F.col("node").alias("outer"), F.col("last").alias("outer_last")))
    link = nodes.filter("link IS NOT NULL").select("page_id", "node", "link")
    told = first.filter("field <> 'url'").join(said.withColumnRenamed("outer", "node"), ["page_id", "node"]).select("page_id", "source_key", "container", "field", F.col("text").alias("value"))
    told = told.unionByName(first.filter("field = 'url'").join(link, ["page_id", "node"]).select("page_id", "source_key", "container", "field", F.col("link").alias("value")))
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    jobs = told.groupBy("source_key", "page_id", "container").agg(*(value(f) for f in FIELDS[1:]))
    return jobs.filter("title IS NOT NULL AND url IS NOT NULL")


def checked_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules that can be used; and ``source_key, reason`` of the others: a required selector is missing, or one is of a form that isn't read."""
    blank = lambda f: F.nullif(F.trim(F.col(f)), F.lit(""))
    missing = F.filter(F.array(*(F.when(blank(f).isNull(), F.lit(f)) for f in FIELDS[:3])), lambda x: x.isNotNull())
    wrong = F.filter(F.array(*(F.when(blank(f).isNotNull() & steps_of(blank(f)).isNull(), F.lit(f)) for f in FIELDS)), lambda x: x.isNotNull())
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(F.size(wrong) > 0, F.concat(F.lit("not a selector: "), F.array_join(wrong, ", ")))
    rows = rules.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").select("source_key", "reason")


def validate_selectors(pages: DataFrame, rules: DataFrame, jobs: DataFrame, least: int = 1) -> DataFrame:
    """``source_key, page_id, jobs, ok, error`` for every rule and page of its host; a page with fewer than ``least`` jobs, or whose rule can't be used, fails."""
    fine, bad = checked_rules(rules)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("page_host"))
    asked = rules.select("source_key", F.lower("page_host").alias("page_host")).join(bad, "source_key", "left")
    counts = jobs.groupBy("source_key", "page_id").agg(F.count("*").alias("jobs"))
    rows = keyed.join(asked, "page_host").join(counts, ["source_key", "page_id"], "left")
    n = F.coalesce("jobs", F.lit(0))
    return rows.select("source_key", "page_id", n.alias("jobs"), (F.col("reason").isNull() & (n >= least)).alias("ok"), F.col("reason").alias("error"))


def judge_parsers(results: DataFrame, threshold: float = 0.8, least_pages: int = 5) -> DataFrame:
    """``source_key, sample_size, success_rate, status``: ``active`` with enough pages and a high enough share that succeeded, else ``failed``."""
    rows = results.groupBy("source_key").agg(F.count("*").alias("sample_size"), (F.count_if("ok") / F.count("*")).alias("success_rate"))
    good = (F.col("sample_size") >= least_pages) & (F.col("success_rate") >= threshold)
    return rows.withColumn("status", F.when(good, "active").otherwise("failed"))


# --- cleaned markup ---------------------------------------------------------------------------------------------------------------

#: Elements and attributes that are left out of cleaned markup (attributes that begin with data- too).
NOISY_ELEMENTS = ("script", "style", "noscript", "svg", "head", "iframe", "path")
NOISY_ATTRIBUTES = ("style", "srcset", "sizes", "integrity", "nonce")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def condense_html(nodes: DataFrame, budget: int = 24_000) -> DataFrame:
    """``page_id, condensed``: markup rebuilt from the element table without noisy elements and attributes, white space collapsed, its first ``budget``
    characters. Pages of which nothing is left don't appear."""
    upto = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    gone_to = F.max(F.when(F.col("tag").isin(*NOISY_ELEMENTS), F.col("last"))).over(upto)  # intervals never cross: the furthest end so far decides
    kept = nodes.withColumn("_gone", F.coalesce(gone_to >= F.col("node"), F.lit(False))).filter("NOT _gone")
    wanted = F.filter(F.map_entries("attributes"), lambda a: ~a["key"].isin(*NOISY_ATTRIBUTES) & ~a["key"].startswith("data-"))
    inner = F.array_join(F.transform(wanted, lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), F.replace(_escaped(a["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")
    void = F.col("tag").isin(*VOID)
    opening = (
        F.when(F.col("tag") == "#text", _escaped(F.col("content"))).when(F.col("tag") == "#code", F.col("content")).when(F.col("tag") == "#comment", F.concat(F.lit("<!--"), F.col("content"), F.lit("-->")))
        .when(F.col("tag") == "#doctype", F.concat(F.lit("<!"), F.col("content"), F.lit(">\n"))).otherwise(F.concat(F.lit("<"), F.col("tag"), inner, F.when(void, "/>").otherwise(">")))
    )
    at = lambda place, closing, depth, text: F.struct(place.alias("place"), closing.alias("closing"), depth.alias("depth"), text.alias("text"))
    start = at(F.col("node"), F.lit(0), F.lit(0), opening)
    end = at(F.col("last"), F.lit(1), -F.col("depth"), F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
    marks = kept.select("page_id", F.explode(F.when(void | F.col("tag").startswith("#"), F.array(start)).otherwise(F.array(start, end))).alias("m"))
    whole = marks.groupBy("page_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return whole.select("page_id", F.substring(F.regexp_replace(F.array_join(F.transform("m", lambda m: m["text"]), ""), r"(?U)\s+", " "), 1, budget).alias("condensed"))
