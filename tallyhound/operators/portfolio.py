"""People and companies in saved pages: founders from embedded JSON or from links, and portfolio pages cut into company cards.

Both read the stored element table (:mod:`tallyhound.operators.elements`). Embedded JSON is walked level by level as VARIANT; cards are intervals of
elements, and what belongs to a card is what lies inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.adapters import spread
from tallyhound.functions import columns as c
from tallyhound.operators.elements import inside, stripped, texts_in
from tallyhound.operators.latest import first_per_key
from tallyhound.store import write_shared

EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
#: Roles that a founder's card may name, and words that end a name at its head.
CARD_ROLE = r"(?i)\b(Co-Founder|Cofounder|Founder/CEO|Founder|CEO|CTO|COO|Chief [A-Za-z ]+ Officer)\b"
NAME_END = r"(?i)Founder|CEO|CTO|COO|Chief|LinkedIn|Twitter|X"


def arrays_under(docs: DataFrame, word: str, key: str = "page_id", value: str = "v") -> DataFrame:
    """``key, place, v``: the outermost arrays of VARIANT ``value`` on whose path of keys ``word`` occurs (lower case), with their place in the document.

    A level of nesting is a stored step, so there are as many as the deepest document has. Keys of an object are taken in alphabetical order, as
    VARIANT keeps them. Scalars and null have no arrays.
    """
    spark = docs.sparkSession
    is_array = F.try_variant_get("v", "$", "array<variant>").isNotNull()
    rows = docs.select(F.col(key), F.array().cast("array<int>").alias("place"), F.lit(False).alias("told"), F.col(value).alias("v"))
    found, level = None, spread(write_shared(rows.filter("v IS NOT NULL"), "variant-level"))
    while not level.isEmpty():
        each = level.withColumnRenamed("v", "_v").lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        each = each.select(key, F.concat("place", F.array("pos")).alias("place"), (F.col("told") | F.coalesce(F.lower("key").contains(word), F.lit(False))).alias("told"), F.col("value").alias("v"))
        each = each.filter(is_array | F.try_variant_get("v", "$", "map<string,variant>").isNotNull())
        below = write_shared(each.withColumn("hit", F.col("told") & is_array), "variant-level")
        hits = below.filter("hit").select(key, "place", "v")
        found = hits if found is None else found.unionByName(hits)
        level = below.filter("NOT hit").drop("hit")
    return found if found is not None else rows.select(key, "place", "v")


def _first(item: str, *names: str) -> Column:
    return F.coalesce(*(c.blank_to_null(F.trim(F.try_variant_get(item, f"$.{n}", "string"))) for n in names))


def founders_in_json(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Founders in the JSON of pages' first ``data-page`` attribute: all items of arrays whose path of keys names founders, wherever they lie."""
    told = nodes.filter(F.col("attributes")["data-page"].isNotNull()).groupBy("page_id").agg(F.min_by(F.col("attributes")["data-page"], "node").alias("json"))
    arrays = arrays_under(told.select("page_id", F.try_parse_json("json").alias("v")), "founder")
    items = arrays.select("page_id", "place", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "f")).join(pages.select("page_id", "url"), "page_id")
    link = lambda *names: c.let(_first("f", *names), lambda ref: c.absolute_url(F.col("url"), ref))
    rows = items.select(
        "page_id", F.concat("place", F.array("pos")).alias("place"), _first("f", "name", "full_name", "fullName", "title", "username").alias("name"), _first("f", "role", "title", "title_text", "position").alias("role"),
        link("url", "profile_url", "profileUrl", "path").alias("profile_url"), link("linkedin_url", "linkedinUrl", "linkedin", "linkedin_link").alias("linkedin_url"), link("twitter_url", "twitterUrl", "twitter", "x_url").alias("x_url"),
        _first("f", "bio", "founder_bio", "description", "about").alias("bio"), F.nullif(F.regexp_extract(F.to_json("f"), EMAIL, 0), F.lit("")).alias("email"), F.lit("json").alias("found_in"),
    )
    return rows.filter("name IS NOT NULL")


def founders_in_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Founders by links to profiles, each with what the innermost block around it says."""
    href = F.col("attributes")["href"]
    anchors = nodes.filter((F.col("tag") == "a") & (href.contains("/people/") | href.contains("linkedin.com/in/"))).select("page_id", "node", "last", F.col("attributes")["href"].alias("href"), "link")
    blocks = nodes.filter(F.col("tag").isin("div", "li", "article", "section")).join(anchors.select("page_id").distinct(), "page_id", "left_semi").select("page_id", F.col("node").alias("outer"), F.col("last").alias("outer_last"))
    cards = inside(anchors.select("page_id", "node"), blocks, ["page_id"]).groupBy("page_id", "node").agg(F.max(F.struct("outer", "outer_last")).alias("_c")).select("page_id", "node", "_c.outer", "_c.outer_last")
    own = anchors.select("page_id", F.col("node").alias("outer"), F.col("last").alias("outer_last"))
    said = texts_in(nodes, cards.select("page_id", "outer", "outer_last").unionByName(own), raw=True)
    alt = inside(nodes.filter("tag = 'img' AND attributes['alt'] <> ''").select("page_id", "node", F.col("attributes")["alt"].alias("alt")), own, ["page_id"]).groupBy("page_id", "outer").agg(F.min_by("alt", "node").alias("alt"))
    social = nodes.filter("tag = 'a' AND (attributes['href'] LIKE '%twitter.com%' OR attributes['href'] LIKE '%x.com%')").select("page_id", "node", "link")
    social = inside(social, cards.select("page_id", "outer", "outer_last").distinct(), ["page_id"]).groupBy("page_id", "outer").agg(F.min_by("link", "node").alias("x_url"))
    rows = anchors.join(cards, ["page_id", "node"], "left").join(social, ["page_id", "outer"], "left").join(said.withColumnRenamed("text", "card"), ["page_id", "outer"], "left")
    rows = rows.join(said.select("page_id", F.col("outer").alias("node"), F.col("text").alias("said")), ["page_id", "node"], "left").join(alt.select("page_id", F.col("outer").alias("node"), "alt"), ["page_id", "node"], "left")
    head = F.trim(F.get(F.split("card", NAME_END, 2), 0))
    name = F.coalesce(c.blank_to_null(F.col("said")), c.blank_to_null(F.col("alt")), F.when(F.length(head) <= 80, c.blank_to_null(head)))
    pick = lambda pattern: F.nullif(F.regexp_extract(F.coalesce("card", F.lit("")), pattern, 0), F.lit(""))
    rows = rows.select(
        "page_id", F.array("node").alias("place"), name.alias("name"), pick(CARD_ROLE).alias("role"), F.when(F.col("href").contains("/people/"), F.col("link")).alias("profile_url"),
        F.when(F.col("href").contains("linkedin.com"), F.col("link")).alias("linkedin_url"), "x_url", c.blank_to_null(F.col("card")).alias("bio"), pick(EMAIL).alias("email"), F.lit("links").alias("found_in"),
    )
    return rows.filter("name IS NOT NULL")


def extract_founders(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, name, role, profile_url, linkedin_url, x_url, bio, email, found_in`` of pages' founders, the first of each name (in lower case).

    ``nodes`` is the stored element table of ``pages`` (``page_id, url``). Links are looked at only on pages whose embedded JSON has no founder.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    told = write_shared(founders_in_json(nodes, pages), "founders")
    linked = founders_in_links(nodes.join(told.select("page_id").distinct(), "page_id", "left_anti"), pages)
    rows = told.unionByName(linked).withColumn("_k", F.lower(F.trim("name")))
    return first_per_key(rows, ["page_id", "_k"], "place").drop("_k", "place")


# --- portfolio pages --------------------------------------------------------------------------------------------------------------

COMPANY = ("company_name", "source_record_id", "website", "description", "location", "industry", "year_or_stage", "company_linkedin_url")
PEOPLE = "array<struct<name:string,role:string,linkedin_url:string>>"
#: How four layouts of portfolio pages mark a company's card and its fields. ``one``: the first element's text; ``many``: all texts.
LAYOUTS = {
    "tiles": {
        "card": "tag = 'div' AND array_contains(classes, 'tile') AND array_contains(classes, 'tile--company')",
        "own": {"company_name": "attributes['data-companyname']", "source_record_id": "attributes['data-companyslug']"},
        "one": {"description": "array_contains(classes, 'tile__description')"},
        "many": {"location": "array_contains(classes, 'locationtag')", "industry": "array_contains(classes, 'categorytag')"},
        "labelled": {"year_or_stage": "founded"},
        "role": "array_contains(classes, 'meta__row__role')", "person": "tag = 'a' AND array_contains(classes, 'text-link')",
    },
    "mix_items": {
        "card": "tag = 'div' AND array_contains(classes, 'company__item') AND array_contains(classes, 'mix')",
        "own": {"industry": "array_join(transform(filter(classes, x -> x NOT IN ('company__item', 'mix', 'visible', 'portfolio', 'selected') AND NOT x RLIKE '^[0-9]+$'), x -> replace(x, '-', ' ')), ', ')"},
        "one": {"company_name": "array_contains(classes, 'company__item__name')", "description": "array_contains(classes, 'company__item__description__content')", "year_or_stage": "array_contains(classes, 'company__item__year')"},
        "website": ("seedcamp.com",),
    },
    "cms_list": {
        "card": "tag = 'div' AND attributes['role'] = 'listitem'", "begin": "attributes['fs-cmsfilter-field'] = 'name'",
        "one": {"company_name": "attributes['fs-cmsfilter-field'] = 'name'", "description": "attributes['fs-cmsfilter-field'] = 'description'", "location": "attributes['fs-cmsfilter-field'] = 'location'", "industry": "attributes['fs-cmsfilter-field'] = 'sector'",
                "year_or_stage": "attributes['fs-cmsfilter-field'] = 'year'", "_stage": "attributes['fs-cmsfilter-field'] = 'stage'"},
        "website": ("antler.co", "cdn.prod.website-files.com", "uploads-ssl.webflow.com"),
    },
}
#: Links to these aren't a company's own site; blocks of the layout in JSON, escaped and plain.
SOCIAL = ("linkedin.com/", "twitter.com/", "x.com/", "facebook.com/", "instagram.com/")
JSON_BLOCKS = (r'(?s)\{\\"id\\":\\"[0-9a-f-]+\\".*?\\"session_year\\":(?:null|\d+)\}', r'(?s)\{"id":.*?"updatedAt":.*?\}')
_BLOCK = "name string, vertical string, stage string, description string, website string, linkedin_url string, session_year string"


def _cards(nodes: DataFrame, layout: dict) -> DataFrame:
    """``page_id, outer, outer_last`` and the card's own attributes. Where a page has no card and the layout names what begins one, a card goes from there to the next."""
    found = nodes.filter(layout["card"])
    own = [F.expr(e).alias(n) for n, e in layout.get("own", {}).items()]
    cards = found.select("page_id", F.col("node").alias("outer"), F.col("last").alias("outer_last"), *own)
    if "begin" in layout:
        rest = nodes.join(found.select("page_id").distinct(), "page_id", "left_anti")
        ends = rest.groupBy("page_id").agg(F.max("node").alias("_end"))
        nxt = F.lead("node").over(Window.partitionBy("page_id").orderBy("node"))
        begun = rest.filter(layout["begin"]).select("page_id", (F.col("node") - 1).alias("outer"), (nxt - 1).alias("_last")).join(ends, "page_id")
        cards = cards.unionByName(begun.select("page_id", "outer", F.coalesce("_last", "_end").alias("outer_last")), allowMissingColumns=True)
    return cards


def _values(nodes: DataFrame, cards: DataFrame, layout: dict) -> DataFrame:
    """``page_id, outer`` and the fields that stand in elements: the first text, all texts, or the text after a label."""
    asked = [(f, e) for kind in ("one", "many") for f, e in layout.get(kind, {}).items()]
    field = F.explode(F.filter(F.array(*(F.when(F.expr(e), F.lit(f)) for f, e in asked)), lambda f: f.isNotNull()))
    marked = nodes.select("page_id", "node", "last", field.alias("field"))
    if "labelled" in layout:
        label = F.create_map(*(F.lit(x) for f, word in layout["labelled"].items() for x in (word, f)))
        named = nodes.filter("tag = '#text'").select("page_id", F.col("parent").alias("node"), label[F.lower(stripped(F.col("content")))].alias("field")).filter("field IS NOT NULL")
        after = named.join(nodes.select("page_id", "node", "last", "parent"), ["page_id", "node"])
        beside = nodes.filter("tag NOT LIKE '#%'").select("page_id", F.col("parent"), F.col("node").alias("_n"), F.col("last").alias("_l"))
        after = after.join(beside, ["page_id", "parent"]).filter("_n > last").groupBy("page_id", "node", "field").agg(F.min(F.struct("_n", "_l")).alias("_s"))
        marked = marked.unionByName(after.select("page_id", F.col("_s._n").alias("node"), F.col("_s._l").alias("last"), "field"))
    held = inside(marked, cards.select("page_id", "outer", "outer_last"), ["page_id"]).withColumnRenamed("outer", "card")
    said = texts_in(nodes, held.select("page_id", F.col("node").alias("outer"), F.col("last").alias("outer_last")), raw=True)
    rows = held.join(said.withColumnRenamed("outer", "node"), ["page_id", "node"]).filter("text <> ''")
    every = F.array_sort(F.collect_list(F.when(F.col("field").isin(list(layout.get("many", {}))), F.struct("field", "node", "text"))))
    aggs = [F.min_by(F.when(F.col("field") == f, F.col("text")), F.when(F.col("field") == f, F.col("node"))).alias(f) for f in [*layout.get("one", {}), *layout.get("labelled", {})]]
    out = rows.groupBy("page_id", F.col("card").alias("outer")).agg(every.alias("_many"), *aggs)
    listed = lambda f: F.array_join(F.transform(F.filter("_many", lambda x: x["field"] == f), lambda x: x["text"]), ", ")
    for f in layout.get("many", {}):
        out = out.withColumn(f, c.blank_to_null(listed(f)))
    return out.drop("_many")


def _people(nodes: DataFrame, cards: DataFrame, layout: dict) -> DataFrame:
    """``page_id, outer, people``: each role with the link after it; of roles in a row, the first."""
    kind = F.when(F.expr(layout["role"]), "role").when(F.expr(layout["person"]), "person")
    marks = nodes.select("page_id", "node", "last", "link", kind.alias("kind")).filter("kind IS NOT NULL")
    marks = inside(marks, cards.select("page_id", "outer", "outer_last"), ["page_id"])
    said = texts_in(nodes, marks.select("page_id", F.col("node").alias("outer"), F.col("last").alias("outer_last")), raw=True).withColumnRenamed("outer", "node")
    marks = marks.join(said, ["page_id", "node"], "left")
    order = Window.partitionBy("page_id", "outer").orderBy("node")
    marks = marks.withColumn("_new", F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit("person")))
    marks = marks.filter("kind = 'person' OR _new")
    role = F.when(F.lag("kind").over(order) == "role", F.lag("text").over(order))
    marks = marks.withColumns({"role": role, "_led": F.coalesce(F.lag("kind").over(order) == "role", F.lit(False))}).filter("kind = 'person' AND _led")
    person = F.struct("node", F.struct(F.col("text").alias("name"), "role", F.when(F.col("link").contains("linkedin.com/"), F.col("link")).alias("linkedin_url")).alias("p"))
    return marks.groupBy("page_id", "outer").agg(F.transform(F.array_sort(F.collect_list(person)), lambda x: x["p"]).alias("people"))


def parse_portfolio_pages(nodes: DataFrame, pages: DataFrame, layout: str) -> DataFrame:
    """Companies of portfolio pages in one of the layouts of :data:`LAYOUTS`, or ``json``: ``page_id``, :data:`COMPANY`, ``domain``, ``people`` and
    ``emails``, once per page and lower-case name.

    ``nodes`` is the stored element table of ``pages`` (``page_id, html``; the text of the latter is read by ``json`` alone). Cards without a name are left out.
    """
    none = F.array().cast(PEOPLE)
    if layout == "json":
        plain = pages.select(F.col("page_id").cast("long").alias("page_id"), c.unescape_html(F.col("html")).alias("_t"))
        escaped = F.regexp_extract_all("_t", F.lit(JSON_BLOCKS[0]), F.lit(0))
        blocks = F.when(F.size(escaped) > 0, F.transform(escaped, lambda b: F.replace(F.replace(b, F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/")))).otherwise(F.regexp_extract_all("_t", F.lit(JSON_BLOCKS[1]), F.lit(0)))
        rows = plain.select("page_id", F.posexplode(blocks).alias("outer", "b")).withColumn("r", F.from_json("b", _BLOCK))
        rows = rows.select("page_id", "outer", c.blank_to_null(F.col("r.name")).alias("company_name"), F.lit(None).cast("string").alias("source_record_id"), c.blank_to_null(F.col("r.website")).alias("website"), c.blank_to_null(F.col("r.description")).alias("description"), F.lit(None).cast("string").alias("location"),
                           c.blank_to_null(F.col("r.vertical")).alias("industry"), F.coalesce(c.blank_to_null(F.col("r.session_year")), c.blank_to_null(F.col("r.stage"))).alias("year_or_stage"), c.blank_to_null(F.col("r.linkedin_url")).alias("company_linkedin_url"), none.alias("people"), c.extract_emails(F.col("b")).alias("emails"))
    else:
        spec = LAYOUTS[layout]
        cards = write_shared(_cards(nodes, spec), "portfolio-cards")
        spans = cards.select("page_id", "outer", "outer_last")
        rows = cards.join(_values(nodes, spans, spec), ["page_id", "outer"], "left")
        if "website" in spec:
            links = nodes.filter("attributes['href'] RLIKE '^https?://'").select("page_id", "node", F.col("attributes")["href"].alias("href"))
            links = links.filter(~c.has_any(F.lower("href"), (*spec["website"], *SOCIAL)))
            rows = rows.join(inside(links, spans, ["page_id"]).groupBy("page_id", "outer").agg(F.min_by("href", "node").alias("website")), ["page_id", "outer"], "left")
        rows = rows.join(_people(nodes, spans, spec), ["page_id", "outer"], "left") if "role" in spec else rows.withColumn("people", none)
        told = nodes.select("page_id", "node", F.explode(F.concat(F.array("content"), F.coalesce(F.map_values("attributes"), F.array().cast("array<string>")))).alias("_t")).filter("_t LIKE '%@%'")
        mails = inside(told.select("page_id", "node", F.explode(c.extract_emails(F.col("_t"))).alias("email")), spans, ["page_id"]).groupBy("page_id", "outer").agg(F.array_sort(F.collect_set("email")).alias("emails"))
        rows = rows.join(mails, ["page_id", "outer"], "left")
        for name in COMPANY:
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast("string"))
        if "_stage" in rows.columns:
            rows = rows.withColumn("year_or_stage", F.coalesce("year_or_stage", "_stage"))
        if "source_record_id" in spec.get("own", {}):
            slug = F.regexp_replace(F.regexp_replace(F.lower("company_name"), "[^a-z0-9]+", "-"), "^-|-$", "")
            rows = rows.withColumn("source_record_id", F.coalesce(c.blank_to_null(F.col("source_record_id")), c.blank_to_null(slug), F.lit("unknown")))
    rows = rows.withColumns({"company_name": c.blank_to_null(F.trim(F.regexp_replace("company_name", r"\s+", " "))), "people": F.coalesce("people", none), "emails": F.coalesce("emails", F.array().cast("array<string>"))}).filter("company_name IS NOT NULL")
    rows = first_per_key(rows.withColumn("_k", F.lower("company_name")), ["page_id", "_k"], "outer")
    return rows.select("page_id", *(c.blank_to_null(F.col(n)).alias(n) for n in COMPANY), c.normalize_domain(F.col("website")).alias("domain"), "people", "emails")


def coverage_score(companies: DataFrame, by: list[str]) -> DataFrame:
    """``by``, counts of what companies of a source tell, and ``quality_score``: 25 for websites, 15 for descriptions, 10 each for industries, locations and
    company profiles, by share; 20 for people and 10 for their profiles by their average per company, at most one."""
    told = lambda n: F.count(c.blank_to_null(F.col(n))).alias(n + "s")
    people, profiles = F.sum(F.size("people")), F.sum(F.size(F.filter("people", lambda p: p["linkedin_url"].isNotNull())))
    rows = companies.groupBy(*by).agg(F.count("*").alias("companies"), *(told(n) for n in ("website", "description", "location", "industry", "year_or_stage", "company_linkedin_url")), people.alias("people"), profiles.alias("people_with_profile"), F.sum(F.size("emails")).alias("emails"))
    share = lambda n: F.least(F.col(n) / F.col("companies"), F.lit(1.0))
    score = share("websites") * 25 + share("descriptions") * 15 + share("industrys") * 10 + share("locations") * 10 + share("company_linkedin_urls") * 10 + share("people") * 20 + share("people_with_profile") * 10
    return rows.withColumn("quality_score", c.half_even(score).cast("int")).withColumnsRenamed({"industrys": "industries", "year_or_stages": "years_or_stages"})
