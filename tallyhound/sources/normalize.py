"""Normalisers of landed raw records into one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.functions import terms as t
from tallyhound.operators.latest import first_per_key
from tallyhound.store import drop_shared, write_shared


def alias(*names: str) -> Column:
    """The first of several fields that isn't blank."""
    return F.coalesce(*(c.blank_to_null(F.col(n)) for n in names))


def links_in(text: Column) -> Column:
    """URLs in HTML attributes or plain text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>)]+"), F.lit(0)))


def headline_company(title: Column) -> Column:
    """The name before the verb of a funding headline."""
    name = F.regexp_extract(title, r"(?i)^(.{2,80}?)\s+(?:raises|raised|secures|secured|closes|closed|lands|landed|nabs|gets|bags|announces|picks up)\b", 1)
    return c.display_name(F.regexp_replace(name, r"(?i)^(?:exclusive|breaking|startup|fintech)\s*[:,-]?\s+", ""))


def post_company(first_line: Column) -> Column:
    """The name at the head of a hiring post, before a separator or bracket."""
    head = F.regexp_extract(first_line, r"^([^|(\[–—]+)", 1)
    return c.display_name(F.regexp_replace(head, r"https?://\S+", ""))


def normalize_funding_items(df: DataFrame, feed: str, blocked: tuple[str, ...] = t.NON_COMPANY_HOSTS, tlds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Feed items to discovery records; and ``index, reason`` of those without a domain or a name."""
    body = F.concat_ws(" ", "content", "description")
    own = c.normalize_domain(F.col("link"), tlds)
    hosts = F.filter(F.transform(links_in(body), lambda u: F.struct(u.alias("url"), c.normalize_domain(u, tlds).alias("host"))), lambda x: x["host"].isNotNull() & ~x["host"].isin(*blocked) & ~x["host"].eqNullSafe(own))
    rows = df.withColumns({"_u": F.get(hosts, 0), "company_name": headline_company(F.col("title"))})
    rows = rows.select("index", F.lit(feed).alias("source"), F.col("link").alias("source_url"), F.coalesce(c.blank_to_null(F.col("guid")), F.col("link")).alias("source_record_id"), "company_name", F.col("_u.url").alias("website"), F.col("_u.host").alias("domain"), F.lit("funding").alias("event_type"), F.col("title").alias("event_summary"))
    reason = F.when(F.col("domain").isNull(), "missing_domain").when(F.col("company_name").isNull(), "missing_company_name")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").select("index", "reason")


def flatten_comment_tree(df: DataFrame, id: str = "id", parent: str = "parent", position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``root, id, depth, path, place`` of all comments, roots (rows without parent) included; and ``id, reason`` of the rejects.

    ``path`` has the ids from the root; ordered by ``place`` (the positions of those among their siblings), comments of a root stand depth first. Siblings are ordered
    by ``position``, or their ids. Paths are doubled: every step joins what is known up to an ancestor with what that ancestor knows, so a thread of
    depth d takes log(d) stored steps. Rejected by name: ``missing_id``; ``repeated_id`` (the first by position stays); ``missing_parent``, for all below it too; and
    ``cycle``, for what leads into one.
    """
    rows = df.select(F.col(id).alias("id"), F.col(parent).alias("up"), F.col(position or id).alias("_at"))
    bad = rows.filter("id IS NULL").select("id", F.lit("missing_id").alias("reason"))
    rows = rows.filter("id IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_at", "up")))
    bad = bad.unionByName(rows.filter("_n > 1").select("id", F.lit("repeated_id").alias("reason")))
    rows = write_shared(rows.filter("_n = 1").select("id", "up", "_at"), "comments")
    roots = rows.filter("up IS NULL").select("id", "up", F.lit(None).cast("string").alias("reason"), F.lit(1).alias("_n"))  # they have no siblings, and would be one hot key
    below = rows.filter("up IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("up").orderBy("_at", "id")))
    known = rows.select(F.col("id").alias("_id"))
    below = below.join(known, F.col("up") == F.col("_id"), "left").select("id", "up", F.when(F.col("_id").isNull(), "missing_parent").alias("reason"), "_n")
    rows = roots.unionByName(below).select("id", "up", "reason", F.array("id").alias("path"), F.array("_n").alias("place"))
    now = write_shared(rows.withColumn("up", F.when(F.col("reason").isNull(), F.col("up"))), "comment-paths")
    open_, before = now.filter("up IS NOT NULL").count(), None
    while open_ and open_ != before:
        above = now.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("reason").alias("_r"), F.col("path").alias("_p"), F.col("place").alias("_q"))
        step = now.filter("up IS NOT NULL").join(above, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), F.col("_r").alias("reason"), F.concat("_p", "path").alias("path"), F.concat("_q", "place").alias("place"))
        after = write_shared(now.filter("up IS NULL").unionByName(step), "comment-paths")
        drop_shared(now)
        now, before = after, open_
        open_ = now.filter("up IS NOT NULL").count()  # falls with every step until only what leads into a cycle is left
    bad = bad.unionByName(now.filter("up IS NOT NULL OR reason IS NOT NULL").select("id", F.coalesce("reason", F.lit("cycle")).alias("reason")))
    return now.filter("up IS NULL AND reason IS NULL").select(F.get("path", 0).alias("root"), "id", (F.size("path") - 1).alias("depth"), "path", "place"), bad


def normalize_hiring_posts(df: DataFrame, tlds: tuple[str, ...], blocked: tuple[str, ...] = t.NON_COMPANY_HOSTS, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """Hiring posts (``index, id, text``) to discovery records; and the rejects."""
    plain = F.regexp_replace(F.regexp_replace("text", r"(?i)<p>", "\n"), r"<[^>]+>", " ")
    bare = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\b(?:[a-z0-9-]+\.)+[a-z]{2,12}\b"), F.lit(0)), lambda h: c.normalize_domain(h, tlds))
    linked = F.transform(links_in(F.col("text")), lambda u: c.normalize_domain(u, tlds))
    hosts = F.filter(F.concat(linked, bare), lambda h: h.isNotNull() & ~h.isin(*blocked) & ~c.root_domain(h).isin(*blocked))
    first_line = F.get(F.filter(F.split(plain, "\n"), lambda x: F.trim(x) != ""), 0)
    rows = df.select("index", F.lit("hiring_posts").alias("source"), F.col("id").cast("string").alias("source_record_id"), post_company(first_line).alias("company_name"), F.get(hosts, 0).alias("domain"), c.infer_location(plain).alias("location"), F.lit("hiring_post").alias("event_type"), F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, 2000).alias("description"), F.length(F.coalesce("text", F.lit(""))).alias("_n"))
    reason = F.when(F.col("_n") < least, "too_short").when(F.col("domain").isNull(), "missing_domain").when(F.col("company_name").isNull(), "missing_company_name")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason", "_n"), rows.filter("reason IS NOT NULL").select("index", "reason")


PARTIES = "array<struct<name:string,roles:array<string>,details:struct<url:string>,contactPoint:struct<name:string,email:string,telephone:string,url:string>>>"
ITEM = "struct<classification:struct<scheme:string,id:string>,additionalClassifications:array<struct<scheme:string,id:string>>>"
OCDS = f"ocid string, id string, date string, parties {PARTIES}, tender struct<title:string,description:string,status:string,classification:struct<scheme:string,id:string>,additionalClassifications:array<struct<scheme:string,id:string>>,items:array<{ITEM}>>"


def pick_buyer_domain(parties: Column, portals: tuple[str, ...], free_mail: tuple[str, ...] = t.FREE_MAIL_DOMAINS) -> Column:
    """The first declared URL that isn't a portal's, else the first address host that is neither a portal's nor free mail."""
    urls = F.flatten(F.transform(parties, lambda p: F.array(p["details"]["url"], p["contactPoint"]["url"])))
    own = F.filter(F.transform(urls, lambda u: c.normalize_domain(u)), lambda h: h.isNotNull() & ~h.isin(*portals))
    mails = F.filter(F.transform(parties, lambda p: c.email_domain(p["contactPoint"]["email"])), lambda h: h.isNotNull() & ~h.isin(*portals, *free_mail))
    return F.coalesce(F.get(own, 0), F.get(mails, 0))


def pick_buyer_contact(parties: Column, domain: Column, portals: tuple[str, ...]) -> Column:
    """A contact at the buyer's own domain, else the first that isn't a portal's."""
    points = F.filter(F.transform(parties, lambda p: p["contactPoint"]), lambda x: x["email"].isNotNull())
    own = F.filter(points, lambda x: c.email_domain(x["email"]) == domain)
    other = F.filter(points, lambda x: ~c.email_domain(x["email"]).isin(*portals))
    return F.coalesce(F.get(own, 0), F.get(other, 0))


def normalize_tenders_ocds(df: DataFrame, cpv_prefixes: tuple[str, ...], portals: tuple[str, ...]) -> DataFrame:
    """Releases (``raw`` JSON) with a wanted code anywhere, as discovery records with buyer, domain and contact."""
    r = df.withColumn("r", F.from_json("raw", OCDS))
    ids = lambda a: F.transform(F.coalesce(a, F.array().cast("array<struct<scheme:string,id:string>>")), lambda x: x["id"])
    items = F.coalesce(F.col("r.tender.items"), F.array().cast(f"array<{ITEM}>"))
    codes = F.concat(F.array(F.col("r.tender.classification.id")), ids(F.col("r.tender.additionalClassifications")), F.transform(items, lambda i: i["classification"]["id"]), F.flatten(F.transform(items, lambda i: ids(i["additionalClassifications"]))))
    codes = F.array_distinct(F.filter(codes, lambda x: x.isNotNull()))
    wanted = F.exists(codes, lambda x: x.rlike("^(" + "|".join(cpv_prefixes) + ")"))
    parties = F.coalesce(F.col("r.parties"), F.array().cast(PARTIES))
    buyers = F.filter(parties, lambda p: F.coalesce(F.array_contains(p["roles"], "buyer"), F.lit(False)))
    rows = r.withColumns({"codes": codes, "_b": F.when(F.size(buyers) > 0, buyers).otherwise(parties)}).filter(wanted)
    domain = pick_buyer_domain(F.col("_b"), portals)
    rows = rows.withColumn("domain", domain)
    contact = pick_buyer_contact(F.col("_b"), F.col("domain"), portals)
    return rows.select(F.col("r.ocid").alias("source_record_id"), F.get("_b", 0)["name"].alias("company_name"), "domain", "codes", contact["email"].alias("contact_email"), contact["name"].alias("contact_name"), F.lit("procurement_notice").alias("event_type"), F.concat_ws(" | ", "r.tender.title", "r.tender.description", F.array_join("codes", ",")).alias("event_summary"))


def multilingual(values: Column) -> Column:
    """The first English value of a map of lists, else the first of any language."""
    return F.coalesce(F.get(F.element_at(values, "eng"), 0), F.get(F.get(F.map_values(values), 0), 0))


def normalize_tenders_ted(df: DataFrame) -> DataFrame:
    """Notices (``index, publication, buyer_name, title`` as maps of lists, ``url, email``), once per domain and publication."""
    domain = F.coalesce(c.normalize_domain(F.col("url")), c.email_domain(F.col("email")))
    rows = df.select("index", "publication", multilingual(F.col("buyer_name")).alias("company_name"), multilingual(F.col("title")).alias("event_summary"), domain.alias("domain"), F.lit("procurement_notice").alias("event_type"))
    return first_per_key(rows.filter("domain IS NOT NULL AND company_name IS NOT NULL"), ["domain", "publication"], "index")


_PAYLOADS = {
    "greenhouse": ("id string, title string, absolute_url string, updated_at string, content string, location struct<name:string>, departments array<struct<name:string>>", lambda p: {"external_job_id": p["id"], "title": p["title"], "url": p["absolute_url"], "posted_at": p["updated_at"], "description_text": p["content"], "location": p["location"]["name"], "department": F.get(p["departments"], 0)["name"]}),
    "lever": ("id string, text string, hostedUrl string, createdAt long, descriptionPlain string, categories struct<location:string,team:string,department:string,commitment:string>", lambda p: {"external_job_id": p["id"], "title": p["text"], "url": p["hostedUrl"], "posted_at": F.timestamp_millis(p["createdAt"]).cast("string"), "description_text": p["descriptionPlain"], "location": p["categories"]["location"], "department": F.coalesce(p["categories"]["department"], p["categories"]["team"])}),
    "ashby": ("id string, title string, jobUrl string, publishedAt string, descriptionPlain string, location string, department string, team string", lambda p: {"external_job_id": p["id"], "title": p["title"], "url": p["jobUrl"], "posted_at": p["publishedAt"], "description_text": p["descriptionPlain"], "location": p["location"], "department": F.coalesce(p["department"], p["team"])}),
}


def normalize_job_payloads(df: DataFrame, provider: str) -> DataFrame:
    """Job JSON (``raw``, besides other columns) of one provider in one schema, with what its text tells."""
    schema, fields = _PAYLOADS[provider]
    rows = df.withColumn("_p", F.from_json("raw", schema))
    rows = rows.withColumns(fields(F.col("_p"))).drop("_p").withColumns({"posted_at": c.parse_ts(F.col("posted_at")), "description_text": F.trim(F.regexp_replace(F.regexp_replace("description_text", r"<[^>]+>", " "), r"\s+", " "))})
    text = F.concat_ws(" ", "title", "department", "location", "description_text")
    return rows.withColumns({
        "ats_provider": F.lit(provider), "department": F.coalesce("department", c.infer_department(text)), "location": F.coalesce("location", c.infer_location(text)), "remote_policy": c.infer_remote_policy(text),
        "employment_type": c.infer_employment_type(text), "seniority": c.infer_seniority(F.col("title")), "stack_terms": c.stack_terms(text),
    })


def told(item: str, *names: str) -> Column:
    """The first of several fields of a VARIANT that is text and isn't blank, trimmed."""
    text = lambda n: F.when(F.schema_of_variant(F.try_variant_get(item, f"$.{n}", "variant")) == "STRING", c.blank_to_null(F.trim(F.try_variant_get(item, f"$.{n}", "string"))))
    return F.coalesce(*(text(n) for n in names))


def once(rows: DataFrame, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    """``keep`` and the ``fields``, each evaluated once a row: expressions don't move through the generator, and so aren't copied to where they are used."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(v.alias(k) for k, v in fields.items())))))


def _own_host(host: Column) -> Column:
    return ~host.isin(*t.VENDOR_HOSTS) & ~F.coalesce(c.root_domain(host).isin(*t.VENDOR_HOSTS), F.lit(False))


def _first_of_domain(rows: DataFrame) -> DataFrame:
    """The rows, stored, so that they are worked out once; ``reason`` of those after the first of their domain that has none: ``duplicate_domain``, whatever they had."""
    rows = write_shared(rows, "items")
    first = rows.filter("reason IS NULL AND domain IS NOT NULL").groupBy(F.col("domain").alias("_domain")).agg(F.min("index").alias("_first"))
    named = rows.filter("domain IS NOT NULL").join(first, F.col("domain") == F.col("_domain"), "left")
    named = named.withColumn("reason", F.when(F.col("index") > F.col("_first"), "duplicate_domain").otherwise(F.col("reason"))).drop("_domain", "_first")
    return rows.filter("domain IS NULL").unionByName(named)  # rows without domain don't meet in one task


def normalize_vendor_companies(df: DataFrame, require_non_technical: bool = True, tlds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vendors' company items (``index, raw`` JSON) with fields under any of several names, as discovery records, the first of each domain; and ``index, reason`` of the
    rejects: ``not_an_object``, ``no_company_name``, ``no_resolvable_domain`` (none, or a platform's), ``duplicate_domain`` of an accepted one, ``not_non_technical``."""
    from tallyhound.operators.validate import looks_non_technical

    count = F.coalesce(*(F.coalesce(F.try_variant_get("v", f"$.{n}", "int"), F.regexp_replace(F.split_part(F.try_variant_get("v", f"$.{n}", "string"), F.lit("-"), F.lit(1)), "[^0-9]", "").try_cast("int")) for n in ("employeeCount", "employees", "staffCount")))
    fields = {
        "is_object": F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "company_name": told("v", "name", "companyName", "title", "fullName"), "site": told("v", "website", "companyWebsite", "url", "domain", "websiteUrl"),
        "industry": told("v", "industry", "industryName", "sector"), "description": told("v", "description", "about", "tagline", "summary"), "location": told("v", "location", "headquarters", "city"),
        "profile": told("v", "linkedinUrl", "profileUrl", "url", "link"), "count": count,
    }
    rows = once(df.select("index", F.try_parse_json("raw").alias("v")), ["index"], fields)
    host = c.normalize_domain(F.col("site"), tlds)
    rows = once(rows, ["index", "is_object", "company_name", "industry", "description", "location", "profile", "count"], {"host": host, "said": F.concat_ws(" ", "industry", "description")})
    rows = rows.withColumns({"domain": F.when(_own_host(F.col("host")), F.col("host")), "employee_count": F.when((F.col("count") > 0) & (F.col("count") < 5_000_000), F.col("count"))})
    fine = looks_non_technical(F.col("said")) if require_non_technical else F.lit(True)
    reason = F.when(~F.col("is_object"), "not_an_object").when(F.col("company_name").isNull(), "no_company_name").when(F.col("domain").isNull(), "no_resolvable_domain").when(~fine, "not_non_technical")
    rows = rows.withColumn("reason", reason)
    named = F.col("company_name").isNotNull() & F.col("domain").isNotNull()
    rows = _first_of_domain(rows.withColumn("domain", F.when(named, F.col("domain"))))
    site = F.concat(F.lit("https://"), "domain")
    good = rows.filter("reason IS NULL").select("index", F.lit("vendor_companies").alias("source"), F.concat(F.lit("vendor:"), "domain").alias("source_record_id"), F.coalesce("profile", site).alias("source_url"), "company_name", site.alias("website"), "domain", "location", "industry", F.substring("description", 1, 2000).alias("description"), "employee_count", F.lit("discovery").alias("event_type"))
    return good, rows.filter("reason IS NOT NULL").select("index", "reason")


def normalize_vendor_posts(df: DataFrame, tlds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Posts (``index, raw`` JSON) that link a company's site, in the post or at its author, the first of each domain; and ``index, reason`` of the rejects:
    ``not_an_object``, ``no_resolvable_domain``, ``non_company_host``, ``duplicate_domain``. A post without author is named by its domain."""
    rows = df.select("index", F.try_parse_json("raw").alias("v"))
    linked = F.coalesce(told("v", "expandedUrl", "outboundUrl"), told("v", "author.url", "author.website", "author.expandedUrl"))
    rows = rows.withColumn("domain", c.let(linked, lambda x: c.normalize_domain(x, tlds)))
    name = F.coalesce(told("v", "author.name", "author.displayName", "author.userName"), F.initcap(F.substring_index("domain", ".", 1)))
    reason = F.when(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "not_an_object").when(F.col("domain").isNull(), "no_resolvable_domain").when(~_own_host(F.col("domain")), "non_company_host")
    rows = _first_of_domain(rows.withColumns({"company_name": name, "text": told("v", "text", "full_text", "content"), "reason": reason}))
    return rows.filter("reason IS NULL").select("index", "company_name", "domain", "text"), rows.filter("reason IS NOT NULL").select("index", "reason")


def normalize_directory_companies(df: DataFrame, regions: tuple[str, ...] = (), min_employees: int = 0) -> DataFrame:
    """Directory rows (``index, name, website, regions, team_size, batch, one_liner``) of wanted regions and sizes."""
    rows = df.select("index", c.display_name(F.col("name")).alias("company_name"), c.normalize_domain(F.col("website")).alias("domain"), "regions", F.col("team_size").cast("int").alias("employee_count"), "batch", F.col("one_liner").alias("description"))
    rows = rows.filter("company_name IS NOT NULL AND domain IS NOT NULL").filter(F.coalesce("employee_count", F.lit(0)) >= min_employees)
    return rows.filter(F.exists("regions", lambda r: c.has_any(F.lower(r), [x.lower() for x in regions]))) if regions else rows
