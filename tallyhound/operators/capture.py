"""Contacts and facts from saved pages. Pages are parsed once, in one vectorised pass; everything after it is DataFrame work."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.functions import terms as t
from tallyhound.operators.elements import SLICE_CHARS
from tallyhound.operators.latest import first_per_key, latest
from tallyhound.operators.resolve import with_deliverability
from tallyhound.operators.scoring import candidate_confidence, review_hint
from tallyhound.store import map_slices

PARSED = "page_id long, url string, title string, meta string, h1 string, links array<struct<href:string,text:string,tag:string,css:string>>, lines array<string>, text string"
_BLOCKS = frozenset(("p", "div", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "article", "section", "nav", "header", "footer", "ul", "ol", "table"))


class _Page(HTMLParser):
    """Collects title, description, first heading, links and lines; skips scripts and styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title = self.meta = self.h1 = ""
        self.links: list[dict] = []
        self.parts: list[str] = []
        self.skip, self.open = 0, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "a" and a.get("href"):
            self.links.append({"href": a["href"].strip(), "text": "", "tag": tag, "css": a.get("class") or ""})
        elif tag == "meta" and (a.get("name") or "").lower() == "description" and not self.meta:
            self.meta = (a.get("content") or "").strip()
        if tag in ("title", "h1", "a"):
            self.open.append(tag)
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in self.open:
            self.open.remove(tag)
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if "title" in self.open:
            self.title += data
            return
        if "h1" in self.open and not self.h1.strip():
            self.h1 += data
        if "a" in self.open and self.links:
            self.links[-1]["text"] += data
        self.parts.append(data)


def parse_html(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` to title, description, first heading, links (absolute where they can be), lines and text. Null pages are empty."""

    link = pa.struct([(n, pa.string()) for n in ("href", "text", "tag", "css")])
    schema = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("url", "title", "meta", "h1")), ("links", pa.list_(link)), ("lines", pa.list_(pa.string())), ("text", pa.string())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for row in range(b.num_rows):  # one page at a time as Python text
                page_id, url, source = (b.column(n)[row].as_py() for n in ("page_id", "url", "html"))
                p = _Page()
                p.feed(source or "")
                p.close()
                lines = [x for x in (" ".join(line.split()) for line in "".join(p.parts).split("\n")) if x]
                for link in p.links:
                    link["text"] = " ".join(link["text"].split())
                    if not link["href"].lower().startswith(("mailto:", "tel:", "#", "javascript:")):
                        try:
                            link["href"] = urljoin(url or "", link["href"])
                        except ValueError:
                            pass
                out.append((page_id, url, " ".join(p.title.split()), p.meta, " ".join(p.h1.split()), p.links, lines, " ".join(lines)))
                size += len(source or "")
                if size > SLICE_CHARS:
                    yield table(out)
                    out, size = [], 0
        if out:
            yield table(out)

    return map_slices(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run, PARSED)


def capture_emails(parsed: DataFrame, mx_records: DataFrame, domain: str = "domain") -> DataFrame:
    """Addresses per page, those of mailto links before those in text, each once, with kind and deliverability. ``parsed`` carries the
    company's ``domain``."""
    mail = F.filter("links", lambda x: F.lower(x["href"]).startswith("mailto:"))
    linked = F.transform(mail, lambda x: F.struct(F.lit("mailto").alias("how"), F.split_part(F.substring(x["href"], F.lit(8), F.length(x["href"])), F.lit("?"), F.lit(1)).alias("raw")))
    in_text = F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), lambda e: F.struct(F.lit("page_text").alias("how"), e.alias("raw")))
    rows = parsed.select("page_id", "url", domain, F.posexplode(F.concat(linked, in_text)).alias("index", "f"))
    rows = rows.withColumn("email", F.regexp_replace(F.lower(F.trim("f.raw")), r"[.,;:)]+$", ""))
    host = c.email_domain(F.col("email"))
    fine = F.col("email").contains("@") & (F.substring_index("email", "@", 1) != "") & ~c.local_part(F.col("email")).isin(*t.JUNK_LOCAL_PARTS) & ~host.rlike(r"\.(png|jpg|gif|svg|webp)$")
    rows = first_per_key(rows.filter(fine), ["page_id", "email"], "index")
    rows = with_deliverability(rows, mx_records)
    return rows.select("page_id", F.col("url").alias("source_url"), "email", F.col("f.how").alias("extraction"), c.classify_local_part(F.col("email")).alias("contact_kind"), F.coalesce(c.email_domain(F.col("email")) == F.lower(domain), F.lit(False)).alias("on_company_domain"), "deliverability")


def capture_phones(parsed: DataFrame) -> DataFrame:
    linked = F.transform(F.filter("links", lambda x: F.lower(x["href"]).startswith("tel:")), lambda x: F.struct(F.lit("tel").alias("how"), c.normalize_phone(x["href"]).alias("phone")))
    in_text = F.transform(c.extract_phones(F.col("text")), lambda p: F.struct(F.lit("page_text").alias("how"), p.alias("phone")))
    rows = parsed.select("page_id", "url", F.posexplode(F.concat(linked, in_text)).alias("index", "f")).select("page_id", F.col("url").alias("source_url"), "index", F.col("f.phone").alias("phone"), F.col("f.how").alias("extraction")).filter("phone IS NOT NULL")
    return first_per_key(rows, ["page_id", "phone"], "index").drop("index")


def capture_web_presence(parsed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Links of a known kind, each URL once per page; and a website row for each of ``base`` (``page_id, url``)."""
    rows = parsed.select("page_id", F.col("url").alias("discovered_from"), F.posexplode("links").alias("index", "l")).select("page_id", "discovered_from", "index", F.col("l.href").alias("url"), F.nullif(F.substring("l.text", 1, 120), F.lit("")).alias("title"))
    rows = rows.filter(F.col("url").rlike(r"^https?:")).withColumn("presence_kind", c.presence_kind(F.col("url"))).filter("presence_kind IS NOT NULL")
    rows = first_per_key(rows, ["page_id", "url"], "index").drop("index")
    if base is None:
        return rows
    home = base.select("page_id", F.lit(None).cast("string").alias("discovered_from"), "url", F.lit(None).cast("string").alias("title"), F.lit("website").alias("presence_kind"))
    return rows.unionByName(home)


def procurement_contacts(records: DataFrame, mx_records: DataFrame, order: str = "id") -> DataFrame:
    """Published contacts of tender records (``id, company_id, domain, source_key, source_type, source_url, raw_payload``): address, name or phone in the payload.

    A company's contact of an address, phone and source URL is taken once, from the last record by ``order``. Records of other source types, and those
    without any of the three, have none; payload values that aren't text count as absent.
    """
    v = F.try_parse_json("raw_payload")
    told = lambda n: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", c.blank_to_null(F.trim(F.try_variant_get(v, f"$.{n}", "string"))))
    rows = records.filter("source_type = 'procurement_discovery'").withColumns({"email": F.lower(told("contact_email")), "full_name": told("contact_name"), "phone": told("contact_phone"), "_source": told("source_url"), "_record": told("source_record_id"), "_portal": F.try_variant_get(v, "$.contact_is_portal", "boolean")})
    rows = rows.withColumn("email", F.when(F.col("email").contains("@"), F.col("email"))).withColumn("source_url", F.coalesce("source_url", "_source", F.lit("")))
    rows = rows.filter("email IS NOT NULL OR phone IS NOT NULL OR full_name IS NOT NULL")
    rows = latest(rows, ["company_id", "email", "phone", "source_url"], F.col(order).desc())
    rows = with_deliverability(rows, mx_records)
    kind = F.when(F.col("full_name").isNotNull(), "person").when(F.col("email").isNotNull(), "role_inbox").otherwise("unknown")
    evidence = F.to_json(F.struct(F.lit("procurement_notice_contact").alias("collector"), F.col("source_key").alias("source"), F.col("_record").alias("source_record_id"), F.col("_portal").alias("contact_is_portal")))
    return rows.select(
        "company_id", "email", "full_name", "phone", kind.alias("contact_kind"), F.coalesce(c.email_domain(F.col("email")) == F.lower("domain"), F.lit(False)).alias("on_company_domain"),
        F.when(F.col("email").isNull(), "no_email").otherwise(F.col("deliverability")).alias("deliverability"), F.lit("procurement_notice").alias("source_type"), "source_url", evidence.alias("raw_evidence"),
    )


def decision_makers(lines: DataFrame) -> DataFrame:
    """People with a role, from ``page_id, number, line, previous_line, domain``: short lines that name a role, with a name before or after
    it or on the line above, or an address of the company."""
    rows = lines.filter((F.length("line") <= 240) & F.col("line").rlike(t.ROLE_PATTERN)).withColumn("role", c.extract_role(F.col("line")))
    before = F.regexp_extract("line", r"(?s)^(.*?)" + t.ROLE_PATTERN.replace("(?i)", "(?i:", 1) + ")", 1)
    after = F.regexp_replace("line", r"(?s)^.*?" + t.ROLE_PATTERN.replace("(?i)", "(?i:", 1) + ")", "")
    name = F.coalesce(c.person_name(before), F.when(before != "", c.person_name(after)), c.person_name(F.col("previous_line")))
    email = F.get(F.filter(c.extract_emails(F.col("line")), lambda e: c.keep_email(e, F.col("domain"))), 0)
    rows = rows.withColumns({"full_name": name, "email": email}).filter("full_name IS NOT NULL OR email IS NOT NULL")
    return rows.withColumns({"role_category": c.role_category(F.col("role")), "confidence": F.when(F.col("full_name").isNotNull(), 0.65).otherwise(0.55)})


def page_email_evidence(parsed: DataFrame, domain: str = "domain") -> DataFrame:
    """Addresses in page text that belong to the company and aren't generic."""
    rows = parsed.select("page_id", "url", domain, F.explode(c.extract_emails(F.col("text"))).alias("email"))
    return rows.filter(c.keep_email(F.col("email"), F.col(domain))).select("page_id", F.col("url").alias("source_url"), "email")


def contact_candidates(parsed: DataFrame, include_generic: bool = False, include_external: bool = False, approvable: tuple[str, ...] = t.APPROVABLE_INBOXES) -> DataFrame:
    """Candidates for review from parsed pages of a company (``domain``): addresses of mailto links, those in text, and lines with a role, a name and an address.

    Each has the first line that holds its address, or else the text around it, as excerpt; the role and name told there; the kind of address, a review hint
    and a confidence. An address is taken once per domain: links first, then text, then lines, by page and place.
    """
    clean = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    linked = F.transform(F.filter("links", lambda x: F.lower(x["href"]).startswith("mailto:")), lambda x: F.substring(x["href"], F.lit(8), F.length(x["href"])))
    linked = F.array_distinct(F.transform(linked, lambda x: F.lower(F.trim(F.get(F.split(F.coalesce(F.try_url_decode(x), x), "[?;]"), 0)))))
    linked = F.filter(linked, lambda e: F.size(c.extract_emails(e)) > 0)
    role_lines = F.filter("lines", lambda x: x.rlike("|".join(t.CANDIDATE_ROLES)) & x.contains("@"))
    item = lambda how, place, email, line: F.struct(F.lit(how).alias("place"), place.alias("index"), email.alias("email"), line.alias("line"))
    none = F.lit(None).cast("string")
    found = F.concat(F.transform(linked, lambda e, i: item(0, i, e, none)), F.transform(c.extract_emails(F.col("text")), lambda e, i: item(1, i, e, none)), F.transform(role_lines, lambda x, i: item(2, i, F.get(c.extract_emails(x), 0), x)))
    rows = parsed.select("page_id", "url", "domain", "lines", "text", F.explode(found).alias("f")).select("page_id", "url", "domain", "lines", "text", "f.*").filter("email IS NOT NULL")
    rows = rows.filter(c.keep_email(F.col("email"), F.col("domain"), t.GENERIC_INBOXES, include_generic=include_generic, include_external=include_external))
    line = F.coalesce("line", F.get(F.filter("lines", lambda x: F.contains(F.lower(x), F.col("email"))), 0))
    where = F.expr("locate(email, lower(text))")
    near = F.when(where > 0, clean(F.substring("text", F.greatest(F.lit(1), where - 180), F.least(where - 1, F.lit(180)) + 220)))
    rows = rows.withColumns({"_line": line, "_near": near})
    role = lambda x: F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), p, 1), F.lit("")) for p in t.CANDIDATE_ROLES))
    titled = lambda r: F.coalesce(c.lookup(F.lower(clean(r)), t.CANDIDATE_ROLE_NAMES), F.initcap(clean(r)))
    names = F.regexp_extract_all(F.replace(F.coalesce("_line", F.lit("")), F.col("email"), F.lit(" ")), F.lit(t.PERSON_PATTERN), F.lit(1))
    name = F.get(F.filter(names, lambda n: ~n.isin(*t.ROLE_NAMES)), 0)
    rows = rows.withColumns({"role": titled(F.coalesce(role(F.col("_line")), role(F.col("_near")))), "full_name": name})
    rows = rows.filter("place < 2 OR (full_name IS NOT NULL AND role IS NOT NULL)")
    generic = c.generic_local_part(F.substring_index("email", "@", 1), t.GENERIC_INBOXES, t.GENERIC_INBOX_PARTS)
    own = F.coalesce(c.email_domain(F.col("email")) == F.lower("domain"), F.lit(False))
    how = F.when(F.col("place") == 0, "mailto_link").when(F.col("place") == 1, "email_regex").otherwise("role_line_with_email")
    rows = rows.withColumns({"_generic": generic, "is_company_domain_email": own, "extraction": how, "has_name_evidence": F.col("full_name").isNotNull(), "has_role_evidence": F.col("role").isNotNull()})
    kind = F.when(~F.col("is_company_domain_email"), "external_email").when(F.col("_generic") == "", "direct_person").when(F.col("_generic").isin(*approvable), "generic_inbox").otherwise("low_value_generic_inbox")
    rows = first_per_key(rows.withColumns({"candidate_type": kind, "_order": F.struct("page_id", "place", "index")}), ["domain", "email"], "_order")
    hint = review_hint(F.col("candidate_type"), F.col("has_name_evidence"), F.col("has_role_evidence"), F.col("extraction"))
    return rows.withColumn("_h", hint).select(
        "page_id", F.col("url").alias("source_url"), "domain", "email", "full_name", "role", "extraction", F.substring(clean(F.coalesce("_line", "_near")), 1, 500).alias("source_excerpt"), "candidate_type", (F.col("_generic") != "").alias("is_generic_email"),
        "is_company_domain_email", "has_name_evidence", "has_role_evidence", F.col("_h.recommended_status").alias("recommended_status"), F.col("_h.hint").alias("review_hint"), candidate_confidence(F.col("full_name"), F.col("role"), F.col("email")).alias("confidence"),
    )


def page_facts(parsed: DataFrame, words: tuple[str, ...], most: int = 5) -> DataFrame:
    """Positioning (description, else first heading), the first lines with any of the words, and technologies named."""
    hit = F.slice(F.filter("lines", lambda x: c.has_any(F.lower(x), words)), 1, most)
    return parsed.select("page_id", "url", "title", F.coalesce(c.blank_to_null(F.col("meta")), c.blank_to_null(F.col("h1"))).alias("positioning"), hit.alias("snippets"), c.stack_terms(F.col("text")).alias("technologies"), F.size("links").alias("n_links"))


def research_summary(parsed: DataFrame, reason: str = "reason_to_write") -> DataFrame:
    """One line on each page: positioning, what its text and address show, and the trigger in ``reason``, where it has one."""
    text = F.lower("text")
    said = F.coalesce(c.blank_to_null(F.col("meta")), c.blank_to_null(F.col("h1")))
    bits = F.concat_ws(
        " ",
        said,
        F.when(c.has_any(text, ("api", "developer")), "Developer or API surface found."),
        F.when(c.has_any(text, ("automation", "workflow")), "Automation or workflow language found."),
        F.when(F.col("url").rlike("(?i)career|job"), "Careers content is visible."),
        F.concat(F.lit("Trigger: "), c.blank_to_null(F.col(reason))),
    )
    return parsed.select("page_id", "url", bits.alias("summary"))


def contact_routes(parsed: DataFrame) -> DataFrame:
    """``page_id, index, route_type, value, source_url``: contact and careers pages themselves, addresses of mailto links, and those in lines,
    in this order; repeats stay."""
    route = lambda kind, value: F.struct(F.lit(kind).alias("route_type"), value.alias("value"))
    page = F.when(F.col("url").rlike("(?i)contact|career|job"), F.array(route("page", F.col("url"))))
    mail = F.transform(F.filter("links", lambda x: F.lower(x["href"]).startswith("mailto:")), lambda x: F.substring(x["href"], F.lit(8), F.length(x["href"])))
    mail = F.transform(mail, lambda x: F.lower(F.trim(F.get(F.split(F.coalesce(F.try_url_decode(x), x), "[?;]"), 0))))
    mail = F.filter(mail, lambda x: F.size(c.extract_emails(x)) > 0)
    told = F.flatten(F.transform("lines", lambda x: c.extract_emails(x)))
    none = F.array().cast("array<struct<route_type:string,value:string>>")
    every = F.concat(F.coalesce(page, none), F.transform(mail, lambda x: route("mailto", x)), F.transform(told, lambda x: route("email_text", x)))
    return parsed.select("page_id", "url", F.posexplode(every).alias("index", "r")).select("page_id", "index", "r.route_type", "r.value", F.col("url").alias("source_url"))


def decision_maker_names(parsed: DataFrame) -> DataFrame:
    """``page_id, name``: each likely name in a line that names a role, with the line's first role, once per page."""
    lines = parsed.select("page_id", F.explode("lines").alias("line")).filter(F.col("line").rlike(t.ROLE_PATTERN))
    role = c.normalize_role(F.regexp_extract("line", t.ROLE_PATTERN, 1))
    rows = lines.select("page_id", role.alias("role"), F.explode(F.regexp_extract_all("line", F.lit(t.PERSON_PATTERN), F.lit(1))).alias("found"))
    rows = rows.withColumn("person", c.person_name(F.col("found"))).filter("person IS NOT NULL")
    return rows.select("page_id", F.concat("person", F.lit(" - "), "role").alias("name")).distinct()


def extract_jobs_from_html(parsed: DataFrame, most: int = 50) -> DataFrame:
    """Links whose text looks like a job title; where a page has none, such lines, at most ``most`` (the feature's limit)."""
    links = F.filter("links", lambda x: c.looks_like_job_title(x["text"]))
    linked = F.transform(links, lambda x: F.struct(x["text"].alias("title"), x["href"].alias("job_url")))
    lines = F.transform(F.slice(F.filter("lines", c.looks_like_job_title), 1, most), lambda x: F.struct(x.alias("title"), F.lit(None).cast("string").alias("job_url")))
    rows = parsed.select("page_id", "url", F.posexplode(F.when(F.size(links) > 0, linked).otherwise(lines)).alias("index", "j")).select("page_id", "url", "index", "j.*")
    return first_per_key(rows, ["page_id", "title", "job_url"], "index")


def verified_provider_rows(df: DataFrame, most: int) -> DataFrame:
    """Provider rows with a valid, verified address: once per address, at most so many per company."""
    from tallyhound.operators.latest import top_per_key

    rows = df.filter((F.lower("email_status") == "verified") & F.col("email").rlike(r"^[^@\s<>]+@[^@\s<>]+\.[^@\s<>]+$")).withColumn("email", F.lower("email"))
    return top_per_key(first_per_key(rows, ["email"], "index"), ["company_id"], most, F.col("index"))


def evidence_rows(df: DataFrame, source_type: Column | None = None) -> DataFrame:
    """Reviewed or provider rows (``company_id, email, full_name, role, evidence_urls, confidence, verification_status``, and ``source_type`` unless given) in the shape of
    contact evidence. A row that says no confidence, one that isn't a number from 0 to 1, or no status, gets those of its source type."""
    kind = F.col("source_type") if source_type is None else source_type
    said = F.col("confidence").try_cast("double")
    return df.select(
        "company_id", F.lower(F.trim("email")).alias("email"), c.blank_to_null(F.col("full_name")).alias("full_name"), c.blank_to_null(F.col("role")).alias("role"), c.first_url(F.col("evidence_urls")).alias("source_url"), kind.alias("source_type"),
        F.coalesce(F.when(said.between(0, 1), said), c.lookup(kind, t.EVIDENCE_CONFIDENCE)).alias("confidence"), F.coalesce(c.blank_to_null(F.col("verification_status")), c.lookup(kind, t.EVIDENCE_STATUS)).alias("verification_status"),
    )
