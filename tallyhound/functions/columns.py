"""Scalar functions as Column expressions; all stay in generated code."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhound.functions import terms as t


def lits(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs in the text."""
    return reduce(lambda a, b: a | b, (F.coalesce(text.contains(w), F.lit(False)) for w in words))


def matched_terms(text: Column, words: Iterable[str]) -> Column:
    """The words that occur in the text, in list order."""
    found = F.concat_ws("\n", *(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words))  # all in generated code
    return F.array_remove(F.split(found, "\n"), "")


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Texts whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(r) if isinstance(r, str) else r) for c, r in pairs)))


def lookup(key: Column, table: Mapping, default: Column | None = None) -> Column:
    """A small fixed mapping as an expression."""
    found = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return found if default is None else F.coalesce(found, default)


# --- names, places, domains -------------------------------------------------------------------------------------------------------


def display_name(name: Column) -> Column:
    """White space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(name, r"\s+", " ")), F.lit(""))


def match_name(name: Column) -> Column:
    """A name without legal suffixes and anything but a-z and 0-9."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(display_name(name), t.COMPANY_SUFFIX, "")), r"[^a-z0-9]+", ""), F.lit(""))


def valid_tld(host: Column, tlds: Iterable[str] | None = None) -> Column:
    """Whether the last label is in ``tlds``; without a list, whether it has the form of one."""
    last = F.substring_index(host, ".", -1)
    return last.isin(list(tlds)) if tlds is not None else last.rlike(r"^([a-z]{2,24}|xn--[a-z0-9-]+)$")


def repair_host(host: Column, tlds: Iterable[str] | None = None) -> Column:
    """A host whose suffix has another word glued on loses that word; valid suffixes stay."""

    def repaired(h: Column) -> Column:
        cut = F.regexp_extract(h, r"^(.+\.(?:com|org|net|io|ai|dev|co))[a-z]{2,10}$", 1)
        return F.when(valid_tld(h, tlds), h).otherwise(F.coalesce(F.nullif(cut, F.lit("")), h))

    return let(host, repaired)


def normalize_domain(value: Column, tlds: Iterable[str] | None = None) -> Column:
    """The host of a URL or bare domain in lower case, without ``www.``; null if it is none or its suffix is not valid."""
    url = let(blank_to_null(value), lambda v: F.when(v.contains("://"), v).otherwise(F.concat(F.lit("https://"), v)))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^\.+|\.+$", ""), r"^www\.", "")
    return let(repair_host(host, tlds), lambda h: F.when(h.contains(".") & valid_tld(h, tlds), h))


def root_domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def base_url(url: Column) -> Column:
    """Scheme and host."""
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit(""))


def first_url(urls: Column, pages: Column | None = None) -> Column:
    """The first absolute URL of a list separated by ``;`` or ``,``; else the first page's."""
    parts = F.filter(F.transform(F.split(urls, "[;,]"), lambda u: F.trim(u)), lambda u: u.rlike(r"^https?://"))
    found = F.get(parts, 0)
    return found if pages is None else F.coalesce(found, F.get(pages, 0))


def absolute_url(base: Column, ref: Column) -> Column:
    """``ref`` as an absolute URL, read from a page at ``base``; null without either, or where ``base`` is no URL and is needed."""
    origin, scheme = F.nullif(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit("")), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    own = F.regexp_replace(ref, r"[?#].*$", "")
    joined = F.when(own == "", F.when(path == "", "/").otherwise(path)).when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), F.when(path == "", "/").otherwise(""), own))
    kept = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s))))
    end = F.when(joined.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, ref)).otherwise(F.concat(origin, F.array_join(kept, "/"), end, tail))


def unescape_html(text: Column) -> Column:
    """The five entities that every serialiser writes, as characters."""
    for name, sign in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def country_name(value: Column) -> Column:
    trimmed = F.trim(value)
    return lookup(F.lower(trimmed), t.COUNTRY_ALIASES, trimmed)


def split_location(value: Column) -> Column:
    """``struct<raw, city, country>``: of the part before ``;`` the first and, if there are several, the last comma part."""
    raw = display_name(value)
    parts = F.filter(F.transform(F.split(F.substring_index(raw, ";", 1), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.struct(raw.alias("raw"), F.get(parts, 0).alias("city"), F.when(F.size(parts) > 1, country_name(F.element_at(parts, -1))).alias("country"))


def title_from_key(key: Column) -> Column:
    return F.initcap(F.translate(key, "_-", "  "))


def employee_count(text: Column) -> Column:
    """Lower bound of a band such as ``51-200 employees``; null unless positive."""
    n = F.regexp_replace(F.split_part(text, F.lit("-"), F.lit(1)), r"\D", "").try_cast("int")
    return F.when(n > 0, n)


# --- time and numbers -------------------------------------------------------------------------------------------------------------


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days elapsed, never negative."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor((us(as_of) - us(ts)) / 86_400_000_000)).cast("int")


def parse_ts(text: Column) -> Column:
    """ISO text as a timestamp, read as UTC where it names no zone (with the session in UTC); null if it is none."""
    return text.try_cast("timestamp")


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def half_even(c: Column) -> Column:
    """Rounded to an integer, ties to even."""
    return F.bround(c.cast("decimal(18,6)"), 0).cast("int")


def percent(part: Column, whole: Column) -> Column:
    """``12.3%`` of safe division."""
    return F.format_string("%.1f%%", 100 * rate(part, whole))


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, F.when(whole > 0, whole)), F.lit(0.0))


# --- e-mail, phone, URL -----------------------------------------------------------------------------------------------------------


def extract_emails(text: Column) -> Column:
    """Addresses in a text: sorted, distinct, lower case, without trailing punctuation, double dots and image names."""
    raw = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    found = F.transform(raw, lambda e: F.regexp_replace(F.lower(e), r"[.,;:)]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(found, lambda e: ~e.contains("..") & ~e.rlike(r"\.(png|jpg|jpeg|gif|svg|webp)$"))))


def local_part(email: Column) -> Column:
    """What stands before the sign, without a plus address."""
    return F.substring_index(F.substring_index(F.lower(email), "@", 1), "+", 1)


def email_domain(email: Column) -> Column:
    return F.when(email.contains("@"), F.lower(F.regexp_extract(email, r"^[^@]*@(.*)$", 1)))


def classify_local_part(email: Column) -> Column:
    local = local_part(email)
    return F.when(local.isin(*t.ROLE_LOCAL_PARTS), "role_inbox").when(local.rlike(r"^[a-z]{2,}([._-][a-z]{2,})?$"), "person").otherwise("generic")


def deliverability(email: Column, mx_count: Column, mx_error: Column) -> Column:
    """Label of an address given what is known of its domain's mail servers (a count, or an error)."""
    e = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    domain = email_domain(e)
    return (
        F.when(~e.rlike(r"^[a-z0-9][a-z0-9._%+-]*@[a-z0-9.-]+\.[a-z]{2,}$"), "invalid_syntax")
        .when(domain.isin(*t.DISPOSABLE_DOMAINS), "disposable_domain")
        .when(domain.isin(*t.FREE_MAIL_DOMAINS), "free_mail_domain")
        .when(mx_error.isNotNull(), "dns_error")
        .when(F.coalesce(mx_count, F.lit(0)) == 0, "no_mx_record")
        .when(local_part(e).isin(*t.ROLE_LOCAL_PARTS), "role_address")
        .otherwise("deliverable_domain")
    )


def published_email(email: Column, blocked: Iterable[str] = (), tlds: Iterable[str] | None = None) -> Column:
    """A published address in normal form, or null: one sign, a valid suffix, no blocked host, a local part besides the plus address."""
    blocked = list(blocked)

    def checked(e: Column) -> Column:
        local = F.substring_index(e, "@", 1)
        fine = (F.length(F.regexp_replace(e, "[^@]", "")) == 1) & local.rlike(r"^[a-z0-9][a-z0-9._%+-]*$")
        return let(repair_host(email_domain(e), tlds), lambda h: F.when(fine & valid_tld(h, tlds) & ~(h.isin(blocked) if blocked else F.lit(False)), F.concat(local, F.lit("@"), h)))

    return let(F.regexp_replace(F.lower(F.trim(email)), r"[.,;:)]+$", ""), checked)


def generic_local_part(local: Column, names: Iterable[str], substrings: Iterable[str]) -> Column:
    """The generic inbox that a local part stands for: itself, itself without digits, or by a part of it; else empty."""
    names, out = list(names), None
    bare = F.regexp_replace(local, "[0-9]+$", "")
    out = F.when(local.isin(names), local).when(bare.isin(names), bare)
    for s in substrings:
        out = out.when(local.contains(s), {"career": "careers", "employ": "employment", "recruit": "recruiting"}.get(s, s))
    return out.otherwise("")


def keep_email(email: Column, company_domain: Column, generic: Iterable[str] = t.ROLE_LOCAL_PARTS, include_generic: bool = False, include_external: bool = False) -> Column:
    """Whether an address is of the company and personal: no generic inbox, alone or glued to other words, and not named like the domain."""
    own = F.lit(True) if include_external else email_domain(email) == F.lower(company_domain)
    local, names = F.substring_index(F.lower(email), "@", 1), list(generic)
    glued = (F.length(local) >= 14) & has_any(local, names)  # a generic word within a long one
    named = F.lit(True) if include_generic else ~local.isin(names) & (local != F.substring_index(F.lower(company_domain), ".", 1)) & ~glued
    return F.coalesce(own & named & (local != "") & ~email.contains("%"), F.lit(False))


def normalize_phone(value: Column) -> Column:
    """A phone number without ``tel:`` and outer punctuation; null unless it has 8 to 16 digits."""
    phone = F.regexp_replace(F.trim(value), r"(?i)^tel:", "")
    phone = F.regexp_replace(F.regexp_replace(phone, r"\s+", " "), r"^[ .,:;()]+|[ .,:;()]+$", "")
    return F.when(F.length(F.regexp_replace(phone, r"\D", "")).between(8, 16), phone)


def extract_phones(text: Column) -> Column:
    raw = F.regexp_extract_all(text, F.lit(r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(raw, normalize_phone), lambda p: p.isNotNull()))


def presence_kind(url: Column) -> Column:
    """The first kind of web presence whose pattern is in the URL; null if none."""
    out = None
    for kind, pattern in t.PRESENCE_PATTERNS:
        out = F.when(url.rlike(pattern), kind) if out is None else out.when(url.rlike(pattern), kind)
    return out


def board_key(token: Column, board_url: Column, careers_url: Column) -> Column:
    first = F.coalesce(blank_to_null(token), blank_to_null(board_url), blank_to_null(careers_url))
    return F.lower(F.regexp_replace(first, "/+$", ""))


# --- jobs -------------------------------------------------------------------------------------------------------------------------


def joined_lower(*parts: Column) -> Column:
    """Non-empty parts with blanks between, in lower case."""
    return F.lower(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))  # all in generated code


def is_relevant_role(title: Column, department: Column) -> Column:
    return has_any(joined_lower(title, department), t.ROLE_KEYWORDS)


def is_non_technical_title(title: Column) -> Column:
    return has_any(F.lower(title), t.NON_TECHNICAL_TITLES)


def looks_like_job_title(text: Column) -> Column:
    title = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = r"(?i)\b(engineer|developer|designer|product|data|platform|backend|frontend|full[- ]?stack|devops|qa|manager|analyst|architect|operations|automation)\b"
    return F.length(title).between(4, 120) & title.rlike(words)


def infer_department(text: Column) -> Column:
    x = F.lower(text)
    return (
        F.when(x.rlike(r"\b(engineering|developer|software|backend|frontend|platform|devops|qa|sre)\b"), "Engineering")
        .when(x.rlike(r"\b(product manager|product designer|product)\b"), "Product")
        .when(x.rlike(r"\b(data|analytics|machine learning|ai)\b"), "Data")
        .when(x.rlike(r"\b(operations|automation|ops)\b"), "Operations")
    )


def infer_location(text: Column) -> Column:
    places = r"(?i)\b(remote|hybrid|onsite|on-site|new york|london|san francisco|berlin|paris|amsterdam|antwerp|ontario|canada|united states|usa|us)\b"
    return F.nullif(F.regexp_extract(text, places, 1), F.lit(""))


def infer_remote_policy(text: Column) -> Column:
    x = F.lower(text)
    return F.when(x.contains("remote"), "remote").when(x.contains("hybrid"), "hybrid").when(x.contains("onsite") | x.contains("on-site"), "onsite")


def infer_employment_type(text: Column) -> Column:
    x = F.lower(text)
    return (
        F.when(x.contains("part-time") | x.contains("part time"), "part_time")
        .when(x.contains("contract"), "contract")
        .when(x.rlike(r"\bintern(ship)?\b"), "internship")
        .when(x.contains("full-time") | x.contains("full time"), "full_time")
    )


def infer_seniority(text: Column) -> Column:
    x = F.lower(text)
    return F.when(x.rlike(r"\b(staff|principal|lead)\b"), "staff").when(x.rlike(r"\b(senior|sr\.?)\b"), "senior").when(x.rlike(r"\b(junior|jr\.?|entry)\b"), "junior")


def stack_terms(text: Column, words: Iterable[str] = t.TECH_STACK_TERMS) -> Column:
    return matched_terms(F.lower(text), sorted(words))  # sorting an array would take it, and all below it, out of generated code


# --- people -----------------------------------------------------------------------------------------------------------------------


def normalize_role(role: Column) -> Column:
    r = F.trim(F.regexp_replace(role, r"\s+", " "))
    short = F.upper(r).isin("CEO", "COO", "CMO", "CRO", "CBO", "CTO", "VP")
    return F.when(short, F.upper(r)).otherwise(F.regexp_replace(F.regexp_replace(F.initcap(r), "Ceo", "CEO"), "Cto", "CTO"))


def extract_role(line: Column) -> Column:
    """The last role named in a line, in title case."""
    return normalize_role(F.try_element_at(F.regexp_extract_all(line, F.lit(t.ROLE_PATTERN), F.lit(1)), F.lit(-1)))


def role_category(role: Column) -> Column:
    r = F.lower(role)
    out = F.when(r.contains("founder"), "founder").when(r.isin("ceo", "coo", "cmo", "cro", "cbo") | r.contains("chief"), "executive")
    for word, label in (("business", "business"), ("growth", "growth"), ("partnership", "partnerships"), ("product", "product"), ("marketing", "marketing"), ("sales", "sales"), ("revenue", "sales"), ("operation", "operations")):
        out = out.when(r.contains(word), label)
    return out.when(r == "cto", "technical").otherwise("other")


def person_name(text: Column, organisations: Iterable[str] = (), blocked: Iterable[str] = ()) -> Column:
    """The last two to four capitalised words in a row that don't look like a role or an organisation; null if there are none."""
    name = F.try_element_at(F.regexp_extract_all(text, F.lit(t.PERSON_PATTERN), F.lit(1)), F.lit(-1))
    lower, words = F.lower(name), F.split(name, r"\s+")
    role = lower.rlike(r"^(chief |head of |vp |vice president|director of )")
    org = F.arrays_overlap(words, lits(organisations)) if (organisations := list(organisations)) else F.lit(False)
    barred = name.isin(blocked) if (blocked := list(blocked)) else F.lit(False)
    return F.when(F.size(words).between(2, 4) & ~role & ~org & ~barred, name)


def target_roles(signal_types: Column) -> Column:
    """Roles to look for, from the signal types of a company: sorted and distinct."""
    has = lambda *x: F.arrays_overlap(signal_types, lits(x))
    none = F.array().cast("array<string>")
    pick = lambda c, *x: F.when(c, lits(x)).otherwise(none)
    first = F.concat(
        pick(has("STALE_ENGINEERING_ROLE", "AGING_ENGINEERING_ROLE"), "CTO", "VP Engineering", "Head of Product", "Founder"),
        pick(has("HIRING_SPIKE"), "CTO", "VP Engineering", "COO", "Founder"),
        pick(has("OPERATIONS_SOFTWARE_NEED"), "COO", "Head of Operations", "Head of Digital", "Founder"),
    )
    discovery = pick(has("HIRING_DISCOVERY") & (F.size(first) == 0), "CTO", "VP Engineering", "Head of Talent", "Founder")
    return F.array_sort(F.array_distinct(F.concat(first, discovery, pick(has("FUNDING_EVENT"), "Founder"))))


# --- evidence ---------------------------------------------------------------------------------------------------------------------


def attested(quotes: Column, page_text: Column, most: int = 8, longest: int = 200, least: int = 12) -> Column:
    """Of the first quotes those, cut to ``longest``, that are long enough and stand in the page, white space and case aside."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    cut = F.transform(F.slice(quotes, 1, most), lambda q: F.substring(F.trim(q), 1, longest))
    return let(plain(page_text), lambda page: F.filter(cut, lambda q: (F.length(q) >= least) & F.contains(page, plain(q))))


def ordered_urls(evidence: Column) -> Column:
    """Distinct URLs of ``array<struct<job_urls, source_url>>`` in the order in which they are first seen."""
    each = F.transform(evidence, lambda e: F.concat(F.coalesce(e["job_urls"], F.array().cast("array<string>")), F.array(e["source_url"])))
    return F.array_distinct(F.filter(F.flatten(each), lambda u: u.isNotNull() & (u != "")))


def reason_to_write(evidence: Column, positive: Column) -> Column:
    """The first description that isn't blank; else the first reason; else empty."""
    told = F.filter(F.transform(evidence, lambda e: F.trim(e["description"])), lambda d: d.isNotNull() & (d != ""))
    return F.coalesce(F.get(told, 0), F.get(positive, 0), F.lit(""))


def as_list(value: Column) -> Column:
    """A JSON list, or plain text as a list of one; null as empty."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(value, "array<string>"), F.array(value)))


def load_json(raw: Column, default: str = "{}") -> Column:
    """Text as a variant; ``default`` where it is null or no JSON."""
    return F.coalesce(F.try_parse_json(raw), F.parse_json(F.lit(default)))


def build_object(**fields: Column) -> Column:
    """A JSON object of named values; nulls stay."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def content_hash(raw: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys; null for text that isn't JSON."""
    return F.sha2(F.to_json(F.try_parse_json(raw)), 256)


def surrogate_id(*key: Column) -> Column:
    """A deterministic key, so that retries and later runs agree."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(k.cast("string"), F.lit("")) for k in key)), 256)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def trim_sentence(text: Column, longest: int) -> Column:
    """The first ``longest`` characters, cut back to a word, without a final full stop."""
    x = F.trim(F.regexp_replace(text, r"\s+", " "))
    short = F.when(F.length(x) <= longest, x).otherwise(F.regexp_replace(F.substring(x, 1, longest), r"\s+\S*$", ""))
    return F.regexp_replace(short, r"[.\s]+$", "")


def trim_to_words(text: Column, most: int) -> Column:
    """The first sentence if it has 5 to ``most`` words, else the first ``most`` words without a dangling small word; no final full stop."""
    whole = F.trim(text)
    first = F.regexp_extract(whole, r"^(.+?[.!?])(?:\s|$)", 1)
    words = F.split(whole, r"\s+")
    dangling = rf"(?i)((^|\s+)({'|'.join(t.NO_LAST_WORDS)})[.,;:]*)+$"
    cut = F.regexp_replace(F.regexp_replace(F.array_join(F.slice(words, 1, most), " "), dangling, ""), r"[.,;:]+$", "")
    return F.when(word_count(first).between(5, most) | (F.size(words) <= most), F.regexp_replace(F.when(word_count(first).between(5, most), first).otherwise(whole), r"\.+$", "")).otherwise(cut)


def board_token(url: Column) -> Column:
    """The first path segment of a board's URL, decoded, in lower case; null where it can't be a board's name."""
    raw = F.regexp_extract(url, r"^https?://[^/?#]+/+([^/?#]+)", 1)
    token = F.lower(F.coalesce(F.try_url_decode(raw), raw))
    return F.when(token.rlike(r"^[a-z0-9][a-z0-9._-]+$") & ~token.rlike(t.ASSET_PATTERN) & ~token.isin(*t.RESERVED_BOARD_TOKENS), token)
