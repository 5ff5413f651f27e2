"""Validation: good rows and rejects, issues per row, data-quality audits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.functions import terms as t


def split_by_reason(df: DataFrame, *checks: tuple[Column, str], index: str = "index") -> tuple[DataFrame, DataFrame]:
    """Rows without a failed check, and ``index, reason`` of the others with their first failed check."""
    reason = None
    for failed, name in checks:
        failed = F.coalesce(failed, F.lit(False))
        reason = F.when(failed, name) if reason is None else reason.when(failed, name)
    rows = df.withColumn("_reason", reason)
    return rows.filter("_reason IS NULL").drop("_reason"), rows.filter("_reason IS NOT NULL").select(index, F.col("_reason").alias("reason"))


def blank(name: str) -> Column:
    return c.blank_to_null(F.col(name).cast("string")).isNull()


def validate_discovery(df: DataFrame, batch_source: str) -> tuple[DataFrame, DataFrame]:
    return split_by_reason(df, (blank("source"), "missing_source"), (F.col("source") != batch_source, "source_mismatch"), (blank("source_url"), "missing_source_url"), (blank("source_record_id"), "missing_source_record_id"), (blank("company_name"), "missing_company_name"), (blank("website") & blank("domain"), "missing_website_or_domain"))


def reject_without_domain_or_name(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    domain = c.normalize_domain(F.coalesce(c.blank_to_null(F.col("domain")), F.col("website")))
    return split_by_reason(df, (domain.isNull(), "missing_domain"), (blank("company_name"), "missing_company_name"))


def _common(df: DataFrame) -> list[tuple[Column, str]]:
    return [(blank("company_id") & blank("domain"), "missing_company_reference"), (~F.coalesce(F.col("confidence"), F.lit(0.5)).between(0, 1), "confidence_out_of_range")]


PROVIDERS = ("greenhouse", "lever", "ashby", "workable", "generic")


def validate_boards(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_by_reason(df, *_common(df), (~F.col("ats_provider").isin(*PROVIDERS) | blank("ats_provider"), "unknown_provider"), (blank("board_token") & blank("board_url") & blank("careers_url"), "missing_board_reference"))


def validate_misses(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Searches for a board that found none: they need a company and a confidence within range only."""
    return split_by_reason(df, *_common(df))


def validate_jobs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_by_reason(df, (blank("company_id") & blank("domain"), "missing_company_reference"), (~F.col("ats_provider").isin(*PROVIDERS) | blank("ats_provider"), "unknown_provider"), (blank("external_job_id"), "missing_external_job_id"), (blank("title"), "missing_title"))


EMAIL_SHAPE = r"^[^@\s<>]+@[^@\s<>]+\.[^@\s<>]+$"
OUTCOME_EVENTS = ("sent", "delivered", "opened", "clicked", "replied", "positive_reply", "negative_reply", "meeting_booked", "bounced", "unsubscribed")


def validate_contact_evidence(df: DataFrame, sources: tuple[str, ...], statuses: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    trimmed = df.withColumns({f: c.blank_to_null(F.col(f)) for f in ("full_name", "role", "source_url") if f in df.columns})
    return split_by_reason(trimmed, (blank("email"), "missing_email"), (~F.col("email").rlike(EMAIL_SHAPE), "invalid_email"), (~F.col("source_type").isin(*sources), "unknown_source_type"), (~F.col("verification_status").isin(*statuses), "unknown_verification_status"))


def validate_outcomes(df: DataFrame, events: tuple[str, ...] = OUTCOME_EVENTS) -> tuple[DataFrame, DataFrame]:
    return split_by_reason(df, (~F.col("event").isin(*events) | blank("event"), "unknown_event"), (~F.col("email").rlike(EMAIL_SHAPE), "invalid_email"), (blank("email") & blank("contact_id") & blank("company_id"), "missing_target"))


CAMPAIGN_REQUIRED = ("company", "domain", "segment", "trigger_type", "trigger_summary", "trigger_url", "email", "email_source", "email_verification", "message_angle")


def campaign_issues(df: DataFrame, allowed: Mapping[str, tuple[str, ...]], generic: tuple[str, ...] = t.ROLE_LOCAL_PARTS) -> DataFrame:
    """``row_number, field, message`` of all issues; a row may have several. ``allowed`` has the values of the enumerated fields."""
    clean = lambda f: F.coalesce(F.trim(F.col(f)), F.lit(""))
    issue = lambda bad, field, message: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
    found = [issue(clean(f) == "", f, "is required") for f in CAMPAIGN_REQUIRED]
    found.append(issue((clean("target_person") == "") & (clean("target_role") == ""), "target_person", "target_person or target_role is required"))
    for field, values in allowed.items():
        found.append(issue((clean(field) != "") & ~F.lower(clean(field)).isin(*values), field, "must be one of: " + ", ".join(sorted(values))))
    df = df.withColumns({"_domain": c.normalize_domain(F.col("domain")), "_email": F.lower(clean("email"))})
    domain, email = F.col("_domain"), F.col("_email")
    shape = email.rlike(EMAIL_SHAPE)
    stale = F.lower(clean("trigger_type")) == "stale_hiring"
    age = clean("role_age_days").try_cast("int")
    found += [
        issue(domain.isNull(), "domain", "must be a company domain"),
        issue(~clean("trigger_url").rlike(r"^https?://[^/?#]+"), "trigger_url", "must be an absolute http(s) URL"),
        issue(~shape, "email", "must be a valid explicit email"),
        issue(shape & F.substring_index(email, "@", 1).isin(*generic), "email", "must be a person-level email"),
        issue(shape & (c.email_domain(email) != domain), "email", "email domain must match company domain"),
        issue(stale & (clean("role_age_days") == ""), "role_age_days", "is required"),
        issue(stale & (clean("role_age_days") != "") & age.isNull(), "role_age_days", "must be an integer"),
        issue(stale & (age < 60), "role_age_days", "must be at least 60"),
    ]
    return df.select("row_number", F.explode(F.array_compact(F.array(*found))).alias("i")).select("row_number", "i.field", "i.message")


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One issue row if the header lacks columns, else none; looks at the schema only."""
    gone = [x for x in required if x not in df.columns]
    rows = [(0, "header", "missing columns: " + ", ".join(gone))] if gone else []
    return df.sparkSession.createDataFrame(rows, "row_number int, field string, message string")


def validation_summary(rows: DataFrame, issues: DataFrame) -> DataFrame:
    failed = issues.agg(F.countDistinct("row_number").alias("failed_rows"), F.count("*").alias("issues"))
    out = rows.agg(F.count("*").alias("rows_seen")).crossJoin(failed)  # one row by one row
    return out.withColumn("send_ready", F.col("rows_seen") - F.col("failed_rows"))


def audit_constraints(df: DataFrame, unique: dict[str, list[str]], checks: dict[str, Column]) -> DataFrame:
    """``constraint, violations`` of unique keys (surplus rows) and checks (rows that fail; null passes)."""
    out = df.agg(*(F.count_if(~F.coalesce(v, F.lit(True))).alias(k) for k, v in checks.items())) if checks else None
    found = out.unpivot([], list(checks), "constraint", "violations") if checks else None
    for name, keys in unique.items():
        surplus = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(name).alias("constraint"), "violations")
        found = surplus if found is None else found.unionByName(surplus)
    return found


def triage_board_detections(df: DataFrame) -> DataFrame:
    """``bucket`` and ``reason``: misses, generic pages, invalid tokens, tokens that don't resemble the domain, the rest kept."""
    token = F.lower(F.coalesce("board_token", F.lit("")))
    slug = F.regexp_replace(token, "[^a-z0-9]", "")
    host = F.regexp_replace(F.substring_index(F.lower(F.coalesce("domain", F.lit(""))), ".", 1), "[^a-z0-9]", "")
    valid = (F.length(token) >= 2) & ~token.rlike(t.ASSET_PATTERN) & ~token.isin(*t.RESERVED_BOARD_TOKENS) & token.rlike(r"^[a-z0-9][a-z0-9._-]*$")
    alike = (slug != "") & (host != "") & (F.contains(host, slug) | F.contains(slug, host) | (F.substring(slug, 1, 5) == F.substring(host, 1, 5)))
    label = F.when(F.col("record_type") == "miss", "miss:no_board_found").when(F.col("ats_provider") == "generic", "keep:generic_careers_page").when(~valid, "quarantine:invalid_board_token").when(~alike, "quarantine:board_token_does_not_match_domain").otherwise("keep:token_matches_domain")
    return df.withColumn("_l", label).withColumns({"bucket": F.split_part("_l", F.lit(":"), F.lit(1)), "reason": F.split_part("_l", F.lit(":"), F.lit(2))}).drop("_l")


def classify_probe_domain(df: DataFrame, tlds: tuple[str, ...] | None = None) -> DataFrame:
    """``probe_domain`` (null if rejected) and ``reason`` for ``host``."""
    df = df.withColumn("_raw", F.regexp_replace(F.lower(F.trim("host")), r"^\.+|\.+$", ""))
    df = df.withColumn("_host", c.repair_host(F.col("_raw"), tlds))
    raw, host = F.col("_raw"), F.col("_host")
    root = c.root_domain(host)
    platform = host.rlike("(" + "|".join(p.replace(".", r"\.") for p in t.BOARD_PLATFORMS) + ")$")
    careers = host.rlike("^(" + "|".join(p.replace(".", r"\.") for p in t.CAREERS_PREFIXES) + ")")
    reason = (
        F.when(raw.isNull() | ~raw.contains("."), "not_a_hostname")
        .when(platform, "ats_platform_host")
        .when(host.isin(*t.NON_COMPANY_HOSTS) | root.isin(*t.NON_COMPANY_HOSTS), "non_company_host")
        .when(~c.valid_tld(host, tlds), "invalid_tld")
        .when(careers, "normalized_from_ats_subdomain")
        .when(host != raw, "repaired_glued_tld")
        .otherwise("ok")
    )
    out = df.withColumn("reason", reason)
    return out.withColumn("probe_domain", F.when(F.col("reason") == "normalized_from_ats_subdomain", root).when(F.col("reason").isin("ok", "repaired_glued_tld"), host)).drop("_raw", "_host")


def is_provider_target(domain: Column, blocked: tuple[str, ...] = t.FREE_MAIL_DOMAINS + t.NON_COMPANY_HOSTS) -> Column:
    suffix = F.substring_index(domain, ".", -1)
    return F.coalesce(~domain.isin(*blocked) & (F.length(F.regexp_replace(domain, r"[^.]", "")) <= 3) & suffix.rlike(r"^[A-Za-z]{2,12}$"), F.lit(False))


def clean_targets(df: DataFrame, min_score: int, offset: int, limit: int, exclude: DataFrame | None = None) -> DataFrame:
    """Targets (``position, company, domain, score``) with a clean domain that aren't excluded; the offset counts what is left."""
    rows = df.filter((F.col("score") >= min_score) & is_provider_target(F.lower("domain")) & ~blank("company"))
    if exclude is not None:
        rows = rows.join(exclude.select(F.lower("domain").alias("_x")).distinct(), F.lower("domain") == F.col("_x"), "left_anti")
    return rows.orderBy("position").offset(offset).limit(limit)


def importable(df: DataFrame, import_all: bool = False) -> DataFrame:
    """Reviewed contact candidates with an address and a page."""
    rows = df.filter((F.col("record_type") == "contact_candidate") & ~blank("email") & ~blank("source_url"))
    return rows if import_all else rows.filter(F.lower("review_status").isin("approve", "approved", "accept", "accepted", "yes"))


def contactable(df: DataFrame) -> DataFrame:
    return df.filter(~blank("company") & ~blank("domain") & ~blank("contact") & ~blank("email"))


def looks_non_technical(text: Column, veto: tuple[str, ...] = t.TECHNICAL_COMPANIES, sectors: tuple[str, ...] = t.NON_TECHNICAL_SECTORS) -> Column:
    low = F.lower(text)
    return ~c.has_any(low, veto) & c.has_any(low, sectors)


def validate_classification(df: DataFrame) -> DataFrame:
    """Model verdicts (``company_type, builds_software, confidence, engineering_signals, buyer_signals, page_text``) with quotes that the page
    doesn't have dropped; a builder verdict without evidence becomes unclear; confidence falls with every note."""
    eng, buy = c.attested(F.col("engineering_signals"), F.col("page_text")), c.attested(F.col("buyer_signals"), F.col("page_text"))
    dropped = lambda raw, kept: F.least(F.size(raw), F.lit(8)) - F.size(kept)
    rows = df.withColumns({"_e": eng, "_b": buy})
    down = F.col("company_type").isin("software_vendor", "agency") & (F.size("_e") == 0)
    notes = dropped(F.col("engineering_signals"), F.col("_e")) + dropped(F.col("buyer_signals"), F.col("_b")) + down.cast("int")
    from tallyhound.operators.scoring import classifier_confidence

    rows = rows.withColumns({"notes": notes, "_down": down})
    return rows.withColumns({
        "company_type": F.when(F.col("_down"), "unclear").otherwise(F.col("company_type")),
        "builds_software": F.when(F.col("_down"), "unknown").otherwise(F.col("builds_software")),
        "confidence": classifier_confidence(F.col("confidence"), F.col("notes")),
        "engineering_signals": F.col("_e"), "buyer_signals": F.col("_b"),
    }).drop("_e", "_b", "_down")


PROFILE_TEXTS = ("positioning", "business_model", "customer_type", "service_fit_evidence")
#: Longest texts, and lists cut to so many.
TEXT_CHARS, TECHNOLOGIES, ROUTES, PEOPLE = 600, 25, 10, 10


def validate_profile(df: DataFrame, index: str = "index") -> tuple[DataFrame, DataFrame]:
    """Model profiles (``index, domain, page_text, payload`` JSON) as records with ``notes`` and ``confidence``; and ``index, reason`` of those whose payload has
    another shape: not an object, a text field that isn't text or is too long, a person without a name of two letters.

    Lists are trimmed, each value once, and cut. Malformed addresses, those of other domains, and people whom the page doesn't name (where its text is known) are dropped with a
    note; confidence grows with what is told and falls with every note.
    """
    from tallyhound.operators.scoring import validated_confidence

    v = F.col("_v")
    raw = lambda n: F.try_variant_get(v, f"$.{n}", "variant")
    is_text = lambda n: F.coalesce(F.schema_of_variant(raw(n)).isin("STRING", "VOID"), F.lit(True))
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    listed = lambda n, most: F.slice(F.array_distinct(F.filter(F.transform(F.filter(F.coalesce(F.try_variant_get(v, f"$.{n}", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.substring(F.trim(F.try_variant_get(x, "$", "string")), 1, 120)), lambda x: x != "")), 1, most)
    items = F.slice(F.coalesce(F.try_variant_get(v, "$.decision_makers", "array<variant>"), F.array().cast("array<variant>")), 1, PEOPLE)
    people = F.transform(F.filter(items, lambda p: F.schema_of_variant(p).startswith("OBJECT")), lambda p: F.struct(F.try_variant_get(p, "$.name", "string").alias("name"), F.try_variant_get(p, "$.role", "string").alias("role")))
    rows = df.withColumn("_v", F.try_parse_json("payload"))
    rows = rows.withColumns({"_people": people, "_routes": listed("contact_routes", ROUTES), "technology_mentions": listed("technology_mentions", TECHNOLOGIES)})
    reason = F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not_an_object")
    for n in PROFILE_TEXTS:
        reason = reason.when(~is_text(n) | (F.length(text(n)) > TEXT_CHARS), f"{n} isn't a text of at most {TEXT_CHARS} characters")
    reason = reason.when(F.exists("_people", lambda p: ~F.coalesce(F.length(p["name"]).between(2, 120), F.lit(False)) | (F.length(p["role"]) > 160)), "a decision maker has no proper name or role")
    rows = rows.withColumn("_reason", reason)
    page = F.lower(F.coalesce("page_text", F.lit("")))
    low = F.transform("_routes", lambda e: F.lower(e))
    fine = lambda e: e.rlike(r"^[a-z0-9][a-z0-9._%+-]*@[a-z0-9.-]+\.[a-z]{2,}$")
    own = lambda e: F.coalesce(F.substring_index(e, "@", -1) == F.lower(F.col("domain")), F.lit(False))
    seen = lambda p: (page == "") | F.contains(page, F.lower(p["name"]))
    notes = F.concat(
        F.transform(F.filter(low, lambda e: ~fine(e)), lambda e: F.concat(F.lit("dropped malformed contact route: "), e)),
        F.transform(F.filter(low, lambda e: fine(e) & ~own(e)), lambda e: F.concat(F.lit("dropped off-domain contact route: "), e)),
        F.transform(F.filter("_people", lambda p: ~seen(p)), lambda p: F.concat(F.lit("dropped unattested decision maker: "), p["name"])),
    )
    good = rows.filter("_reason IS NULL").withColumns({"contact_routes": F.filter(low, lambda e: fine(e) & own(e)), "decision_makers": F.filter("_people", seen), "notes": notes, **{n: c.blank_to_null(text(n)) for n in PROFILE_TEXTS}})
    told = sum((F.col(n).isNotNull().cast("int") for n in PROFILE_TEXTS[1:]), F.col(PROFILE_TEXTS[0]).isNotNull().cast("int"))
    good = good.withColumn("confidence", validated_confidence(told, F.size("contact_routes"), F.size("notes")))
    return good.select(index, "domain", *PROFILE_TEXTS, "technology_mentions", "contact_routes", "decision_makers", "notes", "confidence"), rows.filter("_reason IS NOT NULL").select(index, F.col("_reason").alias("reason"))


def attested_quotes(quotes: DataFrame, docs: DataFrame, words: int = 4) -> DataFrame:
    """``item_id, doc_id`` of every document (``doc_id, text``) that holds the whole text of a quote (``item_id, text``), white space and
    case aside.

    A run of at most ``words`` words inside the quote, which stand whole in any text that holds it, is looked up among the hashed runs of that length of all
    documents; quotes of one or two words have no such run and are looked up by their first characters among those of documents. What meets is
    confirmed on whole texts. Blank quotes and null texts have no rows.
    """
    plain = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    told = quotes.select("item_id", plain.alias("_q")).filter("_q <> ''").withColumn("_w", F.split("_q", " "))
    held = docs.select("doc_id", plain.alias("_t")).filter("_t IS NOT NULL")
    inner = F.least(F.size("_w") - 2, F.lit(words))
    by_run = told.filter(F.size("_w") > 2).select("item_id", "_q", inner.alias("_n"), F.xxhash64(inner, F.slice("_w", F.lit(2), inner)).alias("_run"))
    start = F.least(F.length("_q"), F.lit(4))
    by_start = told.filter(F.size("_w") <= 2).select("item_id", "_q", start.alias("_n"), F.xxhash64(start, F.substring("_q", F.lit(1), start)).alias("_run"))
    lengths = lambda probes: [r[0] for r in probes.select("_n").distinct().collect()]  # noqa: E731 at most ``words``, or four
    split = held.select("doc_id", F.split("_t", " ").alias("_w"), "_t")
    runs = [_grams("_w", n) for n in lengths(by_run)] + [_starts("_t", n) for n in lengths(by_start)]
    if not runs:
        return held.join(told.select("item_id"), F.lit(False)).select("item_id", "doc_id")
    probes = by_run.unionByName(by_start).select("item_id", "_q", "_run")
    met = split.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("_run")).join(probes.select("item_id", "_run"), "_run").select("doc_id", "item_id").distinct()
    pairs = met.join(probes.select("item_id", "_q").distinct(), "item_id").select(F.col("doc_id").alias("_d"), "item_id", "_q")
    return held.join(pairs, F.col("doc_id").eqNullSafe(F.col("_d"))).filter(F.contains("_t", "_q")).select("item_id", "doc_id").distinct()


def _grams(words: str, n: int) -> Column:
    """Hashes of all runs of ``n`` words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.lit(n), F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def _starts(text: str, n: int) -> Column:
    """Hashes of all runs of ``n`` characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.xxhash64(F.lit(n), F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))
