"""Signals derived from records, jobs, organisations and page links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.functions import terms as t
from tallyhound.operators.upsert import count_missing, insert_once

SPIKE_DAYS, SPIKE_JOBS = 30, 3
BOARD = ["company_id", "ats_provider", "ats_board_id"]


def insert_signal_once(new: DataFrame, old: DataFrame, index: str = "index") -> DataFrame:
    """Signals whose company, type, source and URL (missing: empty) aren't stored yet; of several the first."""
    return insert_once(new, old, [F.col("company_id"), F.col("signal_type"), F.coalesce("source", F.lit("")), F.coalesce("source_url", F.lit(""))], index)


def discovery_signals(records: DataFrame, as_of: Column) -> DataFrame:
    """Signals of discovery records with a known event type."""
    kind = c.lookup(F.trim(F.lower("event_type")), t.DISCOVERY_TYPES)
    told = F.coalesce(c.blank_to_null(F.col("event_summary")), c.blank_to_null(F.col("description")), F.concat("company_name", F.lit(" discovered from "), "source", F.lit(".")))
    out = records.withColumn("signal_type", kind).filter("signal_type IS NOT NULL")
    return out.select("index", "company_id", "signal_type", told.alias("description"), "source", "source_url", F.coalesce(F.col("event_date").cast("timestamp"), as_of).alias("detected_at"), c.lookup(F.col("signal_type"), t.DISCOVERY_CONFIDENCE, F.lit(0.6)).alias("confidence"))


def job_signals(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Stale-role, tech-stack and operations signals of ``jobs`` (``title, department, description_text, stack_terms, posted_at,
    first_seen_at`` and others) in one pass: each job carries an array of up to three, which is exploded."""
    names, title, department = jobs.columns, F.col("title"), F.col("department")
    # texts, then what they hold, as columns of their own: each is computed once, in generated code
    jobs = jobs.withColumns({
        "_text": c.joined_lower(title, department, F.col("description_text"), F.array_join("stack_terms", " ")),
        "_head": c.joined_lower(title, department),
        "_title": F.lower("title"),
    }).withColumns({
        "_stack": c.matched_terms(F.col("_text"), t.TECH_STACK_TERMS),
        "_needs": c.matched_terms(F.col("_text"), t.OPERATIONS_TERMS),
        "_able": ~c.has_any(F.col("_title"), t.NON_TECHNICAL_TITLES),
        "_role": c.has_any(F.col("_head"), t.ROLE_KEYWORDS),
        "_ops": c.has_any(F.col("_head"), t.OPERATIONS_TITLES),
        "_age": c.age_days(F.coalesce("posted_at", "first_seen_at"), as_of),
    })
    able, age, stack, needs = F.col("_able"), F.col("_age"), F.col("_stack"), F.col("_needs")
    relevant = able & F.col("_role")
    none = F.array().cast("array<string>")
    name = F.trim(title)

    def signal(kind, confidence, description, days=None, words=none):
        days = F.lit(None).cast("int") if days is None else days
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("signal_type"), F.lit(confidence).alias("confidence") if isinstance(confidence, float) else confidence.alias("confidence"), description.alias("description"), days.alias("age_days"), words.alias("matched_terms"))

    strong = age >= 90
    stale = signal(F.when(strong, "STALE_ENGINEERING_ROLE").otherwise("AGING_ENGINEERING_ROLE"), F.when(strong, 0.9).otherwise(0.75), F.concat(name, F.lit(" role appears open for "), age.cast("string"), F.lit(" days.")), age)
    first = lambda words: F.array_join(F.slice(words, 1, 5), ", ")
    tech = signal("TECH_STACK_NEED", 0.7, F.concat(name, F.lit(" mentions stack or integration needs: "), first(stack), F.lit(".")), words=stack)
    ops = signal("OPERATIONS_SOFTWARE_NEED", 0.75, F.concat(name, F.lit(" suggests internal tooling or operations software need: "), first(needs), F.lit(".")), words=needs)
    found = F.array_compact(F.array(
        F.when(relevant & (age >= 60), stale),
        F.when(relevant & (F.size(stack) > 0), tech),
        F.when(able & (F.size(needs) > 0) & F.col("_ops"), ops),
    ))
    return jobs.withColumn("_s", F.explode(found)).select(*names, "_s.*")


def hiring_spikes(jobs: DataFrame, observed: DataFrame, as_of: Column, days: int = SPIKE_DAYS, least: int = SPIKE_JOBS) -> DataFrame:
    """Boards with at least ``least`` active, relevant jobs of the batch first seen in the last ``days``. ``observed`` has the batch's
    ``company_id, ats_provider, ats_board_id, external_job_id``. Titles and URLs stand in the order of first sight and id."""
    scope = ["company_id", "ats_provider", "ats_board_id"]
    seen = observed.select(*(F.col(k).alias(f"_{k}") for k in [*scope, "external_job_id"])).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*scope, "external_job_id"]]
    rows = jobs.filter("is_active").join(seen, same, "left_semi").filter(c.is_relevant_role(F.col("title"), F.col("department")) & (c.age_days(F.col("first_seen_at"), as_of) <= days))
    items = F.array_sort(F.collect_list(F.struct("first_seen_at", "external_job_id", "title", "url")))
    out = rows.groupBy(*scope).agg(F.count("*").alias("job_count"), items.alias("_i")).filter(F.col("job_count") >= least)
    titles, urls = F.transform(F.slice("_i", 1, 5), lambda x: x["title"]), F.filter(F.transform("_i", lambda x: x["url"]), lambda u: F.coalesce(u, F.lit("")) != "")
    told = F.concat(F.col("job_count").cast("string"), F.lit(f" relevant roles appeared within {days} days: "), F.array_join(titles, ", "), F.lit("."))
    return out.select(*scope, "job_count", told.alias("description"), titles.alias("titles"), urls.alias("job_urls"), F.get(urls, 0).alias("source_url"), F.lit("HIRING_SPIKE").alias("signal_type"), F.lit(0.8).alias("confidence"))


def missing_observations(jobs: DataFrame, snapshot: DataFrame, as_of: Column, threshold: int = 2) -> DataFrame:
    """``jobs`` after a snapshot: active jobs of an observed board that it doesn't have are missing once more, and inactive from the
    threshold on. Other rows are unchanged. Both tables are shuffled once, by board; null keys equal each other."""
    each = [*BOARD, "external_job_id"]
    both = jobs.withColumn("_seen", F.lit(False)).unionByName(snapshot.select(*each, F.lit(True).alias("_seen")), allowMissingColumns=True)
    rows = both.withColumns({"_observed": F.max("_seen").over(Window.partitionBy(*BOARD)), "_present": F.max("_seen").over(Window.partitionBy(*each))}).filter(~F.col("_seen"))
    missing = F.coalesce(F.col("is_active") & F.col("_observed") & ~F.col("_present"), F.lit(False))
    return count_missing(rows, missing, as_of, threshold).select(*jobs.columns)


def board_signals(changes: DataFrame) -> DataFrame:
    """A signal for each board that :func:`~tallyhound.operators.upsert.classify_changes` finds new or changed."""
    told = F.concat(F.lit("Detected "), "ats_provider", F.lit(" board for "), "domain", F.lit("."))
    return changes.filter("status <> 'duplicate'").select("index", "company_id", F.lit("ATS_BOARD_DETECTED").alias("signal_type"), told.alias("description"), F.lit("signal_enrichment").alias("source"), F.col("board_url").alias("source_url"), "confidence")


def no_board_signals(misses: DataFrame, old: DataFrame) -> DataFrame:
    rows = misses.select("index", "company_id", F.lit("NO_ATS_BOARD_FOUND").alias("signal_type"), F.lit("signal_enrichment").alias("source"), F.col("careers_url").alias("source_url"))
    return insert_signal_once(rows, old)


def org_signals(orgs: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Organisations (``login, domain, public_repos, repos array<struct<pushed_at>>``; a null login was not found) with a footprint signal."""
    recent = F.size(F.filter(F.coalesce("repos", F.array().cast("array<struct<pushed_at:timestamp,language:string>>")), lambda r: r["pushed_at"] >= as_of - F.make_dt_interval(F.lit(days))))
    rows = orgs.withColumn("recent_active_repos", recent)
    engineering = (F.col("public_repos") >= 40) | ((F.col("public_repos") >= 15) & (F.col("recent_active_repos") >= 10))
    kind = F.when(F.col("login").isNull(), t.ORG_TYPES[2]).when(F.coalesce(engineering, F.lit(False)), t.ORG_TYPES[0]).otherwise(t.ORG_TYPES[1])
    return rows.withColumn("signal_type", kind).withColumn("confidence", c.lookup(F.col("signal_type"), dict(zip(t.ORG_TYPES, (0.9, 0.7, 0.6), strict=True))))


def board_detections(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boards among page links (``company_id, domain, page_url, href``) and pages, and the companies without any.

    The provider comes from the host, without ``www.``, and the token from the path (:func:`~tallyhound.functions.columns.board_token`).
    A page that is a board itself gives confidence 0.98, a link 0.92; of several of a company, provider and token the surest stays. Where a
    company has no such board, its first careers page by URL is a generic one with confidence 0.55, named by host and path.
    """
    own = links.select("company_id", "domain", "page_url", F.col("page_url").alias("href"))
    rows = links.select(*own.columns).unionByName(own).distinct()
    site = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://([^/?#:]+)", 1)), r"^www\.", "")
    segment = F.regexp_extract("href", r"(?i)^https?://[^/?#]+/+([^/?#]+)", 1)
    board_url = F.concat(F.lower(F.regexp_extract("href", r"(?i)^(https?)://", 1)), F.lit("://"), site("href"), F.lit("/"), segment)
    boards = rows.withColumns({"ats_provider": c.lookup(site("href"), t.BOARD_HOSTS), "board_token": c.board_token(F.col("href")), "board_url": board_url}).filter("ats_provider IS NOT NULL AND board_token IS NOT NULL")
    boards = boards.withColumn("confidence", F.when(F.col("page_url") == F.col("board_url"), 0.98).otherwise(0.92))
    order = Window.partitionBy("company_id", "domain", "ats_provider", "board_token").orderBy(F.col("confidence").desc(), "href", "page_url")
    boards = boards.withColumn("_n", F.row_number().over(order)).filter("_n = 1").withColumn("evidence_url", F.col("page_url"))
    columns = ["company_id", "domain", "ats_provider", "board_token", "board_url", "evidence_url", "confidence"]
    boards = boards.select(*columns)
    same = lambda a, b: a.alias("a").join(b.select("company_id", "domain").distinct().alias("b"), F.col("a.company_id").eqNullSafe(F.col("b.company_id")) & F.col("a.domain").eqNullSafe(F.col("b.domain")), "left_anti")
    pages = same(own.filter(F.lower("page_url").rlike("/career|/jobs")), boards).groupBy("company_id", "domain").agg(F.min("page_url").alias("board_url"))
    token = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract("board_url", r"^[A-Za-z]+://([^?#]+)", 1), r"^www\.", ""), "/$", ""))
    generic = pages.select("company_id", "domain", F.lit("generic").alias("ats_provider"), token.alias("board_token"), "board_url", F.col("board_url").alias("evidence_url"), F.lit(0.55).alias("confidence"))
    found = boards.unionByName(generic)
    return found, same(links.select("company_id", "domain").distinct(), found)
