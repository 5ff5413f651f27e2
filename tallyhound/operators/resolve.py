"""Joins that resolve references, and anti and semi joins that gate work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.operators.latest import latest
from tallyhound.operators.upsert import meet


def with_company(df: DataFrame, companies: DataFrame) -> DataFrame:
    """All rows (``index, company_id, domain``) with ``resolved_id``, by id, else by domain, else null. A domain is worked out once a row; neither rows without an id
    meet in one task, nor those that have no domain or need none, as their id is known."""
    ids = companies.select(F.col("id").alias("_id"))
    domains = companies.filter("canonical_domain IS NOT NULL").groupBy(F.lower("canonical_domain").alias("_domain")).agg(F.min("id").alias("_by_domain"))
    salt = F.xxhash64("index")
    apart = lambda key: F.struct(F.when(key.isNull(), salt).otherwise(0).alias("n"), key.alias("k"))
    whole = lambda key: F.struct(F.lit(0).cast("long").alias("n"), key.alias("k"))
    rows = df.withColumn("_named", F.when(F.col("domain").isNotNull(), c.normalize_domain(F.col("domain")))).join(ids, apart(F.col("company_id")) == whole(F.col("_id")), "left")
    rows = rows.withColumn("_named", F.when(F.col("_id").isNull(), F.col("_named")))
    # the second condition says no more, but lets Spark leave the join out for a batch without domains
    rows = rows.join(domains, (apart(F.col("_named")) == whole(F.col("_domain"))) & (F.col("_named") == F.col("_domain")), "left")
    return rows.withColumn("resolved_id", F.coalesce("_id", "_by_domain")).drop("_id", "_named", "_domain", "_by_domain")


def resolve_company(df: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of :func:`with_company` that have a company; and the rejects ``index, reason``."""
    rows = with_company(df, companies)
    return rows.filter("resolved_id IS NOT NULL"), rows.filter("resolved_id IS NULL").select("index", F.lit("company_not_found").alias("reason"))


def resolve_board(df: DataFrame, boards: DataFrame) -> DataFrame:
    """Rows with ``ats_board_id``: of several boards of a company, provider and key the least id. Null keys equal each other."""
    keys = ["company_id", "ats_provider", "board_key"]
    return meet(df, boards.groupBy(*keys).agg(F.min("id").alias("ats_board_id")), keys, "left")


def resolve_founder(df: DataFrame, founders: DataFrame, links: DataFrame) -> DataFrame:
    """``founder_id`` and ``matched_by``: by id, else by name within the company, else by name alone, else null (to be created)."""
    rows = df.withColumn("_name", F.lower(c.display_name(F.col("full_name"))))
    named = founders.select(F.col("id").alias("_f"), F.lower("full_name").alias("_fn"))
    own = links.join(named, F.col("founder_id") == F.col("_f")).groupBy(F.col("company_id").alias("_c"), F.col("_fn").alias("_cn")).agg(F.min("_f").alias("_own"))
    any_ = named.groupBy("_fn").agg(F.min("_f").alias("_any"))
    ids = founders.select(F.col("id").alias("_given"))
    rows = rows.withColumnRenamed("founder_id", "_wanted").join(ids, F.col("_wanted") == F.col("_given"), "left").join(own, (F.col("company_id") == F.col("_c")) & (F.col("_name") == F.col("_cn")), "left").join(any_, F.col("_name") == F.col("_fn"), "left")
    by = F.when(F.col("_given").isNotNull(), "id").when(F.col("_own").isNotNull(), "company_name").when(F.col("_any").isNotNull(), "name")
    return rows.withColumns({"founder_id": F.coalesce("_given", "_own", "_any"), "matched_by": by}).drop("_name", "_wanted", "_given", "_c", "_cn", "_own", "_fn", "_any")


def resolve_contact(df: DataFrame, contacts: DataFrame) -> DataFrame:
    """``contact_id``: with a founder by company, founder and address, else by company, address and name."""
    own = contacts.filter("founder_id IS NOT NULL").groupBy(F.col("company_id").alias("_c1"), F.col("founder_id").alias("_f1"), F.lower("email").alias("_e1")).agg(F.min("id").alias("_by_founder"))
    other = contacts.groupBy(F.col("company_id").alias("_c2"), F.lower("email").alias("_e2"), F.lower(F.coalesce("full_name", F.lit(""))).alias("_n2")).agg(F.min("id").alias("_by_name"))
    rows = df.join(own, (F.col("company_id") == F.col("_c1")) & (F.col("founder_id") == F.col("_f1")) & (F.lower("email") == F.col("_e1")), "left")
    rows = rows.join(other, (F.col("company_id") == F.col("_c2")) & (F.lower("email") == F.col("_e2")) & (F.lower(F.coalesce("full_name", F.lit(""))) == F.col("_n2")), "left")
    found = F.when(F.col("founder_id").isNotNull(), F.col("_by_founder")).otherwise(F.col("_by_name"))
    return rows.withColumn("contact_id", found).drop("_c1", "_f1", "_e1", "_by_founder", "_c2", "_e2", "_n2", "_by_name")


def resolve_outcome_target(df: DataFrame, contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """Outcome rows with ``target_contact`` and ``target_company``: by contact id; else by company id (and its contact with the address);
    else by the newest contact with the address. A company id that is unknown resolves to nothing."""
    by_id = contacts.select(F.col("id").alias("_k"), F.col("company_id").alias("_kc"))
    own = latest(contacts.withColumn("_e", F.lower("email")), ["company_id", "_e"], F.col("created_at").desc(), F.col("id").desc()).select(F.col("company_id").alias("_oc"), F.col("_e").alias("_oe"), F.col("id").alias("_ok"))
    newest = latest(contacts.withColumn("_e", F.lower("email")), ["_e"], F.col("created_at").desc(), F.col("id").desc()).select(F.col("_e").alias("_ne"), F.col("id").alias("_nk"), F.col("company_id").alias("_nc"))
    known = companies.select(F.col("id").alias("_company"))
    rows = df.join(by_id, F.col("contact_id") == F.col("_k"), "left").join(known, F.col("company_id") == F.col("_company"), "left")
    rows = rows.join(own, (F.col("company_id") == F.col("_oc")) & (F.lower("email") == F.col("_oe")), "left").join(newest, F.lower("email") == F.col("_ne"), "left")
    contact = F.when(F.col("_k").isNotNull(), F.col("_k")).when(F.col("company_id").isNotNull(), F.when(F.col("_company").isNotNull(), F.col("_ok"))).otherwise(F.col("_nk"))
    company = F.when(F.col("_k").isNotNull(), F.col("_kc")).when(F.col("company_id").isNotNull(), F.col("_company")).otherwise(F.col("_nc"))
    return rows.withColumns({"target_contact": contact, "target_company": company}).drop("_k", "_kc", "_company", "_oc", "_oe", "_ok", "_ne", "_nk", "_nc")


def match_org(companies: DataFrame, orgs: DataFrame) -> DataFrame:
    """Companies with the organisation whose login their domain suggests, and how that is corroborated; others are left out."""
    guess = F.regexp_replace(F.lower(F.substring_index("canonical_domain", ".", 1)), "[^a-z0-9-]", "")
    rows = companies.withColumn("_guess", guess).join(orgs, F.col("_guess") == F.lower("login"))
    blog = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim("blog")), r"^https?://", ""), r"/.*$", ""), r"^www\.", "")
    blog = F.when(blog.contains("."), blog)
    by = (
        F.when(blog == F.col("canonical_domain"), "blog_exact")
        .when(F.substring_index(blog, ".", 1) == F.substring_index("canonical_domain", ".", 1), "blog_brand")
        .when(F.col("public_repos") > 0, "login_exact")
    )
    return rows.withColumn("matched_by", by).filter("matched_by IS NOT NULL").drop("_guess")


def drop_suppressed(df: DataFrame, suppression: DataFrame, email: str | None, domain: str) -> DataFrame:
    """Two anti joins: one on either condition would compare every row with every entry."""
    if email:
        df = df.join(suppression.select(F.lower("email").alias("_s")).filter("_s IS NOT NULL").distinct(), F.lower(email) == F.col("_s"), "left_anti")
    return df.join(suppression.select(F.lower("domain").alias("_s")).filter("_s IS NOT NULL").distinct(), F.lower(domain) == F.col("_s"), "left_anti")


def without(df: DataFrame, done: DataFrame, key: str = "id", other: str = "company_id") -> DataFrame:
    """Rows that are not processed yet."""
    return df.join(done.select(F.col(other).alias("_done")).distinct(), F.col(key) == F.col("_done"), "left_anti")


def having(df: DataFrame, rows: DataFrame, key: str = "id", other: str = "company_id", where: Column | None = None) -> DataFrame:
    """Rows that have a match."""
    rows = rows.filter(where) if where is not None else rows
    return df.join(rows.select(F.col(other).alias("_has")).distinct(), F.col(key) == F.col("_has"), "left_semi")


def pending_records(records: DataFrame, sources: DataFrame, source_key: str, limit: int) -> DataFrame:
    own = sources.filter(F.col("source_key") == source_key).select(F.col("id").alias("_source"))
    return records.filter("processing_status = 'pending'").join(own, F.col("source_id") == F.col("_source")).drop("_source").orderBy("created_at", "id").limit(limit)


def with_deliverability(df: DataFrame, mx_records: DataFrame, email: str = "email") -> DataFrame:
    """Rows with the label of their address; mail servers are looked up once per domain from the given table."""
    mx = mx_records.groupBy(F.lower("domain").alias("_mx")).agg(F.max("mx_count").alias("_count"), F.max("error").alias("_error"))
    rows = df.join(mx, c.email_domain(F.lower(F.trim(F.col(email)))) == F.col("_mx"), "left")
    return rows.withColumn("deliverability", c.deliverability(F.col(email), F.col("_count"), F.col("_error"))).drop("_mx", "_count", "_error")


def outer_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join of two count tables; missing counts are 0."""
    numbers = [n for n, k in [*a.dtypes, *b.dtypes] if k in ("bigint", "int") and n != key]
    return a.join(b, key, "full_outer").fillna(0, numbers)


def star(base: DataFrame, *summaries: DataFrame, key: str = "company_id") -> DataFrame:
    """Left joins of per-key summaries; all share the key's partitioning."""
    for s in summaries:
        base = base.join(s, key, "left")
    return base


def profiles_with_companies(profiles: DataFrame, founders: DataFrame, links: DataFrame) -> DataFrame:
    """Profiles with an address, a company and a page (``source_url`` where there is one, else ``profile_url``), with the founder's name and
    role in that company; a founder without a link to it has no role."""
    page = c.blank_to_null(F.col("profile_url"))
    page = F.coalesce(c.blank_to_null(F.col("source_url")), page) if "source_url" in profiles.columns else page
    rows = profiles.withColumn("source_url", page).filter("company_id IS NOT NULL AND source_url IS NOT NULL").filter(c.blank_to_null(F.col("email")).isNotNull())
    return rows.join(founders.select(F.col("id").alias("founder_id"), "full_name"), "founder_id").join(links.select("company_id", "founder_id", "role"), ["company_id", "founder_id"], "left")
