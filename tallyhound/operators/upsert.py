"""Keyed upserts and change detection.

A batch carries ``index`` (its order). Stored tables are frames; an upsert returns the new table and, where useful, a status per batch row.
Rows of one batch see earlier rows of the same batch, as they would if applied one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.operators.latest import first_per_key, latest


def classify_changes(new: DataFrame, old: DataFrame, keys: list[str], hash_column: str, index: str = "index") -> DataFrame:
    """``new`` with ``status``: ``inserted`` for an unseen key, ``duplicate`` where the hash equals the one before it (in the batch, else
    stored), ``updated`` otherwise. Null keys equal each other; of several stored rows of a key the greatest hash counts."""
    order = Window.partitionBy(*keys).orderBy(index)
    names = [f"_stored_{i}" for i in range(len(keys))]
    stored = old.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.max(hash_column).alias("_stored"))
    seen = new.withColumn("_earlier", F.lag(hash_column).over(order)).withColumn("_nth", F.row_number().over(order))
    seen = seen.join(stored, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left").drop(*names)
    before = F.when(F.col("_nth") > 1, F.col("_earlier")).otherwise(F.col("_stored"))
    status = F.when(before.isNull(), "inserted").when(before == F.col(hash_column), "duplicate").otherwise("updated")
    return seen.withColumn("status", status).drop("_earlier", "_nth", "_stored")


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, nulls in them equal; the keys stand once."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    return left.join(right, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], how).drop(*names.values())


def overwrite(new: DataFrame, old: DataFrame, keys: list[str], index: str = "index") -> DataFrame:
    """The stored table after the batch: the last row of each key of the batch replaces the stored one. Null keys equal each other."""
    last = latest(new, keys, F.col(index).desc()).select(*old.columns)
    return meet(old, last.select(*keys), keys, "left_anti").select(*old.columns).unionByName(last)


def merge_fill_nulls(new: DataFrame, old: DataFrame, keys: list[str], fields: list[str], index: str = "index") -> DataFrame:
    """One row per key (null keys equal each other): stored values stay, nulls are filled by the first value that the batch has for them."""
    order = F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"))
    both = old.select(*keys, *fields, order.alias("_at")).unionByName(new.select(*keys, *fields, F.struct(F.lit(1).alias("a"), F.col(index).cast("long").alias("b")).alias("_at")))
    return both.groupBy(*keys).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_at"))).alias(f) for f in fields))


def _with_batch(new: DataFrame, old: DataFrame, index: str) -> DataFrame:
    """Stored jobs and observed ones in one table, the latter active and no longer missing; ``_new`` and ``_at`` tell them apart and keep the batch's order."""
    seen = new.withColumns({"is_active": F.lit(True), "missing_since_at": F.lit(None).cast("timestamp"), "missing_observation_count": F.lit(0), "_new": F.lit(True), "_at": F.col(index)})
    stored = old.withColumns({"_new": F.lit(False), "_at": F.lit(None).cast(new.schema[index].dataType)})
    return stored.unionByName(seen.select(*stored.columns))


def _last_or_stored(both: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key of :func:`_with_batch` the last row of the batch with the least stored ``first_seen_at``, or where the batch has none, all stored ones."""
    order = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col("_at").desc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = both.withColumns({"_nth": F.row_number().over(order), "_hit": F.max("_new").over(whole), "_first": F.min(F.when(~F.col("_new"), F.col("first_seen_at"))).over(whole)})
    rows = rows.filter("_nth = 1 OR NOT _hit")
    return rows.withColumn("first_seen_at", F.when(F.col("_new"), F.coalesce("_first", "first_seen_at")).otherwise(F.col("first_seen_at")))


def merge_jobs(new: DataFrame, old: DataFrame, keys: list[str], index: str = "index") -> DataFrame:
    """Job postings after a snapshot: every observed job is active again, seen now, and no longer missing; ``first_seen_at`` stays the stored
    one; other fields are those of the last observation. Jobs that the snapshot doesn't have stay as they are. Null keys equal each other.
    Both tables are read and shuffled once."""
    return _last_or_stored(_with_batch(new, old, index), keys).select(*old.columns)


def observe_jobs(new: DataFrame, old: DataFrame, keys: list[str], scope: list[str], as_of: Column, threshold: int = 2, index: str = "index") -> DataFrame:
    """:func:`merge_jobs`, then :func:`tallyhound.operators.signals.missing_observations` of the same batch, with one shuffle for both: by the columns that
    ``keys`` and ``scope`` (a board) share. ``keys`` are of ``scope`` but for the posting's id, so a stored row that no observed one replaces isn't in the snapshot."""
    both = _with_batch(new, old, index).repartition(*(k for k in keys if k in scope))
    rows = _last_or_stored(both.withColumn("_observed", F.max("_new").over(Window.partitionBy(*scope))), keys)
    missing = F.coalesce(~F.col("_new") & F.col("is_active") & F.col("_observed"), F.lit(False))
    return count_missing(rows, missing, as_of, threshold).select(*old.columns)


def count_missing(jobs: DataFrame, missing: Column, as_of: Column, threshold: int) -> DataFrame:
    """``jobs`` of which the ``missing`` ones are missing once more, and inactive from the threshold on."""
    n = F.coalesce("missing_observation_count", F.lit(0)) + 1
    return jobs.withColumns({
        "missing_since_at": F.when(missing, F.coalesce(F.col("missing_since_at"), as_of)).otherwise(F.col("missing_since_at")),
        "is_active": F.when(missing, n < threshold).otherwise(F.col("is_active")),
        "missing_observation_count": F.when(missing, n).otherwise(F.col("missing_observation_count")),
    })


def upsert_boards(new: DataFrame, old: DataFrame, keys: list[str], fields: list[str], index: str = "index") -> tuple[DataFrame, DataFrame]:
    """Boards after a batch, and the batch with ``status``: the same ``fields`` are a duplicate, others overwrite. Signals come from
    :func:`tallyhound.operators.signals.board_signals` on the second."""
    mark = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    changes = classify_changes(new.withColumn("fingerprint", mark), old.withColumn("fingerprint", mark), keys, "fingerprint", index)
    return overwrite(new.select(*old.columns, index), old, keys, index), changes


def ensure_source(new: DataFrame, old: DataFrame, index: str = "index") -> DataFrame:
    """Sources whose key isn't stored yet, each once."""
    return insert_once(new, old, [F.col("source_key")], index)


def merge_contacts(new: DataFrame, old: DataFrame, index: str = "index") -> DataFrame:
    """Contacts by company and lower-case address: the first known name and role stay, confidence is the greatest, source and verification
    status are the latest."""
    keys = ["company_id", "email"]
    both = old.withColumn("_at", F.lit(-1).cast("long")).unionByName(new.withColumn("_at", F.col(index).cast("long")).select(*old.columns, "_at"))
    both = both.withColumn("email", F.lower("email"))
    first = lambda f: F.min_by(f, F.when(c.blank_to_null(F.col(f)).isNotNull(), F.col("_at"))).alias(f)
    last = lambda f: F.max_by(f, "_at").alias(f)
    return both.groupBy(*keys).agg(first("full_name"), first("role"), F.max("confidence").alias("confidence"), last("contact_source"), last("verification_status"))


def insert_once(new: DataFrame, old: DataFrame, key: list[Column], index: str = "index") -> DataFrame:
    """Rows of the batch whose key is stored nowhere; of several the first. Nulls in a key equal each other, and nothing else."""
    names = [f"_k{i}" for i in range(len(key))]
    part = lambda df: df.withColumns({n: k.cast("string") for n, k in zip(names, key, strict=True)})
    fresh = meet(part(new), part(old).select(*names).distinct(), names, "left_anti")
    return first_per_key(fresh, names, index).drop(*names)


def touch(new: DataFrame, old: DataFrame, keys: list[str], refresh: list[str], index: str = "index") -> DataFrame:
    """Keep-everything tables: a known key refreshes the named columns only, an unknown one is added. Null keys equal each other."""
    last = latest(new, keys, F.col(index).desc())
    renamed = last.select(*keys, *(F.col(f).alias(f"_{f}") for f in refresh), F.lit(True).alias("_hit"))
    kept = meet(old, renamed, keys, "left").withColumns({f: F.when(F.col("_hit"), F.col(f"_{f}")).otherwise(F.col(f)) for f in refresh}).select(*old.columns)
    return kept.unionByName(meet(last, old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def aliases(companies: DataFrame) -> DataFrame:
    """``company_id, alias, alias_type, confidence`` from ``id, canonical_name, former_names``."""
    own = companies.select(F.col("id").alias("company_id"), c.display_name(F.col("canonical_name")).alias("alias"), F.lit("name").alias("alias_type"), F.lit(1.0).alias("confidence"))
    former = companies.select(F.col("id").alias("company_id"), F.explode("former_names").alias("alias")).select("company_id", c.display_name(F.col("alias")).alias("alias"), F.lit("former_name").alias("alias_type"), F.lit(0.95).alias("confidence"))
    return own.unionByName(former).filter("alias IS NOT NULL").dropDuplicates(["company_id", "alias", "alias_type"])


def source_identities(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First and last sight of each external id, with the company of the last; merged with the stored ones."""
    if stored is not None:
        seen = stored.select("source_id", "external_id", "company_id", F.explode(F.array("first_seen_at", "last_seen_at")).alias("collected_at"), F.lit(None).cast(records.schema["id"].dataType).alias("id"))
        records = records.select(*seen.columns).unionByName(seen)
    return records.groupBy("source_id", "external_id").agg(F.min("collected_at").alias("first_seen_at"), F.max("collected_at").alias("last_seen_at"), F.max_by("company_id", F.struct("collected_at", "id")).alias("company_id"))


def founders(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Founders, company links and profiles from ``company_id, founders array<struct<name, role, profile_url, linkedin_url, x_url, bio, email>>``."""
    each = records.select("company_id", F.explode("founders").alias("f")).select("company_id", c.display_name(F.col("f.name")).alias("full_name"), "f.*").filter("full_name IS NOT NULL")
    each = each.withColumn("founder_id", c.surrogate_id(F.lower("full_name")))
    people = each.groupBy("founder_id").agg(F.min("full_name").alias("full_name"))
    links = each.groupBy("company_id", "founder_id").agg(F.max("role").alias("role")).withColumn("confidence", F.lit(0.95))
    fields = ["profile_url", "linkedin_url", "x_url", "bio", "email"]
    profiles = each.filter(F.coalesce(*(c.blank_to_null(F.col(f)) for f in fields)).isNotNull()).select("company_id", "founder_id", *fields).distinct().withColumn("confidence", F.lit(0.8))
    return people, links, profiles


def resolve_identities(records: DataFrame, companies: DataFrame, allow_name_only: bool = False) -> DataFrame:
    """``records`` (``id, created_at, company_id, name, domain``) with ``action`` and ``resolved_id``.

    In order: linked records backfill; no name goes to review; a known domain fills; else the first record by time and id creates the company
    and later ones of its domain fill. No domain goes to review. If names alone are allowed, it instead matches a stored company of that name,
    else one that an earlier record with a domain creates under it, else the first such record creates it.
    """
    name, domain = c.display_name(F.col("name")), c.blank_to_null(F.lower("domain"))
    known = companies.filter("canonical_domain IS NOT NULL").groupBy(F.lower("canonical_domain").alias("_domain")).agg(F.min("id").alias("_by_domain"))
    named = companies.groupBy(F.lower("canonical_name").alias("_name")).agg(F.min("id").alias("_by_name"))
    rows = records.withColumns({"_n": F.lower(name), "_d": domain}).join(known, F.col("_d") == F.col("_domain"), "left").join(named, F.col("_n") == F.col("_name"), "left")
    new = F.col("company_id").isNull() & F.col("_n").isNotNull()
    open_ = new & F.col("_d").isNotNull() & F.col("_by_domain").isNull()
    # rows that take no turn are groups of their own, so that nulls make no hot key
    alone = F.concat(F.lit("#"), F.col("id").cast("string"))
    rows = rows.withColumn("_group", F.when(open_, F.concat(F.lit("="), "_d")).otherwise(alone))
    rows = rows.withColumn("_nth", F.when(open_, F.row_number().over(Window.partitionBy("_group").orderBy("created_at", "id"))))
    own = F.when(F.col("_nth") == 1, c.surrogate_id(F.col("_d")))
    bare = new & F.col("_d").isNull()
    if allow_name_only:
        rows = rows.withColumn("_group", F.when(bare | (F.col("_nth") == 1), F.concat(F.lit("="), "_n")).otherwise(alone))
        before = Window.partitionBy("_group").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
        made = F.coalesce(own, F.when(bare, c.surrogate_id(F.lit("name"), F.col("_n"))))
        rows = rows.withColumn("_made", F.first(made, ignorenulls=True).over(before))
        by_name = F.coalesce(F.col("_by_name").cast("string"), F.col("_made"))
        without_domain = F.when(by_name.isNotNull(), "match_name").otherwise("create")
    else:
        by_name, without_domain = F.lit(None).cast("string"), F.lit("review_missing_domain")
    action = (
        F.when(F.col("company_id").isNotNull(), "backfill")
        .when(F.col("_n").isNull(), "review_missing_name")
        .when(F.col("_d").isNull(), without_domain)
        .when(F.col("_by_domain").isNotNull(), "match_domain")
        .when(F.col("_nth") == 1, "create")
        .otherwise("match_domain")
    )
    rows = rows.withColumn("action", action)
    found = (
        F.when(F.col("action") == "backfill", F.col("company_id").cast("string"))
        .when(F.col("action").isin("match_domain", "create") & F.col("_d").isNotNull(), F.coalesce(F.col("_by_domain").cast("string"), c.surrogate_id(F.col("_d"))))
        .when(F.col("action").isin("match_name", "create"), F.coalesce(by_name, c.surrogate_id(F.lit("name"), F.col("_n"))))
    )
    return rows.withColumn("resolved_id", found).drop("_n", "_d", "_domain", "_by_domain", "_name", "_by_name", "_nth", "_group", "_made")


def explode_observations(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each named field that isn't blank."""
    long = rows.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot([key], fields, "field", "value")
    return long.filter(F.length(F.trim("value")) > 0)


def add_suppression(new: DataFrame, old: DataFrame, index: str = "index") -> DataFrame:
    """Entries (``email, domain, reason``) of which neither the address nor the domain is listed yet, each once."""
    rows = new.withColumns({"email": c.blank_to_null(F.lower("email")), "domain": c.blank_to_null(F.lower("domain"))}).filter("email IS NOT NULL OR domain IS NOT NULL")
    rows = rows.join(old.select(F.lower("email").alias("_e")).filter("_e IS NOT NULL").distinct(), F.col("email") == F.col("_e"), "left_anti")
    rows = rows.join(old.select(F.lower("domain").alias("_d")).filter("_d IS NOT NULL").distinct(), F.col("domain") == F.col("_d"), "left_anti")
    return first_per_key(rows, ["email", "domain"], index)


def activate_parsers(versions: DataFrame, threshold: float = 0.7, least: int = 3) -> DataFrame:
    """``versions`` with ``status``: too small a sample or too low a rate fails; of the others of a source the latest is active and the rest
    are retired."""
    fine = (F.col("sample_size") >= least) & (F.col("success_rate") >= threshold)
    later = F.row_number().over(Window.partitionBy("source_key", fine).orderBy(F.col("generated_at").desc(), F.col("id").desc()))
    return versions.withColumn("_nth", later).withColumn("status", F.when(~F.coalesce(fine, F.lit(False)), "failed").when(F.col("_nth") == 1, "active").otherwise("retired")).drop("_nth")


def retire_degraded(versions: DataFrame, health: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``versions`` with active parsers of degraded sources (``source_key, degraded`` of :func:`~tallyhound.operators.reports.parser_health`)
    failed, and a note of why."""
    bad = health.filter("degraded").select(F.col("source_key").alias("_bad")).distinct()
    gone = (F.col("status") == "active") & F.col("_bad").isNotNull()
    note = F.concat(F.coalesce("notes", F.lit("")), F.lit(f" retired below {threshold:.0%} threshold;"))
    rows = versions.join(bad, F.col("source_key") == F.col("_bad"), "left")
    return rows.withColumns({"notes": F.when(gone, note).otherwise(F.col("notes")), "status": F.when(gone, "failed").otherwise(F.col("status"))}).drop("_bad")


def apply_verdicts(rows: DataFrame, verdicts: DataFrame, as_of: Column, allowed: tuple[str, ...] = ("accurate", "inaccurate", "unclear")) -> DataFrame:
    """Reviewed rows get their verdict and time; verdicts of other values are ignored. Of several of a row the last by ``index`` counts,
    where verdicts have one, else the greatest."""
    fine = verdicts.filter(F.col("verdict").isin(*allowed))
    fine = fine.groupBy("id").agg((F.max_by("verdict", "index") if "index" in verdicts.columns else F.max("verdict")).alias("_v"))
    out = rows.join(fine, "id", "left")
    return out.withColumns({"review_verdict": F.coalesce("_v", "review_verdict"), "reviewed_at": F.when(F.col("_v").isNotNull(), as_of).otherwise(F.col("reviewed_at"))}).drop("_v")
