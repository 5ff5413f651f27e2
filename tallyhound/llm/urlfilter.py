"""URL filters by a temporal list join, with DataFrame functions only.

A list is a log of dated entries. An entry holds from its date until the next entry of the same pattern: that is its validity interval. A
capture is matched by the entries that are active when it was fetched, and the most specific of them decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhound.llm.asof import as_of
from tallyhound.llm.common import read, write_shared

#: Microseconds of a time range of the as-of join.
RANGE_US = 6 * 3600 * 1_000_000


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.lower(F.regexp_replace(found, r"\.+$", ""))


def path(url: Column) -> Column:
    """The path without its leading slash, query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def patterns(url: Column, deepest: Column | None = None) -> Column:
    """All patterns that could match a URL: every domain suffix of its host (``example.org``), and the host with each of its first path
    segments (``host/a/``, ``host/a/b/`` and so on, as deep as the list goes if ``deepest`` tells). An array, empty without a host."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    depth = F.size(parts) if deepest is None else F.least(deepest, F.size(parts))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host(url) != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, action, valid_from, valid_to`` from the log ``pattern, action, listed_at`` (microseconds).

    ``valid_to`` is exclusive and null for entries still in force; the intervals of a pattern don't overlap. Of entries at the same moment the
    last action by name holds. Entries without pattern, action or date are left out; ``drop`` entries end an interval and begin none. The
    next entry is looked up within time ranges, then among the ranges, so that a hot pattern is spread.
    """
    log = clean(entries).withColumn("_cell", F.floor(F.col("listed_at") / RANGE_US))
    own = F.lead("listed_at").over(Window.partitionBy("pattern", "_cell").orderBy("listed_at"))
    after = F.lead("_first").over(Window.partitionBy("pattern").orderBy("_cell"))
    later = log.groupBy("pattern", "_cell").agg(F.min("listed_at").alias("_first")).withColumn("_after", after).drop("_first")
    out = log.withColumn("_own", own).join(later, ["pattern", "_cell"]).withColumn("valid_to", F.coalesce("_own", "_after"))
    return out.filter("action <> 'drop'").select("pattern", "action", F.col("listed_at").alias("valid_from"), "valid_to")


def clean(entries: DataFrame) -> DataFrame:
    """The log without unusable entries, one action per pattern and moment; hosts in lower case, paths as they are."""
    name = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(name), F.substring(F.col("pattern"), F.length(name) + 1, F.length("pattern")))
    fine = entries.filter("pattern IS NOT NULL AND action IS NOT NULL AND listed_at IS NOT NULL")
    return fine.groupBy(pattern.alias("pattern"), "listed_at").agg(F.max("action").alias("action"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of ``captures`` (``url, fetched_at`` in microseconds, others are kept) with ``rule`` and ``action`` (null where no entry
    is active) and ``blocked``.

    The longest matching pattern with an active entry decides. Captures without a URL, host or time match nothing and aren't blocked. Each
    distinct capture is evaluated once and given to all its rows; added columns replace others of their names. An empty table gives no rows; without entries, or with
    entries that have no pattern or time, nothing is blocked.
    """
    captures = captures.drop("rule", "action", "blocked")
    wanted = captures.select("url", "fetched_at").filter("url IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    log = write_shared(intervals(entries).select(F.col("pattern").alias("key"), F.col("valid_from").alias("time"), F.struct("action", "valid_to").alias("value")), "intervals")
    deepest = log.agg(F.coalesce(F.max(F.size(F.split("key", "/")) - 2), F.lit(0))).first()[0]  # host/a/b/ has four parts
    keys = wanted.select("url", F.col("fetched_at").alias("time"), F.explode(patterns(F.col("url"), F.lit(deepest))).alias("key"))
    keys = keys.join(log.select("key").distinct(), "key", "left_semi")  # patterns that are never listed need no order
    # the latest interval that had begun, if it hadn't ended
    active = as_of(keys, log, RANGE_US).filter("value IS NOT NULL AND (value.valid_to IS NULL OR time < value.valid_to)")
    best = active.groupBy("url", "time").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), F.col("value.action").alias("action"))).alias("_best"))
    best = best.select(F.col("url").alias("_u"), F.col("time").alias("_t"), "_best.rule", "_best.action")
    out = captures.join(best, (F.col("url") == F.col("_u")) & (F.col("fetched_at") == F.col("_t")), "left").drop("_u", "_t")
    return out.withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False)))


def dated_list(events: DataFrame, pages: DataFrame) -> DataFrame:
    """A dated list from the tables at hand: each event is an entry about the page whose number is the event's modulo the pages.

    Errors block a host, sign-ups allow it, views take it off the list, clicks block the first path segment, all others block the domain
    (the last two labels).
    """
    n = pages.count()
    at = events.join(pages.select("page_id", "url"), F.pmod("event_id", F.lit(max(1, n))) == F.col("page_id"))
    name = host(F.col("url"))
    segment = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    kind = F.col("event_type")
    pattern = F.when(kind.isin("error", "signup", "view"), name).when(kind == "click", F.concat(name, F.lit("/"), segment, F.lit("/"))).otherwise(F.substring_index(name, ".", -2))
    action = F.when(kind == "signup", "allow").when(kind == "view", "drop").otherwise("block")
    return at.select(pattern.alias("pattern"), action.alias("action"), F.unix_micros(F.col("ts").cast("timestamp")).alias("listed_at")).filter("pattern <> ''")


#: Captures are fetched within the thirty days from this moment (2024-01-01) on.
FIRST_FETCH_S, FETCH_S = 1_704_067_200, 30 * 86_400


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    fetched = (F.lit(FIRST_FETCH_S) + F.pmod(F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long"), F.lit(FETCH_S))) * 1_000_000
    entries = write_shared(dated_list(read(spark, sf_dir, "events"), pages), "dated-list")
    return filter_urls(pages.withColumn("fetched_at", fetched), entries).select("page_id", "url", "fetched_at", "rule", "action", "blocked")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', '')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) AS path,
         (1704067200 + ('0x' || md5(url)[1:8])::BIGINT % 2592000) * 1000000 AS fetched_at
  FROM pages),
e AS (
  SELECT CASE WHEN event_type IN ('error', 'signup', 'view') THEN host
              WHEN event_type = 'click' THEN host || '/' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) || '/'
              ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS pattern,
         CASE event_type WHEN 'signup' THEN 'allow' WHEN 'view' THEN 'drop' ELSE 'block' END AS action, epoch_us(ts) AS listed_at
  FROM events JOIN p ON event_id % (SELECT count(*) FROM pages) = page_id),
log AS (SELECT pattern, listed_at, max(action) AS action FROM e WHERE pattern <> '' GROUP BY ALL),
valid AS (SELECT *, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS valid_to FROM log),
k AS (
  SELECT DISTINCT url, host, fetched_at, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS pattern
  FROM p WHERE host <> ''
  UNION
  SELECT url, host, fetched_at, host || '/' || array_to_string(parts[1:i], '/') || '/' AS pattern
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p WHERE host <> ''))),
hit AS (
  SELECT k.url, k.fetched_at, v.pattern, v.action
  FROM k JOIN valid v ON k.pattern = v.pattern AND k.fetched_at >= v.listed_at AND (v.valid_to IS NULL OR k.fetched_at < v.valid_to)
  WHERE v.action <> 'drop'),
best AS (SELECT url, fetched_at, pattern, action FROM hit QUALIFY row_number() OVER (PARTITION BY url, fetched_at ORDER BY length(pattern) DESC, pattern DESC) = 1)
SELECT p.page_id, p.url, p.fetched_at, b.pattern AS rule, b.action, coalesce(b.action = 'block', false) AS blocked
FROM p LEFT JOIN best b ON p.url = b.url AND p.fetched_at = b.fetched_at
"""
