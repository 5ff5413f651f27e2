"""Chat formatting by quotation linking, with DataFrame functions only.

Lines that begin with ``>`` quote; the number of signs is the level. Quoted lines and passages are normalised (lower case, white space and
line breaks collapsed) and hashed, passages in windows of words, and each is joined to the latest earlier message of the conversation that says
it in its own words. Messages without their quotes
are then put in reply order: each is followed by its replies, and those by theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhound.llm.asof import as_of
from tallyhound.llm.common import drop_shared, read, write_shared

#: Turns of a conversation that one window holds, and words of a passage that are hashed together.
TURNS, ANCHOR = 1024, 5
QUOTE = r"^[\x20\t]*(?:>[\x20\t]?)+"
#: Line above a quote that names its author.
ATTRIBUTION = r"(?i)\b(?:wrote|said|schrieb|a écrit|escribió)[\x20\t]*:[\x20\t]*$"


def level(line: Column) -> Column:
    """Quote signs that a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), r"[^>]", ""))


def normal(line: Column) -> Column:
    """A line without quote signs, in lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, QUOTE, ""), r"\s+", " ")))


def without_quotes(text: Column) -> Column:
    """The message's own lines: no quoted ones, and no attribution right above one; outer white space is cut."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    quoted = lambda i: F.coalesce(level(F.get(lines, i)) > 0, F.lit(False))
    own = F.filter(lines, lambda x, i: (level(x) == 0) & ~(x.rlike(ATTRIBUTION) & quoted(i + 1)))
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def windows(said: Column) -> Column:
    """``array<struct<said, chars>>``: all windows of ``ANCHOR`` words of a normalised text. ``chars`` is the length of the first word, in the
    last window that of all words, so that the windows of a passage weigh what it is long; none for shorter texts."""
    words = F.split(said, " ")
    last = F.size(words) - ANCHOR
    size = lambda i: F.length(F.get(words, i))
    own = lambda i: F.length(F.array_join(F.slice(words, i + 1, ANCHOR), ""))
    one = lambda i: F.struct(F.concat(F.lit("\t"), F.array_join(F.slice(words, i + 1, ANCHOR), " ")).alias("said"), F.when(i == last, own(i)).otherwise(size(i)).cast("long").alias("chars"))
    none = F.array().cast("array<struct<said:string,chars:bigint>>")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(none)


def links(messages: DataFrame) -> DataFrame:
    """``conv, turn, level, quoted_turn, chars``: per message and level, the earlier message that most quoted characters come from (the
    latest of several).

    What is quoted is found in two ways: as lines, whole, and as passages (lines of a level in a row, joined over the line breaks) by their
    windows of words, however either side is wrapped or cut. The way that finds more characters counts.
    """
    quoting = messages.filter("_quoting").select("conv", "turn", F.split("text", "\n").alias("lines"))
    lines = quoting.select("conv", "turn", F.explode("lines").alias("line")).select("conv", "turn", level(F.col("line")).alias("level"), normal(F.col("line")).alias("said"))
    lines = lines.filter("level > 0 AND said <> ''").select("conv", "turn", "level", "said", F.length("said").cast("long").alias("chars"))
    levels = quoting.select("conv", "turn", "lines", F.explode(F.array_distinct(F.filter(F.transform("lines", level), lambda n: n > 0))).alias("level"))
    of_level = F.array_join(F.transform("lines", lambda x: F.when(level(x) == F.col("level"), normal(x)).otherwise(F.lit("\n"))), " ")
    passages = levels.select("conv", "turn", "level", F.explode(F.split(of_level, "\n")).alias("said")).withColumn("said", F.trim(F.regexp_replace("said", r"\s+", " ")))
    parts = passages.select("conv", "turn", "level", F.explode(windows(F.col("said"))).alias("w")).select("conv", "turn", "level", "w.said", "w.chars")
    quoted = lines.unionByName(parts).groupBy("conv", "turn", "level", "said").agg(F.sum("chars").alias("chars"))
    own = messages.join(quoting.select("conv").distinct(), "conv", "left_semi").filter("turn IS NOT NULL").select("conv", "turn", "own")
    said = own.select("conv", "turn", F.explode(F.split("own", "\n")).alias("line")).select("conv", "turn", normal(F.col("line")).alias("said")).filter("said <> ''")
    said = said.unionByName(own.select("conv", "turn", F.explode(windows(F.lower(F.trim(F.regexp_replace("own", r"\s+", " "))))).alias("w")).select("conv", "turn", "w.said"))
    key = F.md5(F.concat_ws("\n", "conv", "said"))
    # a message is there from the next turn on
    right = said.select(key.alias("key"), (F.col("turn") + 1).alias("time"), F.col("turn").alias("value")).distinct()
    left = quoted.select(key.alias("key"), F.col("turn").alias("time"), "conv", "turn", "level", F.startswith("said", F.lit("\t")).alias("passage"), "chars")
    found = as_of(left, right, TURNS).filter("value IS NOT NULL")
    votes = found.groupBy("conv", "turn", "level", F.col("value").alias("quoted_turn")).agg(F.greatest(*(F.coalesce(F.sum(F.when(F.col("passage") == way, F.col("chars"))), F.lit(0)) for way in (False, True))).alias("chars"))
    return votes.groupBy("conv", "turn", "level").agg(F.max(F.struct("chars", "quoted_turn")).alias("v")).select("conv", "turn", "level", "v.quoted_turn", "v.chars")


def running(rows: DataFrame, amount: Column, alias: str, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with the running total of ``amount`` by ``keys`` and ``order``, of which ``turn`` is the first: totals of ranges of turns, then
    a window within a range, so that a hot conversation is spread."""
    cell = F.floor(F.col("turn") / TURNS)
    rows = rows.withColumn("_amount", amount).withColumn("_cell", F.coalesce(cell, F.lit(-1)))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_cell").agg(F.sum("_amount").alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_upto", F.sum("_amount").over(within)).join(totals, [*keys, "_cell"])
    return out.withColumn(alias, F.col("_ahead") + F.col("_upto")).drop("_amount", "_cell", "_upto", "_ahead")


def _upwards(segments: DataFrame, value: str, descend: bool) -> DataFrame:
    """``conv, seg, total``: the sum of ``value`` over a segment's own subtree (``descend``), or over it and all above it. Known distances double with every stored
    step, so a tree of depth d takes log(d) of them; a segment's row has one number at all times."""
    now = write_shared(segments.select("conv", "seg", F.col("parent").alias("up"), F.col(value).cast("long").alias("total")), "reply-sums")
    while not now.filter("up IS NOT NULL").isEmpty():
        above = now.select(F.col("conv").alias("_c"), F.col("seg").alias("_s"), F.col("up").alias("_up"), F.col("total").alias("_total"))
        after = now.join(above, (F.col("conv") == F.col("_c")) & (F.col("up") == F.col("_s")), "left")
        if descend:
            given = now.filter("up IS NOT NULL").groupBy(F.col("conv").alias("_gc"), F.col("up").alias("_gs")).agg(F.sum("total").alias("_given"))
            after = after.join(given, (F.col("conv") == F.col("_gc")) & (F.col("seg") == F.col("_gs")), "left").withColumn("_total", F.col("_given"))
        after = write_shared(after.select("conv", "seg", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_total", F.lit(0))).alias("total")), "reply-sums")
        drop_shared(now)
        now = after
    return now.drop("up")


def reply_order(turns: DataFrame) -> DataFrame:
    """``conv, turn, thread, ahead`` from ``conv, turn, reply_to, before, n`` (messages of the turn): the turn at the root of what each replies to, and the messages of
    its thread that stand before it where every message is followed by its replies, each with all of theirs, in the order of turns.

    Turns that reply to the one before them make up segments, which stand in one piece: only segments, one for each reply that breaks a chain, form a
    tree. Behind a segment come those that reply into it, to the last of its turns first. Sizes below a segment, and what stands before it, are sums over paths.
    """
    real = turns.filter("turn IS NOT NULL")
    head = F.col("reply_to").isNull() | (F.col("reply_to") != F.col("before"))
    ahead = running(real, F.col("n"), "upto", ["conv"], ["turn"]).withColumn("_ahead", F.col("upto") - F.col("n"))
    ahead = write_shared(ahead.withColumn("head", head), "reply-turns")
    heads = ahead.filter("head").select(F.col("conv").alias("key"), F.col("turn").alias("time"), F.col("turn").alias("value"))
    of = as_of(ahead.select(F.col("conv").alias("key"), F.col("turn").alias("time"), "n", "_ahead"), heads, TURNS)
    of = write_shared(of.select(F.col("key").alias("conv"), F.col("time").alias("turn"), F.col("value").alias("seg"), "n", "_ahead"), "reply-segments")
    sizes = of.groupBy("conv", "seg").agg(F.sum("n").alias("size"), F.min("_ahead").alias("_first"))
    up = ahead.filter("head").select("conv", F.col("turn").alias("seg"), F.col("reply_to").alias("hang"))
    up = up.join(of.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("seg").alias("parent")), (F.col("conv") == F.col("_c")) & (F.col("hang") == F.col("_t")), "left").drop("_c", "_t")
    segments = write_shared(up.join(sizes, ["conv", "seg"]), "reply-tree")
    whole = _upwards(segments, "size", descend=True)
    siblings = Window.partitionBy("conv", "parent").orderBy(F.desc("hang"), "seg").rowsBetween(Window.unboundedPreceding, -1)
    branch = segments.filter("parent IS NOT NULL").join(whole, ["conv", "seg"]).withColumn("_earlier", F.coalesce(F.sum("total").over(siblings), F.lit(0)))
    branch = branch.join(segments.select("conv", F.col("seg").alias("parent"), F.col("size").alias("_above")), ["conv", "parent"]).select("conv", "seg", "parent", (F.col("_earlier") + F.col("_above")).alias("step"))
    roots = segments.filter("parent IS NULL").select("conv", "seg", "parent", F.lit(0).cast("long").alias("step"))
    begins = _upwards(roots.unionByName(branch), "step", descend=False).select(F.col("conv").alias("_c"), F.col("seg").alias("_s"), "total")
    first = segments.select(F.col("conv").alias("_fc"), F.col("seg").alias("_fs"), "_first")
    root = segments.filter("parent IS NULL").select(F.col("conv").alias("_rc"), F.col("seg").alias("thread"))  # a conversation's first turn is its only one without a reply
    placed = of.join(begins, (F.col("conv") == F.col("_c")) & (F.col("seg") == F.col("_s"))).join(first, (F.col("conv") == F.col("_fc")) & (F.col("seg") == F.col("_fs"))).join(root, F.col("conv") == F.col("_rc"))
    placed = placed.select("conv", "turn", "thread", (F.col("total") + F.col("_ahead") - F.col("_first")).alias("ahead"))
    none = F.lit(None).cast("long")
    return placed.unionByName(turns.filter("turn IS NULL").select("conv", "turn", none.alias("thread"), F.lit(0).cast("long").alias("ahead")))


def format_chat(conversations: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, text, n_quoted, max_level, reply_to, thread, position, formatted``.

    ``text`` has no quotes and ``formatted`` is ``<|role|>`` and the text. ``reply_to`` is the turn quoted at the lowest linked level, else the turn
    before (null for the first). ``thread`` is the turn at the root of these, and ``position``, from 1, the place in the thread when each message is followed by its
    replies, and those by theirs, in the order of turns. Equal rows count once; several messages of one turn stand in the order of role and text. Null conversations form
    one; null turns are a thread of their own (null) and never quoted, null texts are empty and null roles are ``user``. Messages that consist of quotes
    alone stay, with empty text. Other columns are dropped. An empty table gives no rows.
    """
    rows = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    messages = rows.select("*", conv.alias("conv"), without_quotes(F.col("text")).alias("own"), F.coalesce(F.col("text").rlike(r"(?m)" + QUOTE), F.lit(False)).alias("_quoting"))
    messages = write_shared(messages, "messages")
    linked = links(messages).groupBy("conv", "turn").agg(F.min(F.struct("level", "quoted_turn")).alias("_l")).select("conv", "turn", F.col("_l.quoted_turn").alias("_quoted"))
    turns = messages.groupBy("conv", "turn").agg(F.count("*").alias("n"))
    # the turn before: rows hold from the next number on
    before = as_of(turns.select(F.col("conv").alias("key"), F.col("turn").alias("time"), "n"), turns.filter("turn IS NOT NULL").select(F.col("conv").alias("key"), (F.col("turn") + 1).alias("time"), F.col("turn").alias("value")), TURNS)
    before = before.select(F.col("key").alias("conv"), F.col("time").alias("turn"), "n", F.col("value").alias("before"))
    known = write_shared(before.join(linked, ["conv", "turn"], "left").withColumn("reply_to", F.coalesce("_quoted", "before")).drop("_quoted"), "replies")
    placed = reply_order(known).select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), "thread", "ahead")
    placed = placed.join(known.select(F.col("conv").alias("_kc"), F.col("turn").alias("_kt"), "reply_to"), (F.col("_c") == F.col("_kc")) & F.col("_t").eqNullSafe(F.col("_kt")))
    out = messages.join(placed, (F.col("conv") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")))
    levels = F.transform(F.split("text", "\n"), level)
    nth = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "own", "text"))
    out = out.select("conv_id", "turn", "role", F.col("own").alias("_own"), F.size(F.filter(levels, lambda n: n > 0)).cast("long").alias("n_quoted"), F.array_max(levels).cast("long").alias("max_level"), "reply_to", "thread", (F.col("ahead") + nth).alias("position"))
    return out.select("conv_id", "turn", "role", F.col("_own").alias("text"), "n_quoted", "max_level", "reply_to", "thread", "position", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "_own", F.lit("\n")).alias("formatted"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(read(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH RECURSIVE m AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
n AS (
  SELECT *, row_number() OVER () AS id, string_split(text, chr(10)) AS lines,
         list_transform(string_split(text, chr(10)), lambda x: length(regexp_replace(regexp_extract(x, '^[\x20\t]*(?:>[\x20\t]?)+'), '[^>]', '', 'g'))) AS levels
  FROM m),
o AS (
  SELECT *, regexp_replace(coalesce(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: levels[i] = 0 AND NOT
              (regexp_matches(lines[i], '(?i)\b(?:wrote|said|schrieb|a écrit|escribió)[\x20\t]*:[\x20\t]*$') AND coalesce(levels[i + 1], 0) > 0)), lambda i: lines[i]), chr(10)), ''), '^\s+|\s+$', '', 'g') AS own
  FROM n),
g AS (
  SELECT conv_id, turn, lines, levels, unnest(list_distinct(list_filter(levels, lambda x: x > 0))) AS level FROM o WHERE list_max(levels) > 0),
p AS (
  SELECT conv_id, turn, level, string_split(lower(trim(regexp_replace(said, '\s+', ' ', 'g'))), ' ') AS w
  FROM (SELECT conv_id, turn, level, unnest(string_split(array_to_string(list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN levels[i] = level THEN regexp_replace(lines[i], '^[\x20\t]*(?:>[\x20\t]?)+', '') ELSE chr(10) END), ' '), chr(10))) AS said FROM g)),
q AS (
  SELECT conv_id, turn, level, false AS passage, said, sum(length(said)) AS chars
  FROM (SELECT conv_id, turn, level, lower(trim(regexp_replace(regexp_replace(line, '^[\x20\t]*(?:>[\x20\t]?)+', ''), '\s+', ' ', 'g'))) AS said
        FROM (SELECT conv_id, turn, unnest(lines) AS line, unnest(levels) AS level FROM o) WHERE level > 0) WHERE said <> '' GROUP BY ALL
  UNION ALL
  SELECT conv_id, turn, level, true, array_to_string(w[i + 1:i + 5], ' ') AS said, sum(CASE WHEN i = len(w) - 5 THEN length(array_to_string(w[i + 1:i + 5], '')) ELSE length(w[i + 1]) END)
  FROM (SELECT *, unnest(range(0, len(w) - 4)) AS i FROM p) GROUP BY ALL),
w AS (
  SELECT DISTINCT conv_id, turn, false AS passage, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS said
  FROM (SELECT conv_id, turn, unnest(string_split(own, chr(10))) AS line FROM o)
  UNION
  SELECT conv_id, turn, true, array_to_string(w[i + 1:i + 5], ' ')
  FROM (SELECT *, unnest(range(0, len(w) - 4)) AS i FROM (SELECT conv_id, turn, string_split(lower(trim(regexp_replace(own, '\s+', ' ', 'g'))), ' ') AS w FROM o))),
f AS (
  SELECT q.conv_id, q.turn, q.level, q.passage, q.chars, max(w.turn) AS quoted_turn
  FROM q JOIN w ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.passage = w.passage AND q.said = w.said AND w.turn < q.turn GROUP BY q.conv_id, q.turn, q.level, q.passage, q.said, q.chars),
v AS (
  SELECT conv_id, turn, level, quoted_turn FROM (SELECT conv_id, turn, level, quoted_turn, greatest(coalesce(sum(chars) FILTER (NOT passage), 0), coalesce(sum(chars) FILTER (passage), 0)) AS chars FROM f GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY chars DESC, quoted_turn DESC) = 1),
u AS (SELECT conv_id, turn, quoted_turn FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level) = 1),
t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS prior FROM (SELECT DISTINCT conv_id, turn FROM m)),
r AS (SELECT t.conv_id, t.turn, coalesce(u.quoted_turn, t.prior) AS reply_to FROM t LEFT JOIN u ON t.conv_id IS NOT DISTINCT FROM u.conv_id AND t.turn = u.turn),
tree AS (
  SELECT conv_id, turn, reply_to, turn AS thread, [turn] AS path FROM r WHERE reply_to IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, r.reply_to, tree.thread, list_append(tree.path, r.turn) FROM tree JOIN r ON r.conv_id IS NOT DISTINCT FROM tree.conv_id AND r.reply_to = tree.turn)
SELECT o.conv_id, o.turn, o.role, o.own AS text, len(list_filter(levels, lambda x: x > 0))::BIGINT AS n_quoted, list_max(levels)::BIGINT AS max_level, tree.reply_to, tree.thread,
       row_number() OVER (PARTITION BY o.conv_id, tree.thread ORDER BY tree.path, o.role, o.own, o.text) AS position,
       '<|' || o.role || '|>' || chr(10) || o.own || chr(10) AS formatted
FROM o JOIN tree ON o.conv_id IS NOT DISTINCT FROM tree.conv_id AND o.turn IS NOT DISTINCT FROM tree.turn
"""
