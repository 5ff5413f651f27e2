"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow that is served in shuffled order, again and again up to ``epochs`` times. The words of a source up to a document's end, divided by
the source's target, are the document's virtual finish time. The queue of all copies is sorted by it, less half of the document's own service, and
cut where its words reach the total budget: the copy at the cut is in if that brings the sum nearer. Copies are whole, and as half a
document counts as the document, each source ends within about half a document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhound.llm.common import drop_shared, read, write_shared
from tallyhound.operators.latest import global_rank

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: Ranges of virtual time up to 1 that the words of the queue are summed by.
TIMES = 4096


def word_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Weights repeat over the sources by code point, null last. A target stops at ``epochs`` times its source's size and the excess goes to
    the others by weight: targets are ``min(cap, level * weight)``. Ranks come from a range sort; the level from sums over the sources that are capped at the last
    level, which only grows, until no more are: a few small aggregations, however many sources there are.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(per, F.col("source").isNull(), F.col("source"))
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = write_shared(ranked.select("source", "source_size", weigh.alias("weight"), (F.col("source_size") * epochs).alias("cap")), "mix-sources")
    full = F.col("cap") / F.col("weight")
    total, every = known.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (share * (total or 0)) / every if every else 0.0, -1
    while True:
        capped, open_, n = known.agg(F.sum(F.when(full < level, F.col("cap"))), F.sum(F.when(full >= level, F.col("weight"))), F.count_if(full < level)).first()
        if n == before or not open_:
            break
        level, before = (share * total - (capped or 0)) / open_, n
    least = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight")) if open_ else F.col("cap").cast("double")
    return known.select("source", "source_size", least.alias("target"))


def middle(epoch: int | Column) -> Column:
    """Virtual time at which half of a document's copy of that round is served; null where its source has no words."""
    return F.try_divide(((F.col("before") + F.col("source_size") * epoch) * 2 + F.col("size")).cast("double"), F.col("target") * 2)


def _place(epoch: int | Column) -> Column:
    """A copy's place in the queue; ties stand by document, source and turn."""
    return F.struct(middle(epoch).alias("time"), F.col("doc_id").alias("doc"), F.col("source").alias("source"), F.col("before").alias("before"), F.lit(epoch).alias("epoch"))


def _cell(epoch: int | Column) -> Column:
    return F.least(F.floor(middle(epoch) * TIMES), F.lit(4 * TIMES))


def queue(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """The queue with one row per document: ``doc_id, source, size, source_size, target, before, taken``, and ``_hash`` of its text if kept.

    ``before`` are the words of its source ahead of it in the first round; ``taken`` the words of the copies that are taken, all of them whole. Prefix sums have two
    levels: sums of (source, hash range) cells and a window within a cell for the sources, sums of ranges of virtual time and a window within the one that
    holds the cut for the queue, so that a hot source is spread over all tasks. Only small integers and a hash are shuffled, never texts.
    Null texts have size 0 and are taken for 0 words; null sources form one source, the last; equal rows are interchangeable; extra columns are ignored. An empty
    table gives no rows.
    """
    size = word_count(F.col("text")) if size is None else size
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))
    rows = write_shared(docs.select("doc_id", "source", size.alias("size"), order.alias("_order"), (F.xxhash64("text") if "text" in docs.columns else F.lit(0)).alias("_hash")), "mix-sizes")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cells = min(4096, max(64, count // 4000))  # affects the spread only, not the order
    rows = rows.withColumn("_cell", F.floor(F.conv(F.substring("_order", 1, 4), 16, 10).cast("long") * cells / 65536))
    in_source = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "_cell").agg(F.sum("size").alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(in_source), F.lit(0)))
    known = sums.join(source_targets(rows, weights, share, epochs).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("_cell").alias("_c"), "_ahead", "source_size", "target")
    in_cell = Window.partitionBy("source", "_cell").orderBy("_order", "doc_id", "size", "_hash").rowsBetween(Window.unboundedPreceding, 0)
    ahead = rows.withColumn("_upto", F.sum("size").over(in_cell)).join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    ahead = ahead.withColumn("before", F.col("_ahead") + F.col("_upto") - F.col("size"))
    turns = write_shared(ahead.select("doc_id", "source", "size", "source_size", "target", "before", "_hash"), "mix-queue")
    drop_shared(rows)

    copies = turns.filter("size > 0").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    times = copies.groupBy(_cell(F.col("e")).alias("c")).agg(F.sum("size").alias("words"))  # at most 4 * TIMES + 1 rows
    times = times.withColumn("upto", F.sum("words").over(Window.orderBy("c")))
    cut = times.filter(F.col("upto") >= F.lit(share * total)).orderBy("c").limit(1).first()
    if cut is None:  # all is taken
        taken = F.col("size") * epochs
    else:
        inner = copies.filter(_cell(F.col("e")) == cut.c).select(_place(F.col("e")).alias("place"), "size")
        inner = inner.withColumn("upto", F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) + (cut.upto - cut.words))
        last = inner.filter(F.col("upto") * 2 - F.col("size") <= F.lit(2 * share * total)).agg(F.max("place")).first()[0]

        def served(e: int) -> Column:
            if last is None:
                return _cell(e) < cut.c
            own = _place(e)
            kinds = turns.select(own.alias("p")).schema["p"].dataType
            return (_cell(e) < cut.c) | ((_cell(e) == cut.c) & (own <= F.struct(*(F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields))))

        taken = sum((F.when(served(e), F.col("size")).otherwise(0) for e in range(epochs)), F.lit(0))
    return turns.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(0).cast("long")).select("doc_id", "source", "size", "source_size", "target", "before", "taken", *(keep or []))


def virtual_finish(epoch: int | Column = 0) -> Column:
    """Virtual time at which a document's copy of that round is through; null where its source has no words."""
    return F.try_divide((F.col("before") + F.col("size") + F.col("source_size") * epoch).cast("double"), F.col("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = SEED) -> DataFrame:
    """The mixed documents: the columns of ``docs``, a row for each copy taken, whole, globally sorted by virtual time.

    Documents without words (null and empty texts), and those whose turn doesn't come, are left out. Rows that share
    doc_id, source and text take their turns in any order; null doc_ids and sources are values like others. Other columns are kept whatever
    their names. An empty table gives no rows.

    Texts are shuffled twice: to meet their turn in the queue, which is planned on sizes and hashes alone, and into the queue's order.
    """
    names, key = docs.columns, [f"_k{i}" for i in range(3)]
    own = [F.col("doc_id"), F.col("source"), F.xxhash64("text")]
    plan = queue(docs.select("doc_id", "source", "text"), weights=weights, share=share, epochs=epochs, seed=seed, keep=["_hash"])
    plan = plan.select(F.col("doc_id").alias("_k0"), F.col("source").alias("_k1"), F.col("_hash").alias("_k2"), F.struct("before", "taken", "size", "source_size", "target").alias("turn"))
    plan = plan.withColumns({"nth": F.row_number().over(Window.partitionBy(*key).orderBy("turn.before")), "rows": F.count("*").over(Window.partitionBy(*key))})
    plan = write_shared(plan, "mix-plan")
    rows = docs.select(*(c.alias(k) for c, k in zip(own, key, strict=True)), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    same = lambda a, b: (a["_k0"].eqNullSafe(b["_k0"])) & (a["_k1"].eqNullSafe(b["_k1"])) & (a["_k2"] == b["_k2"])
    a, b = rows.alias("a"), plan.filter("rows = 1 AND turn.taken > 0").alias("b")
    once = a.join(b, same({k: F.col(f"a.{k}") for k in key}, {k: F.col(f"b.{k}") for k in key})).select("a.row", "b.turn")
    # rows that are repeated meet one turn each
    again = plan.filter("rows > 1")
    if not again.isEmpty():
        b = again.select(*key).distinct().alias("b")
        numbered = a.join(b, same({k: F.col(f"a.{k}") for k in key}, {k: F.col(f"b.{k}") for k in key}), "left_semi")
        numbered = numbered.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.to_json("row")))).alias("a")
        b = again.filter("turn.taken > 0").alias("b")
        met = numbered.join(b, same({k: F.col(f"a.{k}") for k in key}, {k: F.col(f"b.{k}") for k in key}) & (F.col("a.nth") == F.col("b.nth")))
        once = once.unionByName(met.select("a.row", "b.turn"))
    rounds = F.transform(F.sequence(F.lit(0), (F.col("turn.taken") / F.col("turn.size")).cast("int") - 1), lambda e: ((F.col("turn.before") + F.col("turn.source_size") * e) * 2 + F.col("turn.size")) / (F.col("turn.target") * 2))
    copies = once.select("row", F.explode(rounds).alias("time"))
    return copies.orderBy("time", "row.doc_id").select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = queue(read(spark, sf_dir, "documents"))
    return plan.orderBy(virtual_finish(), "doc_id").select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix-1') AS o
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM r),
q AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM l WHERE level <= ratio) * weight) AS target FROM l),
c AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, ((before + source_size * e) * 2 + size)::DOUBLE / (target * 2) AS time FROM c, (SELECT unnest([0, 1]) AS e) WHERE size > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY time, doc_id, source, before, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e),
n AS (SELECT doc_id, source, before, sum(size) AS taken FROM k WHERE 2 * upto - size <= 3.0::DOUBLE * (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT c.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM c LEFT JOIN n ON c.doc_id IS NOT DISTINCT FROM n.doc_id AND c.source IS NOT DISTINCT FROM n.source AND c.before = n.before AND size > 0
"""
