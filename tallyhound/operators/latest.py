"""Row selection per key and in order: windows, top-k, samples, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.store import write_shared


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in ``order``, which should end in a unique column."""
    return top_per_key(df, keys, 1, *order)


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """At most ``n`` rows per key. The plan limits each task's groups before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def latest_with_ties(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """All rows that share their key's latest time."""
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(time).desc()))).filter("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """First occurrence in input order wins."""
    return latest(df, keys, F.col(index).asc())


def by_rank_list(column: str, ranked: tuple[str, ...]) -> Column:
    """Position of a value in a fixed list; values outside it come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranked)), F.col(column)), F.lit(0)), F.lit(len(ranked) + 1))


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Row numbers over a total order without one task holding all rows. ``order`` must be total.

    Rows are range-partitioned, sorted and stored once with their range and their place in it; ranges (one row each) are counted from the
    stored table, and their offsets added. Counting from the plan instead would compute the ranges anew, and not the same ones.
    """
    at = F.monotonically_increasing_id()  # the range in the upper 31 bits, the place in it in the lower 33
    parts = write_shared(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranked")
    parts = parts.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_in", "_at", "_before")


def pivot_latest(df: DataFrame, keys: list[str], field: str, value: str, fields: list[str], *order: Column) -> DataFrame:
    """Latest value of each named field as columns."""
    return latest(df, [*keys, field], *order).groupBy(*keys).pivot(field, fields).agg(F.first(value))


def previous_line(df: DataFrame, page: str, number: str, line: str) -> DataFrame:
    return df.withColumn("previous_line", F.lag(line).over(Window.partitionBy(page).orderBy(number)))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by least hash: random, yet the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def shard(df: DataFrame, key: str, shards: int, number: int) -> DataFrame:
    return df.filter(F.pmod(F.xxhash64(key), F.lit(shards)) == number)


def page_of(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """Rows after ``offset``; filters come before it."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_targets(base: Column, hinted: Column, most: int) -> Column:
    """Base paths, then hinted links, each once, at most so many."""
    return F.slice(F.array_distinct(F.concat(base, hinted)), 1, most)
