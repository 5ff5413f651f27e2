"""As-of joins with DataFrame functions alone, for keys that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """``left`` with ``value`` of the latest row of ``right`` of the same ``key`` at or before ``time``; null where there is none.

    ``key`` (not null) and ``time`` (integer; null finds nothing) are in both, ``value`` in ``right`` only, one row for each key and time.
    The union of both is ordered within (key, time range of ``width``), so a hot key is spread over its time ranges; what enters a range
    from before comes from one aggregate row per range. No pair of rows is formed.
    """
    names = left.columns
    cell = F.floor(F.col("time") / width)
    entry = F.struct("time", "value")
    rows = left.select("key", "time", F.lit(1).alias("_is"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(entry.alias("e")).schema["e"].dataType).alias("_entry"))
    listed = right.filter(F.col("time").isNotNull()).select("key", "time", F.lit(0).alias("_is"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), entry.alias("_entry"))
    both = rows.unionByName(listed).withColumn("_cell", cell)
    before = Window.partitionBy("key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("key", "_cell").agg(F.max("_entry").alias("_last")).select(F.col("key").alias("_k"), F.col("_cell").alias("_c"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    upto = Window.partitionBy("key", "_cell").orderBy("time", "_is").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_entry", ignorenulls=True).over(upto)).filter("_is = 1")
    found = found.join(carried, (F.col("key") == F.col("_k")) & F.col("_cell").eqNullSafe(F.col("_c")), "left")
    value = F.when(F.col("time").isNotNull(), F.coalesce("_own", "_carried")["value"])
    return found.select(*(F.col("_row")[c].alias(c) for c in names), value.alias("value"))
