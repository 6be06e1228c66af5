"""Window operators, and the grouping of slides built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import anchored


def queue_position(df: DataFrame, queued: Column, ts: str, by: list[str]) -> DataFrame:
    """df with queue_position: 1 and the number of queued rows of its partition strictly earlier; null if not queued, 1 if
    it has no time."""
    rank = F.rank().over(Window.partitionBy(*by, queued).orderBy(F.col(ts).asc_nulls_first()))
    nulls = F.count(F.when(F.col(ts).isNull(), 1)).over(Window.partitionBy(*by, queued))
    return df.withColumn("queue_position", F.when(queued, F.when(F.col(ts).isNull(), 1).otherwise(rank - nulls)).cast("long"))


def changes(df: DataFrame, key: str, order: str, value: str, low: float, high: float) -> DataFrame:
    """Rows whose change against the row before is a `transition` (below low) or `ambiguous` (up to high); others are left out."""
    diff = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    similarity = F.lit(1.0) / (F.lit(1.0) + F.abs(diff))
    named = df.withColumn("similarity", similarity).withColumn("classification", F.when(F.col("similarity") < low, "transition").when(F.col("similarity") <= high, "ambiguous"))
    return named.where(F.col("classification").isNotNull())


def every_nth(df: DataFrame, key: str, order: str, rate: float, fps: float) -> DataFrame:
    """Rows whose place (from 0) is divisible by max(1, int(rate / fps))."""
    n = max(1, int(rate / fps))
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).where(F.col("_i") % n == 0).drop("_i")


def filled_forward(df: DataFrame, key: str, order: str, value: str, default) -> DataFrame:
    """df with nulls of a column replaced by the last value before, at first by the default."""
    over = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(over), F.lit(default)))


def first_occurrences(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows that are equal in `by` the first by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_n = 1").drop("_n")


def newest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each group in the order given; only a limited number of rows of a group is shuffled."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def monotonic(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with accepted: whether the value is not below any before it."""
    before = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("accepted", before.isNull() | (F.col(value) >= before))


def slides(events: DataFrame, key: str, ts: str, order: str, incremental: Column, durations: DataFrame, min_duration: float) -> DataFrame:
    """key, slide_number, start, end, is_incremental, parent_slide_number.

    Transitions that are not incremental become slides if `min_duration` or more after the last slide's start (at first 0);
    each ends where the next starts, the last at the key's duration. A key without slides has one over all of it; a first
    slide later than min_duration is led in by one from 0. Incremental transitions follow as children in order of time, all
    ending at the duration, each under the latest slide that starts at or before it. `durations`: key, duration, one row each.
    """
    real = anchored(events.where(~incremental).select(key, F.col(ts).alias("start"), order), key, "start", min_duration, order).where("kept").select(key, "start")
    by_start = Window.partitionBy(key).orderBy("start")
    mains = durations.join(real, key, "left").withColumn("start", F.coalesce("start", F.lit(0.0)))
    lead_in = mains.groupBy(key, "duration").agg(F.min("start").alias("start")).where(F.col("start") > min_duration).withColumn("start", F.lit(0.0))
    mains = mains.select(key, "duration", "start").unionByName(lead_in.select(key, "duration", "start"))
    mains = mains.withColumns({
        "end": F.lead("start").over(by_start), "slide_number": F.row_number().over(by_start).cast("long"),
    }).withColumn("end", F.coalesce("end", "duration"))
    children = events.where(incremental).select(key, F.col(ts).alias("start"), F.col(order).alias("_order")).join(durations, key)
    rows = mains.select(key, "start", "end", "slide_number", F.lit(False).alias("is_incremental"), F.lit(None).cast("long").alias("_order"))
    rows = rows.unionByName(children.select(key, "start", F.col("duration").alias("end"), F.lit(None).cast("long").alias("slide_number"), F.lit(True).alias("is_incremental"), F.col("_order").cast("long").alias("_order")))
    carry = Window.partitionBy(key).orderBy("start", "is_incremental", F.col("_order").asc_nulls_first())
    rows = rows.withColumn("parent_slide_number", F.when(F.col("is_incremental"), F.last("slide_number", ignorenulls=True).over(carry.rowsBetween(Window.unboundedPreceding, 0))))
    number = F.row_number().over(Window.partitionBy(key).orderBy("is_incremental", "start", F.col("_order").asc_nulls_first())).cast("long")
    return rows.withColumn("slide_number", number).drop("_order")
