"""Time joins: as-of with its policies, overlap, ranges, ordered merges; and joins against what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(probes: DataFrame, lines: DataFrame, key: str, ts: str, payload: list[str], order: str, tie: str = "first", miss: str = "drop") -> DataFrame:
    """Each probe with the payload of the latest line at or before it.

    tie: of lines of equal time the `first` or `last` by `order`. miss: a probe before all lines is dropped (`drop`), has
    nulls (`null`), gets the `first` line by order that has a time, or the line by order before all (`zero`), whether it has a time
    or not. Lines without a time are never the latest. One shuffle by key, linear in rows: both sides are put in one order and the
    last line is carried on.
    """
    every = lines
    lines = lines.where(F.col(ts).isNotNull())
    kept = F.struct(*[F.col(c) for c in payload])
    carried = "_line"
    if tie == "first":  # of equal times only the first line counts
        lines = lines.withColumn("_n", F.row_number().over(Window.partitionBy(key, ts).orderBy(order))).where("_n = 1").drop("_n")
    left = probes.select(key, ts, F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_order"), F.struct(*probes.columns).alias("_probe"))
    right = lines.select(key, ts, F.lit(0).alias("_side"), F.col(order).cast("long").alias("_order"), kept.alias(carried))
    both = left.unionByName(right, allowMissingColumns=True)
    over = Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_last(), "_side", F.col("_order").asc_nulls_last())
    both = both.withColumn(carried, F.last(carried, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    if miss == "first":
        least = F.min(F.when(F.col("_side") == 0, F.struct("_order", F.col(carried)))).over(Window.partitionBy(key))
        both = both.withColumn(carried, F.coalesce(carried, least[carried]))
    if miss == "zero":
        least = every.groupBy(key).agg(F.min_by(kept, order).alias("_zero"))
        both = both.where("_side = 1").join(least, key, "left").withColumn(carried, F.coalesce(carried, "_zero"))
    out = both.where("_side = 1").select("_probe.*", *[F.col(f"{carried}.{c}").alias(c) for c in payload], F.col(carried).isNull().alias("_missed"))
    return (out.where("NOT _missed") if miss == "drop" else out).drop("_missed")


def overlap(spans: DataFrame, parts: DataFrame, key: str, width: float | None = None) -> DataFrame:
    """Pairs of a span (start, end) and a part (part_start, part_end) of one key that overlap; both bounds are strict.

    width: where a key has many rows, both sides are also joined by time buckets of this width, and a pair counts in the
    bucket of the later of the two starts alone.
    """
    condition = (F.col("part_end") > F.col("start")) & (F.col("part_start") < F.col("end"))
    if not width:
        return spans.join(parts, key).where(condition)
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b)) / width)))
    left = spans.withColumn("_bucket", bucket("start", "end"))
    right = parts.withColumn("_bucket", bucket("part_start", "part_end"))
    once = F.col("_bucket") == F.floor(F.greatest("start", "part_start") / width)
    return left.join(right, [key, "_bucket"]).where(condition & once).drop("_bucket")


def joined_texts(pairs: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """Texts of each group joined by spaces in order."""
    return pairs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda s: s[text]), " ").alias("text"))


def in_range(points: DataFrame, ranges: DataFrame, key: str, ts: str, width: float | None = None) -> DataFrame:
    """Points with the ranges [start, end) that hold them; a null start or end is open.

    width: where a key has many rows, both sides are joined by time buckets of this width; a range stands in those between the
    first and the last point of its key, and a point is in one bucket, so a pair is found once.
    """
    c = F.col(ts)
    condition = (F.col("start").isNull() | (c >= F.col("start"))) & (F.col("end").isNull() | (c < F.col("end")))
    if not width:
        return points.join(ranges, key).where(condition)
    known = points.groupBy(key).agg(F.floor(F.min(c) / width).alias("_first"), F.floor(F.max(c) / width).alias("_last"))
    low = F.greatest("_first", F.coalesce(F.floor(F.col("start") / width), "_first"))
    high = F.least("_last", F.coalesce(F.floor(F.col("end") / width), "_last"))
    dealt = ranges.join(known, key).withColumn("_bucket", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))).drop("_first", "_last")
    return points.withColumn("_bucket", F.floor(c / width)).join(dealt, [key, "_bucket"]).where(condition).drop("_bucket")


def locate(bounds: DataFrame, lines: DataFrame, key: str, ts: str, index: str, default: Column) -> DataFrame:
    """bounds (key, bound) with the least index of a line at or after the bound, `default` if there is none.

    One order of both sides, from the latest on, in which the least index so far is carried on.
    """
    kept = F.struct(*bounds.columns)
    left = bounds.select(key, F.col("bound").cast("double").alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_index"), kept.alias("_bound"))
    right = lines.where(F.col(ts).isNotNull()).select(key, F.col(ts).cast("double").alias("_ts"), F.lit(0).alias("_side"), F.col(index).cast("long").alias("_index"))
    over = Window.partitionBy(key).orderBy(F.col("_ts").desc_nulls_last(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_at", F.min("_index").over(over)).where("_side = 1")
    return both.select("_bound.*", F.coalesce(F.when(F.col("_ts").isNotNull(), F.col("_at")), default).alias("line"))


def merge_before(lines: DataFrame, marks: DataFrame, key: str, ts: str, index: str) -> DataFrame:
    """Ordered merge: a mark goes before the first line at or after it, or after all lines. key, position, kind, ts.

    One order of both sides decides: going back from the end, a mark takes the index of the line that follows it.
    """
    a = lines.select(key, ts, F.col(index).cast("long").alias("_index"), F.lit("line").alias("kind"), F.lit(1).alias("_side"))
    b = marks.select(key, ts, F.lit(None).cast("long").alias("_index"), F.lit("mark").alias("kind"), F.lit(0).alias("_side"))
    over = Window.partitionBy(key).orderBy(F.col(ts).asc(), "_side", F.col("_index").asc_nulls_first())
    both = a.unionByName(b).withColumn("_before", F.coalesce(F.first("_index", ignorenulls=True).over(over.rowsBetween(0, Window.unboundedFollowing)), F.lit(1 << 60)))
    place = Window.partitionBy(key).orderBy("_before", "_side", ts)
    return both.select(key, (F.row_number().over(place) - 1).cast("long").alias("position"), "kind", ts)


def with_default(left: DataFrame, counts: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join against a table with one row for each key; missing values take defaults."""
    joined = left.join(counts, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def missing_slots(owners: DataFrame, count: Column, existing: DataFrame, key: str) -> DataFrame:
    """key and slot_index of the slots 0..count-1 that an owner should have and that do not exist."""
    wanted = owners.where(count > 0).select(key, F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("slot_index"))
    return wanted.join(existing, [key, "slot_index"], "left_anti")


def duplicates(jobs: DataFrame, owner: str, kind: Column, native_id: Column, url: str, order: str, cancelled: Column | None = None) -> DataFrame:
    """Each job with the earliest earlier job of the same owner, kind and id (the raw URL where there is no id) that is not cancelled, if any."""
    over = Window.partitionBy(owner, kind, native_id.isNull(), F.coalesce(native_id, F.col(url))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    alive = F.lit(True) if cancelled is None else ~F.coalesce(cancelled, F.lit(False))
    return jobs.withColumn("duplicate_of", F.min(F.when(alive, F.col(order))).over(over))
