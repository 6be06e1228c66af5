"""Aggregations over job steps, durations and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed values: weight of each step; other steps weigh 10
STEP_WEIGHTS = {"download": 10, "transcribe": 20, "snapshots": 15, "slides": 30, "summarize": 20, "export": 5}
DEFAULT_WEIGHT = 10
#: fixed value: jobs of history
HISTORY_JOBS = 50
#: fixed values: upper bounds of latency buckets in seconds
LATENCY_BOUNDS = (0.05, 0.1, 0.5, 1.0, 5.0)


def step_weight(name: Column, weights: dict[str, int] = STEP_WEIGHTS) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), name), F.lit(DEFAULT_WEIGHT))


def progress(steps: DataFrame, by: list[str], percent: Column, weight: Column, status: Column) -> DataFrame:
    """Weighted progress: 100 if completed; failed and cancelled stay as they are, others are kept within 0..100."""
    total = F.expr("_weighted div _weights")
    out = steps.groupBy(*by).agg(F.sum(F.coalesce(percent, F.lit(0)) * weight).alias("_weighted"), F.sum(weight).alias("_weights"), F.first(status).alias("_status"))
    value = F.when(F.col("_weights") == 0, None).when(F.col("_status") == "completed", 100).when(F.col("_status").isin("failed", "cancelled"), total).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))
    return out.select(*by, value.cast("long").alias("progress"))


def newest_jobs(jobs: DataFrame, mode: str, created: str, job: str, limit: int = HISTORY_JOBS) -> DataFrame:
    """The `limit` newest jobs of each mode: what durations are estimated from. Ties go to the greater job."""
    over = Window.partitionBy(mode).orderBy(F.col(created).desc(), F.col(job).desc())
    return jobs.withColumn("_n", F.row_number().over(over)).where(F.col("_n") <= limit).drop("_n")


def step_statistics(history: DataFrame, by: str | list[str], seconds: str) -> DataFrame:
    """median and p90 of each step's durations, n of them.

    The exact 90th value is found by rank, not by gathering a step's values: counts of each duration are summed first.
    """
    by = [by] if isinstance(by, str) else by
    counts = history.groupBy(*by, seconds).agg(F.count("*").alias("c"))
    totals = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    over = Window.partitionBy(*by).orderBy(seconds).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(over)).join(totals, by)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(seconds)))
    n = F.col("n")
    low, high, tail = F.floor((n - 1) / 2), F.floor(n / 2), F.least(n - 1, F.floor(n * F.lit(0.9)))
    return ranked.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median"), at(tail).alias("p90"), F.max("n").alias("n"))


def eta(open_steps: DataFrame, statistics: DataFrame, by: str | list[str], job: str, percent: Column, jobs_in_history: Column) -> DataFrame:
    """eta_low, eta_high, confidence of each job: medians and 90th values of its open steps, less what is done of them."""
    left = F.lit(1.0) - percent / 100.0
    out = open_steps.join(statistics, by, "left").groupBy(job).agg(F.sum(F.col("median") * left).alias("_low"), F.sum(F.col("p90") * left).alias("_high"), F.max(jobs_in_history).alias("_n"))
    confidence = F.when(F.col("_n") >= 10, "high").when(F.col("_n") >= 5, "medium").when(F.col("_n") >= 3, "low").otherwise("cold")
    warm = F.col("_n") >= 3
    low = F.round(F.coalesce("_low", F.lit(0.0)), 1)
    return out.select(job, F.when(warm, low).alias("eta_low"), F.when(warm, F.greatest(low, F.round(F.coalesce("_high", F.lit(0.0)), 1))).alias("eta_high"), confidence.alias("confidence"))


def latency_bucket(seconds: Column, bounds=LATENCY_BOUNDS) -> Column:
    """Smallest bound above the latency as text, `inf` beyond all; not cumulative."""
    out = F.when(seconds < bounds[0], str(bounds[0]))
    for b in bounds[1:]:
        out = out.when(seconds < b, str(b))
    return out.otherwise("inf")


def layout_vote(df: DataFrame, by: str, pip: Column, split: Column, share: float = 0.4) -> DataFrame:
    """`pip_speaker` if enough rows vote for it, else `split_panel` if enough do, else `full_frame`."""
    n = F.count("*")
    return df.groupBy(by).agg(F.when(F.count_if(pip) >= share * n, "pip_speaker").when(F.count_if(split) >= share * n, "split_panel").otherwise("full_frame").alias("layout"))


def missing_evidence(counts: DataFrame, columns: list[str]) -> DataFrame:
    """names of the columns whose count is below 1 (sorted, joined by commas) and the verdict."""
    empty = F.array_compact(F.array(*[F.when(F.col(c) < 1, F.lit(c)) for c in sorted(columns)]))
    return counts.select(F.array_join(empty, ",").alias("missing"), F.when(F.size(empty) == 0, "PASS").otherwise("FAIL").alias("verdict"))
