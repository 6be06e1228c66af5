"""Pages, top-k by several keys, best of each group, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """Rows skip..skip+limit in order; 0 <= skip, 1 <= limit <= 100."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError(f"skip {skip} or limit {limit} out of range")
    return df.orderBy(*order).offset(skip).limit(limit)


def best(df: DataFrame, by: list[str], value: Column, key: Column) -> DataFrame:
    """value of the row with the smallest key of each group (a key that is a struct orders by its fields in turn)."""
    return df.groupBy(*by).agg(F.min_by(value, key).alias("best"))


def candidates(df: DataFrame, required: list[str], capabilities: Column, healthy: Column, context: Column, least_context: int) -> DataFrame:
    """Healthy rows with enough context whose capabilities hold all required ones."""
    wanted = F.array(*map(F.lit, required)) if required else F.array().cast("array<string>")
    return df.where(healthy & (context >= least_context) & (F.size(F.array_except(wanted, capabilities)) == 0))


def beyond_retention(df: DataFrame, by: list[str], name: str, keep: int) -> DataFrame:
    """Rows that are not among the `keep` newest of their group by name."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(name).desc()))).where(F.col("_n") > keep).drop("_n")


def by_custom_order(values: Column, order: list[str]) -> Column:
    """Place of a value in a list, 99 if it is not there."""
    out = F.when(values == order[0], 0)
    for i, v in enumerate(order[1:], 1):
        out = out.when(values == v, i)
    return out.otherwise(99)
