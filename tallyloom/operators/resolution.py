"""Which provider, model and address a user's requests go to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_filled = lambda c: F.nullif(F.col(c), F.lit(""))


def resolved(owners: DataFrame, nodes: DataFrame, defaults: dict[str, str], fallback: str, address: str, own: str = "vllm") -> DataFrame:
    """owners with provider, model, base_url replaced by those in effect, and node.

    owners: provider, model, base_url, null or empty where not chosen. nodes: position, node, url, models; those without a url
    are left out. Who uses the provider `own` without a model takes the first model of the first node that has any; others take
    their provider's default. A model of `own` is looked for on the first node that has it.
    """
    up = nodes.where(_filled("url").isNotNull())
    where = up.select("position", "node", "url", F.explode("models").alias("model")).groupBy("model").agg(F.min_by(F.struct("node", "url"), "position").alias("at"))
    first = up.where(F.size("models") > 0).agg(F.min_by(F.get("models", F.lit(0)), "position").alias("adopted"))  # one row
    provider = F.coalesce(_filled("provider"), F.lit(own))
    default = F.coalesce(*[F.when(F.col("provider") == k, v) for k, v in defaults.items()], F.lit(fallback))
    rows = owners.withColumn("provider", provider).crossJoin(F.broadcast(first))
    rows = rows.withColumn("model", F.coalesce(_filled("model"), F.when(F.col("provider") == own, F.col("adopted")), default)).drop("adopted")
    rows = rows.withColumn("asked", F.when(F.col("provider") == own, F.col("model")))
    rows = rows.join(where.withColumnRenamed("model", "asked"), "asked", "left")
    return rows.withColumn("base_url", F.coalesce(_filled("base_url"), "at.url", F.lit(address))).withColumn("node", F.col("at.node")).drop("asked", "at")
