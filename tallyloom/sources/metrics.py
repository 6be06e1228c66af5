"""Metric texts: rendering counters and reading gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rendered(metrics: DataFrame) -> DataFrame:
    """name and text of metrics (name, kind, help, value): HELP and TYPE lines and the value; sorting by name is the writer's."""
    text = F.concat_ws("\n", F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"), F.concat_ws(" ", "name", F.col("value").cast("string")))
    return metrics.select("name", text.alias("text"))


def gauges(lines: DataFrame, prefix: str) -> DataFrame:
    """name and value of gauge lines that begin with the prefix: the value is the last token if it is a number."""
    row = lines.where(F.col("value").startswith(prefix)).withColumn("_last", F.regexp_extract("value", r"(\S+)\s*$", 1)).where("_last <> ''")
    return row.select(F.regexp_extract("value", r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1).alias("name"), F.expr("try_cast(_last AS double)").alias("value"))
