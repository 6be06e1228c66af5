"""Caption files (VTT, SRT) and stamped transcript text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip, without_tags

_CUE = r"^(\d{1,2}):(\d{2}):(\d{2})[.,]\d+\s*-->"
_STAMP = r"^\[(\d{2}):(\d{2}):(\d{2})\]\s*(.*)$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """file and raw text of caption files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))


def caption_lines(files: DataFrame) -> DataFrame:
    """file, position, line of caption files (file, raw): header, number and cue lines go, marks are stripped, and of equal
    texts of a file the first stays. A cue line without an hour is kept as text."""
    lines = files.select("file", F.posexplode(F.split("raw", r"\r\n|\r|\n")).alias("position", "raw")).withColumn("raw", strip(F.col("raw")))
    lines = lines.where((F.col("raw") != "") & ~F.col("raw").rlike(r"^(WEBVTT|NOTE|STYLE)|^\d+$"))
    part = lambda i: F.lpad(F.regexp_extract("raw", _CUE, i), 2, "0")
    lines = lines.withColumn("stamp", F.when(F.col("raw").rlike(_CUE), F.concat(F.lit("["), part(1), F.lit(":"), part(2), F.lit(":"), part(3), F.lit("]"))))
    over = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("at", F.last("stamp", ignorenulls=True).over(over)).where("stamp IS NULL").withColumn("text", without_tags(F.col("raw"))).where("text <> ''")
    first = lines.withColumn("_n", F.row_number().over(Window.partitionBy("file", "text").orderBy("position"))).where("_n = 1")
    return first.select("file", "position", F.concat_ws(" ", "at", "text").alias("line"))


def stamped_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, ts, text of transcript lines: a line without a stamp has the last one's time (at first 0); headings,
    `Source:` and `Language:` lines go; an empty stamped line moves the clock and gives no row."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("position", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    part = lambda i: F.regexp_extract("line", _STAMP, i).cast("bigint")
    stamped = F.col("line").rlike(_STAMP)
    lines = lines.withColumn("stamp", F.when(stamped, (part(1) * 3600 + part(2) * 60 + part(3)).cast("double")))
    lines = lines.withColumn("text", F.when(stamped, strip(F.regexp_extract("line", _STAMP, 4))).otherwise(F.col("line")))
    over = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("ts", F.coalesce(F.last("stamp", ignorenulls=True).over(over), F.lit(0.0)))
    keep = stamped & (F.col("text") != "") | ~stamped & ~F.col("line").rlike("^(#|Source:|Language:)")
    return lines.where(keep).select(key, "position", "ts", "text")


def best_track(tracks: DataFrame, job: str, language: str, is_generated: str, position: str, requested: str) -> DataFrame:
    """One track for each job: the requested language, else the first manual one, else the first listed."""
    rank = F.when(F.col(language) == F.col(requested), 0).when(~F.col(is_generated), 1).otherwise(2)
    return tracks.withColumn("_n", F.row_number().over(Window.partitionBy(job).orderBy(rank, position))).where("_n = 1").drop("_n")
