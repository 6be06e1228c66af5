"""Strict reading of JSON lines: every line is either accepted, typed and with its defaults, or refused for its first reason.

Lines are parsed to variants once, in the JVM; what is wrong is told by expressions on the variant, field by field in the order of the
rules. Nothing is dropped: accepted and refused rows together are all lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .tables import written

#: Words for what a kind wants, and the types of a variant that satisfy it.
KINDS = {"text": ("a non-empty string", "STRING"), "whole": ("an integer", "BIGINT"), "number": ("a number", r"BIGINT|DOUBLE|DECIMAL.*"), "texts": ("a non-empty list of non-empty strings", r"ARRAY<.*"), "any": ("present", ".*"), "list": ("a list", r"ARRAY<.*")}
SQL_TYPES = {"text": "string", "whole": "bigint", "number": "double", "texts": "array<string>"}


@dataclass(frozen=True)
class Field:
    """A key of an object: its kind, whether it must be there, what stands in for it, and its least and greatest value or its values."""

    name: str
    kind: str = "text"
    required: bool = True
    default: object = None
    least: float | None = None
    most: float | None = None
    values: tuple[str, ...] = ()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path and line of each non-blank line of the JSON-lines files in a folder, plain or gzip."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return rows.where(F.trim("line") != "")


def parsed(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows with the line's variant as `v` (null if it is none) and `reason` (invalid JSON, duplicate key, not an object, or null)."""
    v = F.try_parse_json(line)
    # of what is JSON, objects alone begin with a brace; the schema of a whole line would cost more than its parsing
    told = F.when(F.col("v").isNotNull(), F.when(~F.col(line).rlike(r"^[\x20\t\r\n]*\{"), "not an object"))
    # a parser that lets the last of equal keys win reads what the variant's refuses
    twice = F.from_json(F.concat(F.lit('{"x":'), F.col(line), F.lit("}")), "x string")["x"].isNotNull() & F.get_json_object(line, "$").isNotNull()
    return rows.withColumn("v", v).withColumn("reason", F.when(F.col("v").isNull(), F.when(twice, "duplicate key").otherwise("invalid JSON")).otherwise(told))


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _is(value: Column, kind: str) -> Column:
    """Whether a variant, which is there, is of a kind."""
    fits = F.schema_of_variant(value).rlike(f"^(?:{KINDS[kind][1]})$")
    if kind == "text":
        return fits & (strip(F.try_variant_get(value, "$", "string")) != "")
    if kind == "texts":
        each = F.try_variant_get(value, "$", "array<variant>")
        return fits & (F.size(each) > 0) & F.forall(each, lambda x: F.coalesce(_is(x, "text"), F.lit(False)))
    return fits


def problem(v: Column, field: Field) -> Column:
    """Why the object v is refused for a field, or null. A JSON null is as good as no key where the field may lack and has no default."""
    value = _get(v, field.name)
    optional = not field.required and field.default is None
    there = value.isNotNull() & (F.schema_of_variant(value) != "VOID") if optional else value.isNotNull()
    wants = KINDS[field.kind][0]
    wrong = ~F.coalesce(_is(value, field.kind), F.lit(False))
    out = F.when(there & wrong, f"{field.name} must be {wants}")
    if field.required:
        out = F.when(~there, f"{field.name} is missing").otherwise(out)
    if field.least is not None or field.most is not None:
        n = _get(v, field.name, "double")
        low = F.lit(False) if field.least is None else n < field.least
        high = F.lit(False) if field.most is None else n > field.most
        out = F.coalesce(out, F.when(there & (low | high), f"{field.name} is out of range"))
    if field.values:
        out = F.coalesce(out, F.when(there & ~_get(v, field.name, "string").isin(*field.values), f"{field.name} must be one of {', '.join(field.values)}"))
    return out


def value(v: Column, field: Field) -> Column:
    """The field's value in its SQL type, texts without white space around them, or its default."""
    got = _get(v, field.name, SQL_TYPES[field.kind])
    got = strip(got) if field.kind == "text" else F.transform(got, strip) if field.kind == "texts" else got
    return F.coalesce(got, F.lit(field.default)) if field.default is not None else got


def read(rows: DataFrame, fields: list[Field], key: list[str], also: list[tuple[Column, str]] = (), line: str = "line") -> DataFrame:
    """rows with reason (null: accepted) and, for what is accepted, the fields' values.

    also: further conditions that refuse, with their reasons; they may name the fields. Of accepted rows of equal key the first by line
    is kept and the others are refused as duplicates.
    """
    out = parsed(rows, line)
    reason = F.col("reason")
    for field in fields:
        reason = F.coalesce(reason, problem(F.col("v"), field))
    out = out.withColumn("reason", reason).withColumns({f.name: value(F.col("v"), f) for f in fields}).drop("v")
    for condition, why in also:
        out = out.withColumn("reason", F.coalesce("reason", F.when(condition, why)))
    if key:
        # refused rows have a key of their own each, so that they do not meet in one task
        alone = F.when(F.col("reason").isNotNull(), F.concat(F.col(line), F.monotonically_increasing_id().cast("string")))
        out = out.withColumn("_alone", alone)
        over = Window.partitionBy("_alone", *key).orderBy(line)
        out = out.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(over) > 1, "duplicate of another row"))).drop("_alone")
    return out.withColumns({f.name: F.when(F.col("reason").isNull(), F.col(f.name)) for f in fields})


def split(rows: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without a reason, refused rows without the fields."""
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL").drop(*fields)


#: fixed values: fields of a model's profile, and of each part of an exported job; what has no default may lack where not required
PROFILE = [
    Field("node"), Field("model"), Field("capabilities", "texts"), Field("priority", "whole", least=0), Field("context_tokens", "whole", least=1), Field("latency_ms", "whole", least=1), Field("reliability", "number", least=0, most=1),
    Field("tier", required=False, default="local", values=("local", "cloud")), Field("provider", required=False, default="vllm"), Field("base_url", required=False), Field("api_key_env", required=False),
]
EXPORT_VERSION = "1.0"
PARTS = {
    "videos": ("url", "video_id", "title"), "transcripts": ("full_text",), "snapshots": ("file_path", "timestamp"), "documents": ("title", "content"), "logs": ("message",),
}
SEGMENT = ("text", "start_time", "end_time", "sequence")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")
JOB = (
    "struct<job: struct<video_url: string, youtube_url: string>, videos: array<struct<url: string, video_id: string, title: string, description: string, duration: double>>, "
    "transcripts: array<struct<full_text: string, language: string, source: string, segments: array<struct<text: string, start_time: double, end_time: double, speaker: string, sequence: bigint>>>>, "
    "snapshots: array<struct<file_path: string, timestamp: double, detected_text: string>>, documents: array<struct<title: string, content: string, format: string>>, logs: array<struct<level: string, message: string, step: string>>>"
)


def profiles(rows: DataFrame) -> DataFrame:
    """Profiles of models: a row for each line, with its reason or its fields; a cloud profile names its key, node and model are unique."""
    return read(rows, PROFILE, ["node", "model"], [((F.col("tier") == "cloud") & F.col("api_key_env").isNull(), "cloud profile requires api_key_env")])


def _lacks(items: Column, names: tuple[str, ...]) -> Column:
    """Name of the first of the keys that an item of an array of variants lacks, or null."""
    out = None
    for name in names:
        missing = F.exists(items, _without(name))
        out = F.when(missing, name) if out is None else out.when(missing, name)
    return out


def _without(name: str):
    return lambda x: _get(x, name).isNull()


def jobs(rows: DataFrame, existing: DataFrame | None = None, line: str = "line") -> DataFrame:
    """Exported jobs: rows with reason and job.

    Refused are: no JSON object, another version, no job, a part that is no list or an item that lacks a required key, a video_id
    that exists already (existing: video_id). Missing parts are empty. Defaults: the language en, the format markdown, the level
    INFO (also for unknown ones); an older address stands in for a missing one.
    """
    out = parsed(rows, line)
    v = F.col("v")
    version = _get(v, "export_version", "string")
    reason = F.coalesce("reason", F.when(F.coalesce(version, F.lit("")) != EXPORT_VERSION, F.concat(F.lit("unsupported export version: "), F.coalesce(version, F.lit("none")))))
    job = _get(v, "job")
    reason = F.coalesce(reason, F.when(job.isNull() | F.schema_of_variant(job).isin("VOID", "OBJECT<>"), "missing job"))
    none = F.array().cast("array<variant>")
    # a part is taken as a list once for each row
    out = out.withColumn("_items", F.struct(*[_get(v, part, "array<variant>").alias(part) for part in PARTS]))
    items = {part: F.coalesce(F.col("_items")[part], none) for part in PARTS}
    for part, names in PARTS.items():
        whole = _get(v, part)
        reason = F.coalesce(reason, F.when(whole.isNotNull() & F.col("_items")[part].isNull(), f"{part} must be a list"))
        reason = F.coalesce(reason, F.concat(F.lit(f"{part}: "), _lacks(items[part], names), F.lit(" is missing")))
    segments = F.flatten(F.transform(items["transcripts"], lambda t: F.coalesce(_get(t, "segments", "array<variant>"), none)))
    reason = F.coalesce(reason, F.concat(F.lit("segments: "), _lacks(segments, SEGMENT), F.lit(" is missing")))
    body = F.from_json(line, JOB)
    out = out.withColumn("reason", reason).withColumn("_b", body)
    b = F.col("_b")
    empty = lambda part: F.coalesce(b[part], F.array())
    full = F.struct(
        F.coalesce(F.nullif(b["job"]["video_url"], F.lit("")), b["job"]["youtube_url"]).alias("video_url"), empty("videos").alias("videos"),
        F.transform(empty("transcripts"), lambda t: t.withField("language", F.coalesce(t["language"], F.lit("en"))).withField("segments", F.coalesce(t["segments"], F.array()))).alias("transcripts"),
        empty("snapshots").alias("snapshots"), F.transform(empty("documents"), lambda d: d.withField("format", F.coalesce(d["format"], F.lit("markdown")))).alias("documents"),
        F.transform(empty("logs"), lambda x: x.withField("level", F.when(F.upper(x["level"]).isin(*LEVELS), F.upper(x["level"])).otherwise("INFO"))).alias("logs"),
    )
    out = out.withColumn("job", F.when(F.col("reason").isNull(), full)).drop("v", "_b", "_items")
    if existing is not None:
        known = existing.select(F.col("video_id").alias("_known")).where("_known IS NOT NULL").distinct()
        # rows of one line share their outcome; lines are read and parsed once, as both sides of the join read the written rows
        out = written(out.withColumn("_row", F.md5(line)))
        twice = out.select("_row", F.explode("job.videos.video_id").alias("_known")).join(known, "_known", "left_semi").select("_row").distinct().withColumn("_twice", F.lit(True))
        out = out.join(twice, "_row", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_twice"), "video exists already")))
        out = out.withColumn("job", F.when(F.col("reason").isNull(), F.col("job"))).drop("_row", "_twice")
    return out
