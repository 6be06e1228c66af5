"""Export of jobs with their children as nested JSON, import of such documents, and backup manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"
MAX_SNAPSHOTS = 200
EXPORT_SCHEMA = (
    "version string, job struct<job_id: string, status: string, video_url: string>, videos array<struct<video_id: string, title: string, duration: int>>, "
    "transcripts array<struct<full_text: string, language: string, segments: array<struct<sequence: int, start_time: double, end_time: double, text: string>>>>, "
    "snapshots array<struct<file_path: string, timestamp: double>>, documents array<struct<title: string, content: string>>, logs array<struct<level: string, message: string>>"
)


def with_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]], most: dict[str, int] | None = None) -> DataFrame:
    """parents with an array of each child table, in the order of the columns named; each is gathered alone and then joined,
    so that children never multiply each other. `most`: the first so many of a child."""
    for name, (table, columns) in children.items():
        listed = F.array_sort(F.collect_list(F.struct(*columns)))
        rows = table
        if most and name in most:  # only the first rows of a parent are gathered
            from pyspark.sql.window import Window

            rows = table.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*columns))).where(F.col("_n") <= most[name])
        parents = parents.join(rows.groupBy(key).agg(listed.alias(name)), key, "left")
        parents = parents.withColumn(name, F.coalesce(name, F.array().cast(dict(parents.dtypes)[name])))
    return parents


def document(df: DataFrame, columns: list[str]) -> Column:
    """One JSON text of the columns named."""
    return F.to_json(F.struct(F.lit(VERSION).alias("version"), *columns))


def write_json(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.json(path, compression=compression)


def read_json(spark: SparkSession, path: str, schema: str = EXPORT_SCHEMA) -> DataFrame:
    """Export documents, plain or gzip, in the declared schema; what does not parse is in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").json(path, multiLine=False, columnNameOfCorruptRecord="_corrupt")


def checked(documents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """documents with error: a wrong version, no job, or a video that exists already; null if it may be imported."""
    error = F.when(F.coalesce(F.col("version"), F.lit("")) != VERSION, "unsupported version").when(F.col("job").isNull(), "missing job")
    if existing is None:
        return documents.withColumn("error", error)
    known = existing.select(F.col("video_id").alias("_known")).distinct()
    rows = documents.withColumn("_row", F.monotonically_increasing_id())
    twice = rows.select("_row", F.explode("videos.video_id").alias("_known")).join(known, "_known", "left_semi").select("_row").distinct().withColumn("_twice", F.lit(True))
    return rows.join(twice, "_row", "left").withColumn("error", F.coalesce(error, F.when(F.col("_twice"), "duplicate video"))).drop("_row", "_twice")


def exploded(documents: DataFrame, key: str, child: str) -> DataFrame:
    """Rows of one child array with the key and their position."""
    return documents.select(key, F.posexplode(child).alias("position", "_c")).select(key, "position", "_c.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size_bytes of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def compared(manifested: DataFrame, found: DataFrame) -> DataFrame:
    """path and problem of manifest entries: invalid path, missing, checksum mismatch; null where all is well."""
    both = manifested.join(found.select("path", F.col("sha256").alias("_found")), "path", "left")
    invalid = F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.col("path").startswith("/")
    return both.select("path", F.when(invalid, "invalid path").when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col("sha256"), "checksum mismatch").alias("problem"))


#: Markers of a JPEG that hold its size, segments that are looked at for one, and bytes of a file that are.
_SIZED = ("FFC0", "FFC1", "FFC2", "FFC3", "FFC5", "FFC6", "FFC7", "FFC9", "FFCA", "FFCB", "FFCD", "FFCE", "FFCF")
SEGMENTS, HEAD_BYTES = 64, 1 << 20


def image_size(content: Column) -> Column:
    """kind, width and height that the first bytes of a PNG, GIF or JPEG say; null for anything else, or if they end too early."""
    head = F.substring(content, 1, HEAD_BYTES)
    digits = lambda c, at, n: F.hex(F.substring(c, at, n))
    number = lambda c, at, n: F.conv(digits(c, at, n), 16, 10).try_cast("int")
    little = lambda c, at: number(c, at, 1) + number(c, at + 1, 1) * 256
    size = lambda kind, width, height: F.struct(F.lit(kind).alias("kind"), width.alias("width"), height.alias("height"))

    def jpeg(c: Column) -> Column:
        start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("int").alias("found"))

        def step(s, _):
            marker = digits(c, s["at"], 2)
            hit = s["found"].isNull() & marker.isin(*_SIZED)
            onward = F.when(marker.startswith("FF"), s["at"] + 2 + F.coalesce(number(c, s["at"] + 2, 2), F.lit(HEAD_BYTES))).otherwise(HEAD_BYTES)
            return F.struct(F.when(s["found"].isNotNull() | hit, s["at"]).otherwise(onward).alias("at"), F.coalesce(s["found"], F.when(hit, s["at"])).alias("found"))

        at = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step)["found"]
        return F.transform(F.array(at), lambda p: F.when(p.isNotNull(), size("jpeg", number(c, p + 7, 2), number(c, p + 5, 2))))[0]

    one = lambda c: F.when(digits(c, 1, 8) == "89504E470D0A1A0A", size("png", number(c, 17, 4), number(c, 21, 4))).when(digits(c, 1, 4) == "47494638", size("gif", little(c, 7), little(c, 9))).when(digits(c, 1, 2) == "FFD8", jpeg(c))
    found = F.transform(F.array(head), one)[0]
    return F.when(found["width"].isNotNull() & found["height"].isNotNull(), found)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path (below the folder), sha256, size_bytes, and image (kind, width, height) of every file in a folder, read a file a row.

    Spark's readers pass over files without bytes, so those are not told, and verified() finds them missing.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    below = F.substring_index(F.col("path"), root, -1)
    return rows.select(below.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), image_size(F.col("content")).alias("image"))


def verified(manifested: DataFrame, found: DataFrame) -> DataFrame:
    """path and problem of a manifest's entries (path, sha256) and of the files found (path, sha256), by path.

    invalid path (null, absolute, or leading upwards), missing, checksum mismatch, or extra (a file that the manifest lacks); null where
    all is well. Entries that occur twice are told twice.
    """
    listed = manifested.select("path", F.col("sha256").alias("_listed"), F.lit(True).alias("_in"))
    invalid = F.col("path").isNull() | F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    both = listed.join(found.select("path", F.col("sha256").alias("_found"), F.lit(True).alias("_there")), "path", "full_outer")
    problem = F.when(F.col("_in").isNull(), "extra").when(invalid, "invalid path").when(F.col("_there").isNull(), "missing").when(~F.col("_found").eqNullSafe(F.col("_listed")), "checksum mismatch")
    return both.select("path", problem.alias("problem")).orderBy("path")
