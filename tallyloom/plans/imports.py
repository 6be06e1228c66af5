"""Strict import: what is accepted and what is refused, with its reason, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import job_documents, strict
from ..sources.tables import shared_folder
from .registry import query, table


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 16 AS m FROM part), r AS (SELECT k, m, CASE m WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'not an object' WHEN 3 THEN 'duplicate key' WHEN 4 THEN 'model is missing' WHEN 5 THEN 'node must be a non-empty string'
WHEN 6 THEN 'capabilities must be a non-empty list of non-empty strings' WHEN 7 THEN 'priority is out of range' WHEN 8 THEN 'priority must be an integer' WHEN 9 THEN 'reliability is out of range' WHEN 10 THEN 'reliability must be a number'
WHEN 11 THEN 'cloud profile requires api_key_env' WHEN 13 THEN 'tier must be one of local, cloud' WHEN 14 THEN 'tier must be a non-empty string' WHEN 15 THEN CASE WHEN row_number() OVER (PARTITION BY m, k // 64 ORDER BY CAST(k + 1 AS VARCHAR)) > 1 THEN 'duplicate of another row' END END AS reason FROM p)
SELECT k AS p_partkey, reason, CASE WHEN reason IS NULL THEN CASE m WHEN 15 THEN 'm' || k // 64 ELSE 'm' || k END END AS model, CASE WHEN reason IS NULL THEN CASE m WHEN 12 THEN 'cloud' ELSE 'local' END END AS tier, CASE WHEN reason IS NULL THEN 'vllm' END AS provider, CASE WHEN reason IS NULL THEN k + 1 END AS context_tokens FROM r""")
def strict_profiles(spark, sf):
    """A profile for each part; fifteen of sixteen kinds have something about them."""
    k = F.col("p_partkey").cast("long")
    m = k % 16
    text = lambda c: c.cast("string")
    node = F.when(m == 5, '"node": "  ", ').when(m == 3, '"node": "a", "node": "b", ').when(m == 15, '"node": "dup", ').otherwise(F.concat(F.lit('"node": "n'), text(k % 50), F.lit('", ')))
    model = F.when(m == 4, "").when(m == 15, F.concat(F.lit('"model": "m'), text(F.floor(k / 64)), F.lit('", '))).otherwise(F.concat(F.lit('"model": " m'), text(k), F.lit(' ", ')))
    rest = F.concat(
        F.when(m == 6, '"capabilities": [], ').otherwise('"capabilities": ["text", "code"], '), F.when(m == 7, '"priority": -1, ').when(m == 8, '"priority": true, ').otherwise('"priority": 0, '), F.lit('"context_tokens": '), text(k + 1),
        F.lit(', "latency_ms": 5, "reliability": '), F.when(m == 9, "1.5").when(m == 10, '"x"').otherwise("0.5"),
        F.when(m == 11, ', "tier": "cloud"').when(m == 12, ', "tier": "cloud", "api_key_env": "KEY"').when(m == 13, ', "tier": "odd"').when(m == 14, ', "tier": null').otherwise(', "base_url": null'),
    )
    line = F.when(m == 1, '{"node": ').when(m == 2, "[1]").otherwise(F.concat(F.lit("{"), node, model, rest, F.lit("}")))
    rows = strict.profiles(table(spark, sf, "part").select("p_partkey", line.alias("line")))
    return rows.select("p_partkey", "reason", "model", "tier", "provider", "context_tokens")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS m, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
r AS (SELECT k, m, n, CASE m WHEN 1 THEN 'unsupported export version: 2.0' WHEN 2 THEN 'missing job' WHEN 3 THEN CASE WHEN n > 0 THEN 'videos: title is missing' END WHEN 4 THEN 'videos must be a list' WHEN 5 THEN 'segments: sequence is missing' WHEN 6 THEN CASE WHEN n > 0 THEN 'video exists already' END END AS reason FROM o)
SELECT k, reason, CASE WHEN reason IS NULL THEN n END AS videos, CASE WHEN reason IS NULL THEN 'http://x/' || k END AS video_url, CASE WHEN reason IS NULL THEN CASE m WHEN 7 THEN 'INFO' ELSE 'ERROR' END END AS level, CASE WHEN reason IS NULL THEN CASE m WHEN 7 THEN 'markdown' ELSE 'html' END END AS format FROM r""")
def strict_job_import(spark, sf):
    """A job for each order, its items as videos, written as gzipped JSON lines and read again."""
    k, m = F.col("k"), F.col("k") % 8
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("items"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k")).join(items, "k", "left").withColumn("items", F.coalesce("items", F.array()))
    video = lambda x: F.struct(F.lit("u").alias("url"), F.concat_ws("-", k.cast("string"), x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")).alias("video_id"), F.when(m != 3, "t").alias("title"))
    videos = F.when(m == 4, '{"a": 1}').otherwise(F.to_json(F.transform("items", video)))
    url = F.when(m == 7, F.concat(F.lit('"youtube_url": "http://x/'), k.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"video_url": "http://x/'), k.cast("string"), F.lit('"')))
    line = F.concat(
        F.lit('{"k": '), k.cast("string"), F.lit(', "export_version": "'), F.when(m == 1, "2.0").otherwise("1.0"), F.lit('", "job": {'), F.when(m == 2, "").otherwise(url), F.lit('}, "videos": '), videos,
        F.lit(', "transcripts": [{"full_text": "x", "segments": [{"text": "a", "start_time": 0, "end_time": 1.5'), F.when(m == 5, "").otherwise(', "sequence": 0'), F.lit('}]}], "documents": [{"title": "d", "content": "c"'),
        F.when(m == 7, "").otherwise(', "format": "html"'), F.lit('}], "logs": [{"message": "m", "level": "'), F.when(m == 7, "odd").otherwise("error"), F.lit('"}]}'),
    )
    folder = shared_folder(spark, "exports")
    rows.select(line.alias("value")).write.text(folder, compression="gzip")
    known = table(spark, sf, "lineitem").where("l_orderkey % 8 = 6").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("video_id"))
    # the key is taken before the join, which then carries no lines
    out = strict.jobs(strict.lines(spark, folder).withColumn("k", F.get_json_object("line", "$.k").cast("long")), known)
    return out.select(
        "k", "reason", F.size("job.videos").cast("long").alias("videos"), "job.video_url", F.col("job.logs")[0]["level"].alias("level"), F.col("job.documents")[0]["format"].alias("format")
    ).withColumn("videos", F.when(F.col("reason").isNull(), F.col("videos")))


@query("""WITH f AS (SELECT c_nationkey AS k, sha256(string_agg(c_custkey || ' ' || c_name || chr(10), '' ORDER BY c_custkey)) AS sha, sum(strlen(c_custkey || ' ' || c_name || chr(10))) AS n FROM customer GROUP BY 1)
SELECT 'nation=' || k AS path, CASE k % 5 WHEN 0 THEN 'extra' WHEN 1 THEN 'checksum mismatch' END AS problem, sha AS sha256, CAST(n AS BIGINT) AS size_bytes FROM f
UNION ALL SELECT 'nation=' || k || '/../x', 'invalid path', NULL, NULL FROM f WHERE k % 5 = 2 UNION ALL SELECT 'lost=' || k, 'missing', NULL, NULL FROM f WHERE k % 5 = 3""")
def manifest_verification(spark, sf):
    """A file of customers for each nation, and a manifest that leaves out, misstates and makes up some of them."""
    folder = shared_folder(spark, "bundle")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_name").alias("value"), F.col("c_nationkey").alias("nation"))
    rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", "value").write.partitionBy("nation").text(folder)
    found = job_documents.files(spark, folder).where(F.col("path").startswith("nation=")).withColumn("path", F.substring_index("path", "/", 1))
    k = F.substring_index("path", "=", -1).cast("int") % 5
    listed = found.where(k != 0).select("path", F.when(k == 1, "0").otherwise(F.col("sha256")).alias("sha256"))
    made_up = found.where(k.isin(2, 3)).select(F.when(k == 2, F.concat("path", F.lit("/../x"))).otherwise(F.replace("path", F.lit("nation"), F.lit("lost"))).alias("path"), "sha256")
    return job_documents.verified(listed.unionByName(made_up), found).join(found.select("path", "sha256", "size_bytes"), "path", "left")
