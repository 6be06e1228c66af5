"""Captions, nested documents, manifests, metrics."""

import gzip
import json

from pyspark.sql import functions as F

from tallyloom.functions import nested, times, urls
from tallyloom.operators import transitions
from tallyloom.sources import captions, job_documents, metrics


def test_caption_lines(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<b>Hello</b>\n2\n0:00:03,500 --> 0:00:04,000\nagain\nHello\n01:02.000 --> 01:03.000\n")
    out = captions.caption_lines(captions.read(spark, str(tmp_path))).orderBy("position").collect()
    assert [r["line"] for r in out] == ["[00:00:01] Hello", "[00:00:03] again", "[00:00:03] 01:02.000 --> 01:03.000"]


def test_stamped_lines(spark):
    rows = spark.createDataFrame([(1, "# Title\nSource: x\nfirst\n[00:00:05] a\nb\n[00:00:09]\nc")], "k long, t string")
    out = captions.stamped_lines(rows, "k", "t").orderBy("position").collect()
    assert [(r["ts"], r["text"]) for r in out] == [(0.0, "first"), (5.0, "a"), (5.0, "b"), (9.0, "c")]


def test_documents_round_trip_and_checks(spark, tmp_path):
    good = {"version": "1.0", "job": {"job_id": "j", "status": "done", "video_url": "u"}, "videos": [{"video_id": "v1", "title": "t", "duration": 3}], "snapshots": [{"file_path": "p", "timestamp": 1.5}]}
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, [good, good | {"version": "0.9"}, good | {"videos": [{"video_id": "old"}]}])))
    docs = job_documents.read_json(spark, str(tmp_path))
    existing = spark.createDataFrame([("old",)], "video_id string")
    assert sorted(str(r["error"]) for r in job_documents.checked(docs, existing).collect()) == ["None", "duplicate video", "unsupported version"]
    assert job_documents.exploded(docs.select("job.job_id", "snapshots"), "job_id", "snapshots").first()["timestamp"] == 1.5


def test_manifest(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    found = job_documents.manifest(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    wanted = spark.createDataFrame([("f", "0"), ("g", "1"), ("../h", "2")], "path string, sha256 string")
    assert {r["path"]: r["problem"] for r in job_documents.compared(wanted, found).collect()} == {"f": "checksum mismatch", "g": "missing", "../h": "invalid path"}
    assert job_documents.compared(found, found).first()["problem"] is None


def test_gauges(spark):
    lines = spark.createDataFrame([("vllm:num_requests_running{a=\"b\"} 3.0",), ("vllm:num_requests_waiting x",), ("other 1",)], "value string")
    out = {r["name"]: r["value"] for r in metrics.gauges(lines, "vllm:num_requests_").collect()}
    assert out == {"vllm:num_requests_running": 3.0, "vllm:num_requests_waiting": None}


def test_clocks_and_urls(spark):
    rows = spark.createDataFrame([("[01:23:45]", "https://youtu.be/abcdefghijk"), ("[05:30]", "https://vimeo.com/12"), ("42", "https://x.org/a.mp4?x")], "t string, u string")
    out = rows.select(times.parse_clock_loose(F.col("t")).alias("s"), urls.classify(F.col("u")).alias("f")).collect()
    assert [r["s"] for r in out] == [5025, 330, 0]
    assert [r["f"]["kind"] for r in out] == ["youtube", "vimeo", "direct"]
    assert [r["f"]["native_id"] for r in out][:2] == ["abcdefghijk", "12"]


def test_json_arrays(spark):
    rows = spark.createDataFrame([("x [1,[2]] y]",), ("[",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(nested.first_array(F.col("t"))).collect()] == ["[1,[2]]", "", "", ""]


def test_detail_text(spark):
    rows = spark.createDataFrame([('{"detail": "no"}',), ('{"detail": [{"msg": "a"}, {"msg": "b"}]}',), ('{"detail": ""}',), ("{}",)], "t string")
    assert [r[0] for r in rows.select(nested.detail_text(F.col("t"), "fallback")).collect()] == ["no", "a; b", "fallback", "fallback"]


def test_claims_need_a_free_or_orphaned_step(spark):
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 10:00:00'")
    steps = spark.sql("""SELECT * FROM VALUES (1, 'a', 'pending', 0, NULL, NULL), (2, 'a', 'running', 1, TIMESTAMP_NTZ '2024-01-01 09:00:00', 'x'),
        (3, 'a', 'running', 1, TIMESTAMP_NTZ '2024-01-01 07:59:59', 'y'), (4, 'a', 'completed', 1, NULL, NULL) AS t(job_id, name, status, attempt, started_at, claim_token)""")
    commands = steps.select("job_id", "name", F.lit("new").alias("claim_token"))
    jobs = steps.select("job_id", F.lit("processing").alias("status"))
    out = {r["job_id"]: (r["status"], r["attempt"], r["claimed"]) for r in transitions.claim_steps(steps, jobs, commands, at).collect()}
    assert out == {1: ("running", 1, True), 2: ("running", 1, False), 3: ("running", 2, True), 4: ("completed", 1, False)}
