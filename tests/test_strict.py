"""Strict reading by hand-made lines; whole tables are compared with SQL in test_queries."""

import gzip

from tallyloom.sources import strict

GOOD = '{"node": " a ", "model": "m", "capabilities": ["x "], "priority": 0, "context_tokens": 1, "latency_ms": 1, "reliability": 1}'


def reasons(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    out = strict.profiles(rows)
    accepted, refused = strict.split(out, [f.name for f in strict.PROFILE])
    assert accepted.count() + refused.count() == len(lines) and "reason" not in accepted.columns
    return {r["i"]: r for r in out.collect()}


def test_profiles(spark):
    change = lambda old, new: GOOD.replace(old, new)
    lines = [
        GOOD, "", "nonsense", "3", '{"node": "a", "node": "b"}', change('"m"', "3"), change('"m"', '" "'), change('["x "]', '["x", ""]'), change('["x "]', '["x", 1]'), change('["x "]', '"x"'), change('"priority": 0', '"priority": 1.5'),
        change('"latency_ms": 1', '"latency_ms": 0'), change('"reliability": 1', '"reliability": true'), change('"reliability": 1', '"reliability": -0.1'), GOOD[:-1] + ', "provider": null}', change('"m"', '"m2"')[:-1] + ', "provider": "p", "base_url": null, "more": {"a": 1}}', None, change('"priority": 0', '"priority": 1'),
    ]
    got = reasons(spark, lines)
    assert (got[0]["node"], got[0]["capabilities"], got[0]["tier"], got[0]["provider"], got[0]["base_url"]) == ("a", ["x"], "local", "vllm", None)
    texts = "capabilities must be a non-empty list of non-empty strings"
    assert [got[i]["reason"] for i in range(len(lines))] == [
        None, "invalid JSON", "invalid JSON", "not an object", "duplicate key", "model must be a non-empty string", "model must be a non-empty string", texts, texts, texts, "priority must be an integer",
        "latency_ms is out of range", "reliability must be a number", "reliability is out of range", "provider must be a non-empty string", None, "invalid JSON", "duplicate of another row",
    ]


def test_jobs_from_gzip(spark, tmp_path):
    job = '{"export_version": "1.0", "job": {"video_url": "u"}'
    lines = [job + "}", job + ', "videos": [{"url": "u", "video_id": "v", "title": null}]}', job + ', "snapshots": [{"file_path": "p"}]}', job + ', "logs": 3}', '{"job": {}}', '{"export_version": "1.0", "job": null}', "x", job + ', "videos": [{"url": "u", "video_id": "w", "title": "t"}]}']
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write("\n".join([*lines, "", "  "]))
    (tmp_path / "b.json").write_text(lines[0])
    rows = strict.lines(spark, str(tmp_path))
    assert rows.count() == len(lines) + 1
    got = {r["line"]: r for r in strict.jobs(rows, spark.createDataFrame([("w",), (None,)], "video_id string")).collect()}
    assert [got[x]["reason"] for x in lines] == [None, None, "snapshots: timestamp is missing", "logs must be a list", "unsupported export version: none", "missing job", "invalid JSON", "video exists already"]
    first = got[lines[0]]["job"]
    assert first["video_url"] == "u" and first["videos"] == first["transcripts"] == first["logs"] == [] and got[lines[2]]["job"] is None
    assert strict.jobs(rows.where("false")).count() == 0


def test_lines_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    part = '{"export_version": "1.0", "job": {"video_url": "u"}, "videos": [{"url": "u", "video_id": "v%d", "title": "t"}]}'
    lines = [(i, part % i) for i in range(6)] + [(6, " [1]"), (7, '\t{"a": 1}'), (8, "3"), (9, '{"export_version": "1.0", "job": {"video_url": "u"}, "videos": null}')]
    rows = spark.createDataFrame(lines, "i int, line string").mapInArrow(run, "i int, line string")
    out = {r["i"]: r["reason"] for r in strict.jobs(rows, spark.createDataFrame([("v1",), ("v4",), (None,)], "video_id string")).collect()}
    assert read.value == len(lines)
    assert out == {i: "video exists already" if i in (1, 4) else None for i in range(6)} | {6: "not an object", 7: "unsupported export version: none", 8: "not an object", 9: "videos must be a list"}
