"""The two-pass summary by hand-made cases; whole documents are compared with SQL in test_queries."""

import json
import sys
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyloom.functions import nested
from tallyloom.functions.lines import typed_lines
from tallyloom.operators import boundary, summary

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import this file

TALK = "\n".join(
    ["[00:00:01] Welcome to all.", "[00:00:10] Today we bake.", "[00:01:30] You need flour.", "## [00:02:00] The dough", "[00:02:05] First mix it.", "[00:03:00] Then wait.", "## [00:05:00] The end", "[00:05:05] That is all."]
)
SECTIONS = [
    {"title": "Start", "start_timestamp": "00:00:00", "end_timestamp": "00:02:00", "content_type": "intro", "key_topics": ["flour", "oven"]},
    {"title": "The dough", "start_timestamp": "00:02:00", "end_timestamp": "00:05:00", "content_type": "demo_tutorial", "key_topics": []},
    {"title": "The end", "start_timestamp": "00:05:00", "end_timestamp": "END", "content_type": "conclusion"},
]
IMAGES = [(1, 150.0, "b.png"), (1, 30.0, "a.png"), (1, 310.0, "c.png")]


def run(spark, answer, text=TALK, title=None, url=None, images=IMAGES):
    texts = spark.createDataFrame([(1, text, title, url, "web")], "id long, text string, title string, url string, source_type string")
    shown = spark.createDataFrame(images, "id long, timestamp double, image_url string") if images is not None else None
    return summary.two_pass(texts, shown, "id", answer).first()


def model(first, second):
    return lambda prompts: [first(p) if "JSON array" in p.partition(summary.BODY)[0] else second(p) for p in prompts]


def echo(p):
    head = p.partition(summary.BODY)[0]
    return "About " + head.split("Section: ")[1].split("\n")[0] if "Section: " in head else f"Plain {len(p.partition(summary.BODY)[2].splitlines())}"


def test_both_passes(spark):
    r = run(spark, model(lambda p: f"```json\n{json.dumps(SECTIONS)}\n``` done", echo), title="Bread", url="http://x")
    assert (r["passes"], r["n_sections"]) == (2, 3)
    assert r["summary"].split("\n\n") == [
        "# Bread", "Source: http://x (web)", "---", "## Start", "About Start", "![Snapshot at 00:00:30](a.png)", "## The dough", "About The dough", "![Snapshot at 00:02:30](b.png)", "## The end", "About The end", "![Snapshot at 00:05:10](c.png)",
    ]


def test_prompts_hold_the_section_s_lines_topics_and_context(spark):
    seen = model(lambda p: json.dumps(SECTIONS), lambda p: p)
    said = run(spark, seen, images=None)["summary"]
    start, dough, end = said.split("## ")[1:]
    assert "Today we bake." in start and "flour, oven" in start and "First mix it." not in start and summary.INSTRUCTIONS["intro"] in start
    assert "First mix it." in dough and "general topics" in dough and "That is all." in end and "[00:02:00] The dough" not in dough
    assert all("Part of: Start (intro); The dough (demo_tutorial); The end (conclusion)" in x for x in (start, dough, end))


def fail(p):
    raise ConnectionError


def test_bad_first_answers_fall_back_to_one_pass(spark):
    bad = [fail, lambda p: "", lambda p: "not json", lambda p: "[]", lambda p: '{"key": 1}', lambda p: "[1, 2]", lambda p: '[{"title": "x", "start_timestamp": null}]']
    texts = spark.createDataFrame([(i, TALK.replace("to all", f"to {i}"), "Bread", None, None) for i in range(len(bad))], "id long, text string, title string, url string, source_type string")
    shown = spark.createDataFrame([(i, t, u) for i in range(len(bad)) for _, t, u in IMAGES], "id long, timestamp double, image_url string")
    which = lambda p: bad[int(p.split("Welcome to ")[1].split(".")[0])](p)
    rows = summary.two_pass(texts, shown, "id", model(which, echo)).collect()
    assert len(rows) == len(bad)
    for r in rows:
        assert (r["passes"], r["n_sections"]) == (1, 0)
        # images stand after the line of their stamp and wait for the sentence to end
        assert r["summary"].split("\n\n") == [
            "# Bread", "---", "Plain 3", "![Snapshot at 00:00:30](a.png)", "## [00:02:00] The dough", "Plain 2", "![Snapshot at 00:02:30](b.png)", "## [00:05:00] The end", "Plain 1", "![Snapshot at 00:05:10](c.png)",
        ]


def test_second_answers(spark):
    """Each transcript says which answer it gets, and which after being asked again."""
    think = "Thinking process: hm"
    cases = [(None, None, "text 0"), (" ", None, "text 1"), ("<think>a</think> b ", None, "b"), (think, "done", "done"), (think, think, "text 4"), (think, None, "text 5"), (think, "", "text 6")]

    def second(p):
        again = p.startswith(summary.NO_REASONING)
        said = cases[int(p.rsplit("text ", 1)[1])][again]
        return fail(p) if said is None else said

    texts = spark.createDataFrame([(i, f"text {i}", None, None, None) for i in range(len(cases))], "id long, text string, title string, url string, source_type string")
    rows = summary.two_pass(texts, None, "id", model(lambda p: '[{"title": "T"}]', second)).collect()
    assert {r["id"]: r["summary"] for r in rows} == {i: f"## T\n\n{c[2]}" for i, c in enumerate(cases)}


def test_odd_transcripts(spark):
    assert run(spark, model(fail, echo), text=None, images=None)["summary"] == ""
    assert run(spark, model(fail, echo), text="", title="x")["summary"] == "# x\n\n---"
    assert run(spark, model(lambda p: '[{"title": "a", "start_timestamp": "soon", "end_timestamp": "later"}]', echo), text="no stamps", images=[])["summary"] == "## a\n\nAbout a"
    assert summary.two_pass(spark.createDataFrame([], "id long, text string, title string, url string, source_type string"), None, "id", model(fail, echo)).count() == 0


def test_explicit_nulls_stay(spark):
    answers = ['[{"title": null, "key_topics": null, "content_type": null, "more": {"a": [1]}}]', '[{"start_timestamp": "00:00:00"}]', '[{"title": "x", "key_topics": ["a", "b"]}, 3]', "x"]
    rows = spark.createDataFrame([(a,) for a in answers], "a string").coalesce(1).select(nested.sections(F.col("a"))).collect()
    assert [None if r[0] is None else [tuple(s) for s in r[0]] for r in rows] == [[(None, "00:00:00", "END", "general", None)], [("Untitled", "00:00:00", "END", "general", [])], None, None]


def test_calls_are_made_once_and_alone_after_a_failed_batch(spark):
    seen = spark.sparkContext.accumulator(0)

    def answer(prompts):
        seen.add(len(prompts))
        if len(prompts) > 1:
            raise TimeoutError
        return [None if prompts[0] == "b" else prompts[0] * 2]

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "k int, p string").coalesce(1)
    assert [tuple(r) for r in boundary.answered(rows, ["k"], "p", answer).collect()] == [(1, "aa"), (2, None), (3, None), (4, "cc")]
    assert seen.value == 6  # three together, then each alone; nothing for the null


def test_lines_are_read_once(spark):
    kinds = [("[00:00:05] a", "stamped", 5, "a"), ("## [00:01:00] b", "chapter", 60, "b"), ("![Snapshot at 00:00:01](x)", "image", None, "![Snapshot at 00:00:01](x)"), ("plain [00:00:01]", "plain", None, "plain [00:00:01]"), ("", "plain", None, "")]
    got = spark.createDataFrame([("\n".join(k[0] for k in kinds),)], "t string").select(F.explode(typed_lines(F.col("t"))).alias("x")).select("x.line", "x.kind", "x.seconds", "x.body").collect()
    assert [tuple(r) for r in got] == kinds
    long = spark.createDataFrame([("\n".join(f"[00:00:{i % 60:02d}] line {i}" for i in range(20_000)),)], "t string")
    count = lambda: long.select(F.size(F.filter(typed_lines(F.col("t")), lambda x: x["seconds"] >= 0))).first()[0]
    count()
    began = time.time()
    assert count() == 20_000 and time.time() - began < 5


def test_lines_are_typed_once(spark):
    """However often the rules name a text's lines: they are split in one place of the plan, outside of what is done for each line."""
    rows = spark.createDataFrame([("x", [{"title": "t"}])], "text string, analyses array<map<string, string>>")
    plan = lambda column: rows.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("split(text")
    images = F.array().cast(summary.IMAGES)
    assert plan(summary.sliced(F.col("text"), F.col("analyses"), images)) == 1 and plan(summary.with_images(F.col("text"), images)) == 1
