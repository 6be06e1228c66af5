"""Rules and transitions on cases whose outcome is known, and folds against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom import plans
from tallyloom.functions import nested, rules, text, times, urls
from tallyloom.operators import folds, joins, transitions


def each(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r["out"] for r in rows.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def test_texts_of_durations(spark):
    assert each(spark, [-3.0, 0.4, 59.4, 59.6, 90.0, 3599.0, 3600.0, 7500.0], times.remaining_text, "double") == ["0s", "0s", "59s", "1m", "1m", "59m", "1h", "2h 5m"]
    assert each(spark, [None, -1.0, 59.6, 61.0, 7260.4], times.elapsed_text, "double") == ["—", "0s", "1m 0s", "1m 1s", "2h 1m"]


def test_names_and_labels(spark):
    assert each(spark, ["Foo-Bar_baz qux", " A  b ", "???", "x" * 90], text.snake_case) == ["foobarbaz_qux", "a_b", "video", "x" * 80]
    found = each(spark, ["t_1: MAYBE\n t_2 - incremental\nt_2: TRANSITION\nt_3:INCREMENTALLY\nx t_4: TRANSITION\nt_5:Transition."], text.labelled_lines)[0]
    assert [tuple(r) for r in found] == [("t_2", "transition"), ("t_5", "transition")]


def test_labels_of_many_lines_take_no_more_than_their_lines(spark):
    import time

    many = "\n".join(f"t_{i % 9000}: {'TRANSITION' if i % 7 else 'INCREMENTAL'}" for i in range(20_000))
    each(spark, [many], text.labelled_lines)
    began = time.time()
    found = {x["key"]: x["label"] for x in each(spark, [many], text.labelled_lines)[0]}
    assert time.time() - began < 10
    assert len(found) == 9000 and all(found[f"t_{i % 9000}"] == ("transition" if i % 7 else "incremental") for i in range(11_000, 20_000))


def test_arrays_in_text(spark):
    def plain(t):
        depth, start = 0, -1
        for i, c in enumerate(t):
            if c == "[":
                start = i if depth == 0 else start
                depth += 1
            elif c == "]":
                depth -= 1
                if depth == 0 and start != -1:
                    return t[start : i + 1]
        return ""

    random.seed(1)
    texts = ["".join(random.choice("[]ab") for _ in range(random.randint(0, 12))) for _ in range(300)] + ["] [1]"]
    assert each(spark, texts, nested.first_array) == [plain(t) for t in texts]


@pytest.mark.parametrize(
    ("url", "refused"),
    [("http://user@127.0.0.1/", "internal"), ("http://u:p@10.0.0.1/", "internal"), ("http://[::1]/", "internal"), ("http://224.0.0.1", "internal"), ("http://240.0.0.1", "internal"), ("http://0.1.2.3", "internal"), ("http://user:p@good.org/", None), ("http://[2606:4700::1]:80/x", None), ("javascript:x", "scheme"), ("http://", "host"), ("http://172.32.0.1", None)],
)
def test_guard(spark, url, refused):
    assert each(spark, [url], urls.guard) == [refused]


def test_validators(spark):
    assert each(spark, ["ab", "abc", "a b", "x" * 256], rules.user_name) == ["length", None, "characters", "length"]
    assert each(spark, ["Abcdefg", "Abcdefg1", "abcdefg1", "ABCDEFG1", "Abcdefgh"], rules.password) == ["length", None, "upper", "lower", "digit"]
    assert each(spark, [None, "en", "zh-Hans", "e", "en-", "eng1"], rules.language_code) == [True, True, True, False, False, False]


def test_range_joins(spark):
    points = spark.createDataFrame([(1, float(t)) for t in (-5, 30, 150, 310)], "k long, t double")
    ranges = spark.createDataFrame([(1, "a", 0.0, 120.0), (1, "b", 120.0, 300.0), (1, "c", 300.0, None), (1, "open", None, 100.0), (2, "other", 0.0, 1.0)], "k long, name string, start double, end double")
    expected = {(-5.0, "open"), (30.0, "a"), (30.0, "open"), (150.0, "b"), (310.0, "c")}
    for width in (None, 7.0, 1000.0):
        found = joins.in_range(points, ranges, "k", "t", width).collect()
        assert {(r["t"], r["name"]) for r in found} == expected and len(found) == len(expected)
    lines = spark.createDataFrame([(1, 5.0, 0), (1, None, 1), (1, 9.0, 2), (1, 7.0, 3)], "k long, t double, i long")
    bounds = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 6.0), (1, 9.5), (1, None), (2, 0.0)], "k long, bound double")
    found = {(r["k"], r["bound"]): r["line"] for r in joins.locate(bounds, lines, "k", "t", "i", F.lit(-1).cast("long")).collect()}
    assert found == {(1, 0.0): 0, (1, 5.0): 0, (1, 6.0): 2, (1, 9.5): -1, (1, None): -1, (2, 0.0): -1}


def now():
    return F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")


def test_steps(spark):
    rows = spark.createDataFrame([(1, "a", "running", "t", 40), (1, "b", "pending", None, 0), (1, "c", "failed", "u", 70), (1, "d", "completed", "t", 100)], "job_id long, name string, status string, claim_token string, percent int")
    rows = rows.withColumns({"attempt": F.lit(1), "started_at": now(), "finished_at": F.lit(None).cast("timestamp_ntz")})

    def after(token, outcome):
        out = transitions.finish_steps(rows, rows.select("job_id", "name", F.lit(token).alias("token"), F.lit(outcome).alias("outcome")), now()).collect()
        return {r["name"]: (r["status"], r["percent"], r["claim_token"]) for r in out if r["applied"]}

    assert after("t", "completed") == {"a": ("completed", 100, "t")} and after("t", "failed") == {"a": ("failed", 40, "t")} and after("x", "failed") == {}
    assert after(None, "skipped") == {"b": ("skipped", 100, None)} and after(None, "retry") == {"c": ("pending", 0, None)}
    claim = lambda job, token: {r["name"]: (r["attempt"], r["claim_token"]) for r in transitions.claim_steps(rows, spark.createDataFrame([(1, job)], "job_id long, status string"), rows.select("job_id", "name", F.lit(token).alias("claim_token")), now()).collect() if r["claimed"]}
    assert claim("processing", "t") == {"a": (1, "t"), "b": (2, "t"), "c": (2, "t")} and claim("cancelled", "t") == {}


def test_slots_leave_quarantine(spark):
    rows = spark.createDataFrame([(1, "leased", -1), (2, "leased", 5), (3, "expired", -901), (4, "expired", -900), (5, "free", -9999)], "slot_id long, state string, s long")
    moved = now() + F.make_interval(secs=F.col("s"))
    rows = rows.withColumns({"expires_at": moved, "updated_at": moved, "claim_exec_uuid": F.lit("u")})
    once = transitions.expire_slots(rows, now())
    assert {r["slot_id"]: r["state"] for r in once.collect()} == {1: "expired", 2: "leased", 3: "free", 4: "expired", 5: "free"}
    later = transitions.expire_slots(once, now() + F.make_interval(secs=F.lit(901)))
    assert {r["slot_id"]: r["state"] for r in later.collect()} == {1: "free", 2: "expired", 3: "free", 4: "free", 5: "free"}


def test_watchdog(spark):
    rows = [(1, float(i * 60), i, False, i != 1) for i in range(14)] + [(2, 0.0, 0, False, True), (2, 60.0, 1, True, True)]
    out = folds.watchdog(spark.createDataFrame(rows, "k long, t double, i long, ok boolean, deps boolean"), "k", "t", "i", "ok", "deps", most=2).orderBy("k", "i").collect()
    assert [r["action"] for r in out if r["k"] == 1] == ["waiting", "dependency", "restart", "waiting", "waiting", "restart", "waiting", "waiting", "limited", "limited", "limited", "limited", "limited", "limited"]
    assert [r["failures"] for r in out if r["k"] == 2] == [1, 0]


def test_packed_sentences_fill_each_segment(spark, sf):
    """Segments are the sentences in order; one of several keeps the limit, and none had room for the sentence after it."""
    limit = 500
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(text.sentences(F.col("text")).alias("s")).select("s", folds.packed_sentences(F.col("s"), limit).alias("p")).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        words = lambda parts: " ".join(parts).split()
        assert words(r["p"]) == words(r["s"])
        rest = [s for s in r["s"] if s.strip()]
        for segment in r["p"]:
            took = 0
            while len(words(rest[:took])) < len(segment.split()):
                took += 1
            assert took == 1 or len(segment) <= limit
            rest = rest[took:]
            assert not rest or len(f"{segment} {rest[0]}".strip()) > limit
        assert not rest


IMAGE, OTHER, PART = "![Snapshot at 00:00:05](x)", "![Snapshot at 00:00:09](y)", "## [00:00:10] Part"
#: lines, and their sections: texts as they are, markers in a list
SECTIONS = [
    (["a", "b"], ["a\nb"]), ([], []), (["", "  "], []), (["a", PART, "b"], ["a", [PART], "b"]), ([IMAGE, "It ends.", "b"], ["It ends.", [IMAGE], "b"]), (["a", IMAGE, "b", "c", "d", "e"], ["a\nb\nc\nd", [IMAGE], "e"]),
    (["a", IMAGE, "b", OTHER, "c", "d", "An end!"], ["a\nb\nc\nd\nAn end!", [IMAGE], [OTHER]]), ([IMAGE, PART, "a"], [[IMAGE], [PART], "a"]), ([IMAGE, "b", PART], ["b", [IMAGE], [PART]]), ([IMAGE, "etc.", "c", "d", "e"], ["etc.\nc\nd", [IMAGE], "e"]),
    ([IMAGE, "[00:00:02] It ends!", "x"], ["[00:00:02] It ends!", [IMAGE], "x"]), ([IMAGE], [[IMAGE]]), ([IMAGE, "", "", "", "x"], [[IMAGE], "x"]),
]


def test_marked_sections(spark):
    told = lambda sections: [s["content"] if s["type"] == "text" else [s["content"]] for s in sections]
    assert [told(o) for o in each(spark, [lines for lines, _ in SECTIONS], folds.marked_sections, "array<string>")] == [x for _, x in SECTIONS]


def test_marked_sections_lose_nothing(spark):
    random.seed(5)
    pool = ["plain words", "An end.", "[00:00:01] stamped, and", "[00:00:02] It ends!", IMAGE, PART, "", "etc.", "  ", OTHER]
    rows = [[random.choice(pool) for _ in range(random.randint(0, 15))] for _ in range(150)]
    for lines, sections in zip(rows, each(spark, rows, folds.marked_sections, "array<string>"), strict=True):
        marks = {IMAGE, OTHER, PART}
        assert [s["content"] for s in sections if s["type"] == "marker"] == [x for x in lines if x in marks]
        assert " ".join(s["content"] for s in sections if s["type"] == "text").split() == " ".join(x for x in lines if x not in marks).split()


def test_answers_are_parsed_once(spark, sf):
    """A step for each bracket in one fold, which the plan names once."""
    plan = plans.QUERIES["json_sections"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_first_array_equals_a_plain_loop(spark):
    def plain(t):
        depth = begin = 0
        for at, c in enumerate(t, 1):
            begin = at if c == "[" and depth == 0 else begin
            depth += (c == "[") - (c == "]")
            if c == "]" and depth == 0 and begin:
                return t[begin - 1 : at]
        return ""

    rng = random.Random(5)
    texts = ["".join(rng.choice("[]ab\U0001f600 \n") for _ in range(rng.randrange(14))) for _ in range(400)]
    assert each(spark, [*texts, None], nested.first_array) == [*map(plain, texts), ""]
