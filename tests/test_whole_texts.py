"""Queries over whole texts against brute force, on texts that are long or hold marks of the grammar themselves."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyloom import plans
from tallyloom.functions import text

LONG = "word " * 3_000
TEXTS = [
    "## Head\nplain **bold** and *it* `code`\n\n### Sub\n```py\nx = 1\n```\nend", "* a\n# b\n#c\n** open", "a\r## b\n## c\rd", "...!!! " * 40 + "The late title is here", LONG + "end**", "", "one", "<think>x</think> later <think>y",
    "thinking process: a [output] b Final answer: c ### answer d", "x " * 60 + "Here is a thinking process: y **answer** z ", "`" * 7 + "\nq\n``` ```js\nlet a\n```", "- \t-_" * 40, "Ünïcode tïtle * 2 ", "$1 \\1 ## no", "???" * 41 + " A" * 50,
]


#: a text in markdown, and its HTML
PAGES = [
    ("# A\n## B\n### C", "<p><h1>A</h1>\n<h2>B</h2>\n<h3>C</h3></p>"), ("#A\n#### D", "<p>#A\n#### D</p>"), ("a **b** *c* d", "<p>a <strong>b</strong> <em>c</em> d</p>"), ("one\n\ntwo\nthree", "<p>one</p><p>two\nthree</p>"),
    ("`x` and `y", "<p><code>x</code> and `y</p>"), ("```\nq\n```", "<p><pre><code>\nq\n</code></pre></p>"), ("a **b", "<p>a <em></em>b</p>"), ("", "<p></p>"), ("x" * 70_000 + " *y*", "<p>" + "x" * 70_000 + " <em>y</em></p>"), ("$1 \\1", "<p>$1 \\1</p>"),
]
#: an answer, and what is left without reasoning
ANSWERS = [
    ("plain", "plain"), (" kept as it is ", " kept as it is "), ("<think>a</think> b", "b"), ("x <THINK>a</Think> y", "x  y"), ("x <think>never ends", "x"), ("</think> b <think> c", "</think> b"), ("Here's a thinking process: a", ""),
    ("Thinking process: a [output] b", "b"), ("before Here is a thinking process a final answer: b Final Answer: c", "c"), ("thinking process: a [output] b ### Answer c", "c"), ("[output] a thinking process: b", ""), ("thinking process: **answer**", ""),
    ("w " * 40_000 + "thinking process: z [output generation] end ", "end"), ("", ""),
]


@pytest.mark.parametrize("rule, cases", [(text.markdown_to_html, PAGES), (text.strip_reasoning, ANSWERS)], ids=["markdown", "reasoning"])
def test_texts_and_what_becomes_of_them(spark, rule, cases):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string").select("i", rule(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: x for i, (_, x) in enumerate(cases)}


def test_queries_take_whole_texts(spark, folder):
    """The queries give for each long text what the rules give for it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    body = F.concat(F.lit("## "), "text", F.lit("\n\n**"), "text", F.lit("** `x`"))
    start = F.element_at(F.array(*map(F.lit, ("", "<think>no</think>A ", "Thinking process: ", "Here's a thinking process ... [output] x Final answer: "))), (F.col("doc_id") % 4 + 1).cast("int"))
    for name, made in (("md_to_html_whole", text.markdown_to_html(body)), ("strip_reasoning_whole", text.strip_reasoning(F.concat(start, "text")))):
        assert sorted(map(tuple, plans.QUERIES[name](spark, folder).collect())) == sorted(map(tuple, docs.select("doc_id", F.md5(made)).collect()))


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def snake(t):
    return re.sub(r"\s+", "_", re.sub(r"[^a-zA-Z0-9\s]", "", t).strip()).lower()[:80] or "video"


BRUTE = {
    "snake_case_whole": lambda i, t: [(i, snake(t))],
    "file_name_whole": lambda i, t: [(i, "".join(c for c in t if c.isalnum() or c in " _-").strip()[:60])],
    "code_blocks_whole": lambda i, t: [(i, a or "text", md5(b.strip())) for a, b in re.findall(r"(?s)```(\w+)?\n(.*?)```", f"before\n```{'' if i % 2 else 'python'}\n{t}\n```\nafter")],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    # each text with each remainder of doc_id by 4
    spark.createDataFrame([(4 * i + k, t) for i, t in enumerate(TEXTS) for k in range(4)], "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_whole_texts(spark, folder, name):
    found = sorted(tuple(r) for r in plans.QUERIES[name](spark, folder).collect())
    assert found == sorted(x for i, t in enumerate(TEXTS) for k in range(4) for x in BRUTE[name](4 * i + k, t))


def test_prompt_keeps_30000_characters_and_later_chapters(spark):
    head = "small line\n" * 2_000
    full = head + "x" * (30_000 - len(head))
    rows = [head, full, full + "tail\nCapital\n## [00:10:00] Part\nsmall\n## [00:20:00] End", full + "tail\nCapital"]
    found = [r["p"] for r in spark.createDataFrame(list(enumerate(rows)), "i long, t string").orderBy("i").select(text.prompt_text(F.col("t")).alias("p")).collect()]
    assert found == [head, full, full + "\n...\n## [00:10:00] Part\n## [00:20:00] End", full]
