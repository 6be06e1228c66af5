"""Stems, the search syntax, phrases and ranks; searches with stems against brute force over whole documents."""

import re

import pytest

from tallyloom.functions.stemming import stem
from tallyloom.operators import fulltext
from tallyloom.plans import QUERIES
from tallyloom.plans.search import ENGLISH

#: fixed values: words of the algorithm's published sample, each with its stem
SAMPLE = """consign consign consigned consign consignment consign consistency consist consistently consist consolations consol consolatory consolatori
consolidating consolid consolingly consol consonant conson consorting consort conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl
constancy constanc knackeries knackeri knaves knave knavish knavish kneeling kneel knees knee knightly knight knitting knit knives knive knocker knocker knots knot""".split()
OTHERS = {"kubernetes": "kubernet", "controllers": "control", "configuring": "configur", "hopping": "hop", "hoping": "hope", "generically": "generic", "relational": "relat", "cries": "cri", "ties": "tie", "skies": "sky", "dying": "die", "succeeding": "succeed", "yy": "yy", "sayings": "say", "it's": "it"}


def test_stems():
    pairs = list(zip(SAMPLE[::2], SAMPLE[1::2], strict=True)) + list(OTHERS.items())
    assert [(w, s, stem(w)) for w, s in pairs if stem(w) != s] == []


def shape(q, config="simple"):
    return [[("-" if o.negated else "") + " ".join(f"{t}@{at}" for at, t in o.terms) for o in b] for b in fulltext.parsed(q, config).branches]


@pytest.mark.parametrize(
    "q, branches",
    [
        ("a b", [["a@0", "b@0"]]), ("a or b c", [["a@0"], ["b@0", "c@0"]]), ('"a b" -c', [["a@0 b@1", "-c@0"]]), ('-"a b"', [["-a@0 b@1"]]), ("a-b", [["a@0 b@1"]]),
        ("or a", [["or@0", "a@0"]]), ("a or", [["a@0", "or@0"]]), ('"a b', [["a@0 b@1"]]), ("", []), ("!! --", []), ("a OR -b", [["a@0"], ["-b@0"]]), ('""', []),
    ],
)
def test_syntax(q, branches):
    assert shape(q) == branches


def test_stop_words_leave_gaps():
    assert shape('"rise of the machines"', "english") == [["rise@0 machin@3"]]
    assert shape("the", "english") == [] and shape("the or cats", "english") == [["cat@0"]]


@pytest.fixture(scope="module")
def index(spark):
    texts = [
        (1, "This tutorial explains how to configure a Kubernetes ingress controller."), (2, "A completely unrelated video about baking sourdough bread."),
        (3, "We are configuring several ingress controllers today."), (4, "The rise of the machines"), (5, "the machines rise"), (6, None), (7, ""), (8, "bread bread bread"), (9, "bread and a very long text about other things " * 300),
    ]
    return fulltext.index(spark.createDataFrame(texts, "id long, body string").repartition(3), "id", "body")


def keys(index, q):
    return sorted(r["key"] for r in fulltext.search(index, q).collect())


def test_searches(index):
    assert keys(index, "kubernetes") == [1] and keys(index, "controller") == [1, 3] and keys(index, "CONFIGURED controllers") == [1, 3]
    assert keys(index, '"rise of the machine"') == [4] and keys(index, "rise machines") == [4, 5] and keys(index, '"ingress controller" -kubernetes') == [3]
    assert keys(index, "sourdough or kubernetes") == [1, 2] and keys(index, "nothing") == [] and keys(index, "the of") == [] and keys(index, "") == []
    assert keys(index, "-bread") == [1, 3, 4, 5, 6, 7] and keys(index, "-bread -machines or sourdough") == [1, 2, 3, 6, 7]
    ranks = {r["key"]: r["rank"] for r in fulltext.search(index, "bread").collect()}
    assert sorted(ranks) == [2, 8, 9] and ranks[8] > ranks[2] > 0


def test_only_the_query_s_postings_are_read(spark, index, capsys):
    fulltext.of_terms(index, ["kubernet"]).explain()
    said = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[.*bucket", said) and re.search(r"PushedFilters: \[.*term", said)


def test_empty_table(spark):
    assert keys(fulltext.index(spark.createDataFrame([], "id long, body string"), "id", "body"), "bread or -bread") == []


def test_english_searches_equal_brute_force(spark, sf):
    texts = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall(r"[^\W_]+", (r["text"] or "").lower())
        texts[r["doc_id"]] = [fulltext.lexeme(w, "english") for w in words]

    def holds(words, operand):
        (_, first), *_ = operand.terms
        at = any(w == first and all(words[i + d : i + d + 1] == [t] for d, t in operand.terms) for i, w in enumerate(words))
        return at != operand.negated

    expected = set()
    for n, q in enumerate(ENGLISH):
        branches = fulltext.parsed(q).branches
        expected |= {(n, d) for d, words in texts.items() if any(all(holds(words, o) for o in b) for b in branches)}
    rows = QUERIES["full_text_search_english"](spark, sf).collect()
    assert {(r["search"], r["doc_id"]) for r in rows} == expected and len(rows) == len(expected) > 0


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, "a b a" * (i % 3)) for i in range(50)], "id long, body string").mapInArrow(run, "id long, body string")
    index = fulltext.index(docs, "id", "body", "simple")
    assert read.value == 50 and index.texts.count() == 50 and index.total["texts"] == 50


def test_blocks_of_words_change_nothing(spark, monkeypatch):
    texts = [(1, "b x b"), (2, None), (2, "x"), (None, "the x"), (4, ""), (5, "c the b x")]
    docs = spark.createDataFrame(texts, "id long, body string").coalesce(1)
    expected = sorted([("b", 1, [0, 2], 3), ("x", 1, [1], 3), ("x", 2, [0], 1), ("x", None, [1], 2), ("c", 5, [0], 4), ("b", 5, [2], 4), ("x", 5, [3], 4)], key=str)
    for most in (1, 4, 500_000):
        monkeypatch.setattr(fulltext, "BLOCK_WORDS", most)
        assert sorted(map(tuple, fulltext.postings(docs, "id", "body").collect()), key=str) == expected
