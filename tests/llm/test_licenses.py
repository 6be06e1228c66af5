import re

import pytest

from tallyloom.llm import licenses

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(df):
    out = licenses.scan(df).collect()
    assert sorted(str(tuple(r)[:6]) for r in out) == sorted(str((r["doc_id"], *brute(r["text"]))) for r in df.collect())
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)
    return {r["doc_id"]: r for r in out}


def test_documents(documents):
    check(documents)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"), ("x Licensed under the Apache License, Version 2.0. y", "apache-2.0"),
        ("This is licensed under the GNU General Public License, version 3.", "gpl"), ("ALL RIGHTS\nRESERVED", "reserved"), ("the mit has a license", ""), ("apache license", ""),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"), ("généralcc by", ""), ("all rights reserved all rights reserved", "reserved"),
    ],
)
def test_labels(spark, text, labels):
    noise = [(i, "the quick fox and the license of the use under this version is permitted 2 0 you may not") for i in range(5)]
    out = check(spark.createDataFrame([(99, text), *noise], "doc_id long, text string"))
    assert out[99]["labels"] == labels


def test_several_licences_in_one_long_text(spark):
    """Each template that stands whole in a text is found, also where its words are common and others' are rare."""
    noise = [(i, "Licensed under CC BY 4.0 and CC BY-SA 4.0, see the licensed version 2 0 under nc") for i in range(40)]
    every = "\n".join(t for _, t, _ in licenses.TEMPLATES)
    three = "\n".join([licenses.TEMPLATES[2][1], licenses.TEMPLATES[8][1], "Licensed under CC BY-SA 4.0.", "the end of this and of the like " * 200])
    out = check(spark.createDataFrame([(98, every), (99, three), *noise], "doc_id long, text string"))
    assert out[99]["labels"] == "bsd,cc-by,cc-by-sa,mit"
    assert set(out[98]["labels"].split(",")) == {label for label, _, _ in licenses.TEMPLATES} | {"cc-by"}


def test_odd_rows(odd, nothing, spark):
    check(odd)
    assert licenses.scan(nothing).count() == 0
    check(spark.createDataFrame([(1, "worK CC İ by cc by"), (1, "Released under the MIT License"), (1, "Released under the MIT License"), (None, "mit license")], "doc_id long, text string"))


def test_no_python_on_the_way(spark, documents, capsys):
    licenses.scan(documents).explain()
    said = capsys.readouterr().out
    assert "Python" not in said and "Arrow" not in said and "Pandas" not in said


def test_texts_are_read_once(spark, documents, monkeypatch, capsys):
    """The words of a text are taken in one pass, which all that follows reads as a table."""
    calls, lowered = [], licenses.lowered
    monkeypatch.setattr(licenses, "lowered", lambda text: calls.append(1) or lowered(text))
    out = licenses.scan(documents)
    out.explain()
    said = capsys.readouterr().out
    assert len(calls) == 1 and "regexp_extract_all" not in said and "split" not in said


@pytest.mark.parametrize("text", ["", " ", "...", "a", " a ", ".a b.", "\n\ncc by\n", "cc  by-nc", "é ß", "İ.K"])
def test_words_at_the_ends_of_texts(spark, text):
    check(spark.createDataFrame([(1, text)], "doc_id long, text string"))
