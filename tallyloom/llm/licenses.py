"""Licence scan by a positional rare-token index, in DataFrame functions only.

The index holds, for each template, where its words stand. Document frequencies of all template words are counted over all
texts; for each template whose mandatory phrase occurs in a text, those of its words in the text that have the highest inverse
document frequency are looked up, and a posting (word at place p of the text, place q of the template) votes for the template
beginning at p - q. Where enough different words agree on one beginning, the template's label is found. No template takes
another's places, so one that stands whole in a text is found whatever else stands there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

#: fixed values: base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: fixed values: label, text and mandatory phrase of the templates (public licence texts and notices)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)
#: Words of highest inverse document frequency that are looked up for each text and template; words that must agree on a beginning (fewer
#: if a template has fewer different ones), and the share of a template's words among those looked up that must.
LOOKED_UP = 16
LEAST_AGREEING = 3
AGREEING = 0.75
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case. `lower` is many times faster and, but for two characters, changes no other character into ASCII;
    texts that hold one of those are translated letter by letter."""
    return F.when(text.contains("K") | text.contains("İ"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def has_phrase(text: Column, phrase: str) -> Column:
    """The words of the phrase stand consecutively in a lower-cased text."""
    near = phrase.split()[0]
    pattern = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + _GAP.join(map(re.escape, phrase.split())) + r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
    return text.contains(near) & text.rlike(pattern)


def places(words: Column, phrase: str) -> Column:
    """Where (from 0) the words of the phrase stand consecutively."""
    first, *rest = phrase.split()
    hit = lambda i: F.when(F.get(words, i) == first, math_and([F.get(words, i + 1 + j) == w for j, w in enumerate(rest)])).otherwise(False)
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), hit)


def math_and(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def words_of(docs: DataFrame) -> DataFrame:
    """doc_id, lower-cased text and its words; a null text is empty. Gaps are split at: that is some four times faster than to extract
    the words, and leaves an empty string at either end of some texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("low"))
    return rows.withColumn("words", F.array_remove(F.split("low", _GAP), ""))


def by_rarity(known: DataFrame) -> list[str]:
    """The template words that occur in any text (known: those of each text), rarest first; ties go to the first by name."""
    seen = known.select(F.explode("known").alias("word"))
    count = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row for each template word
    return sorted(count, key=lambda w: (count[w], w))


def read(docs: DataFrame) -> DataFrame:
    """What a scan needs of each text, taken in one pass: doc_id, content (a hash), n_words, n_base, first_word, last_word, base,
    known (its template words), templates (whose mandatory phrase it holds) and, if there are any, words."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    rows, empty = words_of(docs), F.array().cast("array<int>")
    for phrase in PHRASES:
        rows = rows.withColumn(PHRASES[phrase], F.when(has_phrase(F.col("low"), phrase), places(F.col("words"), phrase)).otherwise(empty))
    every = F.array_sort(F.flatten(F.array(*[F.col(f"`{label}`") for label in PHRASES.values()])))
    rows = rows.withColumns({"every": every, "templates": F.array_compact(F.array(*[F.when(has_phrase(F.col("low"), phrase), F.lit(k)) for k, (_, _, phrase) in enumerate(TEMPLATES)]))})
    return rows.select(
        "doc_id", F.xxhash64("low").alias("content"), F.size("words").cast("long").alias("n_words"), F.size("every").cast("long").alias("n_base"),
        F.get("every", F.lit(0)).cast("long").alias("first_word"), F.try_element_at("every", F.lit(-1)).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(F.col(f"`{label}`")) > 0, F.lit(label)) for label in sorted(PHRASES.values())])).alias("base"),
        F.array_intersect(F.array(*map(F.lit, vocabulary)), "words").alias("known"), "templates", F.when(F.size("templates") > 0, F.col("words")).alias("words"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word and last_word tell of all places of the base phrases; base_labels and labels are distinct, sorted and
    joined by commas. score is 1 with a base phrase, else the best share of a found template's looked-up words that agree on
    one beginning, else 0. Null and empty texts have no words. Repeated rows and null ids are kept; only doc_id and text are
    read. Texts are read once: what their rows tell is a table in the shared folder, from which the words are counted and vote.
    """
    rows, _ = written(read(docs))
    rarity = F.array(*map(F.lit, by_rarity(rows))).cast("array<string>")

    # Postings vote.
    distinct = lambda k: sorted(set(TEMPLATES[k][1].split()))
    postings = lambda k: F.array(*[F.struct(F.lit(w).alias("word"), F.lit(q).alias("q")) for q, w in enumerate(TEMPLATES[k][1].split())])
    rare = lambda k: F.slice(F.array_intersect("known", F.array(*map(F.lit, distinct(k)))), 1, LOOKED_UP)
    template = lambda k: F.struct(F.lit(k).alias("template"), rare(k).alias("rare"), postings(k).alias("postings"))
    open_ = F.filter(F.array(*[F.when(F.array_contains("templates", k), template(k)) for k in range(len(TEMPLATES))]), lambda t: t.isNotNull())
    may = rows.where(F.size("templates") > 0).select("doc_id", "content", "templates", "words", F.array_intersect(rarity, "known").alias("known"))
    may = may.select("doc_id", "content", open_.alias("templates"), "words")
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("p"))), lambda x: F.array_contains(F.col("t.rare"), x["word"]))
    # Outer explodes: from others Catalyst infers filters, and pushes them down with all that the arrays are made of.
    votes = may.select("doc_id", "content", F.explode_outer("templates").alias("t"), "words").where(F.col("t").isNotNull())
    votes = votes.select("doc_id", "content", "t", F.explode_outer(hits).alias("hit")).where(F.col("hit").isNotNull())
    votes = votes.select("doc_id", "content", F.col("t.template").alias("template"), F.size("t.rare").alias("held"), F.col("hit.p").alias("p"), F.explode_outer(F.filter("t.postings", lambda x: x["word"] == F.col("hit.word"))).alias("posting")).where(F.col("posting").isNotNull())
    votes = votes.groupBy("doc_id", "content", "template", "held", (F.col("p") - F.col("posting.q")).alias("begin")).agg(F.size(F.collect_set("posting.word")).alias("agree"))
    enough = F.element_at(F.create_map(*[F.lit(x) for k in range(len(TEMPLATES)) for x in (k, min(LEAST_AGREEING, len(distinct(k))))]), F.col("template"))
    label = F.element_at(F.create_map(*[F.lit(x) for k, t in enumerate(TEMPLATES) for x in (k, t[0])]), F.col("template"))
    found = votes.where((F.col("agree") >= enough) & (F.col("agree") >= AGREEING * F.col("held"))).groupBy("doc_id", "content").agg(F.collect_set(label).alias("method"), F.max(F.col("agree") / F.col("held")).alias("share"))

    out = rows.join(found.withColumnsRenamed({"doc_id": "found_id", "content": "found_content"}), F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("content") == F.col("found_content")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("method", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
