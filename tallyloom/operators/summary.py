"""Summaries in two passes: a first outside call tells a transcript's sections, a second one summarises each section.

Calls are made once: their answers are written before anything depends on them. What a call fails on, or answers with what cannot be
read, falls back by row: a transcript without readable sections goes through a single pass over its marked sections, a section
without a summary keeps its text. A summary that is reasoning only is asked for once more. All between the calls are Column
expressions on the transcript's row; a section is a row only while its summary is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested, text
from ..functions.lines import CHAPTER, seconds, typed_lines
from ..functions.times import format_clock
from ..sources.tables import written
from .boundary import Answerer, answered
from .folds import marked_sections

#: What a section of each type is asked for; prompts are parameters of the operator.
INSTRUCTIONS = {
    "intro": "Tell the reader what is covered, which prerequisites and tools are needed and what can be learned.",
    "conceptual": "Explain the concept: its principles, its terms and how they belong together.",
    "code_walkthrough": "Go through the code in order and say what each part of it does and why; quote code as such.",
    "demo_tutorial": "Give step-by-step instructions with the commands, settings and results that are shown.",
    "conclusion": "State the takeaways and the next steps.",
    "general": "Give one or two short paragraphs, then the main facts as bullet points.",
}
PLAIN = "Give one or two short paragraphs, then the main facts as bullet points. State facts; do not mention a speaker, a video or a transcript."
NO_REASONING = "Answer with the result only, without any reasoning, steps or drafts.\n\n"
BODY = "\n\nText:\n"
IMAGES = "array<struct<timestamp: double, image_url: string>>"


def analysis_prompt(transcript: Column) -> Column:
    """Asks for the sections of a transcript as a JSON array; long transcripts are cut, but for their chapter lines."""
    chapters = "A line that begins with '## [HH:MM:SS]' is a chapter: keep its title and time, tell its type and two to four topics."
    free = "There are no chapters: find three to eight sections by topic, with a title, times taken from the lines, a type and two to four topics."
    fields = f"Answer with a JSON array only, of objects with title, start_timestamp (HH:MM:SS), end_timestamp (HH:MM:SS or END), content_type (one of {', '.join(nested.CONTENT_TYPES)}) and key_topics (strings)."
    return F.concat(F.when(transcript.rlike(f"(?m){CHAPTER}"), chapters).otherwise(free), F.lit("\n" + fields + BODY), text.prompt_text(transcript))


def _image(s: Column) -> Column:
    return F.concat(F.lit("![Snapshot at "), format_clock(F.floor(s["timestamp"])), F.lit("]("), F.coalesce(s["image_url"], F.lit("")), F.lit(")"))


def sliced(transcript: Column, analyses: Column, images: Column) -> Column:
    """Sections with their texts and images: array of title, kind, topics, content, images.

    A section's lines go from the first one stamped at or after its start (else the text's beginning) to before the first one at or
    after its end (else the text's end); chapter and image lines are left out. Its images are those in [start, end); an open or
    unreadable bound bounds nothing.
    """

    def one(lines: Column, stamps: Column, a: Column, start: Column, end: Column) -> Column:
        first = lambda bound, other: F.when(bound.isNull(), other).otherwise(F.coalesce(F.try_element_at(F.filter(stamps, lambda x: x["seconds"] >= bound), F.lit(1))["at"], other))
        held = lambda low: F.slice(lines, low + 1, F.greatest(first(end, F.size(lines)) - low, F.lit(0)))
        kept = F.filter(nested.once(first(start, F.lit(0)), held), lambda x: ~x["kind"].isin("chapter", "image"))
        inside = F.filter(images, lambda s: (start.isNull() | (s["timestamp"] >= start)) & (end.isNull() | (s["timestamp"] < end)))
        return F.struct(a["title"].alias("title"), a["content_type"].alias("kind"), a["key_topics"].alias("topics"), text.strip(F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("content"), inside.alias("images"))

    def every(lines: Column, stamps: Column) -> Column:
        bounds = lambda a: F.struct(seconds(a["start_timestamp"]).alias("start"), F.when(a["end_timestamp"] != "END", seconds(a["end_timestamp"])).alias("end"))
        return F.transform(analyses, lambda a: nested.once(bounds(a), lambda b: one(lines, stamps, a, b["start"], b["end"])))

    # a text's lines, its stamps and a section's bounds are taken once, not where they are named
    return nested.once(typed_lines(transcript), lambda lines: nested.once(F.filter(lines, lambda x: x["seconds"].isNotNull()), lambda stamps: every(lines, stamps)))


def with_images(transcript: Column, images: Column) -> Column:
    """Lines of a transcript, each image after the line of the latest stamp not after it (the first of equals); others are left out."""
    stamped = lambda lines: F.transform(F.filter(lines, lambda x: x["seconds"].isNotNull()), lambda x: F.struct(x["seconds"].alias("seconds"), (-x["at"]).alias("back")))
    put = lambda stamps: F.transform(images, lambda s: F.struct((-F.array_max(F.filter(stamps, lambda x: x["seconds"] <= s["timestamp"]))["back"]).alias("at"), _image(s).alias("line")))
    shown = lambda lines, placed: F.flatten(F.transform(lines, lambda x: F.concat(F.array(x["line"]), F.transform(F.filter(placed, lambda p: p["at"] == x["at"]), lambda p: p["line"]))))
    # lines are typed once and images placed once for a text, not for each line
    return nested.once(typed_lines(transcript), lambda lines: nested.once(nested.once(stamped(lines), put), lambda placed: shown(lines, placed)))


def header(title: Column, url: Column, kind: Column) -> Column:
    """A title, a source and a rule; null without a title."""
    source = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("\n\nSource: "), url, F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise("")))
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.coalesce(source, F.lit("")), F.lit("\n\n---")))


def summarised(items: DataFrame, keys: list[str], prompt: Column, content: str, answer: Answerer) -> DataFrame:
    """keys and summary of items: the answer without reasoning; asked again, without reasoning, if there was nothing else; the content
    itself where the call fails or gives nothing. Blank contents are not asked for and have an empty summary."""
    blank = text.strip(F.coalesce(F.col(content), F.lit(""))) == ""
    first = written(answered(items.select(*keys, F.when(~blank, prompt).alias("_prompt")), keys, "_prompt", answer))
    both = items.join(first, keys).withColumn("_said", text.strip(F.coalesce("answer", F.lit("")))).withColumn("_clean", text.strip_reasoning(F.col("_said")))
    again = (F.col("_said") != "") & (F.col("_clean") == "")
    second = written(answered(both.where(again).select(*keys, F.concat(F.lit(NO_REASONING), prompt).alias("_prompt")), keys, "_prompt", answer))
    second = second.select(*keys, F.nullif(text.strip_reasoning(text.strip(F.coalesce("answer", F.lit("")))), F.lit("")).alias("_second"))
    kept = F.when(blank, "").when(F.col("_clean") != "", F.col("_clean")).otherwise(F.coalesce("_second", content))
    return both.join(second, keys, "left").select(*keys, kept.alias("summary"))


def two_pass(transcripts: DataFrame, images: DataFrame | None, key: str, answer: Answerer, instructions: dict[str, str] = INSTRUCTIONS, plain: str = PLAIN) -> DataFrame:
    """key, passes (2, or 1 for a fallback), n_sections and summary of each transcript (key, text, title, url, source_type).

    Keys are unique; a null text counts as empty. images: key, timestamp, image_url; those of one transcript are held in its row.
    """
    body = transcripts.withColumn("text", F.coalesce("text", F.lit("")))
    if images is None:
        body = body.withColumn("images", F.array().cast(IMAGES))
    else:
        shown = images.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("timestamp").cast("double").alias("timestamp"), F.col("image_url").cast("string").alias("image_url")))).alias("images"))
        body = body.join(shown, key, "left").withColumn("images", F.coalesce("images", F.array().cast(IMAGES)))
    first = written(answered(body.select(key, analysis_prompt(F.col("text")).alias("_prompt")), [key], "_prompt", answer))
    told = body.join(first.select(key, nested.sections(F.col("answer")).alias("analyses")), key)
    timed = F.forall("analyses", lambda a: a["start_timestamp"].isNotNull() & a["end_timestamp"].isNotNull())
    usable = F.col("analyses").isNotNull() & timed
    told = written(told.withColumn("two", F.coalesce(usable, F.lit(False))))

    named = F.transform("analyses", lambda a: F.concat(F.coalesce(a["title"], F.lit("None")), F.lit(" ("), a["content_type"], F.lit(")")))
    # outer explodes: from others Catalyst infers filters that take the sections again
    sections = told.where("two").select(key, F.concat(F.lit("Part of: "), F.array_join(named, "; ")).alias("context"), F.posexplode_outer(sliced(F.col("text"), F.col("analyses"), F.col("images"))).alias("position", "s")).where("s IS NOT NULL")
    sections = sections.select(key, "position", "context", "s.*").withColumn("title", F.coalesce("title", F.lit("None")))
    asked = F.lit(instructions["general"])
    for kind, words in instructions.items():
        asked = F.when(F.col("kind") == kind, words).otherwise(asked)
    topics = F.when(F.size("topics") > 0, F.array_join("topics", ", ")).otherwise("general topics")
    prompt = F.concat(asked, F.lit("\n\nSection: "), "title", F.lit("\nTopics: "), topics, F.lit("\n"), "context", F.lit(BODY), "content")
    parts = written(sections)
    parts = parts.join(summarised(parts, [key, "position"], prompt, "content", answer), [key, "position"])
    shown = F.when(F.size("images") > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform("images", _image), "\n"))).otherwise("")
    parts = parts.select(key, "position", F.concat(F.lit("## "), "title", F.lit("\n\n"), "summary", shown).alias("part"))

    single = told.where("NOT two").select(key, F.posexplode_outer(marked_sections(with_images(F.col("text"), F.col("images")))).alias("position", "s")).where("s IS NOT NULL").select(key, "position", "s.type", "s.content")
    single = written(single)
    texts = single.where("type = 'text'")
    texts = texts.select(key, "position").join(summarised(texts, [key, "position"], F.concat(F.lit(plain + BODY), "content"), "content", answer).withColumnRenamed("summary", "part"), [key, "position"])
    parts = parts.unionByName(texts).unionByName(single.where("type = 'marker'").select(key, "position", F.col("content").alias("part")))

    joined = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "part"))).alias("parts"))
    out = told.join(joined, key, "left")
    content = F.nullif(F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"), F.lit(""))
    whole = F.concat_ws("\n\n", header(F.col("title"), F.col("url"), F.col("source_type")), content)
    return out.select(key, F.when(F.col("two"), 2).otherwise(1).alias("passes"), F.when(F.col("two"), F.size("analyses")).otherwise(0).alias("n_sections"), whole.alias("summary"))
