"""JSON and array rules as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the similarity from which on a transition is incremental unasked
FAST_PATH = 0.95
#: fixed values: content types; others count as general
CONTENT_TYPES = ("intro", "conceptual", "code_walkthrough", "demo_tutorial", "conclusion", "general")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is evaluated once for a row, however often `use` or its lambdas name it."""
    return F.transform(F.array(value), use)[0]


def first_array(text: Column) -> Column:
    """The first balanced [...] of a text that begins at depth 0 (brackets in strings count, and so do closing ones before), else ''."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.lit(0).alias("end"))

    def step(s, piece):
        at = s["at"] + F.length(piece)
        opens, closes = piece.endswith("["), piece.endswith("]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        begin = F.when(opens & (s["depth"] == 0), at).otherwise(s["begin"])
        end = F.when(closes & (depth == 0) & (s["begin"] > 0), at).otherwise(0)
        told = F.struct(at.alias("at"), depth.alias("depth"), begin.alias("begin"), end.alias("end"))
        return F.when(s["end"] > 0, s).otherwise(told)

    # pieces that end with a bracket each, but for the last: a step for each bracket, not for each character
    found = F.aggregate(F.split(text, r"(?<=[\[\]])"), start, step)
    return once(found, lambda f: F.when(f["end"] > 0, F.substring(text, f["begin"], f["end"] - f["begin"] + 1)).otherwise(""))


def sections(text: Column) -> Column:
    """Array of sections of an answer in JSON (a code fence and text around it are ignored); null if there is none, or if one is no object.

    Missing fields take defaults, explicit nulls stay null, but for the type, where all that is no type is general.
    """
    got = lambda s, name, default: F.when(F.map_contains_key(s, name), s[name]).otherwise(default)
    kind = lambda s: F.when(s["content_type"].isin(*CONTENT_TYPES), s["content_type"]).otherwise("general")
    none = F.array().cast("array<string>")
    full = lambda s: F.struct(
        got(s, "title", F.lit("Untitled")).alias("title"), got(s, "start_timestamp", F.lit("00:00:00")).alias("start_timestamp"), got(s, "end_timestamp", F.lit("END")).alias("end_timestamp"),
        kind(s).alias("content_type"), got(s, "key_topics", F.lit("[]")).alias("topics"),
    )
    listed = lambda s: F.struct(*[s[c].alias(c) for c in ("title", "start_timestamp", "end_timestamp", "content_type")], F.when(s["topics"].isNotNull(), F.coalesce(F.from_json(s["topics"], "array<string>"), none)).alias("key_topics"))
    told = lambda found: F.when((F.size(found) > 0) & F.forall(found, lambda s: s.isNotNull()), F.transform(F.transform(found, full), listed))
    return once(F.from_json(first_array(text), "array<map<string, string>>"), told)


def subset(required: Column, offered: Column) -> Column:
    """All that is required is offered; nothing required is always offered, a null offer holds nothing."""
    return F.size(F.array_except(required, F.coalesce(offered, F.array().cast("array<string>")))) == 0


def model_names(body: Column) -> Column:
    """Names in a JSON body: `data[].id` if there is a data list, else `models[].name`; empty ones are left out."""
    listed = F.from_json(body, "struct<data: array<struct<id: string>>, models: array<struct<name: string>>>")
    names = F.when(listed["data"].isNotNull(), F.transform(listed["data"], lambda m: m["id"])).otherwise(F.transform(listed["models"], lambda m: m["name"]))
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != ""))


def holds_model(names: Column, model: Column, tags: bool) -> Column:
    """The model is among the names; with `tags`, a name that is the model and a tag after a colon counts."""
    return F.exists(names, lambda n: (n == model) | (n.startswith(F.concat(model, F.lit(":"))) if tags else F.lit(False)))


def live_models(listed: Column, managed: Column, ready: Column, running: Column, current: Column) -> Column:
    """A manager's list less what does not run: its current model, if it is ready, running and listed. Other lists stand."""
    none = F.array().cast("array<string>")
    alive = F.coalesce(ready & running & F.array_contains(listed, current), F.lit(False))
    return F.when(~managed, listed).when(alive, F.array(current)).otherwise(none)


def final_classification(given: Column, by_model: Column) -> Column:
    """The model's answer, else what was given, else a transition."""
    return F.coalesce(by_model, given, F.lit("transition"))


def fast_path(similarity: Column, by_model: Column, bound: float = FAST_PATH) -> Column:
    """The model's answer, which a similarity of `bound` or more makes incremental without asking."""
    return F.when(F.coalesce(similarity, F.lit(0.0)) >= bound, "incremental").otherwise(by_model)


def resume_kept(key: Column, entry: Column, cutoff: Column, prefix: str) -> Column:
    """Whether a stored entry stays: other keys and empty entries do; of the prefix only JSON with a number savedAt not before the cutoff."""
    saved = F.from_json(entry, "savedAt string")["savedAt"]
    number = entry.rlike(r'"savedAt"\s*:\s*-?[0-9]') & F.coalesce(saved, F.lit("")).rlike(r"^-?[0-9.eE+]+$")
    return ~key.startswith(prefix) | (F.coalesce(entry, F.lit("")) == "") | F.coalesce(number & (saved.try_cast("double") >= cutoff), F.lit(False))


def detail_text(detail: Column, fallback: str) -> Column:
    """Message of a JSON body: its `detail` text, or the messages of a `detail` list joined by '; ', else the fallback."""
    listed = F.from_json(detail, "struct<detail: array<struct<msg: string>>>")["detail"]["msg"]
    plain = F.get_json_object(detail, "$.detail")
    joined = F.nullif(F.array_join(listed, "; "), F.lit(""))
    return F.coalesce(joined, F.when(~plain.startswith("["), F.nullif(plain, F.lit(""))), F.lit(fallback))
