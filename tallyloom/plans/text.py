"""Text rules over documents, conversations and pages; texts get marks of the grammar at hand where the data has none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested, text, times, urls
from ..operators import folds, joins
from ..sources import captions
from .registry import query, table


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("""SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock, printf('%d:%02d', s // 60, s % 60) AS short,
CASE WHEN event_id % 7 = 0 THEN '—' WHEN r < 0 THEN '0s' WHEN r >= 3600 THEN (r // 3600) || 'h ' || (r % 3600 // 60) || 'm' WHEN r >= 60 THEN (r // 60) || 'm ' || (r % 60) || 's' ELSE r || 's' END AS elapsed
FROM (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s, CAST(floor(CASE WHEN event_id % 5 = 0 THEN -value ELSE value * 60 END + 0.5) AS BIGINT) AS r FROM events)""")
def ts_format(spark, sf):
    s = F.col("value") * 60
    spent = F.when(F.col("event_id") % 7 != 0, F.when(F.col("event_id") % 5 == 0, -F.col("value")).otherwise(s))
    return table(spark, sf, "events").select("event_id", times.format_clock(s).alias("clock"), times.format_minutes(s).alias("short"), times.elapsed_text(spent).alias("elapsed"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value * 60) AS BIGINT) END AS seconds FROM events""")
def ts_parse(spark, sf):
    clock = times.format_clock(F.col("value") * 60)
    return table(spark, sf, "events").select("event_id", times.parse_clock(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), clock)).otherwise(clock)).alias("seconds"))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value * 30 - 100 END AS a, CASE WHEN event_id % 3 <> 0 THEN value * 20 END AS b FROM events),
r AS (SELECT event_id, a, b, greatest(0, CAST(floor(least(a, b) + 0.5) AS BIGINT)) AS x, greatest(0, CAST(floor(greatest(a, b) + 0.5) AS BIGINT)) AS y FROM v),
t AS (SELECT *, CASE WHEN x < 60 THEN x || 's' WHEN x < 3600 THEN (x // 60) || 'm' WHEN x // 60 % 60 = 0 THEN (x // 3600) || 'h' ELSE (x // 3600) || 'h ' || (x // 60 % 60) || 'm' END AS f,
CASE WHEN y < 60 THEN y || 's' WHEN y < 3600 THEN (y // 60) || 'm' WHEN y // 60 % 60 = 0 THEN (y // 3600) || 'h' ELSE (y // 3600) || 'h ' || (y // 60 % 60) || 'm' END AS u FROM r)
SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'eta ' || f || '–' || u WHEN a IS NOT NULL THEN 'eta ~' || f WHEN b IS NOT NULL THEN 'eta up to ' || f END AS eta FROM t""")
def eta_text(spark, sf):
    low, high = F.when(F.col("event_id") % 5 != 0, F.col("value") * 30 - 100), F.when(F.col("event_id") % 3 != 0, F.col("value") * 20)
    return table(spark, sf, "events").select("event_id", times.range_text(low, high).alias("eta"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE greatest(0, least(100, value * 3 - 50)) END AS shown FROM events""")
def shown_progress(spark, sf):
    return table(spark, sf, "events").select("event_id", times.shown_progress(F.when(F.col("event_id") % 7 != 0, F.col("value") * 3 - 50)).alias("shown"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1""")
def compact_date(spark, sf):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("2024-1-7")
    return table(spark, sf, "orders").select("o_orderkey", times.compact_date(raw).alias("day"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT DISTINCT doc_id, line, regexp_replace(line, '\\s+$', '') AS s FROM l),
k AS (SELECT *, regexp_extract(s, '(\\S+)$', 1) AS token FROM t), m AS (SELECT *, regexp_replace(token, '\\.+$', '') AS stem FROM k)
SELECT doc_id, md5(line) AS line, CASE WHEN s = '' THEN false WHEN regexp_matches(s, '[!?]$') THEN true WHEN NOT suffix(s, '.') THEN false ELSE NOT (suffix(s, '...')
OR lower(token) IN ('mr.', 'mrs.', 'ms.', 'dr.', 'prof.', 'sr.', 'jr.', 'etc.', 'e.g.', 'i.e.', 'vs.', 'approx.', 'dept.', 'est.', 'incl.', 'govt.', 'corp.', 'inc.', 'ltd.', 'fig.', 'eq.', 'ch.', 'vol.', 'no.', 'nos.', 'min.', 'max.', 'avg.', 'st.', 'ave.', 'blvd.')
OR regexp_matches(token, '^\\p{Lu}\\.$') OR stem = '' OR regexp_matches(replace(regexp_replace(stem, '^[-$€£¥]+', ''), ',', ''), '^\\d+$') OR regexp_matches(stem, '^(?:\\d*\\.)+\\d*$')
OR (contains(stem, '.') AND regexp_matches(stem, '^[\\p{L}\\p{N}]*(?:\\.[\\p{L}\\p{N}]*)+$'))) END AS ends FROM m""")
def sentence_end(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.select("doc_id", F.md5("line").alias("line"), text.ends_sentence(F.col("line")).alias("ends"))


@query("""SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN regexp_replace('A ' || text, '^\\s+|\\s+$', '', 'g') WHEN 2 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END) AS answer FROM documents""")
def strip_reasoning(spark, sf):
    t = F.col("text")
    raw = F.when(F.col("doc_id") % 4 == 0, t).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<think>no</think>A "), t))
    raw = raw.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Thinking process: "), t)).otherwise(F.concat(F.lit("Here's a thinking process ... [output] x Final answer: "), t))
    return docs(spark, sf).select("doc_id", F.md5(text.strip_reasoning(raw)).alias("answer"))


@query()
def strip_reasoning_whole(spark, sf):
    """As strip_reasoning, over whole texts, whatever marks they hold themselves."""
    t, kind = F.col("text"), F.col("doc_id") % 4
    raw = F.when(kind == 0, t).when(kind == 1, F.concat(F.lit("<think>no</think>A "), t)).when(kind == 2, F.concat(F.lit("Thinking process: "), t))
    raw = raw.otherwise(F.concat(F.lit("Here's a thinking process ... [output] x Final answer: "), t))
    return docs(spark, sf).select("doc_id", F.md5(text.strip_reasoning(raw)).alias("answer"))


@query(r"""WITH a AS (SELECT doc_id, '## ' || text || chr(10) || chr(10) || '**' || text || '** `x`' AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^### ([^\n]*)$', '<h3>\1</h3>', 'g'), '(?m)^## ([^\n]*)$', '<h2>\1</h2>', 'g'), '(?m)^# ([^\n]*)$', '<h1>\1</h1>', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\*\*([^\n]*?)\*\*', '<strong>\1</strong>', 'g'), '\*([^\n]*?)\*', '<em>\1</em>', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?s)```(.*?)```', '<pre><code>\1</code></pre>', 'g'), '`([^\n]*?)`', '<code>\1</code>', 'g') AS t FROM c)
SELECT doc_id, md5('<p>' || replace(t, chr(10) || chr(10), '</p><p>') || '</p>') AS html FROM d""")
def md_to_html(spark, sf):
    return md_to_html_whole(spark, sf)


@query()
def md_to_html_whole(spark, sf):
    """Every document, its whole text as heading and as bold text, whatever marks it holds itself."""
    raw = F.concat(F.lit("## "), "text", F.lit("\n\n**"), "text", F.lit("** `x`"))
    return docs(spark, sf).select("doc_id", F.md5(text.markdown_to_html(raw)).alias("html"))


_SNAKE = """SELECT doc_id, CASE WHEN s = '' THEN 'video' ELSE s END AS name FROM
(SELECT doc_id, left(lower(regexp_replace(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+', '_', 'g')), 80) AS s FROM documents)"""


@query(_SNAKE)
def snake_case(spark, sf):
    return docs(spark, sf).select("doc_id", text.snake_case(F.col("text")).alias("name"))


@query(_SNAKE)
def snake_case_whole(spark, sf):
    return snake_case(spark, sf)


@query("""SELECT doc_id, left(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N} _-]', '', 'g'), '^\\s+|\\s+$', '', 'g'), 60) AS name, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short FROM documents""")
def file_name(spark, sf):
    return docs(spark, sf).select("doc_id", text.safe_file_name(F.col("text")).alias("name"), text.truncated(F.col("text"), 50).alias("short"))


@query("""SELECT doc_id, left(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N} _-]', '', 'g'), '^\\s+|\\s+$', '', 'g'), 60) AS name FROM documents""")
def file_name_whole(spark, sf):
    return docs(spark, sf).select("doc_id", text.safe_file_name(F.col("text")).alias("name"))


@query("""SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS characters FROM pages""")
def strip_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]+>", "")).cast("bigint").alias("characters"))


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(len(regexp_extract_all(text, '[.!?]')) AS BIGINT) AS marks FROM documents""")
def count_chars(spark, sf):
    return docs(spark, sf).select("doc_id", F.length("text").cast("bigint").alias("n"), F.regexp_count("text", F.lit("[.!?]")).cast("bigint").alias("marks"))


@query("""WITH s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS p FROM documents),
c AS (SELECT doc_id, length(text) AS n, len(p) AS k, len(list_filter(p, lambda x: regexp_matches(x, '^\\p{Lu}'))) / greatest(len(p), 1) AS u, len(regexp_extract_all(text, '[.!?]')) / greatest(length(text), 1) AS m FROM s)
SELECT doc_id, least(1.0, round(CAST(0.85 AS DOUBLE) + CASE WHEN n > 10000 THEN 0.05 WHEN n < 100 THEN -0.1 ELSE 0 END + CASE WHEN k > 5 THEN 0.03 ELSE 0 END + CASE WHEN u > 0.8 THEN 0.05 ELSE 0 END + CASE WHEN m > 0.01 AND m < 0.1 THEN 0.02 ELSE 0 END, 6)) AS score FROM c""")
def confidence_score(spark, sf):
    return docs(spark, sf).select("doc_id", text.confidence_score(F.col("text")).alias("score"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'text' END AS language, md5(regexp_replace(replace(text, '`', ''), '^\\s+|\\s+$', '', 'g')) AS code FROM documents""")
def code_blocks(spark, sf):
    fence = F.when(F.col("doc_id") % 2 == 0, "```python\n").otherwise("```\n")
    raw = F.concat(F.lit("before\n"), fence, F.replace("text", F.lit("`"), F.lit("")), F.lit("\n```\nafter"))
    return docs(spark, sf).select("doc_id", F.explode(text.code_blocks(raw)).alias("b")).select("doc_id", "b.language", F.md5("b.code").alias("code"))


@query()
def code_blocks_whole(spark, sf):
    """As code_blocks, over whole texts with the fences that they hold themselves."""
    fence = F.when(F.col("doc_id") % 2 == 0, "```python\n").otherwise("```\n")
    raw = F.concat(F.lit("before\n"), fence, "text", F.lit("\n```\nafter"))
    return docs(spark, sf).select("doc_id", F.explode(text.code_blocks(raw)).alias("b")).select("doc_id", "b.language", F.md5("b.code").alias("code"))


@query("""SELECT conv_id, turn, 't_' || turn AS key, CASE role WHEN 'user' THEN 'transition' ELSE 'incremental' END AS label FROM conversations WHERE role <> 'system'
UNION ALL SELECT conv_id, turn, 't_0' || turn, 'incremental' FROM conversations""")
def label_parse(spark, sf):
    """Lines of other labels do not count, and the last line of a key does."""
    n = F.col("turn").cast("string")
    label = F.when(F.col("role") == "user", "TRANSITION").when(F.col("role") == "assistant", "Incremental: sure").otherwise("MAYBE")
    raw = F.concat(F.lit("noise\n t_0"), n, F.lit(" - transition\n t_"), n, F.lit(": "), label, F.lit("\nt_0"), n, F.lit(":incremental\nt_0"), n, F.lit(": INCREMENTALLY\nT: x"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(text.labelled_lines(raw)).alias("l")).select("conv_id", "turn", "l.key", "l.label")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[1,[2,' || event_id || ']]' WHEN 1 THEN '[x]' ELSE '' END AS found FROM events""")
def json_array_extract(spark, sf):
    e, kind = F.col("event_id").cast("string"), F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("so: [1,[2,"), e, F.lit("]] and [3]"))).when(kind == 1, "a [x] ] [y]").when(kind == 2, "] [1]").otherwise(F.concat(F.lit("none [ "), e))
    return table(spark, sf, "events").select("event_id", nested.first_array(raw).alias("found"))


@query("""SELECT event_id, event_type AS title, 'END' AS end_timestamp, ['intro', 'conceptual', 'code_walkthrough', 'demo_tutorial', 'conclusion', 'general', 'general', 'general'][event_id % 8 + 1] AS content_type FROM events""")
def json_sections(spark, sf):
    kinds = ("intro", "conceptual", "code_walkthrough", "demo_tutorial", "conclusion", "general", "tutorial", "odd")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 8 + 1).cast("int"))
    raw = F.concat(F.lit('```json\n[{"title": "'), F.col("event_type"), F.lit('", "content_type": "'), kind, F.lit('"}]\n``` ok'))
    # an outer explode: from others Catalyst infers a filter that parses the answer again
    found = table(spark, sf, "events").select("event_id", F.explode_outer(nested.sections(raw)).alias("s")).where("s IS NOT NULL")
    return found.select("event_id", "s.title", "s.end_timestamp", "s.content_type")


_ANSWERS = (
    '{"data": [{"id": "llama3"}, {"id": ""}, {"id": "qwen"}]}', '{"models": [{"name": "llama3:latest"}, {"name": "phi"}]}', '{"models": [{"name": "llama3x"}]}', '{"models": []}', '{"data": [], "models": [{"name": "llama3"}]}', "not json",
)


@query("""SELECT event_id, ['llama3,qwen', 'llama3:latest,phi', 'llama3x', '', '', ''][event_id % 6 + 1] AS names, event_id % 6 = 0 AS found, event_id % 6 <= 1 AS tagged FROM events""")
def model_list(spark, sf):
    """What an inventory's answer lists, and whether a model is among it, with and without tags."""
    names = nested.model_names(F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("event_id") % 6 + 1).cast("int")))
    rows = table(spark, sf, "events").select("event_id", names.alias("n"))
    return rows.select("event_id", F.array_join("n", ",").alias("names"), nested.holds_model(F.col("n"), F.lit("llama3"), False).alias("found"), nested.holds_model(F.col("n"), F.lit("llama3"), True).alias("tagged"))


@query("""SELECT event_id, CASE WHEN value >= 95 THEN 'incremental' WHEN event_type = 'click' THEN 'transition' WHEN event_type = 'view' THEN 'incremental' WHEN event_type = 'error' THEN 'ambiguous' ELSE 'transition' END AS label FROM events""")
def final_classification(spark, sf):
    """The similarity's fast path, then the model's answer, then what was given (ambiguous stays so and counts as real), then a transition."""
    e = F.col("event_type")
    answered = F.when(e == "click", "transition").when(e == "view", "incremental")
    given = F.when(e == "error", "ambiguous").when(e == "purchase", "transition").when(e == "click", "incremental")
    return table(spark, sf, "events").select("event_id", nested.final_classification(given, nested.fast_path(F.col("value") / 100, answered)).alias("label"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN value >= 40 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true ELSE true END AS kept FROM events""")
def resume_prune(spark, sf):
    kind, saved = F.col("event_id") % 5, F.format_string("%.6f", "value")
    entry = F.when(kind == 0, F.concat(F.lit('{"position": 3, "savedAt": '), saved, F.lit("}"))).when(kind == 1, F.concat(F.lit('{"savedAt": "'), saved, F.lit('"}'))).when(kind == 2, "broken").when(kind == 3, "").otherwise("broken")
    key = F.concat(F.when(kind == 4, "theme:").otherwise("resume:"), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", nested.resume_kept(key, entry, F.lit(40.0), "resume:").alias("kept"))


@query("""SELECT s_suppkey, chr(10) || '## Detected Slides' || chr(10) || chr(10) || string_agg('### Slide ' || n || ' (' || printf('00:%02d:%02d', 5 * n // 60, 5 * n % 60) || ' – ' || printf('00:%02d:%02d', (5 * n + 5) // 60, (5 * n + 5) % 60) || ')' || chr(10) ||
'![Slide ' || n || '](./slides/slide_' || printf('%03d', n) || '.jpg)' || chr(10) || chr(10) || CASE WHEN n % 2 = 0 THEN '> **OCR Text:**' || chr(10) || '> ' || s_name || chr(10) || '> b' || chr(10) || chr(10) ELSE '' END || '---' || chr(10), chr(10) ORDER BY n) AS section
FROM supplier, (SELECT unnest(range(0, 4)) * 7 AS n) GROUP BY s_suppkey""")
def slides_section(spark, sf):
    slide = lambda n: F.struct((n * 7).cast("int").alias("number"), (n * 35.0).alias("start"), (n * 35.0 + 5).alias("end"), F.when(n * 7 % 2 == 0, F.concat(F.lit(" "), F.col("s_name"), F.lit("\nb\n"))).alias("ocr"))
    return table(spark, sf, "supplier").select("s_suppkey", text.slides_section(F.transform(F.sequence(F.lit(0), F.lit(3)), slide)).alias("section"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
k AS (SELECT doc_id, i, CASE WHEN i % 4 = 1 AND trim(regexp_replace(line, '^\s+|\s+$', '', 'g')) <> '' THEN chr(10) || '## [00:00:10] ' || regexp_replace(line, '^\s+|\s+$', '', 'g') || chr(10) WHEN i % 4 = 2 THEN '**[00:00:20]** ' || regexp_replace(line, '^\s', '') || chr(10)
WHEN i % 4 = 1 THEN '## [00:00:10] ' || line || chr(10) WHEN regexp_matches(line, '[^\s]') THEN line || chr(10) END || CASE WHEN i = 2 THEN chr(10) || '![Snapshot at 00:00:05](./images/snapshot_5.25s.jpg)' || chr(10) ELSE '' END AS part FROM l)
SELECT d.doc_id, md5('# ' || source || chr(10) || chr(10) || 'Source: http://x' || chr(10) || coalesce((SELECT string_agg(chr(10) || part, '' ORDER BY i) FROM k WHERE k.doc_id = d.doc_id), '')) AS document FROM documents d""")
def document_markdown(spark, sf):
    """Whole texts by line; of four lines the second is a chapter and the third has a stamp; the third line of a text has an image."""
    mark = lambda t, i: F.when(i % 4 == 1, F.concat(F.lit("## [00:00:10] "), t)).when(i % 4 == 2, F.concat(F.lit("[00:00:20] "), t)).otherwise(t)
    rows = docs(spark, sf).select("doc_id", "source", F.transform(F.split("text", "\n"), mark).alias("lines"))
    images = F.transform("lines", lambda _, i: F.when(i == 2, F.array(F.lit(5.25))))
    return rows.select("doc_id", F.md5(text.document_markdown(F.col("source"), F.lit("http://x"), F.col("lines"), images)).alias("document"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


#: made from a number: its kind and its id
_URLS = (
    ("youtube", "https://youtu.be/abc-%08d", r"https://youtu\.be/([\w-]{11})"), ("youtube", "https://www.youtube.com/watch?t=3&v=xyz_%07d", r"v=([\w-]{11})"), ("youtube", "https://youtube.com/shorts/abc%08d", r"shorts/([\w-]{11})"),
    ("vimeo", "https://vimeo.com/video/%d", r"video/(\d+)"), ("twitch", "https://twitch.tv/videos/%d", r"videos/(\d+)"), ("twitch", "https://clips.twitch.tv/Clip-%d", r"tv/([\w-]+)"), ("twitch", "https://twitch.tv/joe/clip/C%d", r"clip/([\w-]+)"),
    ("twitter", "https://x.com/joe/status/%d", r"status/(\d+)"), ("tiktok", "https://www.tiktok.com/@joe.x/video/%d", r"video/(\d+)"), ("tiktok", "https://vm.tiktok.com/Z%d", r"com/(\w+)"), ("reddit", "https://reddit.com/r/x/comments/t%d/title", r"comments/(\w+)"),
    ("reddit", "https://redd.it/t%d", r"it/(\w+)"), ("rumble", "https://rumble.com/embed/v%d", r"embed/(v\w+)"), ("direct", "https://good.org/a%d.mp4?x=1", None), ("direct", "https://good.org/a%d.M3U8", None), ("unknown", "https://good.org/a%d.mp4x", None),
)
_URL_SQL = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN printf('{u}', event_id)" for i, (_, u, _) in enumerate(_URLS)) + " END"
_ID_SQL = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN " + (f"regexp_extract(u, '{p}', 1)" if p else "left(md5(u), 16)") for i, (_, _, p) in enumerate(_URLS)) + " END"


@query(f"""SELECT event_id, [{', '.join(f"'{k}'" for k, _, _ in _URLS)}][event_id % 16 + 1] AS kind, {_ID_SQL} AS native_id FROM (SELECT event_id, {_URL_SQL} AS u FROM events)""")
def url_classify(spark, sf):
    """The seven platforms, media files and other sources."""
    url = F.format_string(_URLS[0][1], "event_id")
    for i, (_, form, _) in enumerate(_URLS[1:], 1):
        url = F.when(F.col("event_id") % 16 == i, F.format_string(form, "event_id")).otherwise(url)
    return table(spark, sf, "events").select("event_id", urls.classify(url).alias("f")).select("event_id", "f.kind", "f.native_id")


#: a URL, its host, and why it is refused
_GUARDED = (
    ("ftp://good.org/x", "good.org", "scheme"), ("http:///x", "", "host"), ("http://good.org:8080/x", "good.org", None), ("HTTP://user:p@Good.org/x", "good.org", None), ("http://user@127.0.0.1/", "127.0.0.1", "internal"),
    ("http://u:p@10.0.0.1/", "10.0.0.1", "internal"), ("http://[::1]/", "::1", "internal"), ("http://[2606:4700::1111]/", "2606:4700::1111", None), ("http://224.0.0.1/", "224.0.0.1", "internal"), ("http://240.0.0.1/", "240.0.0.1", "internal"),
    ("http://0.1.2.3/", "0.1.2.3", "internal"), ("http://172.15.0.1/", "172.15.0.1", None), ("http://172.31.9.9/", "172.31.9.9", "internal"), ("http://169.254.169.254/", "169.254.169.254", "internal"), ("http://[fe80::1]/", "fe80::1", "internal"),
    ("http://[::ffff:10.0.0.1]/", "::ffff:10.0.0.1", "internal"), ("http://8.8.8.8/", "8.8.8.8", None), ("http://localhost:3000/", "localhost", "internal"), ("http://10.example.org/", "10.example.org", None), ("http://100.64.0.1/", "100.64.0.1", "internal"),
)


@query(f"""SELECT event_id, [{', '.join('NULL' if r is None else f"'{r}'" for *_, r in _GUARDED)}][event_id % {len(_GUARDED)} + 1] AS refused, [{', '.join(f"'{h}'" for _, h, _ in _GUARDED)}][event_id % {len(_GUARDED)} + 1] AS host FROM events""")
def url_guard(spark, sf):
    url = F.element_at(F.array(*[F.lit(u) for u, *_ in _GUARDED]), (F.col("event_id") % len(_GUARDED) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", urls.guard(url).alias("refused"), urls.host(url).alias("host"))


_NETS = ((0, 8), (10 << 24, 8), (0x64400000, 10), (127 << 24, 8), (0xA9FE0000, 16), (0xAC100000, 12), (0xC0000000, 24), (0xC0000200, 24), (0xC0A80000, 16), (0xC6120000, 15), (0xC6336400, 24), (0xCB007100, 24), (0xE0000000, 4), (0xF0000000, 4))


@query(f"""WITH n AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN [{", ".join(str(n + 5) for n, _ in _NETS)}][event_id % 14 + 1] ELSE event_id * 2654435761 % 4294967296 END AS n FROM events)
SELECT event_id, '00000000000000000000ffff' || lpad(lower(to_hex(n)), 8, '0') AS form, {" OR ".join(f"n BETWEEN {n} AND {n + (1 << 32 - bits) - 1}" for n, bits in _NETS)} AS internal FROM n""")
def address_forms(spark, sf):
    """An IPv4 address for each event, a third of them not public, in eight spellings."""
    e = F.col("event_id")
    nets = F.element_at(F.array(*[F.lit(n + 5).cast("long") for n, _ in _NETS]), (e % 14 + 1).cast("int"))
    n = F.when(e % 3 == 0, nets).otherwise(e.cast("long") * 2654435761 % 4294967296)
    byte = lambda k: F.shiftrightunsigned(n, k).bitwiseAND(F.lit(255).cast("long"))
    text_of = lambda c: c.cast("string")
    hexed = F.lpad(F.lower(F.hex(n)), 8, "0")
    dotted = F.concat_ws(".", *[text_of(byte(k)) for k in (24, 16, 8, 0)])
    forms = [
        dotted, text_of(n), F.concat(F.lit("0x"), F.lower(F.hex(n))), F.concat_ws(".", text_of(byte(24)), text_of(n.bitwiseAND(F.lit(0xFFFFFF).cast("long")))), F.concat_ws(".", F.concat(F.lit("0x"), F.hex(byte(24))), text_of(byte(16)), text_of(n.bitwiseAND(F.lit(0xFFFF).cast("long")))),
        F.concat(F.lit("::ffff:"), dotted), F.concat(F.lit("0:0:0:0:0:FFFF:"), F.left(hexed, F.lit(4)), F.lit(":"), F.right(hexed, F.lit(4))), F.concat(dotted, F.lit(".")),
    ]
    h = F.lower(F.element_at(F.array(*forms), (e % 8 + 1).cast("int")))
    return table(spark, sf, "events").select("event_id", urls.canonical_address(h).alias("form"), urls.internal_host(h).alias("internal"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, nullif(regexp_extract(url, '//[^/]*/([a-z]+)/', 1), 'fr') AS lang, CASE WHEN page_id % 7 > 0 THEN page_id % 7 END AS id, 'u' || page_id % 5 AS u, page_id % 4 = 0 AS gone FROM pages)
SELECT p.page_id, min(q.page_id) AS duplicate_of FROM p LEFT JOIN p q ON q.host = p.host AND q.page_id < p.page_id AND NOT q.gone AND q.lang IS NOT DISTINCT FROM p.lang AND (q.id = p.id OR q.id IS NULL AND p.id IS NULL AND q.u = p.u) GROUP BY 1""")
def dup_detect(spark, sf):
    """Cancelled jobs (every fourth page) are duplicates of others, but none is one of theirs; without an id the URL decides."""
    n = F.col("page_id")
    pages = table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), F.nullif(F.regexp_extract("url", "//[^/]*/([a-z]+)/", 1), F.lit("fr")).alias("lang"), F.concat(F.lit("u"), (n % 5).cast("string")).alias("u"))
    return joins.duplicates(pages, "host", F.col("lang"), F.when(n % 7 > 0, (n % 7).cast("string")), "u", "page_id", n % 4 == 0).select("page_id", "duplicate_of")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents),
t AS (SELECT doc_id, position, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM l) SELECT doc_id, CAST(min(position) AS INTEGER) AS position, md5(line) AS line FROM t WHERE line <> '' AND NOT regexp_matches(line, '^(WEBVTT|NOTE|STYLE)|^\\d+$|<') GROUP BY doc_id, line""")
def first_occurrence_dedup(spark, sf):
    files = docs(spark, sf).select(F.col("doc_id").alias("file"), F.col("text").alias("raw"))
    found = captions.caption_lines(files).where(~F.col("line").contains("<"))
    return found.select(F.col("file").alias("doc_id"), "position", F.md5("line").alias("line"))


_ITEMS = r"""i AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), n AS (SELECT doc_id, k, length(text) AS n, count(*) OVER (PARTITION BY doc_id) AS m FROM i)"""


@query(f"""WITH RECURSIVE {_ITEMS}, g AS (SELECT doc_id, k, m, n + 1 AS len, 1 AS seg FROM n WHERE k = 1 UNION ALL
SELECT g.doc_id, n.k, g.m, CASE WHEN g.len + n.n + 1 > 500 THEN n.n ELSE g.len + n.n + 1 END, CASE WHEN g.len + n.n + 1 > 500 THEN g.seg + 1 ELSE g.seg END FROM g JOIN n ON n.doc_id = g.doc_id AND n.k = g.k + 1)
SELECT doc_id, CAST(seg - 1 AS INTEGER) AS sequence, CAST(count(*) AS INTEGER) AS n_items, CAST(max(len) AS INTEGER) AS length FROM g GROUP BY doc_id, seg""")
def greedy_pack(spark, sf):
    items = F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.cast("double").alias("ts"), t.alias("text")))
    rows = docs(spark, sf).select("doc_id", F.explode(folds.packed(items, 500)).alias("s"))
    return rows.select("doc_id", "s.sequence", "s.n_items", "s.length")


@query()
def greedy_pack_sentences(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.posexplode(folds.packed_sentences(text.sentences(F.col("text")), 500)).alias("sequence", "text"))
    return rows.select("doc_id", "sequence", F.length("text").alias("length"))


@query()
def state_machine_sections(spark, sf):
    """Every fifth line becomes an image reference and every eleventh a chapter."""
    mark = lambda t, i: F.when(i % 11 == 10, F.concat(F.lit("## [00:00:10] "), t)).when(i % 5 == 4, "![Snapshot at 00:00:05](x)").otherwise(t)
    rows = docs(spark, sf).select("doc_id", F.posexplode(folds.marked_sections(F.transform(F.split("text", "\n"), mark))).alias("position", "s"))
    return rows.select("doc_id", "position", "s.type", F.md5("s.content").alias("content"))


@query("""SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def assemble_sections(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("text"))


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 WHEN role <> 'system' THEN 1 ELSE 2 END, turn) AS n FROM conversations) WHERE n = 1""")
def caption_fallback(spark, sf):
    rows = table(spark, sf, "conversations").withColumns({"generated": F.col("role") == "system", "wanted": F.lit("assistant")})
    return captions.best_track(rows, "conv_id", "role", "generated", "turn", "wanted").select("conv_id", "turn", "role", "text")


_CODES = ("en", "FR", "es", "de", "pt", "it", "nl", "ru", "ja", "ko", "zh-CN", "zh", "ar", "hi", "tr", "pl", "sv", "xx")


@query("""SELECT doc_id, coalesce(map {'en': 'English', 'fr': 'French', 'es': 'Spanish', 'de': 'German', 'pt': 'Portuguese', 'it': 'Italian', 'nl': 'Dutch', 'ru': 'Russian', 'ja': 'Japanese', 'ko': 'Korean', 'zh-cn': 'Chinese', 'ar': 'Arabic',
'hi': 'Hindi', 'tr': 'Turkish', 'pl': 'Polish', 'sv': 'Swedish'}[lower(c)], c) AS language FROM (SELECT doc_id, ['en', 'FR', 'es', 'de', 'pt', 'it', 'nl', 'ru', 'ja', 'ko', 'zh-CN', 'zh', 'ar', 'hi', 'tr', 'pl', 'sv', 'xx'][doc_id % 18 + 1] AS c FROM documents)""")
def language_name(spark, sf):
    """All codes of the list, in either case, and two that are not in it."""
    return docs(spark, sf).select("doc_id", text.language_name(F.element_at(F.array(*map(F.lit, _CODES)), (F.col("doc_id") % 18 + 1).cast("int"))).alias("language"))


@query("""SELECT vec_id, round(sqrt(greatest(0.0, 1.0 - list_sum(list_transform(list_zip(a, b), lambda p: sqrt(p[1] * p[2]))) / sqrt(list_sum(a) * list_sum(b)))), 4) AS distance
FROM (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a, list_transform(list_reverse(embedding), lambda x: abs(CAST(x AS DOUBLE))) AS b FROM embeddings)""")
def histogram_distance(spark, sf):
    positive = lambda x: F.transform(x, lambda v: F.abs(v.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(text.histogram_distance(positive(F.col("embedding")), positive(F.reverse("embedding"))), 4).alias("distance"))


@query("""SELECT vec_id, round(-list_sum(list_transform(h, lambda x: x / t * log2(x / t + 1e-7))), 4) AS entropy FROM (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS h, list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS t FROM embeddings)""")
def relevance_entropy(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(text.entropy_bits(F.transform("embedding", lambda v: F.abs(v.cast("double")))), 4).alias("entropy"))


@query("""SELECT event_id, round(least(1.0, 0.4 * least(value / 500, 1.0) + 0.3 * least(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 8, 1.0) + CASE WHEN event_type = 'view' THEN 0.3 ELSE 0 END), 6) AS score FROM events""")
def relevance_score(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").select("event_id", F.round(text.relevance_score(F.col("value"), k, F.col("event_type") == "view"), 6).alias("score"))


@query("""SELECT part_name, size_text FROM (SELECT p_name || p_partkey AS part_name, CASE WHEN s < 1024 THEN s || ' Bytes' ELSE regexp_replace(printf('%.2f', round(s / 1024.0, 2)), '\\.?0+$', '') || ' KB' END AS size_text
FROM (SELECT p_name, p_partkey, 1 + p_size * 37 AS s FROM part))""")
def size_text(spark, sf):
    return table(spark, sf, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("part_name"), text.size_text(F.lit(1) + F.col("p_size") * 37).alias("size_text"))



