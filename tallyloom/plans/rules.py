"""Smaller rules: validators, fallbacks, allowlists, references, batches, catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import nested, rules, text, urls
from ..operators import boundary, resolution
from .registry import query, table


@query("SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007' OR c_mktsegment = 'MACHINERY'")
def login_predicate(spark, sf):
    return table(spark, sf, "customer").where((F.col("c_name") == "Customer#000000007") | (F.col("c_mktsegment") == "MACHINERY")).select("c_custkey")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'tion')")
def segment_search(spark, sf):
    return table(spark, sf, "conversations").where(F.lower("text").contains("tion")).select("conv_id", "turn")


@query("SELECT s_suppkey, s_name FROM supplier")
def allowlist_projection(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_name")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN '/files/' || substr(url, 9) END AS public FROM pages")
def public_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.public_path(F.col("url"), "https://", "/files/").alias("public"))


@query("SELECT doc_id, coalesce(nullif(string_split(text, ' ')[5], ''), lang) AS model FROM documents")
def first_or_declared(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.nullif(F.get(F.split("text", " "), F.lit(4)), F.lit("")), "lang").alias("model"))


@query(r"""SELECT doc_id, md5(CASE WHEN strpos(t, '[00:01:02]') > 0 THEN substr(t, strpos(t, '[00:01:02]')) ELSE t END) AS rest FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE replace(text, chr(10), chr(10) || '[00:01:02] ') END AS t FROM documents)""")
def text_from_mark(spark, sf):
    """Text from its first time stamp on, all of it if there is none."""
    stamped = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("\n[00:01:02] ")))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.from_first_stamp(stamped)).alias("rest"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'captions' END, (SELECT 'subtitles' FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40 LIMIT 1), 'speech') AS source FROM orders""")
def source_chain(spark, sf):
    subtitles = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("subtitles", F.lit("subtitles"))
    rows = table(spark, sf, "orders").join(subtitles, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "F", "captions"), "subtitles", F.lit("speech")).alias("source"))


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20 AS BIGINT) AS batch FROM events")
def batches_of(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf, "events").select("event_id", F.floor(n / 20).alias("batch"))


@query("""SELECT p_partkey, list_contains(list_transform(string_split(p_name, ' '), lambda x: x), 'ring') OR starts_with(p_type, 'ECO') AS listed FROM part""")
def catalogue_probe(spark, sf):
    names = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", (F.exists(names, lambda m: m == "ring") | F.col("p_type").like("ECO%")).alias("listed"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN list_sort(models) WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN [] ELSE list_filter(['m' || s_nationkey % 4], lambda m: list_contains(models, m)) END AS models
FROM (SELECT s_suppkey, s_nationkey, ['m0', 'm1', 'm' || s_suppkey % 7] AS models FROM supplier)""")
def catalogue_intersection(spark, sf):
    """What a manager lists, less what does not run: the current model if it is ready, running and listed; others' lists stand."""
    n = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select("s_suppkey", F.array(F.lit("m0"), F.lit("m1"), F.concat(F.lit("m"), (n % 7).cast("string"))).alias("listed"), (n % 4 != 0).alias("managed"), (n % 3 != 0).alias("ready"), (n % 5 != 0).alias("running"), F.concat(F.lit("m"), (F.col("s_nationkey") % 4).cast("string")).alias("current"))
    return rows.select("s_suppkey", F.array_sort(nested.live_models(F.col("listed"), F.col("managed"), F.col("ready"), F.col("running"), F.col("current"))).alias("models"))


@query("SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT event_id, '/img/' || event_id || '.jpg' AS ref, replace('see ![a](/img/' || event_id || '.jpg) end', '](/img/', '](images/') AS markdown FROM events""")
def image_references(spark, sf):
    raw = F.concat(F.lit("see ![a](/img/"), F.col("event_id").cast("string"), F.lit(".jpg) end"))
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.explode(F.regexp_extract_all("raw", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))).alias("ref"), F.regexp_replace("raw", r"\]\(/img/", "](images/").alias("markdown"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'length' WHEN contains(c_name, '#') THEN 'characters' END AS user_name, CASE c_custkey % 6 WHEN 0 THEN 'length' WHEN 1 THEN 'upper' WHEN 2 THEN 'lower' WHEN 3 THEN 'digit' WHEN 4 THEN 'length' END AS password,
CASE WHEN c_custkey % 4 IN (1, 3) THEN false ELSE true END AS language, CASE c_custkey % 5 WHEN 2 THEN 'side_car-1' END AS preference, c_custkey % 5 IN (3, 4) AS preference_refused FROM customer""")
def validators(spark, sf):
    """Names, passwords, caption languages and preferences, each with its reason or its normal form."""
    n = F.col("c_custkey")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    name = F.when(n % 5 == 0, "ab").otherwise(F.col("c_name"))
    preference, refused = rules.preference(pick(" auto ", "", " side_car-1 ", "a/b", "http://x"))
    return table(spark, sf, "customer").select(
        "c_custkey", rules.user_name(name).alias("user_name"), rules.password(pick("Ab3", "abcdefg3", "ABCDEFG3", "Abcdefgh", "A3" + "x" * 127, "Abcdefg3")).alias("password"),
        rules.language_code(pick("en", "e", "zh-Hans", "english-x")).alias("language"), preference.alias("preference"), refused.alias("preference_refused"),
    )


@query("""SELECT doc_id, left(string_split(p, '.')[1], 100) AS title, md5(p) AS content FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))[1:5]) AS p FROM documents) WHERE length(p) > 50""")
def heuristic_sections(spark, sf):
    raw = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    rows = table(spark, sf, "documents").select("doc_id", F.explode(text.heuristic_sections(raw)).alias("s"))
    return rows.select("doc_id", "s.title", F.md5("s.content").alias("content"))


_PROMPT = r"""WITH m AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 0 THEN '## [00:01:02] ' || x ELSE x END), chr(10)) AS t FROM documents),
r AS (SELECT doc_id, t, list_filter(string_split(substr(t, 30001), chr(10)), lambda x: regexp_matches(x, '^## \[\d{2}:\d{2}:\d{2}\]')) AS c FROM m)
SELECT doc_id, md5(CASE WHEN length(t) <= 30000 THEN t WHEN len(c) > 0 THEN left(t, 30000) || chr(10) || '...' || chr(10) || array_to_string(c, chr(10)) ELSE left(t, 30000) END) AS prompt FROM r"""


@query(_PROMPT)
def truncated_prompt(spark, sf):
    """The first 30,000 characters, and of the rest the chapter lines; every third line is made one."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("## [00:01:02] "), x)).otherwise(x)), "\n")
    return table(spark, sf, "documents").select("doc_id", F.md5(text.prompt_text(marked)).alias("prompt"))


@query(_PROMPT)
def truncated_prompt_whole(spark, sf):
    return truncated_prompt(spark, sf)


@query("SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN 'incremental' ELSE 'transition' END AS label FROM documents")
def batched_classifier(spark, sf):
    """A deterministic stand-in for a model that fails on some batches; failures are asked again."""

    def answer(prompts: list[str]) -> list[str | None]:
        if len(prompts) > 1 and len(prompts[0]) % 5 == 0:
            raise TimeoutError
        return ["incremental" if len(p) % 2 == 0 else None if len(prompts) > 1 else "transition" for p in prompts]

    return boundary.classified(table(spark, sf, "documents"), "doc_id", "text", answer, {"incremental", "transition"}, "transition")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 AND (c_custkey % 101) / 100.0::DOUBLE >= 0.95::DOUBLE THEN 'incremental' ELSE 'ambiguous' END AS label FROM customer""")
def fast_path(spark, sf):
    n = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", rules.fast_path(F.lit("ambiguous"), F.when(n % 7 > 0, n % 101 / 100.0)).alias("label"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 10 / 1000.0::DOUBLE ELSE c_custkey % 3 * c_custkey / greatest(c_custkey % 4, 1)::DOUBLE END AS seconds FROM customer""")
def duration_fallback(spark, sf):
    """Every third has no frames, every fourth no rate."""
    n = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", rules.duration(n % 3 * n, (n % 4).cast("double"), n * 10).alias("seconds"))


@query("""SELECT user_id, CAST(max(ts) AS VARCHAR) AS observed_at, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) <= 30000000 AS fresh FROM events GROUP BY 1""")
def fresh_telemetry(spark, sf):
    """Each user's last event against the last of all."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("observed_at"))
    now = rows.agg(F.max("observed_at").alias("now"))  # one row
    rows = rows.crossJoin(F.broadcast(now))
    return rows.select("user_id", F.col("observed_at").cast("string").alias("observed_at"), rules.fresh(F.col("observed_at"), F.col("now")).alias("fresh"))


@query("""WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'openai' WHEN c_custkey % 4 = 3 AND c_custkey % 5 = 0 THEN 'other' ELSE 'vllm' END AS provider, CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey % 9 END AS model,
CASE WHEN c_custkey % 7 = 0 THEN 'http://own' END AS url FROM customer), n AS (SELECT s_suppkey, s_name, 'http://' || s_suppkey AS url, 'm' || s_suppkey % 9 AS m1, 'm' || (s_suppkey + 1) % 9 AS m2 FROM supplier WHERE s_suppkey % 4 = 0),
r AS (SELECT c_custkey, provider, url, coalesce(model, CASE provider WHEN 'vllm' THEN (SELECT m1 FROM n WHERE s_suppkey = (SELECT min(s_suppkey) FROM n)) WHEN 'openai' THEN 'd1' END, 'd0') AS model FROM o),
f AS (SELECT m, arg_min(s_name, s_suppkey) AS node, arg_min(url, s_suppkey) AS url FROM (SELECT *, unnest([m1, m2]) AS m FROM n) GROUP BY m)
SELECT c_custkey, provider, model, coalesce(r.url, f.url, 'http://primary') AS base_url, node FROM r LEFT JOIN f ON m = model AND provider = 'vllm'""")
def resolved_provider(spark, sf):
    """Customers choose; suppliers are nodes, odd ones without an address, every other even one without a model."""
    n, s = F.col("c_custkey"), F.col("s_suppkey")
    chosen = F.when(n % 4 == 0, "vllm").when(n % 4 == 2, "openai").when((n % 4 == 3) & (n % 5 == 0), "other").when(n % 4 == 3, "")
    owners = table(spark, sf, "customer").select("c_custkey", chosen.alias("provider"), F.when(n % 3 == 0, F.concat(F.lit("m"), (n % 9).cast("string"))).alias("model"), F.when(n % 7 == 0, "http://own").alias("base_url"))
    name = lambda k: F.concat(F.lit("m"), (k % 9).cast("string"))
    models = F.when(s % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(name(s), name(s + 1)))
    nodes = table(spark, sf, "supplier").select(s.alias("position"), F.col("s_name").alias("node"), F.when(s % 2 == 0, F.concat(F.lit("http://"), s.cast("string"))).alias("url"), models.alias("models"))
    return resolution.resolved(owners, nodes, {"openai": "d1"}, "d0", "http://primary")
