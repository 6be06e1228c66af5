"""Listing, search, joins against lookups, ranking and pages. Orders stand for jobs, customers for users, suppliers and parts
for the fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested, text, times
from ..operators import aggregates, folds, joins, ranking, transitions, windows
from .registry import query, table

#: fixed value: the moment that queries take for now
AS_OF = "TIMESTAMP_NTZ '2001-08-02 00:00:00'"


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 20""")
def list_filter_page(spark, sf):
    jobs = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    return ranking.page(jobs, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, 50).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%r_d%'")
def filter_ilike(spark, sf):
    return table(spark, sf, "part").where(text.contains_pattern(F.col("p_name"), "r_d")).select("p_partkey", "p_name")


@query("""SELECT o_orderkey FROM orders o WHERE o_orderpriority ILIKE '%urgent%'
OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)
OR EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = o.o_orderkey AND d.text ILIKE '%idiot%')""")
def search_or_exists(spark, sf):
    for name in ("orders", "lineitem", "documents"):
        table(spark, sf, name).createOrReplaceTempView(f"tl_{name}")
    return spark.sql("""SELECT o_orderkey FROM tl_orders o WHERE o_orderpriority ILIKE '%urgent%'
        OR EXISTS (SELECT 1 FROM tl_lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)
        OR EXISTS (SELECT 1 FROM tl_documents d WHERE d.doc_id = o.o_orderkey AND d.text ILIKE '%idiot%')""")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup')")
def filter_in(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("error", "signup")).select("event_id", "event_type")


@query("SELECT doc_id, lang IS NULL AS no_lang FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def filter_null(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where(F.col("text").isNotNull() & F.col("source").isNotNull()).select("doc_id", F.col("lang").isNull().alias("no_lang"))


@query("SELECT o_orderkey FROM orders WHERE epoch_us(TIMESTAMP '2001-08-02 00:00:00') - epoch_us(o_orderdate) > 7776000000000 AND o_orderstatus = 'P'")
def filter_ttl(spark, sf):
    old = transitions.older(F.col("o_orderdate"), F.expr(AS_OF), 90 * 86400)
    return table(spark, sf, "orders").where(old & (F.col("o_orderstatus") == "P")).select("o_orderkey")


@query("""SELECT event_id FROM events WHERE event_type = 'click' AND (value < 5 OR (user_id % 3 = 0 AND value > 50
AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 40))""")
def filter_compound(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    keep = (F.col("event_type") == "click") & ((F.col("value") < 5) | ((F.col("user_id") % 3 == 0) & (F.col("value") > 50) & (k > 40)))
    return table(spark, sf, "events").where(keep).select("event_id")


@query("""SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'small') AND list_contains(string_split(p_name, ' '), 'ring')
AND p_size >= 10 AND p_retailprice < 1000""")
def filter_subset(spark, sf):
    parts = table(spark, sf, "part")
    found = ranking.candidates(parts, ["small", "ring"], F.split("p_name", " "), F.col("p_retailprice") < 1000, F.col("p_size"), 10)
    return found.select("p_partkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN NULL WHEN contains(m, 'timeout') OR contains(m, 'timed out') THEN 'timeout'
WHEN contains(m, 'unavailable') OR contains(m, 'no compatible model') OR contains(m, 'not loaded') THEN 'capacity'
WHEN contains(m, 'invalid') OR contains(m, '422') THEN 'validation' WHEN contains(m, 'transcription failed') OR contains(m, 'no transcript') THEN 'transcription'
WHEN contains(m, 'download') THEN 'download' ELSE 'other' END AS category
FROM (SELECT o_orderkey, o_orderstatus, lower(CASE o_orderpriority WHEN '1-URGENT' THEN 'Request TIMED out' WHEN '2-HIGH' THEN 'model not loaded'
WHEN '3-MEDIUM' THEN 'HTTP 422 body' WHEN '5-LOW' THEN 'Download stopped' ELSE o_orderpriority END) AS m FROM orders)""")
def case_category(spark, sf):
    p = F.col("o_orderpriority")
    message = F.when(p == "1-URGENT", "Request TIMED out").when(p == "2-HIGH", "model not loaded").when(p == "3-MEDIUM", "HTTP 422 body").when(p == "5-LOW", "Download stopped").otherwise(p)
    return table(spark, sf, "orders").select("o_orderkey", text.failure_category(message, F.col("o_orderstatus") == "F").alias("category"))


@query("""SELECT l_orderkey, l_linenumber, greatest(0.0, (epoch_us(CASE WHEN o_orderstatus = 'F' THEN l_shipdate ELSE TIMESTAMP '2001-08-02 00:00:00' END)
- epoch_us(o_orderdate)) / 1e6) AS elapsed FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def elapsed(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", times.elapsed(F.col("o_orderdate"), F.col("l_shipdate"), F.col("o_orderstatus") == "F", F.expr(AS_OF)).alias("elapsed"))


@query("SELECT event_id, user_id FROM events WHERE strftime(ts, '%Y-%m') = '2024-01' AND user_id = 7 OR event_id = 3")
def filter_month(spark, sf):
    keep = (F.date_format("ts", "yyyy-MM") == "2024-01") & (F.col("user_id") == 7) | (F.col("event_id") == 3)
    return table(spark, sf, "events").where(keep).select("event_id", "user_id")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def filter_active_grant(spark, sf):
    active = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(active, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey > 1 WHERE coalesce(n_regionkey, 0) = c_custkey % 5")
def filter_version(spark, sf):
    nation = table(spark, sf, "nation").where("n_regionkey > 1")
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.where(F.coalesce("n_regionkey", F.lit(0)) == F.col("c_custkey") % 5).select("c_custkey")


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'
ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def join_inner(spark, sf):
    queued = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    return queued.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "c_name")


@query("""SELECT s_suppkey, coalesce(n, 0) AS reserved, coalesce(q, -1.0) AS quantity FROM supplier LEFT JOIN
(SELECT l_suppkey, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 GROUP BY 1) ON l_suppkey = s_suppkey""")
def join_left_default(spark, sf):
    slots = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("reserved"), F.max("l_quantity").alias("quantity"))
    return joins.with_default(table(spark, sf, "supplier").select("s_suppkey"), slots, "s_suppkey", {"reserved": 0, "quantity": -1.0})


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti(spark, sf):
    busy = table(spark, sf, "lineitem").where("l_quantity > 45")
    return table(spark, sf, "part").join(busy, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""SELECT s_suppkey, CAST(i AS INTEGER) AS slot_index FROM (SELECT s_suppkey, unnest(range(0, s_nationkey % 4)) AS i FROM supplier)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber = i AND l_quantity > 49)""")
def join_cross(spark, sf):
    existing = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_linenumber").alias("slot_index"))
    return joins.missing_slots(table(spark, sf, "supplier"), F.col("s_nationkey") % 4, existing, "s_suppkey")


@query("SELECT c1.c_custkey, c2.c_custkey AS parent FROM customer c1 LEFT JOIN customer c2 ON c2.c_custkey = c1.c_custkey // 2 AND c2.c_nationkey = c1.c_nationkey")
def join_self(spark, sf):
    c = table(spark, sf, "customer")
    parents = c.select(F.col("c_custkey").alias("parent"), F.col("c_nationkey").alias("n"))
    return c.join(parents, (F.col("parent") == F.floor(F.col("c_custkey") / 2)) & (F.col("n") == F.col("c_nationkey")), "left").select("c_custkey", "parent")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN rank() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderdate) END AS queue_position FROM orders""")
def rank_queue_position(spark, sf):
    return windows.queue_position(table(spark, sf, "orders"), F.col("o_orderstatus") == "O", "o_orderdate", ["o_custkey"]).select("o_orderkey", "queue_position")


@query("""SELECT l_orderkey, l_returnflag, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_linenumber) AS n
FROM lineitem) WHERE n = 1""")
def first_per_group(spark, sf):
    return windows.newest(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], [F.desc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_linenumber")]).select("l_orderkey", "l_returnflag", "l_partkey")


@query("""SELECT p_type, p_partkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY -p_size, p_retailprice, p_brand, p_partkey) AS n FROM part) WHERE n = 1""")
def topk_multi_key(spark, sf):
    return ranking.best(table(spark, sf, "part"), ["p_type"], F.col("p_partkey"), F.struct(-F.col("p_size"), "p_retailprice", "p_brand", "p_partkey"))


@query("""SELECT s_nationkey, s_suppkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY -s_acctbal, s_suppkey) AS n FROM supplier WHERE s_acctbal > 0) WHERE n = 1""")
def argmin(spark, sf):
    return ranking.best(table(spark, sf, "supplier").where("s_acctbal > 0"), ["s_nationkey"], F.col("s_suppkey"), F.struct(-F.col("s_acctbal"), "s_suppkey"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n > 3")
def retention_topk(spark, sf):
    return ranking.beyond_retention(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", 3).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 99 END AS INTEGER) AS place FROM orders""")
def custom_order(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ranking.by_custom_order(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "5-LOW"]).alias("place"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def fifo_batch(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def distinct_months(spark, sf):
    return table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()


@query("""WITH w AS (SELECT l_orderkey, CAST(round(l_discount * 1000) AS BIGINT) AS p, CASE l_returnflag WHEN 'A' THEN 20 WHEN 'N' THEN 30 ELSE 10 END AS w FROM lineitem)
SELECT l_orderkey, CASE WHEN min(o_orderstatus) = 'F' THEN 100 WHEN min(o_orderstatus) = 'P' THEN CAST(sum(p * w) // sum(w) AS BIGINT)
ELSE greatest(0, least(100, CAST(sum(p * w) // sum(w) AS BIGINT))) END AS progress FROM w JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def sum_weighted(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    step = F.when(F.col("l_returnflag") == "A", "transcribe").when(F.col("l_returnflag") == "N", "slides").otherwise("unlisted")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("processing")
    return aggregates.progress(rows, ["l_orderkey"], F.round(F.col("l_discount") * 1000).cast("bigint"), aggregates.step_weight(step), status)


def _history(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("step"), times.seconds_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds"))


_HISTORY_SQL = """h AS (SELECT o_orderkey, l_returnflag || '/' || l_linestatus AS step, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS seconds
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')"""


@query(f"WITH {_HISTORY_SQL} SELECT step, round(median(seconds), 3) AS median, count(*) AS n FROM h GROUP BY step")
def median_by_group(spark, sf):
    return aggregates.step_statistics(_history(spark, sf), "step", "seconds").select("step", F.round("median", 3).alias("median"), "n")


@query(f"WITH {_HISTORY_SQL} SELECT step, list_sort(list(seconds))[least(count(*), CAST(floor(count(*) * 0.9) AS BIGINT) + 1)] AS p90 FROM h GROUP BY step")
def p90_by_group(spark, sf):
    return aggregates.step_statistics(_history(spark, sf), "step", "seconds").select("step", "p90")


@query(f"""WITH {_HISTORY_SQL}, s AS (SELECT step, median(seconds) AS m, list_sort(list(seconds))[least(count(*), CAST(floor(count(*) * 0.9) AS BIGINT) + 1)] AS p FROM h GROUP BY step),
o AS (SELECT l_orderkey AS job, l_returnflag || '/' || l_linestatus AS step, round(l_discount * 1000) AS pct FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_discount < 0.1),
e AS (SELECT job, round(coalesce(sum(m * (1 - pct / 100.0)), 0), 1) AS lo, round(coalesce(sum(p * (1 - pct / 100.0)), 0), 1) AS hi FROM o LEFT JOIN s USING (step) GROUP BY job)
SELECT job, round(lo, 0) AS eta_low, round(greatest(lo, hi), 0) AS eta_high, 'high' AS confidence FROM e""")
def eta_range(spark, sf):
    history = _history(spark, sf)
    jobs = history.agg(F.count_distinct("o_orderkey").alias("jobs"))
    rows = table(spark, sf, "lineitem").where("l_discount < 0.1").join(table(spark, sf, "orders").where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey"))
    steps = rows.select(F.col("l_orderkey").alias("job"), F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("step"), F.round(F.col("l_discount") * 1000).alias("pct")).crossJoin(F.broadcast(jobs))  # one row
    out = aggregates.eta(steps, F.broadcast(aggregates.step_statistics(history, "step", "seconds").drop("n")), "step", "job", F.col("pct"), F.col("jobs"))
    return out.select("job", F.round("eta_low", 0).alias("eta_low"), F.round("eta_high", 0).alias("eta_high"), "confidence")


@query("""WITH j AS (SELECT * FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'O') WHERE r <= 8),
h AS (SELECT o_custkey, l_returnflag AS step, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS seconds FROM lineitem JOIN orders USING (o_orderkey) JOIN (SELECT o_orderkey FROM j) USING (o_orderkey)),
s AS (SELECT o_custkey, step, median(seconds) AS m, list_sort(list(seconds))[least(count(*), CAST(floor(count(*) * 0.9) AS BIGINT) + 1)] AS p FROM h GROUP BY ALL), n AS (SELECT o_custkey, count(*) AS n FROM j GROUP BY 1),
e AS (SELECT l_orderkey AS job, sum(m * (1 - round(l_discount * 1000) / 100)) AS lo, sum(p * (1 - round(l_discount * 1000) / 100)) AS hi, coalesce(any_value(n), 0) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'O' LEFT JOIN s ON s.o_custkey = orders.o_custkey AND step = l_returnflag LEFT JOIN n ON n.o_custkey = orders.o_custkey WHERE l_discount < 0.1 GROUP BY 1)
SELECT job, CASE WHEN n >= 3 THEN round(round(coalesce(lo, 0), 1), 0) END AS eta_low, CASE WHEN n >= 3 THEN round(greatest(round(coalesce(lo, 0), 1), round(coalesce(hi, 0), 1)), 0) END AS eta_high, CASE WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'medium' WHEN n >= 3 THEN 'low' ELSE 'cold' END AS confidence FROM e"""
.replace("JOIN orders USING (o_orderkey)", "JOIN orders ON l_orderkey = o_orderkey"))
def eta_by_mode(spark, sf):
    """From the newest finished jobs of the same mode (a customer), eight at most, so that all confidences but the highest occur."""
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    jobs = aggregates.newest_jobs(orders.where("o_orderstatus <> 'O'"), "o_custkey", "o_orderdate", "o_orderkey", 8)
    history = items.join(jobs, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_returnflag").alias("step"), times.seconds_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds"))
    statistics = aggregates.step_statistics(history, ["o_custkey", "step"], "seconds").drop("n")
    known = jobs.groupBy("o_custkey").agg(F.count("*").alias("jobs"))
    steps = items.where("l_discount < 0.1").join(orders.where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey")).join(known, "o_custkey", "left")
    steps = steps.select("o_custkey", F.col("l_orderkey").alias("job"), F.col("l_returnflag").alias("step"), F.round(F.col("l_discount") * 1000).alias("pct"), F.coalesce("jobs", F.lit(0)).alias("jobs"))
    out = aggregates.eta(steps, statistics, ["o_custkey", "step"], "job", F.col("pct"), F.col("jobs"))
    return out.select("job", F.round("eta_low", 0).alias("eta_low"), F.round("eta_high", 0).alias("eta_high"), "confidence")


@query("""SELECT CASE WHEN v < 0.05 THEN '0.05' WHEN v < 0.1 THEN '0.1' WHEN v < 0.5 THEN '0.5' WHEN v < 1 THEN '1.0' WHEN v < 5 THEN '5.0' ELSE 'inf' END AS bucket, count(*) AS n
FROM (SELECT value / 20 AS v FROM events) GROUP BY 1""")
def histogram(spark, sf):
    return table(spark, sf, "events").groupBy(aggregates.latency_bucket(F.col("value") / 20).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_suppkey")
def count_by_key(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS main, count(*) FILTER (WHERE value > 100) AS ambiguous FROM events GROUP BY user_id")
def count_where(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("main"), F.count_if(F.col("value") > 100).alias("ambiguous"))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'click') >= 0.4 * count(*) THEN 'pip_speaker'
WHEN count(*) FILTER (WHERE event_type = 'view') >= 0.4 * count(*) THEN 'split_panel' ELSE 'full_frame' END AS layout FROM events GROUP BY user_id""")
def vote_threshold(spark, sf):
    return aggregates.layout_vote(table(spark, sf, "events"), "user_id", F.col("event_type") == "click", F.col("event_type") == "view")


@query("""SELECT '{"orders":' || (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) || ',"events":' || (SELECT count(*) FROM events WHERE user_id = c_custkey) || '}' AS counts, c_custkey FROM customer""")
def json_object_agg(spark, sf):
    count = lambda name, key, out: table(spark, sf, name).groupBy(F.col(key).alias("c_custkey")).agg(F.count("*").alias(out))
    out = joins.with_default(table(spark, sf, "customer").select("c_custkey"), count("orders", "o_custkey", "orders"), "c_custkey", {"orders": 0})
    out = joins.with_default(out, count("events", "user_id", "events"), "c_custkey", {"events": 0})
    return out.select("c_custkey", F.to_json(F.struct("orders", "events")).alias("counts"))


@query("""SELECT 'empty' AS missing, 'FAIL' AS verdict""")
def evidence_check(spark, sf):
    count = lambda df, name: df.agg(F.count("*").alias(name))
    counts = count(table(spark, sf, "orders"), "orders").crossJoin(count(table(spark, sf, "events").where("value < 0"), "empty"))  # one row each
    return aggregates.missing_evidence(counts, ["orders", "empty"])


@query("""WITH u AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM u WHERE n <= 2),
t AS (SELECT CASE WHEN count(*) = 40 THEN max(ts) END AS ts FROM c WHERE r <= 40)
SELECT event_id, CASE WHEN u.ts > t.ts OR n > 2 THEN 'queued' ELSE 'admitted' END AS state, CASE WHEN u.ts > t.ts THEN 'global' WHEN n > 2 THEN 'per-user' END AS queue_reason FROM u, t""")
def admission_fold(spark, sf):
    return folds.admitted(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 40, 2).select("event_id", "state", "queue_reason")


@query("""SELECT DISTINCT doc_id, length(text) AS characters, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4000 AS tokens FROM documents""")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("characters"), text.token_estimate(F.col("text")).alias("tokens")).distinct()


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 0) AS price FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def extension_cube(spark, sf):
    """Extension: the reference groups by no set of keys."""
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 0).alias("price"))


@query("""SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup'""")
def extension_set_operations(spark, sf):
    """Extension: set operations as such."""
    of = lambda kind: table(spark, sf, "events").where(F.col("event_type") == kind).select("user_id")
    return of("purchase").intersect(of("error")).exceptAll(of("signup").distinct())


@query("SELECT count(*) AS n, sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS healthy FROM supplier")
def count_all(spark, sf):
    return table(spark, sf, "supplier").agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 0).alias("healthy"))


@query("""SELECT doc_id, list_sum(list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS BIGINT)))::BIGINT AS total FROM documents""")
def sum_nested(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.aggregate(F.transform(F.split("text", " "), lambda x: F.length(x).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("""SELECT doc_id, len(list_filter(['and', 'the'], lambda x: NOT list_contains(string_split(text, ' '), x))) = 0 AS has_all FROM documents""")
def array_subset(spark, sf):
    return table(spark, sf, "documents").select("doc_id", nested.subset(F.array(F.lit("and"), F.lit("the")), F.split("text", " ")).alias("has_all"))
