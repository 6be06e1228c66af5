"""Job bookkeeping: state transitions, nested export and import, and streams. Lineitems stand for steps of a job (an order),
suppliers for slots, events for streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import folds, transitions
from ..sources import job_documents, metrics
from ..streaming import events as streams
from .registry import query, table

#: fixed value: the moment that queries take for now
AS_OF = "TIMESTAMP_NTZ '2001-01-01 00:00:00'"


def steps(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("name")).agg(F.max("l_shipdate").alias("started_at"), F.count("*").alias("attempt"), F.max("l_linenumber").alias("token"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), F.col("token"))
    return rows.select("job_id", "name", status.alias("status"), "attempt", "started_at", F.col("token").cast("string").alias("claim_token"), (F.col("job_id") % 100).cast("int").alias("percent"))


#: fixed value: the state of a step by its last line's number, from 1
STATUSES = ("pending", "running", "failed", "running", "cancelled", "completed", "running")
_STEPS = f"""s AS (SELECT l_orderkey AS job_id, l_returnflag AS name, {list(STATUSES)}[max(l_linenumber)] AS status,
count(*) AS attempt, max(l_shipdate) AS started_at, CAST(max(l_linenumber) AS VARCHAR) AS claim_token, l_orderkey % 100 AS percent FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {_STEPS}, a AS (SELECT s.*, o_orderstatus <> 'P' AND job_id % 2 = 0 AS may, CASE WHEN job_id % 4 = 0 THEN '2' ELSE 'new' END AS token FROM s JOIN orders ON o_orderkey = job_id),
b AS (SELECT *, may AND status = 'running' AND claim_token = token AS again FROM a), c AS (SELECT *, may AND NOT again AND (status IN ('pending', 'failed', 'cancelled') OR status = 'running' AND epoch_us(TIMESTAMP '2001-01-01') - epoch_us(started_at) > 7200000000) AS fresh FROM b)
SELECT job_id, name, CASE WHEN fresh THEN 'running' ELSE status END AS status, attempt + CAST(fresh AS BIGINT) AS attempt, CASE WHEN fresh THEN token ELSE claim_token END AS claim_token, fresh OR again AS claimed FROM c""")
def step_claim(spark, sf):
    """Jobs in state P are cancelled; every fourth job's steps are claimed under a token that some run under already."""
    rows = steps(spark, sf)
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("processing").alias("status"))
    commands = rows.where("job_id % 2 = 0").select("job_id", "name", F.when(F.col("job_id") % 4 == 0, "2").otherwise("new").alias("claim_token"))
    return transitions.claim_steps(rows, jobs, commands, F.expr(AS_OF)).drop("started_at")


@query(f"""WITH {_STEPS}, c AS (SELECT *, CASE job_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'retry' END AS o FROM s),
d AS (SELECT *, o IN ('completed', 'failed') AND status = 'running' AND claim_token = '4' AS done, o = 'skipped' AND status = 'pending' AS skip, o = 'retry' AND status IN ('failed', 'cancelled') AS retry FROM c)
SELECT job_id, name, CASE WHEN retry THEN 'pending' WHEN done OR skip THEN o ELSE status END AS status, CASE WHEN retry THEN 0 WHEN skip OR done AND o = 'completed' THEN 100 ELSE percent END AS percent,
CASE WHEN NOT coalesce(retry, false) THEN claim_token END AS claim_token, coalesce(retry, false) AS restarted, coalesce(done OR skip, false) AS finished, coalesce(done OR skip OR retry, false) AS applied FROM d""")
def step_finish(spark, sf):
    rows = steps(spark, sf).withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    n = F.col("job_id") % 5
    commands = rows.where(n < 4).select("job_id", "name", F.lit("4").alias("token"), F.when(n == 0, "completed").when(n == 1, "failed").when(n == 2, "skipped").otherwise("retry").alias("outcome"))
    out = transitions.finish_steps(rows, commands, F.expr(AS_OF))
    return out.select("job_id", "name", "status", "percent", "claim_token", F.col("started_at").isNull().alias("restarted"), F.col("finished_at").isNotNull().alias("finished"), "applied")


@query(f"""WITH {_STEPS}, c AS (SELECT *, coalesce(job_id % 3 > 0 AND status = 'running' AND claim_token = '4' AND percent <= job_id % 130 AND job_id % 130 <= 100, false) AS applied FROM s)
SELECT job_id, name, CASE WHEN applied THEN job_id % 130 ELSE percent END AS percent, applied FROM c""")
def step_progress(spark, sf):
    rows = steps(spark, sf)
    commands = rows.where("job_id % 3 > 0").select("job_id", "name", F.lit("4").alias("token"), (F.col("job_id") % 130).cast("int").alias("to"))
    return transitions.advance_steps(rows, commands)


def slots(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    state = F.when(k % 3 == 0, "free").when(k % 3 == 1, "leased").otherwise("expired")
    back = lambda n: F.expr(AS_OF) - F.make_interval(mins=n)
    held = k % 3 > 0
    return s.select(
        k.alias("slot_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("sidecar_id"), k.cast("int").alias("slot_index"), (k % 11 > 0).alias("enabled"), state.alias("state"), F.when(held, k).alias("job_id"),
        F.when(held, F.concat(F.lit("u"), F.col("s_nationkey").cast("string"))).alias("claim_exec_uuid"), F.col("s_nationkey").alias("generation"), F.when(k % 3 == 1, back(F.col("s_nationkey"))).alias("heartbeat_at"),
        F.when(held, F.expr(AS_OF) + F.make_interval(mins=F.lit(10) - F.col("s_nationkey"))).alias("expires_at"), back(F.col("s_nationkey")).alias("updated_at"),
    )


@query("""WITH c AS (SELECT *, s_suppkey % 3 = 1 AND s_nationkey % 2 = 0 AND s_suppkey % 5 > 0 AS mine FROM supplier)
SELECT s_suppkey AS slot_id, CASE WHEN s_suppkey % 3 = 0 OR mine AND s_suppkey % 2 = 1 THEN 'free' WHEN s_suppkey % 3 = 1 THEN 'leased' ELSE 'expired' END AS state, CASE WHEN s_suppkey % 3 > 0 AND NOT (mine AND s_suppkey % 2 = 1) THEN 'u' || s_nationkey END AS claim_exec_uuid,
s_nationkey AS generation, CASE WHEN mine AND s_suppkey % 2 = 0 THEN 20 WHEN s_suppkey % 3 > 0 AND NOT mine THEN 10 - s_nationkey END AS minutes, mine AS applied FROM c""")
def lease_commands(spark, sf):
    """Heartbeats of even slots, releases of odd ones; some come from an older generation and some from another holder."""
    rows = slots(spark, sf)
    generation = F.when(F.col("generation") % 2 == 0, F.col("generation")).otherwise(-1)
    holder = F.when(F.col("slot_id") % 5 > 0, F.coalesce("claim_exec_uuid", F.lit("new"))).otherwise("other")
    commands = rows.select("slot_id", F.when(F.col("slot_id") % 2 == 0, "heartbeat").otherwise("release").alias("command"), holder.alias("exec_uuid"), generation.alias("generation"))
    out = transitions.lease_slots(rows, commands, F.expr(AS_OF))
    left = F.floor(times.seconds_between(F.expr(AS_OF), F.col("expires_at")) / 60).cast("int")
    return out.select("slot_id", "state", "claim_exec_uuid", "generation", left.alias("minutes"), "applied")


_ACQUIRED = """WITH g AS (SELECT 'n' || n_nationkey AS sidecar_id FROM nation WHERE n_nationkey % 5 > 0 AND n_nationkey % 7 > 0), f AS (SELECT s_suppkey, row_number() OVER (ORDER BY 'n' || s_nationkey, s_suppkey) AS n FROM supplier
WHERE s_suppkey % 3 = 0 AND s_suppkey % 11 > 0 AND 'n' || s_nationkey IN (SELECT sidecar_id FROM g) {}), j AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS n FROM customer WHERE c_custkey <= 5)
SELECT s_suppkey AS slot_id, CASE WHEN j.n IS NOT NULL THEN 'leased' WHEN s_suppkey % 3 = 0 THEN 'free' WHEN s_suppkey % 3 = 1 THEN 'leased' ELSE 'expired' END AS state, CASE WHEN j.n IS NOT NULL THEN c_custkey WHEN s_suppkey % 3 > 0 THEN s_suppkey END AS job_id, s_nationkey + CAST(j.n IS NOT NULL AS INTEGER) AS generation
FROM supplier LEFT JOIN f USING (s_suppkey) LEFT JOIN j ON j.n = f.n"""


def _acquired(spark, sf, preferred):
    n = F.col("n_nationkey")
    sidecars = table(spark, sf, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("sidecar_id"), (n % 5 > 0).alias("enabled"), F.lit(True).alias("healthy"), F.lit(False).alias("stale"), F.when(n % 7 > 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("models"))
    commands = table(spark, sf, "customer").where("c_custkey <= 5").select(F.col("c_custkey").alias("job_id"), F.lit("new").alias("exec_uuid"), (-F.col("c_custkey")).alias("place"))
    return transitions.acquire_slots(slots(spark, sf), sidecars, commands, F.expr(AS_OF), preferred).select("slot_id", "state", "job_id", "generation")


@query(_ACQUIRED.format(""))
def lease_acquire(spark, sf):
    return _acquired(spark, sf, None)


@query(_ACQUIRED.format("AND s_nationkey = 8"))
def lease_acquire_preferred(spark, sf):
    return _acquired(spark, sf, "n8")


@query("""SELECT s_suppkey AS slot_id, CASE WHEN s_suppkey % 3 = 1 AND s_nationkey > 10 THEN 'expired' WHEN s_suppkey % 3 = 2 AND s_nationkey > 15 THEN 'free' WHEN s_suppkey % 3 = 0 THEN 'free' WHEN s_suppkey % 3 = 1 THEN 'leased' ELSE 'expired' END AS state,
CASE WHEN s_suppkey % 3 = 1 OR s_suppkey % 3 = 2 AND s_nationkey <= 15 THEN s_suppkey END AS job_id, s_suppkey % 3 = 1 AND s_nationkey <= 10 AS beats FROM supplier""")
def lease_expiry(spark, sf):
    return transitions.expire_slots(slots(spark, sf), F.expr(AS_OF)).select("slot_id", "state", "job_id", F.col("heartbeat_at").isNotNull().alias("beats"))


@query("""SELECT registered_id, available FROM (SELECT 'n' || s_nationkey AS registered_id, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS available, sum(s_suppkey % 4) AS running FROM supplier
WHERE s_nationkey % 3 > 0 AND s_nationkey % 4 > 0 AND s_nationkey <= 20 GROUP BY 1) WHERE available > 0 ORDER BY available DESC, running, registered_id LIMIT 1""")
def route_sidecar(spark, sf):
    """Healthy ones (not every third) that can do what is asked (not every fourth), seen in the last 30 seconds (numbers up to 20)."""
    s, n = table(spark, sf, "supplier"), F.col("s_nationkey")
    rows = s.groupBy("s_nationkey").agg(F.count_if(F.col("s_suppkey") % 3 == 0).alias("available_slots"), F.sum(F.col("s_suppkey") % 4).alias("running_requests"))
    seen = F.expr(AS_OF) - F.make_interval(secs=n * 1.5)
    rows = rows.withColumns({"registered_id": F.concat(F.lit("n"), n.cast("string")), "healthy": n % 3 > 0, "stale": transitions.older(seen, F.expr(AS_OF), transitions.STALE_SECONDS), "capabilities": F.when(n % 4 > 0, F.array(F.lit("text"), F.lit("vision"))).otherwise(F.array(F.lit("text"))), "served_models": F.array(F.lit("m"))})
    return transitions.routed(rows, ["vision"]).join(rows.select("registered_id", F.col("available_slots").alias("available")), "registered_id")


_QUEUE = """WITH q AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 4 = 0 THEN 'preferred sidecar n1 stale' END AS unavailable FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 40 < 4 ORDER BY o_orderdate, o_orderkey LIMIT 40),
r AS (SELECT *, o_custkey % 40 AS u FROM q)"""


@query(f"""WITH RECURSIVE {_QUEUE.removeprefix('WITH ')}, k AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM r),
g AS (SELECT 0 AS n, 3 AS active, map {{0: 1, 1: 0, 2: 5, 3: 0}} AS users, CAST(NULL AS BIGINT) AS job_id, CAST(NULL AS VARCHAR) AS queue_reason UNION ALL
SELECT k.n, CASE WHEN s.reason IS NULL THEN g.active + 1 ELSE g.active END, CASE WHEN s.reason IS NULL THEN map {{0: users[0] + CAST(u = 0 AS INT), 1: users[1] + CAST(u = 1 AS INT), 2: users[2] + CAST(u = 2 AS INT), 3: users[3] + CAST(u = 3 AS INT)}} ELSE users END, k.o_orderkey, s.reason
FROM g JOIN k ON k.n = g.n + 1, LATERAL (SELECT CASE WHEN unavailable IS NOT NULL THEN unavailable WHEN g.active >= 12 THEN 'global active-job limit reached' WHEN u < 2 AND users[u] >= 4 OR u = 3 AND users[u] >= 2 THEN 'per-user active-job limit reached' END AS reason) s)
SELECT job_id, CASE WHEN queue_reason IS NULL THEN 'admitted' ELSE 'queued' END AS state, queue_reason FROM g WHERE n > 0""")
def promote_queued(spark, sf):
    """From durable counters: users 0 and 1 may have four, user 2 any number, user 3 has no counter yet and may have two; twelve in all."""
    rows = table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_custkey % 40 < 4")
    queued = rows.select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 40).alias("user_id"), F.col("o_orderdate").alias("queued_at"), F.when(F.col("o_orderkey") % 4 == 0, "preferred sidecar n1 stale").alias("unavailable"))
    counters = spark.createDataFrame([("global", 3, 12), ("user:0", 1, 4), ("user:1", 0, 4), ("user:2", 5, 0)], "key string, active long, limit long")
    return transitions.promoted(queued, counters, (12, 2), 40)


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'P' THEN 'published' WHEN 'F' THEN 'publishing' ELSE 'pending' END AS state FROM orders),
b AS (SELECT id, created_at, CASE WHEN state = 'publishing' AND epoch_us(TIMESTAMP '2001-01-01') - epoch_us(created_at) > 300000000 THEN 'pending' ELSE state END AS state FROM o)
SELECT id, CASE WHEN state = 'pending' AND row_number() OVER (PARTITION BY state ORDER BY created_at, id) <= 50 THEN 'publishing' ELSE state END AS state FROM b""")
def outbox_publish(spark, sf):
    s = F.col("o_orderstatus")
    outbox = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(s == "P", "published").when(s == "F", "publishing").otherwise("pending").alias("state"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("claimed_at"))
    return transitions.publish(outbox, F.expr(AS_OF), 50).select("id", "state")


@query("""WITH o AS (SELECT o_orderkey AS id, ['pending', 'publishing', 'published', 'delivered'][o_orderkey % 4 + 1] AS state, ['published', 'delivered', 'failed'][o_orderkey // 4 % 4 + 1] AS o FROM orders)
SELECT id, CASE WHEN o = 'published' AND state IN ('pending', 'publishing') THEN o WHEN o = 'delivered' AND state IN ('pending', 'published', 'publishing') THEN o WHEN o = 'failed' AND state = 'publishing' THEN 'pending' ELSE state END AS state,
coalesce(o = 'published' AND state IN ('pending', 'publishing'), false) AS published_now, coalesce(o = 'delivered' AND state IN ('pending', 'published', 'publishing'), false) AS delivered_now FROM o""")
def outbox_delivered(spark, sf):
    n = F.col("o_orderkey")
    pick = lambda i, *values: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    rows = table(spark, sf, "orders").select(n.alias("id"), pick(n % 4, "pending", "publishing", "published", "delivered").alias("state"), F.lit(None).cast("timestamp_ntz").alias("published_at"), F.lit(None).cast("timestamp_ntz").alias("delivered_at"))
    outcomes = table(spark, sf, "orders").where(n.bitwiseAND(F.lit(12)) < 12).select(n.alias("id"), pick(F.floor(n / 4) % 4, "published", "delivered", "failed").alias("outcome"))
    out = transitions.delivered(rows, outcomes, F.expr(AS_OF))
    return out.select("id", "state", F.col("published_at").isNotNull().alias("published_now"), F.col("delivered_at").isNotNull().alias("delivered_now"))


def _admissions(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "admitted").otherwise("queued").alias("state"))
    counters = rows.where("state = 'admitted'").groupBy(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key")).agg(F.count("*").alias("active"))
    counters = counters.unionByName(rows.agg(F.lit("global").alias("key"), F.count_if(F.col("state") == "admitted").alias("active")))
    return transitions.finish_admissions(rows, orders.where("o_totalprice > 300000").select(F.col("o_orderkey").alias("job_id")), counters)


@query("SELECT o_orderkey AS job_id, o_custkey AS user_id, CASE WHEN o_orderstatus <> 'F' THEN 'queued' WHEN o_totalprice > 300000 THEN 'finished' ELSE 'admitted' END AS state FROM orders")
def admission_finish(spark, sf):
    return _admissions(spark, sf)[0]


@query("""SELECT 'user:' || o_custkey AS key, count(*) FILTER (WHERE o_totalprice <= 300000) AS active FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
UNION ALL SELECT 'global', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <= 300000""")
def admission_counters(spark, sf):
    return _admissions(spark, sf)[1]


@query("""SELECT key, CASE WHEN key = 'global' THEN 4 WHEN key LIKE 'user:%' THEN 2 ELSE 9 END AS "limit" FROM (SELECT 'user:' || c_custkey AS key FROM customer UNION ALL SELECT 'global' UNION ALL SELECT 'other')""")
def sync_limits(spark, sf):
    keys = table(spark, sf, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key")).unionByName(spark.createDataFrame([("global",), ("other",)], "key string"))
    return transitions.synced_limits(keys.withColumns({"active": F.lit(0), "limit": F.lit(9)}), 4, 2).select("key", "limit")


@query("""SELECT coalesce(a.k, b.k) AS c_custkey, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0) a
FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) b ON a.k = b.k""")
def upsert(spark, sf):
    state = table(spark, sf, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_acctbal").alias("v"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return transitions.upserted(state, new, "c_custkey", ["v"])


@query("""SELECT o_orderkey AS job_id, p AS position, n AS name, CASE WHEN w THEN 'pending' ELSE 'skipped' END AS status, CASE WHEN w THEN 0 ELSE 100 END AS percent FROM
(SELECT o_orderkey, unnest([0, 1, 2, 3, 4, 5]) AS p, unnest(['download', 'transcribe', 'snapshots', 'slides', 'summarize', 'export']) AS n, unnest([o_orderstatus = 'F' OR o_totalprice > 200000, true, o_orderstatus = 'F', o_totalprice > 200000, true, true]) AS w FROM orders)""")
def seed_steps(spark, sf):
    """Without snapshots and slides nothing is downloaded."""
    return transitions.seeded_steps(table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderstatus") == "F").alias("with_snapshots"), (F.col("o_totalprice") > 200000).alias("with_slides")))


@query(f"""WITH {_STEPS} SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.job_id = o_orderkey AND s.status = 'running') AND o_orderstatus <> 'F' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'processing' END AS status FROM orders""")
def terminalise(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing").alias("status"))
    return transitions.terminalised(jobs, steps(spark, sf), jobs.where("job_id % 2 = 0")).select("job_id", "status")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS generation, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) < count(*) OVER (PARTITION BY user_id) AS stale FROM events""")
def generation_mint(spark, sf):
    return transitions.generations(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("event_id", "generation", "stale")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus <> 'O')""")
def cascade_delete(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    _, left = transitions.deleted(orders, table(spark, sf, "lineitem"), orders.where("l_orderkey % 4 = 0"), "l_orderkey", F.col("o_orderstatus") == "O")
    return left.select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT user_id, CASE WHEN c = 'grant' THEN true WHEN c = 'revoke' THEN false ELSE active END AS active, changed FROM (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 3 = 0 END AS active, CASE c_custkey % 4 WHEN 0 THEN 'grant' WHEN 1 THEN 'revoke' END AS c,
CASE c_custkey % 4 WHEN 0 THEN coalesce(c_custkey % 3 <> 0, true) WHEN 1 THEN c_custkey % 3 = 0 ELSE false END AS changed FROM customer) WHERE active IS NOT NULL OR c = 'grant'""")
def soft_grant(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    roles = c.where("user_id % 3 < 2").select("user_id", (F.col("user_id") % 3 == 0).alias("active"), F.lit(0).alias("changes"))
    commands = c.where("user_id % 4 < 2").select("user_id", F.when(F.col("user_id") % 4 == 0, "grant").otherwise("revoke").alias("command"))
    return transitions.regranted(roles, commands).select("user_id", "active", "changed")


@query("""SELECT o_orderkey AS job, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS items FROM orders LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) ON l_orderkey = o_orderkey AND n <= 3 GROUP BY 1""")
def export_nested(spark, sf):
    items = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "job")
    out = job_documents.with_children(table(spark, sf, "orders").select(F.col("o_orderkey").alias("job")), "job", {"items": (items, ["l_linenumber", "l_partkey", "l_suppkey"])}, {"items": 3})
    one = lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))
    return out.select("job", F.array_join(F.transform("items", one), ",").alias("items"))


@query("SELECT l_orderkey AS job, l_partkey, l_suppkey, l_quantity FROM lineitem")
def import_explode(spark, sf):
    """Export to JSON text and back."""
    items = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "job")
    jobs = job_documents.with_children(items.select("job").distinct(), "job", {"items": (items, ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])})
    raw = jobs.select(job_documents.document(jobs, ["job", "items"]).alias("raw"))
    parsed = raw.select(F.from_json("raw", "version string, job bigint, items array<struct<l_partkey: bigint, l_suppkey: bigint, l_linenumber: int, l_quantity: double>>").alias("d")).select("d.*")
    return job_documents.exploded(parsed.where(F.col("version") == job_documents.VERSION), "job", "items").select("job", "l_partkey", "l_suppkey", "l_quantity")


@query("""SELECT event_type AS name, '# HELP ' || event_type || ' Events' || chr(10) || '# TYPE ' || event_type || ' counter' || chr(10) || event_type || ' ' || count(*) AS text FROM events GROUP BY event_type""")
def metrics_text(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value")).withColumns({"kind": F.lit("counter"), "help": F.lit("Events")})
    return metrics.rendered(counts)


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_counters(spark, sf):
    return streams.drained(streams.counters(streams.source(spark, sf), "event_type"), "complete")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf):
    """The stream is delivered twice."""
    once = streams.source(spark, sf)
    return streams.drained(streams.delivered_once(once.unionByName(streams.source(spark, sf)), "event_id").select("event_id", "user_id"))


@query("""SELECT user_id, count(*) AS beats, min(epoch_us(ts)) AS opened FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 86400000000 THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s""")
def stream_session(spark, sf):
    out = streams.drained(streams.heartbeats(streams.source(spark, sf), "user_id", 86400), "complete")
    return out.select("user_id", "beats", F.unix_micros("w.start").alias("opened"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), k AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL
SELECT k.user_id, n.t FROM k, LATERAL (SELECT min(e.t) AS t FROM e WHERE e.user_id = k.user_id AND e.t - k.t >= 86400000000) n WHERE n.t IS NOT NULL)
SELECT event_id, row_number() OVER (PARTITION BY e.user_id, k.t ORDER BY e.t, event_id) > 3 AS denied FROM e ASOF JOIN k ON e.user_id = k.user_id AND e.t >= k.t""")
def stream_rate_limit(spark, sf):
    return streams.drained(streams.rate_limited(streams.source(spark, sf), "user_id", 86400.0, 3))


@query("SELECT user_id, max(value) AS progress FROM events GROUP BY user_id")
def stream_progress(spark, sf):
    return streams.drained(streams.running_maximum(streams.source(spark, sf), "user_id"), "complete")


@query("SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS generation FROM events GROUP BY user_id")
def stream_generation(spark, sf):
    return streams.drained(streams.newest_generation(streams.source(spark, sf), "user_id", F.get_json_object("props", "$.k").cast("bigint")), "complete")


@query("""SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) >= max(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM events""")
def stream_stale_delivery(spark, sf):
    """Each delivery is accepted, or refused as one of an older generation than its key has seen."""
    return streams.drained(streams.not_older(streams.source(spark, sf), "user_id", F.get_json_object("props", "$.k").cast("double")))


@query("""SELECT event_id, coalesce(value >= max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM events""")
def stream_monotone_progress(spark, sf):
    """Each report of progress is accepted, or refused because it goes back."""
    return streams.drained(streams.not_older(streams.source(spark, sf), "user_id", F.col("value")))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, event_type IN ('view', 'signup') AS ok, value <= 60 AS deps, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT user_id, 0 AS n, 0 AS failures, CAST([] AS DOUBLE[]) AS restarts, CAST(NULL AS BIGINT) AS event_id, '' AS action FROM (SELECT DISTINCT user_id FROM e) UNION ALL
SELECT g.user_id, e.n, CASE WHEN a.action IN ('ok', 'restart') THEN 0 ELSE g.failures + 1 END, CASE WHEN a.action = 'restart' THEN list_append(a.recent, e.t) ELSE g.restarts END, e.event_id, a.action FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1,
LATERAL (SELECT list_filter(g.restarts, lambda x: x >= e.t - 864000) AS recent, CASE WHEN e.ok THEN 'ok' WHEN NOT e.deps THEN 'dependency' WHEN g.failures + 1 < 3 THEN 'waiting' WHEN len(list_filter(g.restarts, lambda x: x >= e.t - 864000)) >= 1 THEN 'limited' ELSE 'restart' END AS action) a)
SELECT event_id, action, failures FROM g WHERE n > 0""")
def watchdog_actions(spark, sf):
    """Three failures running restart what they tell of, unless a dependency is down or it was restarted in the ten days before."""
    rows = table(spark, sf, "events").select("event_id", "user_id", times.epoch_seconds(F.col("ts")).alias("t"), F.col("event_type").isin("view", "signup").alias("ok"), (F.col("value") <= 60).alias("deps"))
    return folds.watchdog(rows, "user_id", "t", "event_id", "ok", "deps", most=1, window=864000.0).select("event_id", "action", "failures")


@query("""SELECT event_id, CASE WHEN bad THEN row_number() OVER (PARTITION BY user_id, g, bad ORDER BY ts, event_id) ELSE 0 END AS failures FROM
(SELECT event_id, user_id, ts, event_type IN ('error', 'click') AS bad, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)""")
def watchdog_failures(spark, sf):
    """Consecutive failures of each user; any success sets the counter back."""
    from pyspark.sql.window import Window

    over = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("event_type").isin("error", "click")
    rows = table(spark, sf, "events").withColumn("g", F.count_if(~bad).over(over))
    run = F.count_if(bad).over(Window.partitionBy("user_id", "g").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("event_id", F.when(bad, run).otherwise(0).alias("failures"))
