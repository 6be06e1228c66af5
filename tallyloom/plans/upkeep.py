"""Timers, maintenance cycles and audited roles over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transitions
from ..sources.tables import shared_folder
from ..streaming import events as streams
from ..streaming.timers import claims
from ..streaming.upkeep import Cycle, Step
from .registry import query, table

TTL, DELAY = 100_000, 3_600

_KIND = "CASE event_type WHEN 'signup' THEN 'claim' WHEN 'click' THEN 'beat' WHEN 'error' THEN 'release' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS at, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE {_KIND} IS NOT NULL),
g AS (SELECT user_id, 0 AS n, CAST(NULL AS BIGINT) AS held, CAST(NULL AS BIGINT) AS until, 0 AS beats, CAST(NULL AS BIGINT) AS late, CAST(NULL AS BIGINT) AS late_until, 0 AS late_beats, CAST(NULL AS BIGINT) AS freed, CAST(NULL AS BIGINT) AS freed_at, 0 AS freed_beats FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT g.user_id, e.n, CASE WHEN kind = 'release' THEN NULL WHEN open IS NOT NULL THEN open WHEN kind = 'claim' THEN e.at END, CASE WHEN kind = 'release' THEN NULL WHEN open IS NOT NULL OR kind = 'claim' THEN e.at + {TTL}000000 END,
CASE WHEN open IS NOT NULL AND kind <> 'release' THEN g.beats + 1 ELSE 0 END, CASE WHEN e.at > g.until THEN g.held END, CASE WHEN e.at > g.until THEN g.until END, g.beats, CASE WHEN kind = 'release' THEN open END, CASE WHEN kind = 'release' AND open IS NOT NULL THEN e.at END, g.beats
FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1, LATERAL (SELECT CASE WHEN e.at > g.until THEN NULL ELSE g.held END AS open) o),
m AS (SELECT epoch_ms(max(ts)) - {DELAY}000 AS w FROM events)
SELECT user_id AS key, late AS claimed_at, late_until AS ended_at, late_beats AS beats, 'expired' AS reason FROM g WHERE late IS NOT NULL
UNION ALL SELECT user_id, freed, freed_at, freed_beats, 'released' FROM g WHERE freed IS NOT NULL
UNION ALL SELECT user_id, held, until, beats, 'expired' FROM g, m WHERE held IS NOT NULL AND n = (SELECT max(n) FROM e WHERE e.user_id = g.user_id) AND CAST(ceil(until / 1000.0) AS BIGINT) < w""")
def stream_claim_timers(spark, sf):
    """Sign-ups claim, clicks beat, errors release; what is silent for {TTL} seconds expires, also after its last event."""
    kind = F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "click", "beat").when(F.col("event_type") == "error", "release")
    return streams.drained(claims(streams.source(spark, sf), "user_id", kind, TTL, f"{DELAY} seconds"))


LEASE = 432_000
#: State tables of the cycle.
STATE = {"slots": "slot_id long, state string, expires_at timestamp_ntz, updated_at timestamp_ntz", "outbox": "id long, state string, created_at timestamp_ntz, claimed_at timestamp_ntz", "tally": "kind string, n long"}


def taken(batch, tables, moment):
    """Sign-ups lease their user's slot until so long after the last of them; purchases go to the outbox."""
    last = batch.where("event_type = 'signup'").groupBy(F.col("user_id").alias("slot_id")).agg((F.max("ts") + F.expr(f"INTERVAL '{LEASE}' SECOND")).alias("_until"))
    both = tables["slots"].join(last, "slot_id", "full_outer")
    new = F.col("_until").isNotNull()
    slots = both.select("slot_id", F.when(new, "leased").otherwise(F.col("state")).alias("state"), F.coalesce("_until", "expires_at").alias("expires_at"), F.when(new, moment).otherwise(F.col("updated_at")).alias("updated_at"))
    fresh = batch.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.lit("pending").alias("state"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("claimed_at"))
    return {"slots": slots, "outbox": tables["outbox"].unionByName(fresh)}


def arrived(batch, tables, moment):
    """Every other message that is on its way arrives."""
    there = (F.col("state") == "publishing") & (F.col("id") % 2 == 0)
    return {"outbox": tables["outbox"].withColumn("state", F.when(there, "delivered").otherwise(F.col("state")))}


def broken(batch, tables, moment):
    """Writes one table and fails on the next."""
    return {"slots": tables["slots"].limit(0), "outbox": tables["outbox"].withColumn("state", F.raise_error(F.lit("probe failed")))}


def tallied(batch, tables, moment):
    more = batch.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return {"tally": tables["tally"].unionByName(more).groupBy("kind").agg(F.sum("n").alias("n"))}


STEPS = [
    Step("take", taken), Step("reap", lambda _, tables, moment: {"slots": transitions.expire_slots(tables["slots"], moment)}), Step("deliver", arrived), Step("probe", broken),
    Step("publish", lambda _, tables, moment: {"outbox": transitions.publish(tables["outbox"], moment, 50)}), Step("tally", tallied),
]


@query(f"""WITH e AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS b FROM events), m AS (SELECT b, max(ts) AS now FROM e GROUP BY 1),
l AS (SELECT user_id, max(ts) AS last, max_by(b, ts) AS b FROM e WHERE event_type = 'signup' GROUP BY 1),
s AS (SELECT user_id, CASE WHEN l.b = 1 THEN 'free' WHEN l.b = 3 AND last + INTERVAL {LEASE} SECOND >= now THEN 'leased' WHEN l.b = 3 THEN 'expired' WHEN last + INTERVAL {LEASE} SECOND < now THEN 'free' ELSE 'expired' END AS state FROM l JOIN m ON m.b = l.b),
p AS (SELECT event_id AS id, ts, b FROM e WHERE event_type = 'purchase'),
p1 AS (SELECT id FROM p WHERE b = 1 ORDER BY ts, id LIMIT 50), d1 AS (SELECT id FROM p1 WHERE id % 2 = 0),
p2 AS (SELECT id FROM p WHERE b <= 2 AND id NOT IN (FROM d1) ORDER BY ts, id LIMIT 50), d2 AS (SELECT id FROM p2 WHERE id % 2 = 0 UNION ALL FROM d1),
p3 AS (SELECT id FROM p WHERE id NOT IN (FROM d2) ORDER BY ts, id LIMIT 50)
SELECT 'slots' AS name, CAST(user_id AS VARCHAR) AS key, state FROM s UNION ALL SELECT 'outbox', CAST(id AS VARCHAR), CASE WHEN id IN (FROM d2) THEN 'delivered' WHEN id IN (FROM p3) THEN 'publishing' ELSE 'pending' END FROM p
UNION ALL SELECT 'tally', event_type, CAST(count(*) AS VARCHAR) FROM events GROUP BY 2
UNION ALL SELECT 'step', b || ' ' || s, CASE s WHEN 'probe' THEN 'failed' ELSE 'done' END FROM m, (SELECT unnest(['take', 'reap', 'deliver', 'probe', 'publish', 'tally']) AS s)""")
def stream_maintenance_cycle(spark, sf):
    """Three micro-batches of ten days each; the state of all tables after them, and the outcome of each step."""
    folder = shared_folder(spark, "cycle")
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    ends = ["2024-01-11", "2024-01-21"]
    for low, high in zip([None, *ends], [*ends, None], strict=True):  # files in the order of their days
        part = rows.where((F.col("ts") >= F.lit(low).cast("timestamp_ntz") if low else F.lit(True)) & (F.col("ts") < F.lit(high).cast("timestamp_ntz") if high else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    cycle = Cycle(spark, folder, STATE, STEPS)
    cycle.start(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")).awaitTermination()
    now = cycle.tables(cycle.record(2))
    records = [(f"{b + 1} {s['name']}", s["outcome"]) for b in range(3) for s in cycle.record(b)["steps"]]
    told = lambda name, key, state: now[name].select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key"), F.col(state).cast("string").alias("state"))
    steps = spark.createDataFrame([("step", *r) for r in records], "name string, key string, state string")
    return told("slots", "slot_id", "state").unionByName(told("outbox", "id", "state")).unionByName(told("tally", "kind", "n")).unionByName(steps)


_COMMANDS = """c AS (SELECT event_id AS id, user_id, ts AS moment, CASE event_type WHEN 'signup' THEN 'grant' WHEN 'purchase' THEN 'grant' WHEN 'error' THEN 'revoke' END AS command, 'op' || event_id % 7 AS actor, CASE WHEN event_id % 3 > 0 THEN event_type END AS reason FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
k AS (SELECT *, command = 'grant' AS target, coalesce(lag(command = 'grant') OVER w, user_id % 5 = 0) AS found, user_id % 5 <= 1 OR coalesce(bool_or(command = 'grant') OVER (PARTITION BY user_id ORDER BY moment, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ever FROM c WINDOW w AS (PARTITION BY user_id ORDER BY moment, id)),
f AS (SELECT user_id, moment, id, CASE WHEN NOT target THEN 'revoked' WHEN ever THEN 'regranted' ELSE 'granted' END AS change, actor, reason FROM k WHERE found <> target)"""


def role_rows(spark, sf):
    """Of five users one holds the role and one has lost it; sign-ups and purchases ask for it, errors revoke it."""
    e, u = table(spark, sf, "events"), F.col("user_id")
    then = F.lit("2023-12-01").cast("timestamp_ntz")
    roles = e.select("user_id").distinct().where(u % 5 <= 1).select(
        "user_id", (u % 5 == 0).alias("active"), F.lit("seed").alias("granted_by"), then.alias("granted_at"), F.lit("first").alias("grant_reason"),
        F.when(u % 5 == 1, "seed").alias("revoked_by"), F.when(u % 5 == 1, then).alias("revoked_at"), F.when(u % 5 == 1, "left").alias("revoke_reason"),
    )
    command = F.when(F.col("event_type").isin("signup", "purchase"), "grant").when(F.col("event_type") == "error", "revoke")
    commands = e.select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp_ntz").alias("at"), command.alias("command"), F.concat(F.lit("op"), (F.col("event_id") % 7).cast("string")).alias("by"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("reason"))
    return roles, commands


@query(f'WITH {_COMMANDS} SELECT user_id, epoch_us(moment) AS "at", id, change, actor, reason FROM f')
def role_change_feed(spark, sf):
    return transitions.applied(*role_rows(spark, sf)).withColumnRenamed("by", "actor").withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))


@query(f"""WITH {_COMMANDS}, r AS (SELECT DISTINCT user_id, user_id % 5 = 0 AS active, epoch_us(TIMESTAMP '2023-12-01') AS t FROM events WHERE user_id % 5 <= 1),
g AS (SELECT user_id, max_by(change, (moment, id)) <> 'revoked' AS active, max((moment, id)) FILTER (WHERE change <> 'revoked') AS lg, max((moment, id)) FILTER (WHERE change = 'revoked') AS lr FROM f GROUP BY 1)
SELECT coalesce(r.user_id, g.user_id) AS user_id, coalesce(g.active, r.active) AS active, CASE WHEN lg IS NULL THEN CASE WHEN r.user_id IS NOT NULL THEN 'seed' END ELSE fg.actor END AS granted_by, CASE WHEN lg IS NULL THEN r.t ELSE epoch_us(fg.moment) END AS granted_at,
CASE WHEN lg IS NULL THEN CASE WHEN r.user_id IS NOT NULL THEN 'first' END ELSE fg.reason END AS grant_reason, CASE WHEN g.active THEN NULL WHEN lr IS NULL THEN CASE WHEN r.user_id % 5 = 1 THEN 'seed' END ELSE fr.actor END AS revoked_by,
CASE WHEN g.active THEN NULL WHEN lr IS NULL THEN CASE WHEN r.user_id % 5 = 1 THEN r.t END ELSE epoch_us(fr.moment) END AS revoked_at, CASE WHEN lr IS NULL THEN CASE WHEN r.user_id % 5 = 1 THEN 'left' END ELSE fr.reason END AS revoke_reason
FROM r FULL JOIN g ON g.user_id = r.user_id LEFT JOIN f AS fg ON fg.user_id = g.user_id AND (fg.moment, fg.id) = lg LEFT JOIN f AS fr ON fr.user_id = g.user_id AND (fr.moment, fr.id) = lr""")
def roles_audited(spark, sf):
    roles, commands = role_rows(spark, sf)
    out = transitions.audited(roles, transitions.applied(roles, commands))
    return out.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("granted_at", "revoked_at")})


@query(f"WITH {_COMMANDS}, n AS (SELECT *, lead(moment) OVER w AS e, lead(actor) OVER w AS ended_by FROM f WINDOW w AS (PARTITION BY user_id ORDER BY moment, id)) SELECT user_id, epoch_us(moment) AS valid_from, epoch_us(e) AS valid_to, actor AS granted_by, ended_by FROM n WHERE change <> 'revoked'")
def role_validity(spark, sf):
    out = transitions.validity(transitions.applied(*role_rows(spark, sf)))
    return out.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("valid_from", "valid_to")})
