"""State changes as pure transitions: state and commands give the next state; nothing is updated in place.

Each takes the rows as they are and a moment `as_of`, never the clock, and returns rows in which a conditional change has
been made where its guard holds. Commands hold one row for each key at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed values: seconds after which a running step is an orphan, a lease expires, a quarantined slot is free again, and a
#: publishing claim is stale
ORPHAN_SECONDS, LEASE_SECONDS, QUARANTINE_SECONDS, CLAIM_SECONDS = 7200, 1200, 900, 300
#: fixed value: seconds after which what a sidecar said of itself is stale
STALE_SECONDS = 30
#: fixed values: steps of a job and the flags (columns of the job) one of which must be set, or they are skipped
STEPS = (("download", ("with_snapshots", "with_slides")), ("transcribe", ()), ("snapshots", ("with_snapshots",)), ("slides", ("with_slides",)), ("summarize", ()), ("export", ()))
#: fixed values: queued jobs that are looked at together, and reasons of those that stay
PROMOTED = 10
GLOBAL_REASON, USER_REASON = "global active-job limit reached", "per-user active-job limit reached"


def older(ts: Column, as_of: Column, seconds: float) -> Column:
    """Strictly more than so many seconds before `as_of`."""
    return F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")) > int(seconds * 1e6)


def _commanded(state: DataFrame, commands: DataFrame, key: list[str]) -> DataFrame:
    return state.join(commands.withColumn("_commanded", F.lit(True)), key, "left").withColumn("_commanded", F.coalesce("_commanded", F.lit(False)))


def claim_steps(steps: DataFrame, jobs: DataFrame, commands: DataFrame, as_of: Column) -> DataFrame:
    """job_id, name, status, attempt, started_at, claim_token, claimed.

    A commanded step that is pending, failed, cancelled, or running for longer than ORPHAN_SECONDS becomes running in its next
    attempt under the command's token; a step that runs under this token already is claimed as it is. Steps of unknown, failed and
    cancelled jobs (job_id, status) are not claimed.
    """
    both = _commanded(steps, commands.withColumnRenamed("claim_token", "_token"), ["job_id", "name"]).join(jobs.select("job_id", F.col("status").alias("_job")), "job_id", "left")
    alive = F.col("_commanded") & F.coalesce(~F.col("_job").isin("failed", "cancelled"), F.lit(False))
    again = alive & F.coalesce((F.col("status") == "running") & (F.col("claim_token") == F.col("_token")), F.lit(False))
    orphan = (F.col("status") == "running") & older(F.col("started_at"), as_of, ORPHAN_SECONDS)
    may = alive & ~again & (F.col("status").isin("pending", "failed", "cancelled") | F.coalesce(orphan, F.lit(False)))
    new = lambda c, value: F.when(may, value).otherwise(F.col(c)).alias(c)
    return both.select("job_id", "name", new("status", F.lit("running")), new("attempt", F.col("attempt") + 1), new("started_at", as_of), new("claim_token", F.col("_token")), (may | again).alias("claimed"))


def finish_steps(steps: DataFrame, commands: DataFrame, as_of: Column) -> DataFrame:
    """Steps after commands (job_id, name, token, outcome).

    completed, failed: only a running step under the same token. skipped: only a pending step, whatever the token. retry: only a
    failed or cancelled step; it is pending at 0 % again, without token, start and end.
    """
    both = _commanded(steps, commands, ["job_id", "name"])
    o, status = F.col("outcome"), F.col("status")
    done = o.isin("completed", "failed") & (status == "running") & (F.col("claim_token") == F.col("token"))
    skip, retry = (o == "skipped") & (status == "pending"), (o == "retry") & status.isin("failed", "cancelled")
    done, skip, retry = (F.col("_commanded") & F.coalesce(x, F.lit(False)) for x in (done, skip, retry))
    kept = lambda c: F.when(~retry, F.col(c))
    return both.select(
        "job_id", "name", F.when(retry, "pending").when(done | skip, o).otherwise(status).alias("status"),
        F.when(retry, 0).when(skip | (done & (o == "completed")), 100).otherwise(F.col("percent")).alias("percent"), kept("claim_token").alias("claim_token"), kept("started_at").alias("started_at"),
        F.when(done | skip, as_of).otherwise(kept("finished_at")).alias("finished_at"), (done | skip | retry).alias("applied"),
    )


def advance_steps(steps: DataFrame, commands: DataFrame) -> DataFrame:
    """Steps after progress (job_id, name, token, to): only forward, only of a running step under the same token."""
    both = _commanded(steps, commands, ["job_id", "name"])
    may = F.coalesce(F.col("_commanded") & (F.col("status") == "running") & (F.col("claim_token") == F.col("token")) & (F.col("percent") <= F.col("to")) & F.col("to").between(0, 100), F.lit(False))
    return both.select("job_id", "name", F.when(may, F.col("to")).otherwise(F.col("percent")).alias("percent"), may.alias("applied"))


def acquire_slots(slots: DataFrame, sidecars: DataFrame, commands: DataFrame, as_of: Column, preferred: str | None = None) -> DataFrame:
    """Slots (slot_id, sidecar_id, slot_index, enabled, state, job_id, claim_exec_uuid, generation, heartbeat_at, expires_at) after
    commands (job_id, exec_uuid, place) that want one each, in the order of their places.

    Free and enabled slots of eligible sidecars (sidecar_id, enabled, healthy, stale, models) are taken in the order of sidecar and
    index, of the preferred sidecar alone if there is one. The fleet is small; of the commands only as many as it has free slots count.
    """
    good = sidecars.where("enabled AND healthy AND NOT stale AND size(models) > 0").select("sidecar_id")
    free = slots.where("enabled AND state = 'free'").join(good, "sidecar_id", "left_semi")
    free = free.where(F.col("sidecar_id") == preferred) if preferred else free
    wanted = commands.orderBy("place", "job_id").limit(free.count())
    number = lambda *order: F.row_number().over(Window.orderBy(*order))
    free = free.select("slot_id", number("sidecar_id", "slot_index").alias("_n"))
    taken = free.join(wanted.select(F.col("job_id").alias("_job"), F.col("exec_uuid").alias("_uuid"), number("place", "job_id").alias("_n")), "_n").drop("_n")
    both = slots.join(F.broadcast(taken), "slot_id", "left")
    take = F.col("_uuid").isNotNull()
    until = as_of + F.expr(f"INTERVAL '{LEASE_SECONDS}' SECOND")
    new = lambda c, value: F.when(take, value).otherwise(F.col(c))
    return both.withColumns({"state": new("state", F.lit("leased")), "job_id": new("job_id", F.col("_job")), "claim_exec_uuid": new("claim_exec_uuid", F.col("_uuid")), "generation": F.col("generation") + take.cast("int"), "heartbeat_at": new("heartbeat_at", as_of), "expires_at": new("expires_at", until)}).drop("_job", "_uuid")


def lease_slots(slots: DataFrame, commands: DataFrame, as_of: Column) -> DataFrame:
    """Slots after commands (slot_id, command, exec_uuid, generation): heartbeat and release.

    Both count only for a leased slot under its own exec_uuid and generation; a heartbeat extends the lease, a release frees the slot.
    """
    both = _commanded(slots, commands.withColumnsRenamed({"exec_uuid": "_uuid", "generation": "_generation"}), ["slot_id"])
    mine = F.coalesce((F.col("claim_exec_uuid") == F.col("_uuid")) & (F.col("generation") == F.col("_generation")) & (F.col("state") == "leased"), F.lit(False))
    beat, free = mine & (F.col("command") == "heartbeat"), mine & (F.col("command") == "release")
    until = as_of + F.expr(f"INTERVAL '{LEASE_SECONDS}' SECOND")
    kept = lambda c, value: F.when(beat, value).when(~free, F.col(c)).alias(c)
    return both.select("slot_id", F.when(free, "free").otherwise(F.col("state")).alias("state"), F.when(~free, F.col("claim_exec_uuid")).alias("claim_exec_uuid"), "generation", kept("heartbeat_at", as_of), kept("expires_at", until), (beat | free).alias("applied"))


def expire_slots(slots: DataFrame, as_of: Column) -> DataFrame:
    """Leases past their end are expired now; slots expired for longer than QUARANTINE_SECONDS are free, and nobody's."""
    expired = F.coalesce((F.col("state") == "leased") & (F.col("expires_at") < as_of), F.lit(False))
    freed = F.coalesce((F.col("state") == "expired") & older(F.col("updated_at"), as_of, QUARANTINE_SECONDS), F.lit(False))
    changed = {"state": F.when(expired, "expired").when(freed, "free").otherwise(F.col("state")), "updated_at": F.when(expired | freed, as_of).otherwise(F.col("updated_at"))}
    changed |= {c: F.when(~freed, F.col(c)) for c in ("job_id", "claim_exec_uuid", "expires_at") if c in slots.columns}
    return slots.withColumns(changed | {c: F.when(~expired, F.col(c)) for c in ("heartbeat_at",) if c in slots.columns})


def publish(outbox: DataFrame, as_of: Column, batch: int) -> DataFrame:
    """outbox (id, state, created_at, claimed_at) after a pass: stale claims are pending again, then the oldest `batch` pending
    rows are publishing."""
    stale = F.coalesce((F.col("state") == "publishing") & older(F.col("claimed_at"), as_of, CLAIM_SECONDS), F.lit(False))
    back = outbox.withColumn("state", F.when(stale, "pending").otherwise(F.col("state")))
    chosen = back.where("state = 'pending'").orderBy("created_at", "id").limit(batch).select(F.col("id"), F.lit(True).alias("_chosen"))
    out = back.join(F.broadcast(chosen), "id", "left")  # `batch` rows
    take = F.coalesce("_chosen", F.lit(False))
    return out.withColumns({"state": F.when(take, "publishing").otherwise(F.col("state")), "claimed_at": F.when(take, as_of).otherwise(F.col("claimed_at"))}).drop("_chosen")


def delivered(outbox: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """outbox (id, state, published_at, delivered_at) after outcomes (id, outcome).

    published: of pending and publishing rows. delivered (also for a stage that nobody knows): of those and published ones. failed: a
    publishing row is pending again.
    """
    both = _commanded(outbox, outcomes, ["id"])
    o, state = F.col("outcome"), F.col("state")
    out = F.coalesce((o == "published") & state.isin("pending", "publishing"), F.lit(False))
    end = F.coalesce((o == "delivered") & state.isin("pending", "published", "publishing"), F.lit(False))
    back = F.coalesce((o == "failed") & (state == "publishing"), F.lit(False))
    changed = {"state": F.when(out | end, o).when(back, "pending").otherwise(state), "published_at": F.when(out, as_of).otherwise(F.col("published_at")), "delivered_at": F.when(end, as_of).otherwise(F.col("delivered_at"))}
    return both.withColumns(changed).drop("outcome", "_commanded")


def promoted(queued: DataFrame, counters: DataFrame, defaults: tuple[int, int], limit: int = PROMOTED) -> DataFrame:
    """job_id, state and queue_reason of the `limit` oldest queued jobs (job_id, user_id, queued_at, unavailable) after a pass.

    In the order of queued_at each is admitted while the durable counters (key `global` or `user:<id>`, active, limit; a limit of 0
    is none) have room, the global one first; `unavailable` says why a preferred sidecar can't take it (null: it can, or there is
    none). defaults: the global and the user's limit where there is no counter. Only `limit` rows are numbered together.
    """
    oldest = queued.orderBy("queued_at", "job_id").limit(limit)
    room = lambda c: F.when(F.col(f"{c}.limit") > 0, F.greatest(F.lit(0), F.col(f"{c}.limit") - F.col(f"{c}.active"))).otherwise(1 << 30)
    known = counters.select("key", F.struct("active", "limit").alias("_user"))
    both = oldest.withColumn("key", F.concat(F.lit("user:"), F.col("user_id").cast("string"))).join(known, "key", "left")
    both = both.join(F.broadcast(known.where("key = 'global'").select(F.col("_user").alias("_global"))), F.lit(True), "left")  # one row
    user_room = F.when(F.col("_user").isNull(), F.lit(defaults[1] or 1 << 30)).otherwise(room("_user"))
    global_room = F.when(F.col("_global").isNull(), F.lit(defaults[0] or 1 << 30)).otherwise(room("_global"))
    order = Window.orderBy("queued_at", "job_id")
    able = F.col("unavailable").isNull()
    both = both.withColumns({"_g": global_room, "_u": user_room}).withColumn("_n", F.sum(able.cast("int")).over(Window.partitionBy("key").orderBy("queued_at", "job_id")))
    both = both.withColumn("_may", able & (F.col("_n") <= F.col("_u")))
    before = F.coalesce(F.sum(F.col("_may").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = before >= F.col("_g")
    reason = F.when(~able, F.col("unavailable")).when(full, GLOBAL_REASON).when(~F.col("_may"), USER_REASON)
    return both.select("job_id", "queued_at", reason.alias("queue_reason")).select("job_id", F.when(F.col("queue_reason").isNull(), "admitted").otherwise("queued").alias("state"), "queue_reason")


def routed(rows: DataFrame, required: list[str], preference: str | None = None) -> DataFrame:
    """registered_id of the sidecar that a new allocation goes to, at most one row.

    rows: registered_id, healthy, stale, available_slots, capabilities, served_models, running_requests. The preferred one, or none if it can't
    take it; without a preference the one with most slots, then least requests.
    """
    wanted = F.array(*map(F.lit, required)) if required else F.array().cast("array<string>")
    fit = rows.where("healthy AND NOT stale AND available_slots > 0 AND size(served_models) > 0").where(F.size(F.array_except(wanted, "capabilities")) == 0)
    if preference:
        return fit.where(F.col("registered_id") == preference).select("registered_id").limit(1)
    return fit.orderBy(F.col("available_slots").desc(), "running_requests", "registered_id").limit(1).select("registered_id")


def finish_admissions(admissions: DataFrame, finished: DataFrame, counters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admissions (job_id, user_id, state) and counters (key, active): a finished admitted job leaves once, and the global
    and its user's counter go down by one, not below 0."""
    both = _commanded(admissions, finished.select("job_id").distinct(), ["job_id"])
    leaves = F.col("_commanded") & (F.col("state") == "admitted")
    after = both.select("job_id", "user_id", F.when(leaves, "finished").otherwise(F.col("state")).alias("state"), leaves.alias("_left"))
    left = after.where("_left").select(F.explode(F.array(F.lit("global"), F.concat(F.lit("user:"), F.col("user_id").cast("string")))).alias("key"))
    counters = counters.join(left.groupBy("key").agg(F.count("*").alias("_n")), "key", "left")
    return after.drop("_left"), counters.select("key", F.greatest(F.lit(0), F.col("active") - F.coalesce("_n", F.lit(0))).alias("active"))


def synced_limits(counters: DataFrame, global_limit: int, user_limit: int) -> DataFrame:
    """Counters (key, active, limit) with the configured limits."""
    return counters.withColumn("limit", F.when(F.col("key") == "global", global_limit).when(F.col("key").like("user:%"), user_limit).otherwise(F.col("limit")))


def upserted(state: DataFrame, new: DataFrame, key: str, columns: list[str], replace: bool = True) -> DataFrame:
    """Rows of both; where a key is in both, the new values replace the old (or, insert-if-absent, the old stay)."""
    a, b = state.select(key, F.struct(*columns).alias("_old")), new.select(key, F.struct(*columns).alias("_new"))
    row = F.coalesce("_new", "_old") if replace else F.coalesce("_old", "_new")
    return a.join(b, key, "full_outer").select(key, *[row[c].alias(c) for c in columns])


def seeded_steps(jobs: DataFrame) -> DataFrame:
    """Six steps for each job, in order; those none of whose flags is set are skipped at 100 %."""

    def step(i, name, flags):
        wanted = F.lit(not flags)
        for flag in flags:
            wanted = wanted | F.coalesce(F.col(flag), F.lit(False))
        return F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), wanted.alias("wanted"))

    rows = jobs.select("job_id", F.explode(F.array(*[step(i, n, f) for i, (n, f) in enumerate(STEPS)])).alias("s"))
    return rows.select("job_id", "s.position", "s.name", F.when(F.col("s.wanted"), "pending").otherwise("skipped").alias("status"), F.when(F.col("s.wanted"), 0).otherwise(100).alias("percent"))


def terminalised(jobs: DataFrame, steps: DataFrame, commands: DataFrame) -> DataFrame:
    """Commanded jobs without a running step fail; others stay as they are."""
    running = steps.where("status = 'running'").select("job_id").distinct().withColumn("_running", F.lit(True))
    both = _commanded(jobs, commands.select("job_id").distinct(), ["job_id"]).join(running, "job_id", "left")
    return both.withColumn("status", F.when(F.col("_commanded") & F.col("_running").isNull() & ~F.col("status").isin("completed", "cancelled"), "failed").otherwise(F.col("status"))).drop("_commanded", "_running")


def generations(requests: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Requests with their generation (from 1) in their job, and whether it is stale: not the newest of the job."""
    over = Window.partitionBy(job)
    return requests.withColumn("generation", F.row_number().over(over.orderBy(*order)).cast("long")).withColumn("stale", F.col("generation") < F.count("*").over(over))


def deleted(parents: DataFrame, children: DataFrame, commands: DataFrame, key: str, active: Column) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the commanded parents; an active parent is not deleted."""
    gone = parents.join(commands.select(key).distinct(), key, "left_semi").where(~F.coalesce(active, F.lit(False))).select(key)
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def regranted(roles: DataFrame, commands: DataFrame) -> DataFrame:
    """Roles (user_id, active, changes) after commands (user_id, command grant or revoke): no change where the state is as
    commanded, a new row for the first grant, and revoking what was never granted does nothing."""
    both = roles.join(commands, "user_id", "full_outer")
    want = F.when(F.col("command") == "grant", True).when(F.col("command") == "revoke", False)
    change = want.isNotNull() & (F.col("active").isNull() | (want != F.col("active"))) & ~(F.col("active").isNull() & (F.col("command") == "revoke"))
    out = both.select("user_id", F.when(change, want).otherwise(F.col("active")).alias("active"), (F.coalesce("changes", F.lit(0)) + change.cast("int")).alias("changes"), change.alias("changed"))
    return out.where(F.col("active").isNotNull())


def applied(roles: DataFrame, commands: DataFrame) -> DataFrame:
    """The change feed of roles (user_id, active): a row for each command (user_id, at, id, command, by, reason) that changes a state.

    Commands count in the order of at and id. A grant changes what is not active, a revocation what is. After a command the state is
    as commanded, whether it changed or not, so what a command finds is the command before it, or the role. change: granted (the
    user's first), regranted or revoked. Other commands, and those of a null user, are none.
    """
    known = commands.where(F.col("command").isin("grant", "revoke") & F.col("user_id").isNotNull())
    over = Window.partitionBy("user_id").orderBy("at", "id")
    both = known.join(roles.select("user_id", F.col("active").alias("_active")), "user_id", "left")
    target = F.col("command") == "grant"
    found = F.coalesce(F.lag(target).over(over), F.col("_active"), F.lit(False))
    ever = F.col("_active").isNotNull() | F.coalesce(F.max(target).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = both.withColumns({"_found": found, "_ever": ever}).where(F.col("_found") != target)
    change = F.when(F.col("command") == "revoke", "revoked").when(F.col("_ever"), "regranted").otherwise("granted")
    return rows.select("user_id", "at", "id", change.alias("change"), "by", "reason")


def audited(roles: DataFrame, feed: DataFrame) -> DataFrame:
    """Roles (user_id, active, granted_by, granted_at, grant_reason, revoked_by, revoked_at, revoke_reason) after a change feed.

    A grant sets who, when and why and clears the revocation but for its reason; a revocation keeps the grant.
    """
    revoked = F.col("change") == "revoked"
    at = F.struct("at", "id")
    last = lambda c, what: F.max_by(F.when(what, F.struct(F.col(c).alias("v"))), F.when(what, at))["v"].alias(f"_{c}_{'r' if what is revoked else 'g'}")
    granted = ~revoked
    sums = feed.groupBy("user_id").agg(F.max_by(granted, at).alias("_active"), F.bool_or(granted).alias("_granted"), F.bool_or(revoked).alias("_revoked"), *[last(c, w) for w in (granted, revoked) for c in ("by", "at", "reason")])
    both = roles.join(sums, "user_id", "full_outer")
    new = F.col("_active").isNotNull()
    given, taken = F.coalesce("_granted", F.lit(False)), F.coalesce("_revoked", F.lit(False))
    pick = lambda c, has, value: F.when(has, F.col(value)).otherwise(F.col(c))
    cleared = lambda c, value: F.when(new & F.col("_active"), None).otherwise(pick(c, taken, value)).alias(c)
    return both.select(
        "user_id", F.coalesce("_active", "active").alias("active"), pick("granted_by", given, "_by_g").alias("granted_by"), pick("granted_at", given, "_at_g").alias("granted_at"), pick("grant_reason", given, "_reason_g").alias("grant_reason"),
        cleared("revoked_by", "_by_r"), cleared("revoked_at", "_at_r"), pick("revoke_reason", taken, "_reason_r").alias("revoke_reason"),
    )


def validity(feed: DataFrame) -> DataFrame:
    """user_id, valid_from, valid_to (null: still valid), granted_by, ended_by of each time that a feed's grant held."""
    over = Window.partitionBy("user_id").orderBy("at", "id")
    rows = feed.withColumns({"_to": F.lead("at").over(over), "_by": F.lead("by").over(over)}).where("change <> 'revoked'")
    return rows.select("user_id", F.col("at").alias("valid_from"), F.col("_to").alias("valid_to"), F.col("by").alias("granted_by"), F.col("_by").alias("ended_by"))
