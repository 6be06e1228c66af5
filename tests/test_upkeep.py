"""Timers, maintenance cycles and audited roles by hand-made cases; whole tables are compared with SQL in test_queries."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import transitions
from tallyloom.streaming import events as streams
from tallyloom.streaming.timers import claims
from tallyloom.streaming.upkeep import Cycle, Step

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def ended(spark, folder, files, ttl=100, delay="0 seconds"):
    """Ended claims of (key, second, kind) rows, each list of them a batch of its own."""
    n = 0
    for rows in files:
        made = [(n + i, at(s), k, kind, 0.0, "{}") for i, (k, s, kind) in enumerate(rows)]
        n += len(rows)
        spark.createDataFrame(made, streams.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(streams.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.drained(claims(stream, "user_id", F.nullif(F.col("event_type"), F.lit("other")), ttl, delay))
    base = int((T0 - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    return sorted((r["key"], (r["claimed_at"] - base) // 10**6, (r["ended_at"] - base) // 10**6, r["beats"], r["reason"]) for r in out.collect())


def test_claims_expire_without_a_further_event(spark, tmp_path):
    rows = [[(1, 0, "claim"), (1, 50, "beat"), (2, 10, "claim"), (2, 20, "release"), (3, 5, "beat"), (3, 6, "release")], [(4, 149, "claim"), (5, 149, "other")], [(9, 400, "other"), (4, 200, "claim")]]
    # key 1 is silent after 50: its lease ends at 150, key 4 is extended to 300; both are told only by the watermark
    assert ended(spark, tmp_path, rows) == [(1, 0, 150, 1, "expired"), (2, 10, 20, 0, "released"), (4, 149, 300, 1, "expired")]


def test_claims_still_held_are_not_told_and_late_events_find_them_expired(spark, tmp_path):
    rows = [[(1, 0, "claim"), (1, 300, "claim"), (2, 320, "claim"), (3, 250, "claim"), (3, 260, "beat")]]
    assert ended(spark, tmp_path, rows) == [(1, 0, 100, 0, "expired")]
    assert ended(spark, tmp_path / "b", rows, delay="10 seconds") == [(1, 0, 100, 0, "expired")]


SCHEMAS = {"a": "k long, n long", "b": "k long"}


def sums(batch, tables, moment):
    return {"a": tables["a"].unionByName(batch.select("k", F.lit(1).cast("long").alias("n"))).groupBy("k").agg(F.sum("n").alias("n"))}


def copies(batch, tables, moment):
    return {"b": tables["a"].where("n > 1").select("k")}


def fails(batch, tables, moment):
    return {"a": tables["a"].limit(0), "b": tables["a"].select(F.raise_error(F.lit("no")).cast("long").alias("k"))}


def rows(cycle, batch_id, name):
    return sorted(tuple(r) for r in cycle.tables(cycle.record(batch_id))[name].collect())


def batch(spark, *keys, second=0):
    return spark.createDataFrame([(k, at(second)) for k in keys], "k long, ts timestamp_ntz")


def test_each_batch_counts_once_and_steps_are_isolated(spark, tmp_path):
    cycle = Cycle(spark, str(tmp_path), SCHEMAS, [Step("sums", sums), Step("fails", fails), Step("copies", copies)])
    first = cycle.run(batch(spark, 1, 2, second=5), 0)
    assert [(s["name"], s["outcome"]) for s in first["steps"]] == [("sums", "done"), ("fails", "failed"), ("copies", "done")]
    assert "no" in first["steps"][1]["why"] and rows(cycle, 0, "a") == [(1, 1), (2, 1)] and rows(cycle, 0, "b") == []
    cycle.run(batch(spark, 2, 3, second=3), 1)
    assert rows(cycle, 1, "a") == [(1, 1), (2, 2), (3, 1)] and rows(cycle, 1, "b") == [(2,)]
    assert cycle.record(1)["moment"] == first["moment"]  # the clock does not go back
    # a replayed batch changes nothing, by the same process or by a new one
    again = Cycle(spark, str(tmp_path), SCHEMAS, [Step("sums", sums)])
    assert again.run(batch(spark, 2, 3), 1) == cycle.record(1) and rows(cycle, 1, "a") == [(1, 1), (2, 2), (3, 1)]
    # what was begun and has no record is run anew
    spark.createDataFrame([(7, 7)], SCHEMAS["a"]).write.parquet(f"{tmp_path}/tables/{2:012d}/0-a")
    cycle.run(batch(spark, 1), 2)
    assert rows(cycle, 2, "a") == [(1, 2), (2, 2), (3, 1)] and rows(cycle, 2, "b") == [(1,), (2,)]
    assert sorted(p.name for p in (tmp_path / "tables" / f"{0:012d}").iterdir()) == [] if (tmp_path / "tables" / f"{0:012d}").exists() else True
    with pytest.raises(RuntimeError):
        cycle.run(batch(spark, 1), 7)


def test_empty_batches(spark, tmp_path):
    cycle = Cycle(spark, str(tmp_path), SCHEMAS, [Step("sums", sums), Step("copies", copies)])
    cycle.run(batch(spark), 0)
    assert cycle.record(0)["moment"] is None and rows(cycle, 0, "a") == []


def feed(spark, roles, commands):
    state = spark.createDataFrame(roles, "user_id long, active boolean")
    asked = spark.createDataFrame([(u, at(s), i, c, f"op{i}", f"why{i}") for i, (u, s, c) in enumerate(commands)], "user_id long, at timestamp_ntz, id long, command string, by string, reason string")
    return transitions.applied(state, asked)


def test_one_audit_row_for_each_applied_command(spark):
    commands = [(1, 1, "grant"), (1, 2, "grant"), (1, 3, "revoke"), (1, 4, "revoke"), (1, 5, "grant"), (2, 1, "revoke"), (3, 1, "grant"), (3, 1, "revoke"), (4, 1, "grant"), (5, 9, "odd"), (None, 1, "grant")]
    got = feed(spark, [(3, True), (4, False)], commands)
    assert sorted((r["user_id"], r["id"], r["change"], r["by"]) for r in got.collect()) == [(1, 0, "granted", "op0"), (1, 2, "revoked", "op2"), (1, 4, "regranted", "op4"), (3, 7, "revoked", "op7"), (4, 8, "regranted", "op8")]
    spans = sorted((r["user_id"], (r["valid_from"] - T0).seconds, r["valid_to"] and (r["valid_to"] - T0).seconds, r["ended_by"]) for r in transitions.validity(got).collect())
    assert spans == [(1, 1, 3, "op2"), (1, 5, None, None), (4, 1, None, None)]


def test_audit_fields_of_roles(spark):
    fields = "user_id long, active boolean, granted_by string, granted_at timestamp_ntz, grant_reason string, revoked_by string, revoked_at timestamp_ntz, revoke_reason string"
    roles = spark.createDataFrame([(3, True, "seed", T0, "first", None, None, None), (4, False, "seed", T0, "first", "boss", T0, "left"), (9, True, "seed", T0, "first", None, None, None)], fields)
    got = feed(spark, [(3, True), (4, False), (9, True)], [(1, 1, "grant"), (1, 2, "revoke"), (3, 1, "revoke"), (4, 1, "grant"), (5, 1, "revoke")])
    out = {r["user_id"]: tuple(r)[1:] for r in transitions.audited(roles, got).collect()}
    assert out == {
        1: (False, "op0", at(1), "why0", "op1", at(2), "why1"), 3: (False, "seed", T0, "first", "op2", at(1), "why2"),
        4: (True, "op3", at(1), "why3", None, None, "left"), 9: (True, "seed", T0, "first", None, None, None),
    }
