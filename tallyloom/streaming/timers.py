"""Claims that end without a further event of their key: event-time timers over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDED = "key bigint, claimed_at bigint, ended_at bigint, beats bigint, reason string"


def claims(events: DataFrame, key: str, kind: Column, ttl: float, delay: str = "0 seconds") -> DataFrame:
    """Claims that have ended: key, claimed_at and ended_at (microseconds), beats, and the reason (released or expired).

    kind: claim, beat, release or null for each event. A claim of a free key opens a lease of `ttl` seconds; a beat, and a claim of a key
    that is held, extend it to `ttl` after them (beats counts both); a release ends it. A lease that nothing extends ends at its
    end: with the key's next event if that comes later, or else when the watermark, `delay` behind the latest event, has passed it.
    Beats and releases of a free key do nothing. A free key has no state. Events of one batch count in the order of ts and event_id.
    """
    span = int(ttl * 1e6)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None  # claimed_at, expires_at, beats
        ended = []
        if state.hasTimedOut:
            ended.append((*held, "expired"))
            held = None
        else:
            rows = sorted(row for b in batches for row in zip(b["at"].tolist(), b["event_id"].tolist(), b["kind"].tolist(), strict=True))
            for at, _, what in rows:
                if held and at > held[1]:
                    ended.append((*held, "expired"))
                    held = None
                if what == "release" and held:
                    ended.append((held[0], at, held[2], "released"))
                    held = None
                elif what == "claim" and not held:
                    held = (at, at + span, 0)
                elif what in ("claim", "beat") and held:
                    held = (held[0], at + span, held[2] + 1)
            if held and held[1] // 1000 < state.getCurrentWatermarkMs():
                ended.append((*held, "expired"))
                held = None
        if held:
            state.update(tuple(int(x) for x in held))
            state.setTimeoutTimestamp(max(-(-held[1] // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if ended:
            out = pd.DataFrame(ended, columns=["claimed_at", "ended_at", "beats", "reason"])
            out.insert(0, "key", k[0])
            yield out

    rows = events.withWatermark("ts", delay).select(F.col(key).cast("long").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), kind.alias("kind"))
    # it names ts, or it would go below the watermark, which all events move
    rows = rows.where(F.when(F.col("ts").isNotNull() & F.col("key").isNotNull(), F.col("kind")).isNotNull())
    return rows.groupBy("key").applyInPandasWithState(step, ENDED, "claimed_at bigint, expires_at bigint, beats bigint", "append", "EventTimeTimeout")
