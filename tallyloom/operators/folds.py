"""Ordered folds whose state depends on what they have kept: no plain window can express them.

Rows go to the partition of their key and through it in order; the state of the key at hand is all that is held, so a key of
any size streams through one task without being gathered. Where a fold runs over the lines of one text it is a higher-order
function over the row's own array, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: fixed values: failures running that restart, restarts in a window, and its seconds
FAILURES, RESTARTS, RESTART_WINDOW = 3, 3, 3600.0


def anchored(df: DataFrame, key: str, ts: str, gap: float, order: str, strict: bool = False, first: float | None = 0.0) -> DataFrame:
    """df with `kept`: whether a row is `gap` or more (strict: more) after the last kept row of its key.

    The anchor starts at `first` and moves to each kept row (null: the first row is kept). This is not gap sessionization.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("kept", T.BooleanType())])

    def run(batches):
        owner = anchor = None
        for batch in batches:
            t = batch.column(ts).to_numpy(zero_copy_only=False)
            keys = batch.column(key)
            edges = np.flatnonzero(np.concatenate(([True], pc_not_equal(keys)))) if batch.num_rows else np.zeros(0, int)
            kept = np.zeros(batch.num_rows, bool)
            for lo, hi in zip(edges, np.append(edges[1:], batch.num_rows), strict=True):
                if owner is None or keys[lo] != owner[0]:
                    owner, anchor = (keys[lo],), first
                i = lo
                while i < hi:
                    if anchor is not None:  # rows are in order: step to about where the gap ends, then compare as told
                        i = max(lo, i, int(np.searchsorted(t[lo:hi], anchor + gap, "left")) + lo - 1)
                        while i < hi and not (t[i] - anchor > gap if strict else t[i] - anchor >= gap):
                            i += 1
                    if i >= hi:
                        break
                    kept[i] = True
                    anchor = float(t[i])
                    i += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept)], [*batch.schema.names, "kept"])

    return df.repartition(key).sortWithinPartitions(key, ts, order).mapInArrow(run, schema)


def pc_not_equal(keys: pa.Array) -> np.ndarray:
    """Whether each key but the first differs from the one before."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)), True).to_numpy(zero_copy_only=False)


def fixed_windows(df: DataFrame, key: str, ts: str, seconds: float, limit: int, order: str) -> DataFrame:
    """df with window (from 1), place in it and denied: the first event opens a window of `seconds`, the next one after its end
    opens another, and events beyond `limit` are denied."""
    opened = anchored(df, key, ts, seconds, order, first=None)
    over = Window.partitionBy(key).orderBy(ts, order)
    opened = opened.withColumn("window", F.sum(F.col("kept").cast("long")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    opened = opened.withColumn("place", F.row_number().over(Window.partitionBy(key, "window").orderBy(ts, order)).cast("long"))
    return opened.drop("kept").withColumn("denied", F.col("place") > limit)


def watchdog(df: DataFrame, key: str, ts: str, order: str, ok: str, dependencies: str, failures: int = FAILURES, most: int = RESTARTS, window: float = RESTART_WINDOW) -> DataFrame:
    """df with `action` and the count of `failures` after each check of a key, in order.

    ok: the count goes back to 0. Else it goes up, and the action is `dependency` if those are down, `waiting` below `failures` of
    them, `limited` if there were `most` restarts in the last `window` seconds, or `restart`, after which the count is 0.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("action", T.StringType()), T.StructField("failures", T.IntegerType())])

    def run(batches):
        owner, count, restarts = None, 0, []
        for batch in batches:
            actions, counts = [], []
            for k, t, good, whole in zip(*(batch.column(c).to_pylist() for c in (key, ts, ok, dependencies)), strict=True):
                if owner != (k,):
                    owner, count, restarts = (k,), 0, []
                count = 0 if good else count + 1
                if good or not whole or count < failures:
                    action = "ok" if good else "waiting" if whole else "dependency"
                else:
                    restarts = [r for r in restarts if r >= t - window]
                    action = "limited" if len(restarts) >= most else "restart"
                    if action == "restart":
                        restarts.append(t)
                        count = 0
                actions.append(action)
                counts.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(actions, pa.string()), pa.array(counts, pa.int32())], [*batch.schema.names, "action", "failures"])

    return df.repartition(key).sortWithinPartitions(key, ts, order).mapInArrow(run, schema)


def packed(items: Column, limit: int) -> Column:
    """Greedy packing of an array of struct(ts, text): segments of start_time, end_time, n_items, length, sequence.

    The running length adds each text and one; a text that would exceed the limit opens a segment in which it counts without
    the one, unless nothing is open.
    """
    kind = "array<struct<start_time: double, end_time: double, n_items: int, length: int>>"
    none = F.lit(None).cast("struct<start_time: double, end_time: double, n_items: int, length: int>")
    start = F.struct(F.array().cast(kind).alias("done"), none.alias("open"))

    def step(s, x):
        n = F.length(x["text"])
        fits = s["open"].isNotNull() & (s["open"]["length"] + n + 1 <= limit)
        fresh = F.struct(x["ts"].alias("start_time"), x["ts"].alias("end_time"), F.lit(1).alias("n_items"), F.when(s["open"].isNull(), n + 1).otherwise(n).alias("length"))
        more = F.struct(s["open"]["start_time"].alias("start_time"), x["ts"].alias("end_time"), (s["open"]["n_items"] + 1).alias("n_items"), (s["open"]["length"] + n + 1).alias("length"))
        flush = s["open"].isNotNull() & ~fits
        return F.struct(F.when(flush, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"), F.when(fits, more).otherwise(fresh).alias("open"))

    end = F.aggregate(items, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.transform(end, lambda s, i: F.struct(s["start_time"], s["end_time"], s["n_items"], s["length"], i.cast("int").alias("sequence")))


def packed_sentences(sentences: Column, limit: int) -> Column:
    """Greedy packing of sentences by the length of the joined text: array of segment texts."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s, x):
        trial = F.trim(F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x)))
        flush = (F.length(trial) > limit) & (s["open"] != "")
        return F.struct(F.when(flush, F.concat(s["done"], F.array(F.trim(s["open"])))).otherwise(s["done"]).alias("done"), F.when(flush, x).otherwise(trial).alias("open"))

    return F.aggregate(sentences, start, step, lambda s: F.when(F.trim(s["open"]) == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.trim(s["open"])))))


def admitted(arrivals: DataFrame, user: str, order: list[str], global_cap: int, user_cap: int) -> DataFrame:
    """df with state and queue_reason: arrivals in order are admitted while the global cap, then the user's, allows it.

    No one leaves, so a user's first `user_cap` arrivals are the only ones that can be admitted and, of those, the first
    `global_cap` are; what comes after the last of them is queued for the global cap, other rows for the user's. A cap of 0
    is unlimited. No fold over all rows is needed: a rank for each user, and a top-k.
    """
    at = F.struct(*order)
    ranked = arrivals.withColumn("_n", F.row_number().over(Window.partitionBy(user).orderBy(*order)))
    may = ranked.where(F.col("_n") <= user_cap) if user_cap else ranked
    if global_cap:
        top = may.orderBy(*order).limit(global_cap).agg(F.max(at).alias("_last"), F.count("*").alias("_taken"))
        ranked = ranked.crossJoin(F.broadcast(top))  # one row
        after = (F.col("_taken") >= global_cap) & (at > F.col("_last"))
    else:
        ranked, after = ranked.withColumns({"_last": F.lit(None), "_taken": F.lit(0)}), F.lit(False)
    over = F.col("_n") > user_cap if user_cap else F.lit(False)
    reason = F.when(after, "global").when(over, "per-user")
    return ranked.withColumns({"state": F.when(reason.isNull(), "admitted").otherwise("queued"), "queue_reason": reason}).drop("_n", "_last", "_taken")


def marked_sections(lines: Column) -> Column:
    """Sections of an array of lines: chapters are hard boundaries; images wait until a line ends a sentence or for three lines."""
    from ..functions.text import ends_sentence, strip

    section = "array<struct<type: string, content: string>>"
    start = F.struct(F.array().cast(section).alias("done"), F.array().cast("array<string>").alias("text"), F.array().cast("array<string>").alias("images"), F.lit(0).alias("since"))
    marker = lambda x: F.struct(F.lit("marker").alias("type"), x.alias("content"))

    def flushed(s):
        joined = strip(F.array_join(s["text"], "\n"))
        text = F.when(joined == "", F.array().cast(section)).otherwise(F.array(F.struct(F.lit("text").alias("type"), joined.alias("content"))))
        return F.concat(s["done"], text, F.transform(s["images"], marker))

    def step(s, line):
        chapter, image = line.rlike(r"^## \[\d{2}:\d{2}:\d{2}\]"), line.rlike(r"^!\[Snapshot at \d{2}:\d{2}:\d{2}\]")
        none = F.array().cast("array<string>")
        text = F.concat(s["text"], F.array(line))
        waiting = F.size(s["images"]) > 0
        spoken = F.regexp_replace(line, r"^\[\d{2}:\d{2}:\d{2}\]\s*", "")
        end = waiting & (ends_sentence(spoken) | (s["since"] + 1 >= 3))
        after = flushed(F.struct(s["done"].alias("done"), text.alias("text"), s["images"].alias("images"), s["since"].alias("since")))
        state = lambda done, text, images, since: F.struct(done.alias("done"), text.alias("text"), images.alias("images"), since.alias("since"))
        return (
            F.when(chapter, state(F.concat(flushed(s), F.array(marker(line))), none, none, F.lit(0)))
            .when(image, state(s["done"], s["text"], F.concat(s["images"], F.array(line)), F.lit(0)))
            .when(end, state(after, none, none, F.lit(0)))
            .otherwise(state(s["done"], text, s["images"], F.when(waiting, s["since"] + 1).otherwise(s["since"])))
        )

    return F.aggregate(lines, start, step, flushed)
