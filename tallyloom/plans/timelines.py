"""Time joins, folds and windows. Events stand for timelines of a user: clicks for lines, purchases for slides, views for
incremental builds; times are seconds since the start of 2024."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import folds, joins, windows
from .registry import query, table

#: fixed values: start of the timeline, its length, and the least duration of a slide, in seconds
ZERO, DURATION, LEAST = 1704067200.0, 2592000.0, 43200.0


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", (times.epoch_seconds(F.col("ts")) - ZERO).alias("t"))


_E = f"e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 - {ZERO} AS t FROM events)"
_LINES = "l AS (SELECT user_id, t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM e WHERE event_type = 'click')"


def lines(spark, sf):
    from pyspark.sql.window import Window

    return events(spark, sf).where("event_type = 'click'").select("user_id", "t", (F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1).cast("bigint").alias("i"))


_STAMPED = "l AS (SELECT user_id, CASE WHEN event_id % 5 > 0 THEN floor(t / 21600) * 21600 END AS t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM e WHERE event_type = 'click')"


def stamped(spark, sf):
    """Lines with ties (stamps in steps of six hours), every fifth event's without a stamp."""
    from pyspark.sql.window import Window

    rows = events(spark, sf).where("event_type = 'click'").withColumn("i", (F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1).cast("bigint"))
    return rows.select("user_id", F.when(F.col("event_id") % 5 > 0, F.floor(F.col("t") / 21600) * 21600.0).alias("t"), "i")


def _asof(spark, sf, tie, miss):
    probes = events(spark, sf).where("event_type = 'error'").select("event_id", "user_id", "t")
    return joins.asof(probes, lines(spark, sf), "user_id", "t", ["i"], "i", tie, miss).select("event_id", F.col("i").alias("line"))


@query(f"WITH {_E}, {_LINES} SELECT p.event_id, l.i AS line FROM e p ASOF JOIN l ON p.user_id = l.user_id AND p.t >= l.t WHERE p.event_type = 'error'")
def asof_backward_drop(spark, sf):
    return _asof(spark, sf, "first", "drop")


@query(f"""WITH {_E}, {_STAMPED} SELECT p.event_id, coalesce(max_by(l.i, {{'t': l.t, 'i': -l.i}}), 0) AS line FROM e p LEFT JOIN l ON p.user_id = l.user_id AND p.t >= l.t WHERE p.event_type = 'error' AND p.value > 20 GROUP BY 1""")
def asof_backward_first_line(spark, sf):
    """Described probes only; the first of equal stamps; before all stamps the first line, stamped or not."""
    probes = events(spark, sf).where("event_type = 'error' AND value > 20").select("event_id", "user_id", "t")
    found = joins.asof(probes, stamped(spark, sf), "user_id", "t", ["i"], "i", "first", "zero")
    return found.select("event_id", F.coalesce("i", F.lit(0)).cast("bigint").alias("line"))


@query(f"""WITH {_E}, {_STAMPED} SELECT p.event_id, coalesce(max_by(l.i, {{'t': l.t, 'i': l.i}}), min(f.i)) AS line FROM e p JOIN (SELECT user_id, min(i) AS i FROM l WHERE t IS NOT NULL GROUP BY 1) f ON f.user_id = p.user_id
LEFT JOIN l ON p.user_id = l.user_id AND p.t >= l.t WHERE p.event_type = 'error' GROUP BY 1""")
def asof_backward_ui(spark, sf):
    """The last of equal stamps; before all stamps the first stamped line; nothing where no line is stamped."""
    probes = events(spark, sf).where("event_type = 'error'").select("event_id", "user_id", "t")
    found = joins.asof(probes, stamped(spark, sf), "user_id", "t", ["i"], "i", "last", "first")
    return found.where("i IS NOT NULL").select("event_id", F.col("i").alias("line"))


@query(f"WITH {_E}, {_LINES} SELECT p.event_id, l.i AS line FROM e p ASOF LEFT JOIN l ON p.user_id = l.user_id AND p.t >= l.t WHERE p.event_type = 'error'")
def asof_parent(spark, sf):
    return _asof(spark, sf, "last", "null")


_SPANS = f"s AS (SELECT user_id, row_number() OVER w AS n, t AS s, coalesce(lead(t) OVER w, {DURATION}) AS x FROM e WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"


def spans(spark, sf):
    from pyspark.sql.window import Window

    over = Window.partitionBy("user_id").orderBy("t", "event_id")
    return events(spark, sf).where("event_type = 'purchase'").select("user_id", F.row_number().over(over).cast("bigint").alias("slide"), F.col("t").alias("start"), F.coalesce(F.lead("t").over(over), F.lit(DURATION)).alias("end"))


@query(f"""WITH {_E}, {_SPANS}, p AS (SELECT user_id, event_id, t AS ps, t + value * 100 AS px FROM e WHERE event_type = 'view')
SELECT s.user_id, s.n AS slide, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY ps, event_id) AS text FROM s JOIN p ON s.user_id = p.user_id AND px > s AND ps < x GROUP BY 1, 2""")
def interval_overlap(spark, sf):
    parts = events(spark, sf).where("event_type = 'view'").select("user_id", "event_id", F.col("t").alias("part_start"), (F.col("t") + F.col("value") * 100).alias("part_end"))
    pairs = joins.overlap(spans(spark, sf), parts, "user_id", width=86400.0).withColumn("name", F.col("event_id").cast("string"))
    return joins.joined_texts(pairs, ["user_id", "slide"], ["part_start", "event_id"], "name")


@query(f"WITH {_E}, {_SPANS} SELECT e.event_id, s.n AS slide FROM e JOIN s ON e.user_id = s.user_id AND e.t >= s AND e.t < x WHERE event_type = 'error'")
def range_bucket(spark, sf):
    points = events(spark, sf).where("event_type = 'error'").select("event_id", "user_id", "t")
    return joins.in_range(points, spans(spark, sf), "user_id", "t", 86400.0).select("event_id", "slide")


@query(f"""WITH {_E}, {_LINES}, b AS (SELECT user_id, CAST(432000.0 * unnest([1, 3, 5]) AS DOUBLE) AS bound FROM (SELECT DISTINCT user_id FROM e))
SELECT b.user_id, bound, coalesce((SELECT min(i) FROM l WHERE l.user_id = b.user_id AND l.t >= bound), -1) AS line FROM b""")
def range_locate(spark, sf):
    bounds = events(spark, sf).select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(432000.0), F.lit(1296000.0), F.lit(2160000.0))).alias("bound"))
    return joins.locate(bounds, lines(spark, sf), "user_id", "t", "i", F.lit(-1).cast("bigint"))


@query(f"""WITH {_E}, {_LINES}, m AS (SELECT user_id, t FROM e WHERE event_type = 'signup'),
a AS (SELECT user_id, t, 'mark' AS kind, coalesce((SELECT min(i) FROM l WHERE l.user_id = m.user_id AND l.t >= m.t), 1000000) AS b, 0 AS side FROM m UNION ALL SELECT user_id, t, 'line', i, 1 FROM l)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY b, side, t) - 1 AS position, kind, t FROM a""")
def merge_chapters(spark, sf):
    marks = events(spark, sf).where("event_type = 'signup'").select("user_id", "t")
    return joins.merge_before(lines(spark, sf), marks, "user_id", "t", "i")


_ANCHORED = f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, event_id, t FROM e WHERE event_type <> 'view'),
k AS (SELECT user_id, min(t) AS t FROM r WHERE t - 0.0 >= {LEAST} GROUP BY 1
UNION ALL SELECT k.user_id, n.t FROM k, LATERAL (SELECT min(r.t) AS t FROM r WHERE r.user_id = k.user_id AND r.t - k.t >= {LEAST}) n WHERE n.t IS NOT NULL)"""


@query(f"{_ANCHORED} SELECT r.user_id, r.event_id FROM r JOIN k ON r.user_id = k.user_id AND r.t = k.t")
def anchored_fold(spark, sf):
    rows = events(spark, sf).where("event_type <> 'view'").select("user_id", "event_id", "t")
    return folds.anchored(rows, "user_id", "t", LEAST, "event_id").where("kept").select("user_id", "event_id")


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, event_id, t FROM e WHERE value > 27),
k AS (SELECT user_id, min(t) AS t FROM r WHERE t + 100000 > 100000 GROUP BY 1
UNION ALL SELECT k.user_id, n.t FROM k, LATERAL (SELECT min(r.t) AS t FROM r WHERE r.user_id = k.user_id AND r.t - k.t > 100000) n WHERE n.t IS NOT NULL)
SELECT r.user_id, r.event_id FROM r JOIN k ON r.user_id = k.user_id AND r.t = k.t""")
def min_spacing_peaks(spark, sf):
    rows = events(spark, sf).where("value > 27").select("user_id", "event_id", "t")
    return folds.anchored(rows, "user_id", "t", 100000.0, "event_id", strict=True, first=-100000.0).where("kept").select("user_id", "event_id")


@query(f"""WITH RECURSIVE {_E}, k AS (SELECT user_id, min(t) AS t, 1 AS w FROM e GROUP BY 1
UNION ALL SELECT k.user_id, n.t, w + 1 FROM k, LATERAL (SELECT min(e.t) AS t FROM e WHERE e.user_id = k.user_id AND e.t - k.t >= 86400) n WHERE n.t IS NOT NULL)
SELECT event_id, "window", place, place > 3 AS denied FROM (SELECT e.event_id, CAST(w AS BIGINT) AS "window", row_number() OVER (PARTITION BY e.user_id, w ORDER BY e.t, e.event_id) AS place
FROM e ASOF JOIN k ON e.user_id = k.user_id AND e.t >= k.t)""")
def fixed_window_limit(spark, sf):
    return folds.fixed_windows(events(spark, sf).select("user_id", "event_id", "t"), "user_id", "t", 86400.0, 3, "event_id").select("event_id", "window", "place", "denied")


@query(f"""{_ANCHORED}, u AS (SELECT DISTINCT user_id FROM e), m0 AS (SELECT u.user_id, coalesce(k.t, 0.0) AS s FROM u LEFT JOIN k USING (user_id)),
m1 AS (SELECT * FROM m0 UNION ALL SELECT user_id, 0.0 FROM m0 GROUP BY 1 HAVING min(s) > {LEAST}),
m AS (SELECT user_id, s, coalesce(lead(s) OVER w, {DURATION}) AS x, row_number() OVER w AS n FROM m1 WINDOW w AS (PARTITION BY user_id ORDER BY s)),
c AS (SELECT e.user_id, e.t AS s, row_number() OVER (PARTITION BY e.user_id ORDER BY e.t, e.event_id) AS r, (SELECT max(n) FROM m WHERE m.user_id = e.user_id AND m.s <= e.t) AS parent FROM e WHERE event_type = 'view')
SELECT user_id, n AS slide_number, s AS start, x AS "end", false AS is_incremental, CAST(NULL AS BIGINT) AS parent_slide_number FROM m
UNION ALL SELECT c.user_id, r + (SELECT count(*) FROM m WHERE m.user_id = c.user_id), s, {DURATION}, true, parent FROM c""")
def slide_grouping(spark, sf):
    rows = events(spark, sf)
    durations = rows.select("user_id").distinct().withColumn("duration", F.lit(DURATION))
    out = windows.slides(rows, "user_id", "t", "event_id", F.col("event_type") == "view", durations, LEAST)
    return out.select("user_id", "slide_number", "start", "end", "is_incremental", "parent_slide_number")


@query(f"""WITH {_E}, d AS (SELECT event_id, 1.0 / (1.0 + abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id))) AS s FROM e)
SELECT event_id, CASE WHEN s < 0.05 THEN 'transition' ELSE 'ambiguous' END AS classification FROM d WHERE s <= 0.2""")
def lag_compare(spark, sf):
    rows = events(spark, sf).withColumn("at", F.struct("t", "event_id"))
    return windows.changes(rows, "user_id", "at", "value", 0.05, 0.2).select("event_id", "classification")


@query(f"WITH {_E} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM e) WHERE i % 7 = 0")
def sample_every_n(spark, sf):
    return windows.every_nth(events(spark, sf).withColumn("at", F.struct("t", "event_id")), "user_id", "at", 30.0, 4.0).select("event_id")


@query(f"""WITH {_E}, f AS (SELECT event_id, user_id, t, CASE WHEN event_type = 'click' THEN value END AS v FROM e)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS v FROM f""")
def forward_fill(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id", F.struct("t", "event_id").alias("at"), F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return windows.filled_forward(rows, "user_id", "at", "v", 0.0).select("event_id", "v")


@query(f"""WITH {_E} SELECT event_id, coalesce(value >= max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM e""")
def monotonic(spark, sf):
    rows = events(spark, sf).withColumn("at", F.struct("t", "event_id"))
    return windows.monotonic(rows, "user_id", "at", "value").select("event_id", "accepted")


@query(f"""WITH {_E} SELECT user_id, min(t) AS opened, max(t) + 43200 AS expired, count(*) AS beats FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session
FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 43200 THEN 0 ELSE 1 END AS n FROM e)) GROUP BY user_id, session""")
def session_expiry(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "43200 seconds").alias("w")).agg(F.count("*").alias("beats"))
    seconds = lambda c: F.unix_micros(c) / 1e6 - ZERO
    return out.select("user_id", seconds(F.col("w.start")).alias("opened"), seconds(F.col("w.end")).alias("expired"), "beats")


@query(f"""WITH {_E} SELECT event_type, CAST(floor(t / 21600) AS BIGINT) AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM e GROUP BY 1, 2""")
def extension_tumbling(spark, sf):
    """Extension: tumbling windows over event time."""
    out = table(spark, sf, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select("event_type", F.floor((F.unix_micros("w.start") / 1e6 - ZERO) / 21600).alias("bucket"), "n", "total")
