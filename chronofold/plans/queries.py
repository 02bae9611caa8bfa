"""Queries over the driver's tables, each with the same query in SQL.

The tables hold no locations: ``events`` stands for a history for each user,
with the event's type as kind or mode and its value as distance, and ``props``
holds the number of steps.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import codec, scalars
from chronofold.operators import evidence, frames, intervals, pedometer, reconstruct, routes, timeline, windows
from chronofold.plans import importer, views
from chronofold.plans.incremental import Timeline
from chronofold.plans.store import Store
from chronofold.session import scratch
from chronofold.sources import archive
from chronofold.streaming import frames as frame_streams
from chronofold.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common tables of the SQL: events as observations, and as half-hour intervals.
E = """e AS (SELECT user_id AS history, event_id AS id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS ts, event_type AS kind,
  value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
I = (
    E
    + """, i AS (SELECT *, ts AS start_ts, least(coalesce(lead(ts) OVER (PARTITION BY history ORDER BY ts, id), ts + 1800), ts + 1800) AS end_ts FROM e)"""
)
GEO = E + ", g AS (SELECT *, (id * 37 % 1800) / 10.0 - 90.0 AS lat, (id * 53 % 3600) / 10.0 - 180.0 AS lon FROM e)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)).cast("bigint")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("history"), F.col("event_id").alias("id"), ts.alias("ts"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.over(["history"], "ts", "id")
    return observations(spark, sf_dir).select("*", F.col("ts").alias("start_ts"), F.least(F.coalesce(F.lead("ts").over(w), F.col("ts") + 1800), F.col("ts") + 1800).alias("end_ts"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumn("lat", (F.col("id") * 37 % 1800) / 10.0 - 90.0).withColumn("lon", (F.col("id") * 53 % 3600) / 10.0 - 180.0)


def rounded(*columns: str, places: int = 3) -> list:
    return [F.round(F.col(x), places).alias(x) for x in columns]


@query(f"""WITH {E}, n AS (SELECT *, lead(ts) OVER (PARTITION BY history ORDER BY ts, id) AS end_ts FROM e)
SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS date, kind AS mode, round(CAST(sum(coalesce(value, 0)) AS DOUBLE), 2) AS total_distance_m,
  CAST(sum(end_ts - ts) AS DOUBLE) AS total_duration_s FROM n WHERE end_ts IS NOT NULL GROUP BY 1, 2""")
def daily_activity_stats(spark, sf_dir):
    w = windows.over(["history"], "ts", "id")
    moves = observations(spark, sf_dir).select(F.col("ts").alias("start_ts"), F.lead("ts").over(w).alias("end_ts"), F.col("kind").alias("mode"), F.col("value").alias("distance_m"), F.lit(0).alias("tz_offset_s"))
    return views.daily_activity_stats(moves).select("date", "mode", *rounded("total_distance_m", places=2), "total_duration_s")


def _steps(spark, sf_dir):
    return observations(spark, sf_dir).select("ts", F.col("k").alias("steps_delta"), F.col("value").alias("distance_m"), F.lit(0).alias("tz_offset_s"))


def _steps_sql(when: str, group: str) -> str:
    return f"""WITH {E} SELECT {when}, CAST(sum(coalesce(k, 0)) AS BIGINT) AS total_steps,
  round(CAST(sum(CASE WHEN k > 0 AND value / k BETWEEN 0.3 AND 2.5 THEN value END) AS DOUBLE), 2) AS total_distance_m FROM e GROUP BY {group}"""


_T = "make_timestamp(ts * 1000000)"


@query(_steps_sql(f"strftime({_T}, '%Y-%m-%d') AS date", "1"))
def daily_step_stats(spark, sf_dir):
    return views.pedometer_stats(_steps(spark, sf_dir), "day").select("date", "total_steps", *rounded("total_distance_m", places=2))


@query(_steps_sql(f"strftime({_T}, '%Y-%m-%d') AS date, strftime({_T}, '%H') AS hour", "1, 2"))
def hourly_step_stats(spark, sf_dir):
    return views.pedometer_stats(_steps(spark, sf_dir), "hour").select("date", "hour", "total_steps", *rounded("total_distance_m", places=2))


@query(_steps_sql(f"strftime({_T}, '%Y-%m') AS month", "1"))
def monthly_step_stats(spark, sf_dir):
    return views.pedometer_stats(_steps(spark, sf_dir), "month").select("month", "total_steps", *rounded("total_distance_m", places=2))


_STAR = """s AS (SELECT * FROM i WHERE kind = 'view'), m AS (SELECT * FROM i WHERE kind IN ('click', 'purchase')), g AS (SELECT * FROM i WHERE kind NOT IN ('view', 'click', 'purchase')),
x AS (SELECT 'stay' AS kind, start_ts, end_ts, id AS stay_id, NULL::BIGINT AS move_id, NULL::BIGINT AS gap_id FROM s UNION ALL SELECT 'move', start_ts, end_ts, NULL, id, NULL FROM m UNION ALL SELECT 'gap', start_ts, end_ts, NULL, NULL, id FROM g)"""


@query(f"""WITH {I}, {_STAR}
SELECT x.kind, x.start_ts, x.end_ts, stay_id, move_id, gap_id, CASE WHEN s_suppkey IS NULL THEN NULL ELSE s_name END AS poi_name, s.k AS poi_id, m.kind AS mode, m.value AS distance_m, g.kind AS reason,
  coalesce(CASE WHEN s.id % 3 > 0 THEN s.k * 60 END, CASE WHEN m.id % 2 > 0 THEN m.k * 30 END, g.k) AS tz_offset_s
FROM x LEFT JOIN s ON x.stay_id = s.id LEFT JOIN supplier ON s_suppkey = s.k LEFT JOIN m ON x.move_id = m.id LEFT JOIN g ON x.gap_id = g.id""")
def enriched_star(spark, sf_dir):
    i = half_hours(spark, sf_dir)
    none = F.lit(None)
    kind = lambda *k: i.where(F.col("kind").isin(*k))
    stays = kind("view").select("id", "start_ts", "end_ts", F.col("k").alias("poi_id"), none.alias("centroid_lat"), none.alias("centroid_lon"), none.alias("radius_m"), F.lit("visit").alias("type"), F.when(F.col("id") % 3 > 0, F.col("k") * 60).alias("tz_offset_s"), none.alias("end_tz_offset_s"))
    moves = kind("click", "purchase").select("id", "start_ts", "end_ts", F.col("kind").alias("mode"), F.col("value").alias("distance_m"), F.when(F.col("id") % 2 > 0, F.col("k") * 30).alias("tz_offset_s"), none.alias("end_tz_offset_s"))
    gaps = i.where(~F.col("kind").isin("view", "click", "purchase")).select("id", "start_ts", "end_ts", F.col("kind").alias("reason"), none.alias("uncertainty"), none.alias("notes"), F.col("k").alias("tz_offset_s"), none.alias("end_tz_offset_s"))
    pois = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), none.alias("category"), none.alias("subcategory"), none.alias("lat"), none.alias("lon"))
    out = views.enriched_events(views.timeline_events(stays, moves, gaps), stays, pois, moves, gaps)
    return out.select("kind", "start_ts", "end_ts", "stay_id", "move_id", "gap_id", "poi_name", "poi_id", "mode", "distance_m", "reason", "tz_offset_s")


_KINDS = "CASE kind WHEN 'view' THEN 'stay' WHEN 'click' THEN 'move' WHEN 'purchase' THEN 'move' ELSE 'gap' END"


def _kinds(df):
    return df.withColumn("kind", F.when(F.col("kind") == "view", "stay").when(F.col("kind").isin("click", "purchase"), "move").otherwise("gap"))


@query(f"""WITH {I}, t AS (SELECT history, {_KINDS} AS kind, start_ts, end_ts FROM i),
s AS (SELECT *, max(end_ts) OVER (PARTITION BY history ORDER BY start_ts, end_ts, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
  lag(kind) OVER w AS k, lag(start_ts) OVER w AS s FROM t WINDOW w AS (PARTITION BY history ORDER BY start_ts, end_ts, kind))
SELECT history, count(*) AS n_events, count(*) FILTER (start_ts = s) AS n_duplicate_starts, count(*) FILTER (start_ts < reach) AS n_overlaps,
  count(*) FILTER (kind = k AND kind <> 'move') AS n_adjacent_same_kind, 0::BIGINT AS n_open, 0::BIGINT AS n_open_not_last, count(*) FILTER (end_ts <= start_ts) AS n_non_positive
FROM s GROUP BY history""")
def timeline_integrity(spark, sf_dir):
    return timeline.integrity(_kinds(half_hours(spark, sf_dir)), ["history"])


_ISLANDS = "l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY history ORDER BY ts, id) AS d FROM e), r AS (SELECT *, sum(CASE WHEN d IS NULL OR d > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY history ORDER BY ts, id) AS island FROM l)"


@query(f"""WITH {E}, {_ISLANDS.format(gap=7200)}
SELECT history, min(ts) AS start_ts, max(ts) + greatest(1.0, least(60.0, coalesce(avg(d) FILTER (d > 0 AND d <= 7200), 60.0))) AS end_ts, count(*) AS n FROM r GROUP BY history, island HAVING count(*) > 1""")
def observation_gap_windows(spark, sf_dir):
    out = windows.observation_windows(observations(spark, sf_dir), ["history"], "ts", "id", 7200, None)
    return out.select("history", "start_ts", F.col("end_ts").cast("double").alias("end_ts"), "n")


@query(f"""WITH RECURSIVE {E}, o AS (SELECT history, ts, row_number() OVER (PARTITION BY history ORDER BY ts, id) AS n FROM e),
c AS (SELECT history, n, ts, ts AS opened FROM o WHERE n = 1
  UNION ALL SELECT o.history, o.n, o.ts, CASE WHEN o.ts - c.ts > 7200 OR o.ts - c.opened >= 21600 THEN o.ts ELSE c.opened END FROM c JOIN o ON o.history = c.history AND o.n = c.n + 1),
d AS (SELECT *, ts - lag(ts) OVER (PARTITION BY history, opened ORDER BY n) AS d FROM c)
SELECT history, min(ts) AS start_ts, max(ts) + greatest(1.0, least(60.0, coalesce(avg(d) FILTER (d > 0), 60.0))) AS end_ts, count(*) AS n FROM d GROUP BY history, opened HAVING count(*) > 1""")
def observation_capped_windows(spark, sf_dir):
    out = windows.observation_windows(observations(spark, sf_dir), ["history"], "ts", "id", 7200, 21_600)
    return out.select("history", "start_ts", F.col("end_ts").cast("double").alias("end_ts"), "n")


@query(f"WITH {E} SELECT history, arg_max(kind, (value, id)) AS kind, arg_max(id, (value, id)) AS id FROM e GROUP BY history")
def latest_revision(spark, sf_dir):
    return evidence.latest(observations(spark, sf_dir).select("history", "kind", "id", "value"), ["history"], ["value", "id"]).select("history", "kind", "id")


@contextlib.contextmanager
def _state_partitions(spark, most: int = 8):
    """At most so many partitions of state for queries that start within."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _streamed(spark, rows: DataFrame, files: int) -> DataFrame:
    """Rows as a stream of files, one for each micro-batch."""
    folder = scratch(spark)
    rows.repartition(files).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(ORACLE_SQL["observation_capped_windows"])
def streamed_windows(spark, sf_dir):
    """As ``observation_capped_windows``, from a stream with state; a row of another history, long after all, moves the watermark past them."""
    e = observations(spark, sf_dir).select("history", "ts")
    last = e.agg(F.lit(-1).cast("bigint").alias("history"), (F.max("ts") + 1_000_000).alias("ts"))
    rows = e.unionByName(last).select("history", F.timestamp_seconds("ts").alias("ts"))
    out = scratch(spark)
    with _state_partitions(spark):
        found = state.capped_windows(_streamed(spark, rows, 1), ["history"], "ts", "1 hour", 7200, 21_600)
        found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("history bigint, start_ts bigint, end_ts double, n bigint").parquet(f"{out}/rows").where("history >= 0")


@query(ORACLE_SQL["latest_revision"])
def streamed_latest(spark, sf_dir):
    """As ``latest_revision``, from changes of a stream of three batches in buckets of a store."""
    rows = observations(spark, sf_dir).select("history", "kind", "id", "value")
    out = scratch(spark)
    with _state_partitions(spark):
        state.keep_current(_streamed(spark, rows, 3), ["history"], ["value", "id"], f"{out}/store", f"{out}/state", buckets=8).awaitTermination()
    return Store(spark, f"{out}/store").read("current").select("history", "kind", "id")


@query(f"""WITH {E}, n AS (SELECT history, id, value, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS a, CASE WHEN kind = 'view' THEN NULL ELSE kind END AS b FROM e)
SELECT history, arg_max(a, (value, id)) FILTER (a IS NOT NULL) AS a, arg_max(b, (value, id)) FILTER (b IS NOT NULL) AS b FROM n GROUP BY history""")
def rank_first_non_null(spark, sf_dir):
    e = observations(spark, sf_dir).select("history", "id", "value", F.when(F.col("k") % 3 != 0, F.col("k")).alias("a"), F.when(F.col("kind") != "view", F.col("kind")).alias("b"))
    return evidence.merged(e, ["history"], {"x": ["a", "b"]}, {"x": ["value", "id"]})


@query(f"""WITH {E}, d AS (SELECT history, max(id) AS revision FROM e WHERE kind = 'error' GROUP BY history)
SELECT e.history, e.id, e.kind FROM e WHERE kind <> 'error' AND NOT EXISTS (SELECT 1 FROM d WHERE d.history = e.history AND d.revision >= e.id)""")
def tombstone_anti(spark, sf_dir):
    e = observations(spark, sf_dir).select("history", "id", "kind", F.col("id").alias("revision"))
    return evidence.without_deleted(e.where("kind <> 'error'"), e.where("kind = 'error'"), ["history"]).select("history", "id", "kind")


_TWINS = "x AS (SELECT CASE WHEN id % 4 <> 0 THEN id END AS identity, ts // 86400 AS day, CASE WHEN k % 2 = 0 THEN k END AS spot, kind, id, CASE WHEN id % 4 = 0 OR id % 3 = 0 THEN value END AS value FROM e)"


@query(f"""WITH {E}, {_TWINS}, o AS (SELECT day, spot, arg_max(value, id) FILTER (value IS NOT NULL) AS v FROM x WHERE identity IS NULL GROUP BY day, spot),
t AS (SELECT x.identity, x.id, x.kind, coalesce(x.value, o.v) AS value FROM x LEFT JOIN o ON x.day IS NOT DISTINCT FROM o.day AND x.spot IS NOT DISTINCT FROM o.spot WHERE identity IS NOT NULL
  UNION ALL SELECT identity, id, kind, value FROM x WHERE identity IS NULL AND NOT EXISTS (SELECT 1 FROM x y WHERE y.identity IS NOT NULL AND y.day IS NOT DISTINCT FROM x.day AND y.spot IS NOT DISTINCT FROM x.spot))
SELECT * FROM t""")
def null_safe_absorb(spark, sf_dir):
    e = observations(spark, sf_dir)
    x = e.select(
        F.when(F.col("id") % 4 != 0, F.col("id")).alias("identity"), scalars.day_key("ts").alias("day"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("spot"), "kind", "id", F.when((F.col("id") % 4 == 0) | (F.col("id") % 3 == 0), F.col("value")).alias("value")
    )
    return evidence.absorb_twins(x, "identity", ["day", "spot"], ["value"], {"value": ["id"]}).select("identity", "id", "kind", "value")


@query(f"WITH {E} SELECT history, id, lag(id) OVER w AS previous_id, lag(kind) OVER w AS previous_kind, lead(id) OVER w AS next_id, lead(kind) OVER w AS next_kind FROM e WINDOW w AS (PARTITION BY history ORDER BY ts, id)")
def neighbour_asof(spark, sf_dir):
    e = observations(spark, sf_dir).select("history", "id", "ts", "kind")
    return windows.neighbours(e, ["history"], "ts", "id", ["id", "kind"]).select("history", "id", "previous_id", "previous_kind", "next_id", "next_kind")


_AB = (
    "a AS (SELECT history, id AS a_id, ts AS a_start, ts + 1800 AS a_end FROM e WHERE kind = 'view'), b AS (SELECT history, id AS b_id, ts AS b_start, ts + 3600 AS b_end, value FROM e WHERE kind = 'click'),"
    "m AS (SELECT *, least(a_end, b_end) - greatest(a_start, b_start) AS overlap_s FROM a JOIN b USING (history) WHERE a_start < b_end AND b_start < a_end)"
)


def _ab(spark, sf_dir):
    e = observations(spark, sf_dir)
    a = e.where("kind = 'view'").select("history", F.col("id").alias("a_id"), F.col("ts").alias("a_start"), (F.col("ts") + 1800).alias("a_end"))
    b = e.where("kind = 'click'").select("history", F.col("id").alias("b_id"), F.col("ts").alias("b_start"), (F.col("ts") + 3600).alias("b_end"), "value")
    return a, b


@query(f"WITH {E}, {_AB} SELECT history, a_id, b_id, overlap_s FROM m WHERE overlap_s >= 900")
def overlap_half_match(spark, sf_dir):
    return intervals.half_matches(*_ab(spark, sf_dir), ["history"]).select("history", "a_id", "b_id", F.col("overlap_s").cast("bigint").alias("overlap_s"))


@query(f"WITH {E}, {_AB} SELECT history, a_id, b_id, overlap_s FROM (SELECT *, row_number() OVER (PARTITION BY history, a_id ORDER BY overlap_s DESC, value, b_id) AS r FROM m WHERE overlap_s >= 900) WHERE r = 1")
def best_overlap_match(spark, sf_dir):
    pairs = intervals.half_matches(*_ab(spark, sf_dir), ["history"])
    return intervals.best_match(pairs, ["history", "a_id"], "value", "b_id").select("history", "a_id", "b_id", F.col("overlap_s").cast("bigint").alias("overlap_s"))


@query(f"""WITH {E}, {_AB}, c AS (SELECT a_id, b_id, greatest(least(a_end, b_end) - greatest(a_start, b_start), 0) AS overlap_s,
  abs(a_start - b_start) AS ds, abs(a_end - b_end) AS de FROM a JOIN b USING (history))
SELECT a_id, b_id, overlap_s FROM c WHERE overlap_s >= 900 OR (ds <= 90 AND de <= 90)""")
def claim_window_match(spark, sf_dir):
    return intervals.claim_matches(*_ab(spark, sf_dir), ["history"]).select("a_id", "b_id", F.col("overlap_s").cast("bigint").alias("overlap_s"))


@query(f"""WITH {E}, w AS (SELECT DISTINCT history, ts // 86400 AS window_id, ts // 86400 * 86400 AS a, ts // 86400 * 86400 + 86400 AS b FROM e),
c AS (SELECT w.history, window_id, a, b, greatest(a, ts) AS s, least(b, ts + 1800) AS t FROM w JOIN e ON e.history = w.history AND e.ts < b AND e.ts + 1800 > a
  UNION ALL SELECT history, window_id, a, b, b, b FROM w),
f AS (SELECT *, coalesce(max(t) OVER (PARTITION BY history, window_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS f FROM c)
SELECT history, window_id, f AS start_ts, s AS end_ts FROM f WHERE s > f""")
def interval_subtract(spark, sf_dir):
    e = observations(spark, sf_dir)
    day = scalars.day_key("ts")
    days = e.select("history", day.alias("window_id"), (day * 86400).alias("start_ts"), (day * 86400 + 86400).alias("end_ts")).distinct()
    return intervals.subtract(days, e.select("history", F.col("ts").alias("start_ts"), (F.col("ts") + 1800).alias("end_ts")), ["history"])


@query(f"WITH {E} SELECT history, kind, n FROM (SELECT history, kind, count(*) AS n, row_number() OVER (PARTITION BY history ORDER BY count(*) DESC, kind) AS r FROM e WHERE kind IS NOT NULL GROUP BY history, kind) WHERE r = 1")
def dominant_mode(spark, sf_dir):
    return windows.dominant(observations(spark, sf_dir), ["history"], "kind")


@query(f"WITH {E} SELECT history, round(median(value), 4) AS median_value FROM e GROUP BY history")
def median_value(spark, sf_dir):
    return windows.median(observations(spark, sf_dir), ["history"], "value").select("history", F.round("value", 4).alias("median_value"))


@query(f"WITH {E} SELECT history, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.9) AS INTEGER) + 1] AS p90 FROM e WHERE value IS NOT NULL GROUP BY history")
def p90_floor_index(spark, sf_dir):
    return windows.floor_index(observations(spark, sf_dir), ["history"], "value", 0.9).select("history", F.col("value").alias("p90"))


_HAV = "2 * 6371000 * atan2(sqrt({h}), sqrt(1 - ({h})))"


def _hav_sql(a1, o1, a2, o2):
    h = f"pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2)"
    return _HAV.format(h=h)


@query(f"WITH {GEO}, p AS (SELECT history, id, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM g WINDOW w AS (PARTITION BY history ORDER BY ts, id)) SELECT history, id, round({_hav_sql('lat0', 'lon0', 'lat', 'lon')}, 2) AS distance_m FROM p WHERE lat0 IS NOT NULL")
def haversine_pairs(spark, sf_dir):
    w = windows.over(["history"], "ts", "id")
    p = track(spark, sf_dir).withColumn("lat0", F.lag("lat").over(w)).withColumn("lon0", F.lag("lon").over(w)).where("lat0 is not null")
    return p.select("history", "id", F.round(scalars.haversine_m("lat0", "lon0", "lat", "lon"), 2).alias("distance_m"))


@query(f"WITH {GEO}, p AS (SELECT history, {_hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM g WINDOW w AS (PARTITION BY history ORDER BY ts, id)) SELECT history, round(coalesce(sum(d), 0), 0) AS path_m FROM p GROUP BY history")
def path_length(spark, sf_dir):
    return windows.path_length(track(spark, sf_dir), ["history"], "ts", "id", "lat", "lon").select("history", F.round("path_m", 0).alias("path_m"))


@query(f"WITH {GEO} SELECT history, min(lat) AS bbox_min_lat, min(lon) AS bbox_min_lon, max(lat) AS bbox_max_lat, max(lon) AS bbox_max_lon FROM g GROUP BY history")
def bbox(spark, sf_dir):
    return intervals.bounds(track(spark, sf_dir), ["history"], "lat", "lon")


@query(f"WITH {GEO} SELECT history, id, lat, lon FROM g WHERE lat BETWEEN 10 AND 45 AND lon BETWEEN -20 AND 60")
def bbox_range(spark, sf_dir):
    return intervals.within_box(track(spark, sf_dir), "lat", "lon", 10, -20, 45, 60).select("history", "id", "lat", "lon")


@query(f"""WITH {E}, d AS (SELECT history, ts // 86400 AS day, CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS duration FROM e),
g AS (SELECT history, day, count(*) AS n, count(*) FILTER (duration <= 0) AS n_empty, CAST(median(duration) AS DOUBLE) AS median_s FROM d GROUP BY history, day)
SELECT *, ((n >= 2 AND n_empty / n >= 0.4) OR (n >= 20 AND median_s < 30)) AS is_fragmented FROM g""")
def fragment_days(spark, sf_dir):
    d = observations(spark, sf_dir).select("history", scalars.day_key("ts").alias("day"), F.when(F.col("k") % 4 == 0, 0).otherwise(F.col("k")).alias("duration"))
    return windows.fragmented(d, ["history", "day"], "duration")


_ANCHOR = "f AS (SELECT history, id, ts AS s, ts + CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS t, kind = 'purchase' AS anchor FROM e)"


@query(f"""WITH {E}, {_ANCHOR}, l AS (SELECT *, CASE WHEN anchor OR coalesce(lag(anchor) OVER w, true) OR s - greatest(lag(s) OVER w, lag(t) OVER w) > 600 THEN 1 ELSE 0 END AS c FROM f WINDOW w AS (PARTITION BY history ORDER BY s, id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY history ORDER BY s, id) AS run FROM l)
SELECT history, min(s) AS start_ts, max(CASE WHEN t <= s THEN s + 60 ELSE t END) AS end_ts, count(*) AS n FROM r WHERE NOT anchor GROUP BY history, run""")
def fragment_runs(spark, sf_dir):
    f = observations(spark, sf_dir).select("history", "id", F.col("ts").alias("s"), (F.col("ts") + F.when(F.col("k") % 4 == 0, 0).otherwise(F.col("k"))).alias("t"), (F.col("kind") == "purchase").alias("anchor"))
    return windows.fragment_windows(f, ["history"], "s", "t", "anchor", "id")


@query(f"""WITH {I}, n AS (SELECT *, lead(start_ts) OVER w AS s2, lead(kind) OVER w AS k2 FROM i WINDOW w AS (PARTITION BY history ORDER BY start_ts, id))
SELECT history, end_ts AS start_ts, s2 AS end_ts FROM n WHERE kind = 'view' AND k2 = 'view' AND s2 > end_ts""")
def gaps_between_same_kind(spark, sf_dir):
    return windows.gaps_between(half_hours(spark, sf_dir), ["history"], "start_ts", "end_ts", "kind", "id", "view")


@query("SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS ship_day, l_returnflag, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2, 3")
def duplicate_moves(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"), "l_returnflag", "l_linenumber")
    return evidence.distinct_by(rows, ["l_orderkey", "ship_day", "l_returnflag"], "l_linenumber")



_NAMES = [(mode, name) for mode, names in scalars.MODE_NAMES.items() for name in names.split()] + [("other", x) for x in ("", "teleport", "walk ing", "bus2")]
#: The ways of writing a name: as it is, with white space around, in upper case, with other separators.
_WRITTEN = (lambda x: x, lambda x: f" \t{x}\n", str.upper, lambda x: x.replace("_", "-"), lambda x: x.replace("_", " ").title(), lambda x: x.replace("_", "/"))


@query(f"""WITH n AS (SELECT unnest([{", ".join(repr(m) for m, _ in _NAMES)}]) AS mode, unnest(range({len(_NAMES)})) AS j)
SELECT event_id, mode FROM events JOIN n ON j = event_id % {len(_NAMES)}""")
def mode_dictionary(spark, sf_dir):
    forms = F.array(*(F.array(*(F.lit(write(name)) for write in _WRITTEN)) for _, name in _NAMES))
    e = read(spark, sf_dir, "events").withColumn("j", (F.col("event_id") % len(_NAMES)).cast("int")).withColumn("way", (F.floor(F.col("event_id") / len(_NAMES)) % len(_WRITTEN)).cast("int"))
    return e.select("event_id", scalars.mode_of(F.get(F.get(forms, F.col("j")), F.col("way"))).alias("mode"))


@query("""WITH o AS (SELECT o_orderkey, CAST(floor(epoch_us(o_orderdate) / 1000000.0) AS BIGINT) AS t, o_orderkey % 27 * 1800 - 23400 AS z FROM orders)
SELECT o_orderkey, t AS iso, t AS compact, t - z AS zoned, CAST(z AS INTEGER) AS zone, t - t % 60 AS minutes, CASE WHEN o_orderkey % 5 > 1 THEN t END AS some FROM o""")
def timestamp_parse(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("z", F.col("o_orderkey") % 27 * 1800 - 23400)
    text = lambda p: F.date_format("o_orderdate", p)
    iso, compact = text("yyyy-MM-dd'T'HH:mm:ss"), text("yyyyMMdd'T'HHmmss")
    size = F.abs("z")
    zone = F.concat(F.when(F.col("z") < 0, "-").otherwise("+"), F.lpad(F.floor(size / 3600).cast("string"), 2, "0"), F.lpad((F.floor(size / 60) % 60).cast("string"), 2, "0"))
    zoned, broken = F.concat(compact, zone), F.concat(text("yyyy"), F.when(F.col("o_orderkey") % 5 == 0, "-02-30T").otherwise("-13-01T"), text("HH:mm:ss"))
    some = scalars.timestamp_s(F.when(F.col("o_orderkey") % 5 > 1, F.concat(F.lit(" "), iso)).otherwise(broken))
    return o.select("o_orderkey", scalars.timestamp_s(F.concat(iso, F.lit(".987Z"))).alias("iso"), scalars.timestamp_s(compact).alias("compact"), scalars.timestamp_s(zoned).alias("zoned"), scalars.timestamp_offset_s(zoned).alias("zone"), scalars.timestamp_s(text("yyyy-MM-dd'T'HH:mm")).alias("minutes"), some.alias("some"))


@query("""WITH e AS (SELECT event_id, event_type, event_id % 6 AS form, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT event_id, CASE WHEN form IN (0, 1) THEN k END AS k, CASE WHEN form IN (0, 2) THEN event_type END AS text, form = 3 AS yes FROM e""")
def json_field(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("form", F.col("event_id") % 6).withColumn("n", F.get_json_object("props", "$.k"))
    # number and text, a number alone, a number as text, true, text that is empty, neither
    forms = ['{"k":%s,"t":"%s"}', '{"k":%s,"t":7}', '{"k":"%s","t":"%s"}', '{"k":false,"t":null,"y":true}', '{"k":null,"t":"","y":"true"}', "no object"]
    made = F.lit(forms[5])
    for j, form in enumerate(forms[:5]):
        made = F.when(F.col("form") == j, F.format_string(form, *["n", "event_type"][: form.count("%s")]) if "%s" in form else F.lit(form)).otherwise(made)
    return e.withColumn("j", made).select("event_id", scalars.strict_number("j", "$.k").alias("k"), scalars.strict_string("j", "$.t").alias("text"), scalars.strict_true("j", "$.y").alias("yes"))


@query(f"WITH {GEO} SELECT history, id, floor(lon / 2 * 1e7 + 0.5) / 1e7 AS lon, floor(lat * 1e7 + 0.5) / 1e7 AS lat FROM g")
def codec_roundtrip(spark, sf_dir):
    """The track of each history and day, encoded and decoded as a whole; half the longitude, for steps that fit in 32 bits."""
    days = track(spark, sf_dir).withColumn("lon", F.col("lon") / 2).groupBy("history", scalars.day_key("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "id", "lon", "lat"))).alias("r"))
    coded = days.select("history", "r", codec.decode_route(codec.encode_route(F.col("r.lon"), F.col("r.lat"))).alias("d"))
    points = coded.select("history", F.explode(F.arrays_zip(F.col("r.id").alias("id"), F.col("d").alias("d"))).alias("p"))
    return points.select("history", "p.id", F.round("p.d.lon", 7).alias("lon"), F.round("p.d.lat", 7).alias("lat"))


@query(f"""WITH {I} SELECT count(*) FILTER (kind = 'view') AS n_stays, count(*) FILTER (kind = 'click') AS n_moves, count(*) FILTER (kind = 'error') AS n_gaps,
  min(start_ts) FILTER (kind IN ('view', 'click', 'error')) AS first_ts, max(end_ts) FILTER (kind IN ('view', 'click', 'error')) AS last_ts, (SELECT count(*) FROM supplier) AS n_pois FROM i""")
def report_summary(spark, sf_dir):
    i = half_hours(spark, sf_dir)
    part = lambda k: i.where(F.col("kind") == k)
    return views.report(part("view"), part("click"), part("error"), read(spark, sf_dir, "supplier"))


@query(f"""WITH {E}, m AS (SELECT kind || ' of user ' || history AS m, count(*) AS n, min(id) AS first_seen FROM e GROUP BY 1)
SELECT CASE WHEN n > 1 THEN m || ' (' || n || ' times)' ELSE m END AS diagnostic, n, first_seen FROM m ORDER BY n DESC, first_seen LIMIT 20""")
def top_diagnostics(spark, sf_dir):
    e = observations(spark, sf_dir).select(F.concat("kind", F.lit(" of user "), F.col("history").cast("string")).alias("m"), "id")
    return views.top_diagnostics(e, "m", "id")


#: Users 2 n and 2 n + 1 stand for the two sources of history n, and each of their events for a claim of half an hour.
_CLAIMS = """c AS (SELECT id, history // 2 AS h, ts // 86400 AS day, history % 2 AS side, ts AS s, ts + 1800 AS t, k, CASE WHEN k % 3 > 0 THEN value END AS metres, id % 9 = 0 AS manual FROM e),
m AS (SELECT a.h, a.day, a.id AS a, b.id AS b FROM c a JOIN c b ON a.h = b.h AND a.day = b.day AND a.side = 0 AND b.side = 1 AND least(a.t, b.t) - greatest(a.s, b.s) >= 900),
u AS (SELECT h, day, a, b FROM m UNION SELECT h, day, b, a FROM m), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen),
p AS (SELECT node, min(seen) AS component FROM r GROUP BY node)"""


def _claims(spark, sf_dir):
    e = observations(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    return e.select(
        F.floor(F.col("history") / 2).cast("string").alias("history_id"), F.col("id").alias("claim_id"), F.when(F.col("history") % 2 == 0, "arc").otherwise("moves").alias("source"), F.lit("move").alias("kind"), scalars.day_key("ts").alias("day_key"),
        F.col("ts").alias("start"), (F.col("ts") + 1800).alias("end"), F.col("k").alias("steps"), F.when(F.col("k") % 3 > 0, F.col("value")).alias("distance"), none("double").alias("floors_up"), none("double").alias("floors_down"), none("int").alias("tz_offset_s"),
        (F.col("id") % 9 == 0).alias("manual"), none("bigint").alias("sequence"), F.lit("walk").alias("mode"),
    )


@query(f"WITH RECURSIVE {E}, {_CLAIMS} SELECT node, component FROM p")
def claim_components(spark, sf_dir):
    claims, keys = _claims(spark, sf_dir), ["history_id", "day_key"]
    side = lambda x, k: claims.where(F.col("source") == k).select(*keys, F.col("claim_id").alias(f"{x}_id"), F.col("start").alias(f"{x}_start"), F.col("end").alias(f"{x}_end"))
    met = intervals.claim_matches(side("a", "arc"), side("b", "moves"), keys)
    return evidence.components(met.select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b")), keys).select("node", "component")


def _events_of(spark, sf_dir):
    e = _kinds(half_hours(spark, sf_dir))
    long = F.col("end_ts") + F.when(F.col("id") % 3 == 0, 3600).otherwise(0)
    spot = (F.col("k") % 7).cast("double")
    routed, measured = (F.col("kind") == "move") & (F.col("id") % 4 == 0), (F.col("kind") == "move") & (F.col("id") % 4 < 2)
    quality = F.when(F.col("kind") == "move", 1 + 6 * routed.cast("int") + 2 * measured.cast("int") + 2 * (F.col("k") % 2)).when(F.col("kind") == "stay", 1 + F.col("k") % 10).otherwise(F.col("k") % 2 * 2)
    return e.select(
        F.col("history").cast("string").alias("history_id"), "id", "kind", F.col("start_ts").cast("double").alias("start_ts"), long.cast("double").alias("end_ts"), quality.cast("int").alias("quality"), (F.col("id") % 11 == 0).alias("manual"),
        F.col("value").alias("revision"), F.when(F.col("id") % 2 == 0, "arc").otherwise("moves").alias("source"), (spot / 10).alias("lat"), (spot / 5).alias("lon"), F.lit(50.0).alias("radius_m"), routed.alias("has_route"), measured.alias("has_distance"),
    )


@query()
def overlap_resolution(spark, sf_dir):
    return timeline.sweep(_events_of(spark, sf_dir)).select("history_id", "id", "part", "kind", "start_ts", "end_ts", "quality", "geometry_valid")


@query(f"""WITH {I}, v AS (SELECT history, start_ts AS s, end_ts + CASE WHEN id % 3 = 0 THEN 3600 ELSE 0 END AS t FROM i WHERE kind IN ('click', 'purchase')), w AS (SELECT * FROM v WHERE t > s),
r AS (SELECT *, max(t) OVER (PARTITION BY history ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w)
SELECT CAST(history AS VARCHAR) AS history_id, CAST(sum(greatest(t - greatest(s, coalesce(reach, s)), 0)) AS DOUBLE) AS covered_s, 0::BIGINT AS n_overlaps FROM r GROUP BY history""")
def overlap_coverage(spark, sf_dir):
    """The moves alone, which never merge: the time that any covers is what the swept ones last, and no two of them overlap."""
    swept = timeline.sweep(_events_of(spark, sf_dir).where("kind = 'move'"))
    total = swept.groupBy("history_id").agg(F.sum(F.col("end_ts") - F.col("start_ts")).alias("covered_s"))
    return total.join(timeline.integrity(swept, ["history_id"]).select("history_id", "n_overlaps"), "history_id")


@query()
def timeline_gaps(spark, sf_dir):
    return timeline.filled_gaps(timeline.sweep(_events_of(spark, sf_dir)))


@query()
def cleaned_routes(spark, sf_dir):
    points = track(spark, sf_dir).groupBy("history", scalars.day_key("ts").alias("day")).agg(F.collect_list(F.struct("ts", "lon", "lat")).alias("points"))
    out = points.select("history", "day", routes.cleaned_route(F.col("points")).alias("r"))
    return out.select("history", "day", F.size("r.points").alias("n_points"), F.round("r.distance_m", 2).alias("distance_m"), "r.quality")


@query(f"""WITH RECURSIVE {E}, {_CLAIMS}, h AS (SELECT c.*, component FROM c LEFT JOIN p ON c.id = p.node),
g AS (SELECT component, [count(*) FILTER (side = 1 AND manual), coalesce(sum(t - s) FILTER (side = 1), 0), count(k) FILTER (side = 1), count(metres) FILTER (side = 1)]
  >= [count(*) FILTER (side = 0 AND manual), coalesce(sum(t - s) FILTER (side = 0), 0), count(k) FILTER (side = 0), count(metres) FILTER (side = 0)] AS days FROM h WHERE component IS NOT NULL GROUP BY component)
SELECT h.id AS claim_id, CASE side WHEN 0 THEN 'arc' ELSE 'moves' END AS source, s AS start, k AS steps FROM h LEFT JOIN g USING (component) WHERE days IS NULL OR days = (side = 1)""")
def pedometer_choice(spark, sf_dir):
    return pedometer.chosen_side(_claims(spark, sf_dir)).select("claim_id", "source", "start", "steps")


@query(f"""WITH {I} SELECT i.history, i.id AS interval_id, p.id AS point_id FROM i JOIN e p ON p.history = i.history AND p.kind = 'click' AND p.ts >= i.start_ts AND p.ts < i.end_ts WHERE i.kind = 'view' OR i.id % 5 = 0""")
def points_in_intervals(spark, sf_dir):
    i = half_hours(spark, sf_dir).where("kind = 'view' or id % 5 = 0").select("history", F.col("id").alias("interval_id"), "start_ts", "end_ts")
    p = observations(spark, sf_dir).where("kind = 'click'").select("history", F.col("id").alias("point_id"), F.col("ts").alias("p_ts"))
    return intervals.points_in(i, p, ["history"], "p_ts").select("history", "interval_id", "point_id")


@query(f"""WITH {E} SELECT a.history, a.ts // 3600 AS hour FROM e a WHERE kind = 'view' AND EXISTS (SELECT 1 FROM e b WHERE b.history = a.history AND b.kind = 'purchase' AND a.ts // 3600 * 3600 < b.ts + 5400 AND b.ts < a.ts // 3600 * 3600 + 7200)""")
def touching_intervals(spark, sf_dir):
    """Hours with a view that a purchase touches, an hour as often as it has views."""
    e = observations(spark, sf_dir)
    hour = F.floor(F.col("ts") / 3600).cast("bigint")
    a = e.where("kind = 'view'").select("history", (hour * 3600).alias("start_ts"), (hour * 3600 + 7200).alias("end_ts"))
    b = e.where("kind = 'purchase'").select("history", F.col("ts").alias("start_ts"), (F.col("ts") + 5400).alias("end_ts"))
    return intervals.touching(a, b, ["history"]).select("history", F.floor(F.col("start_ts") / 3600).cast("bigint").alias("hour"))


@query(f"""WITH {E}, l AS (SELECT *, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 < 3 THEN 'moves:' || k ELSE kind || (id % 50) END AS link FROM e)
SELECT history, id, link FROM l WHERE (link IS NULL OR link NOT LIKE 'moves:%') AND NOT EXISTS (SELECT 1 FROM l m WHERE m.history = l.history AND m.id % 3 = 0 AND m.link = l.link)""")
def unlinked_observations(spark, sf_dir):
    k = F.col("k") % 7
    link = F.when(k == 0, F.lit(None)).when(k < 3, F.concat(F.lit("moves:"), F.col("k").cast("string"))).otherwise(F.concat("kind", (F.col("id") % 50).cast("string")))
    e = observations(spark, sf_dir).withColumn("link", link)
    return evidence.unlinked(e, e.where("id % 3 = 0").select("history", "link"), "link", "moves:", ["history"]).select("history", "id", "link")


@query(f"""WITH {E}, x AS (SELECT history, ts // 86400 AS day, CASE WHEN k % 3 > 0 THEN k % 3 END AS spot, CASE WHEN id % 4 > 0 THEN value END AS a, CASE WHEN id % 5 > 0 THEN kind END AS b, id, k FROM e)
SELECT history, day, spot, arg_max(a, (k, id)) FILTER (a IS NOT NULL) AS a, arg_max(b, (id)) FILTER (b IS NOT NULL) AS b, max(id) AS id FROM x WHERE spot IS NOT NULL GROUP BY history, day, spot
UNION ALL SELECT history, day, spot, a, b, id FROM x WHERE spot IS NULL""")
def collapsed_observations(spark, sf_dir):
    x = observations(spark, sf_dir).select("history", scalars.day_key("ts").alias("day"), F.when(F.col("k") % 3 > 0, F.col("k") % 3).alias("spot"), F.when(F.col("id") % 4 > 0, F.col("value")).alias("a"), F.when(F.col("id") % 5 > 0, F.col("kind")).alias("b"), "id", "k")
    return evidence.collapsed(x, ["history", "day", "spot"], {"a": ["a"], "b": ["b"]}, {"a": ["k", "id"], "b": ["id"]}, "id").select("history", "day", "spot", "a", "b", "id")


@query(f"""WITH {E}, d AS (SELECT history, ts // 86400 AS day, ts - lag(ts) OVER (PARTITION BY history, ts // 86400 ORDER BY ts, id) AS d FROM e)
SELECT history, day, CAST(coalesce(greatest(1.0, least(300.0, median(d) FILTER (d > 0 AND d <= 600))), 60.0) AS DOUBLE) AS interval_s FROM d GROUP BY history, day""")
def typical_interval(spark, sf_dir):
    e = observations(spark, sf_dir).withColumn("day", scalars.day_key("ts"))
    return windows.typical_interval_s(e, ["history", "day"], "ts", "id")


@query(f"""WITH {E}, x AS (SELECT *, CASE WHEN k % 3 > 0 THEN k * 60 END AS o FROM e)
SELECT history, arg_min(o, (ts, id)) FILTER (o IS NOT NULL) AS first_o, arg_max(o, (ts, id)) FILTER (o IS NOT NULL) AS last_o FROM x GROUP BY history""")
def first_last_offset(spark, sf_dir):
    e = observations(spark, sf_dir).withColumn("o", F.when(F.col("k") % 3 > 0, F.col("k") * 60))
    return windows.first_last(e, ["history"], "ts", "id", "o")


@query(f"""WITH {E}, x AS (SELECT id, value, k, CASE WHEN id % 3 = 0 THEN -value WHEN id % 3 = 1 THEN value * 9 ELSE value END AS v, CASE WHEN id % 4 = 0 THEN k * 700.5 ELSE k * 900 - 20000 END AS o FROM e)
SELECT id, CASE WHEN v > 0 THEN v END AS positive, CASE WHEN v >= 0 THEN v END AS not_negative, CASE WHEN v >= 0 THEN round(v % 360, 6) END AS course, CASE WHEN v >= 0 AND v < 360 THEN v END AS accuracy,
  CASE WHEN o = floor(o) AND abs(o) <= 50400 THEN CAST(o AS INTEGER) END AS zone, CAST(floor(v + 0.5) AS BIGINT) AS half_up, v > 0 AND v + k - 20 > v AS valid, v BETWEEN -90 AND 90 AND v * 3 BETWEEN -180 AND 180 AS placed FROM x""")
def scalar_bounds(spark, sf_dir):
    third = F.col("id") % 3
    x = observations(spark, sf_dir).withColumn("v", F.when(third == 0, -F.col("value")).when(third == 1, F.col("value") * 9).otherwise(F.col("value"))).withColumn("o", F.when(F.col("id") % 4 == 0, F.col("k") * 700.5).otherwise(F.col("k") * 900 - 20000))
    return x.select("id", scalars.positive("v").alias("positive"), scalars.non_negative("v").alias("not_negative"), F.round(scalars.course("v"), 6).alias("course"), scalars.course_accuracy("v").alias("accuracy"), scalars.offset_s("o").alias("zone"), scalars.half_up("v").cast("bigint").alias("half_up"), scalars.valid_window("v", F.col("v") + F.col("k") - 20).alias("valid"), scalars.valid_point("v", F.col("v") * 3).alias("placed"))


_NEAR = "p AS (SELECT id, history, 45 + (id * 7919 % 4000) / 100000.0 AS lat, 9 + (id * 104729 % 4000) / 100000.0 AS lon, k * 2.0 AS r FROM e), q AS (SELECT s_suppkey AS place_id, 45 + (s_suppkey * 613 % 4000) / 100000.0 AS plat, 9 + (s_suppkey * 1217 % 4000) / 100000.0 AS plon, s_suppkey % 90 * 1.0 AS pr FROM supplier)"


@query(f"""WITH {E}, {_NEAR}, d AS (SELECT id, place_id, {_hav_sql('lat', 'lon', 'plat', 'plon')} AS m, greatest(50, r + pr) AS reach FROM p, q),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, place_id) AS r, lead(m) OVER (PARTITION BY id ORDER BY m, place_id) AS next FROM d WHERE m <= reach)
SELECT id AS point_id, place_id, round(m, 3) AS distance_m FROM n WHERE r = 1 AND (next IS NULL OR next - m >= 25)""")
def nearest_place(spark, sf_dir):
    p = observations(spark, sf_dir).select(F.col("id").alias("point_id"), (45 + (F.col("id") * 7919 % 4000) / 100000.0).alias("lat"), (9 + (F.col("id") * 104729 % 4000) / 100000.0).alias("lon"), (F.col("k") * 2.0).alias("radius_m"))
    s = F.col("s_suppkey")
    q = read(spark, sf_dir, "supplier").select(s.alias("place_id"), (45 + (s * 613 % 4000) / 100000.0).alias("place_lat"), (9 + (s * 1217 % 4000) / 100000.0).alias("place_lon"), (s % 90 * 1.0).alias("place_radius_m"))
    return intervals.nearest_unambiguous(p, q, []).select("point_id", "place_id", F.round("distance_m", 3).alias("distance_m"))


_FRAMES = "f AS (SELECT id, history, ts // 604800 AS stream_id, CASE WHEN id % 6 > 0 THEN ts END AS s, ts + k * 60 AS t, lat, lon FROM g)"


@query(f"""WITH {GEO}, {_FRAMES} SELECT history, stream_id, count(*) AS frame_count, arg_min(s, id) FILTER (s IS NOT NULL) AS ts_start, max(t) AS ts_end, min(lat) AS bbox_min_lat, min(lon) AS bbox_min_lon, max(lat) + 1 AS bbox_max_lat, max(lon) + 1 AS bbox_max_lon FROM f GROUP BY history, stream_id""")
def stream_totals(spark, sf_dir):
    return frames.stream_totals(_frames(spark, sf_dir), ["history"])


@query(ORACLE_SQL["stream_totals"])
def batched_totals(spark, sf_dir):
    """As ``stream_totals``, from five batches of frames of any time, one of which comes twice."""
    every, store = _frames(spark, sf_dir), Store(spark, scratch(spark))
    for number, part in enumerate((3, 1, 4, 0, 2)):
        for _ in range(1 + (part == 4)):
            frame_streams.fold_frames(store, every.where(F.col("id") % 5 == part), number, keys=["history"], buckets=8)
    return frame_streams.totals(store)


def _frames(spark, sf_dir):
    t = track(spark, sf_dir)
    return t.select("history", F.floor(F.col("ts") / 604800).cast("bigint").alias("stream_id"), "id", F.when(F.col("id") % 6 > 0, F.col("ts")).alias("ts_start"), (F.col("ts") + F.col("k") * 60).alias("ts_end"), F.col("lat").alias("bbox_min_lat"), F.col("lon").alias("bbox_min_lon"), (F.col("lat") + 1).alias("bbox_max_lat"), (F.col("lon") + 1).alias("bbox_max_lon"))


@query(f"""WITH {GEO}, {_FRAMES}, p AS (SELECT history, min(ts) // 86400 * 86400 AS lo, unnest(range(10)) AS j FROM e GROUP BY history), t AS (SELECT history, j AS id, lo + j * 259200 AS a, lo + j * 259200 + 432000 AS b FROM p)
SELECT f.history, f.id AS frame_id, t.id AS tileset_id FROM f JOIN t ON f.history = t.history AND f.t > t.a AND f.s < t.b WHERE s IS NOT NULL""")
def stale_tiles(spark, sf_dir):
    lo = observations(spark, sf_dir).groupBy("history").agg((F.floor(F.min("ts") / 86400) * 86400).cast("bigint").alias("lo"))
    sets = lo.select("history", "lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("id")).select("history", "id", (F.col("lo") + F.col("id") * 259200).alias("period_start"), (F.col("lo") + F.col("id") * 259200 + 432000).alias("period_end"))
    return frames.stale_tiles(_frames(spark, sf_dir), sets, ["history"])


@query(f"""WITH {GEO}, d AS (SELECT DISTINCT history, ts // 86400 AS day FROM e), n AS (SELECT d.history, d.day, d.day * 86400 AS a, d.day * 86400 + 86400 AS b, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM d JOIN e ON e.history = d.history AND e.ts BETWEEN d.day * 86400 AND d.day * 86400 + 86400 GROUP BY d.history, d.day),
s AS (SELECT n.history, n.day, ts - lag(ts) OVER (PARTITION BY n.history, n.day ORDER BY ts) AS d FROM n JOIN e ON e.history = n.history AND e.ts BETWEEN n.a AND n.b),
x AS (SELECT history, day, CAST(trunc(greatest(1, least(300, coalesce(median(d) FILTER (d > 0 AND d <= 600), 60)))) AS BIGINT) AS step FROM s GROUP BY history, day),
y AS (SELECT *, least(b, hi + step) AS u FROM n JOIN x USING (history, day))
SELECT history, lo AS start_ts, u AS end_ts, 'arc_fragment_low_evidence' AS notes FROM y WHERE n > 1 AND u > lo UNION ALL SELECT history, a, lo, 'arc_fragment_unobserved' FROM y WHERE n > 1 AND u > lo AND lo > a
UNION ALL SELECT history, u, b, 'arc_fragment_unobserved' FROM y WHERE n > 1 AND u > lo AND b > u UNION ALL SELECT history, a, b, 'arc_fragment_low_evidence' FROM y WHERE n <= 1 OR u <= lo""")
def reconstructed_days(spark, sf_dir):
    """Days as intervals and events as samples without a place: all that can become of them are gaps."""
    e = observations(spark, sf_dir)
    day = scalars.day_key("ts")
    days = e.select("history", (day * 86400).alias("start_ts"), (day * 86400 + 86400).alias("end_ts")).distinct()
    none = lambda t: F.lit(None).cast(t)
    seen = e.select("history", "ts", none("double").alias("lon"), none("double").alias("lat"), none("double").alias("h_acc"), F.lit("unknown").alias("activity"), none("int").alias("tz_offset_s"))
    return reconstruct.reconstructed(days, seen, ["history"]).select("history", "start_ts", "end_ts", "notes")


@query(f"""WITH {E} SELECT 'history=' || history AS history_id, 'export-item' AS kind, 'e' || id AS item, ts AS start_ts FROM e""")
def history_values(spark, sf_dir):
    """Events as exported items, written as one JSON text for each history and month and read as archives."""
    folder = scratch(spark)
    date = lambda ts: F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(F.concat(F.lit("e"), F.col("id").cast("string")).alias("itemId"), F.lit(False).alias("isVisit"), date(F.col("ts")).alias("startDate"), date(F.col("ts") + 60).alias("endDate"))
    month = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM")
    texts = observations(spark, sf_dir).groupBy("history", month.alias("month")).agg(F.collect_list(item).alias("timelineItems"))
    archive.write_items(texts.withColumnRenamed("month", "name"), folder)
    found = archive.read_archives(spark, folder)
    return found.select("history_id", "kind", F.get_json_object("raw", "$.itemId").alias("item"), scalars.timestamp_s(F.get_json_object("raw", "$.startDate")).alias("start_ts"))


@query(f"""WITH {GEO} SELECT history, id, CASE WHEN id % 3 > 0 THEN lat END AS latitude, CASE WHEN k % 4 >= 3 THEN kind END AS confirmed, CASE WHEN k % 4 = 2 THEN kind END AS core_motion, CASE WHEN id % 2 = 0 THEN 'moving' END AS state, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS date FROM g""")
def observation_samples(spark, sf_dir):
    """Observations of ranks 0 to 3 as the samples that they stand for."""
    t = track(spark, sf_dir)
    there = lambda c: F.when(F.col("id") % 3 > 0, F.col(c))
    seen = t.withColumn("lat", there("lat")).withColumn("lon", there("lon")).withColumnRenamed("kind", "activity").withColumn("rank", F.col("k") % 4).withColumn("moving", F.when(F.col("id") % 2 == 0, "moving"))
    s = evidence.sample_of({"moving_state": "moving"}, seen.columns)
    return seen.select("history", "id", s.alias("s")).select("history", "id", F.col("s.location.latitude").alias("latitude"), F.col("s.confirmedType").alias("confirmed"), F.col("s.coreMotionActivityType").alias("core_motion"), F.col("s.movingState").alias("state"), F.col("s.date").alias("date"))


_FOLDER = "CASE id % 9 WHEN 0 THEN 'Moves\\JSON\\Daily\\Storyline\\' || id || '.json' WHEN 1 THEN 'json/full/storyline.json.gz' WHEN 2 THEN 'a/Export/JSON/monthly/' || id || '.json' WHEN 3 THEN 'json/daily/' || id || '.json' WHEN 4 THEN 'x/TimelineItem/0/' || id || '.json' WHEN 5 THEN 'LocomotionSample/' || id || '.json' WHEN 6 THEN 'b/Place/' || id || '.json' WHEN 7 THEN 'TimelineRangeSummary/1.json' ELSE 'myplace/' || id || '.json' END"


@query(f"""WITH {E} SELECT id, CASE id % 9 WHEN 0 THEN 'day' WHEN 1 THEN 'day' WHEN 2 THEN 'export-item' WHEN 3 THEN 'export-item' WHEN 4 THEN 'stored-item' WHEN 5 THEN 'sample' WHEN 6 THEN 'place' WHEN 7 THEN 'range-summary' END AS kind FROM e""")
def path_kinds(spark, sf_dir):
    number = F.col("id").cast("string")
    folders = ["Moves\\JSON\\Daily\\Storyline\\", "json/full/storyline.json.gz", "a/Export/JSON/monthly/", "json/daily/", "x/TimelineItem/0/", "LocomotionSample/", "b/Place/", "TimelineRangeSummary/1.json", "myplace/"]
    whole = [f if f.endswith((".gz", ".json")) else None for f in folders]
    path = F.get(F.array(*(F.lit(f) if w else F.concat(F.lit(f), number, F.lit(".json")) for f, w in zip(folders, whole, strict=True))), (F.col("id") % 9).cast("int"))
    return observations(spark, sf_dir).select("id", archive.path_kind(path).alias("kind"))


_TWICE = "r AS (SELECT CAST(history AS VARCHAR) AS h, ts // 86400 * 86400 AS s, kind AS mode, id % 2 = 0 AS arc, CASE WHEN id % 3 > 0 THEN value END AS metres, CASE WHEN id % 4 > 0 THEN k * 60 END AS zone, id % 7 = 0 AS manual, CAST(k AS DOUBLE) AS revision, id FROM e)"


@query(f"""WITH {E}, {_TWICE} SELECT h AS history_id, s AS start_ts, mode, arg_max(metres, (arc, revision, lpad(CAST(id AS VARCHAR), 12, '0'))) FILTER (metres IS NOT NULL) AS distance_m, CAST(arg_max(zone, (arc, revision, lpad(CAST(id AS VARCHAR), 12, '0'))) FILTER (zone IS NOT NULL) AS INTEGER) AS start_offset_s,
  CASE WHEN bool_or(arc) THEN 'arc' ELSE 'moves' END AS source, bool_or(manual) AS manual, max(revision) AS revision FROM r GROUP BY h, s, mode""")
def merged_moves(spark, sf_dir):
    """Events of one kind and day as moves of the whole day, told by two sources."""
    e = observations(spark, sf_dir).withColumnRenamed("kind", "told").withColumn("history_id", F.col("history").cast("string"))
    day = (F.floor(F.col("ts") / 86400) * 86400).cast("bigint")
    refs = importer._reference(
        e, kind=F.lit("move"), start_ts=day, end_ts=day + 86400, mode=F.col("told"), source=F.when(F.col("id") % 2 == 0, "arc").otherwise("moves"), distance_m=F.when(F.col("id") % 3 > 0, F.col("value")), start_offset_s=F.when(F.col("id") % 4 > 0, F.col("k") * 60),
        manual=F.col("id") % 7 == 0, revision=F.col("k"), ref=F.lpad(F.col("id").cast("string"), 12, "0"),
    )
    return importer.without_duplicate_moves(refs).select("history_id", "start_ts", "mode", "distance_m", "start_offset_s", "source", "manual", "revision")


@query(f"""WITH RECURSIVE {E}, p AS (SELECT DISTINCT CAST(history AS VARCHAR) AS h, 'arc:' || (id % 40) AS a, 'mapbox:' || (id * 7 % 60) AS b FROM e WHERE id % 5 < 2), s AS (SELECT DISTINCT CAST(history AS VARCHAR) AS h, 'arc:' || (id % 40) AS n FROM e WHERE id % 11 = 0),
u AS (SELECT h, a, b FROM p UNION SELECT h, b, a FROM p), r AS (SELECT h, a AS n, a AS m FROM u UNION SELECT r.h, r.n, u.b FROM r JOIN u ON u.h = r.h AND u.a = r.m),
g AS (SELECT h, n, min(m) AS c FROM r GROUP BY h, n), k AS (SELECT g.h, g.n, g.c, CASE WHEN s.n IS NOT NULL THEN 0 WHEN g.n LIKE 'mapbox:%' THEN 1 ELSE 2 END AS rank FROM g LEFT JOIN s ON s.h = g.h AND s.n = g.n),
o AS (SELECT h, c, arg_min(n, (rank, n)) AS key FROM k GROUP BY h, c) SELECT k.h AS history_id, k.n AS alias, o.key AS place_key FROM k JOIN o ON o.h = k.h AND o.c = k.c""")
def place_alias_groups(spark, sf_dir):
    """Two kinds of ids of places in some events; some of the one kind are of stored places."""
    e = observations(spark, sf_dir).withColumn("history_id", F.col("history").cast("string"))
    key = lambda kind, number: F.concat(F.lit(f"{kind}:"), number.cast("string"))
    pairs = e.where("id % 5 < 2").select("history_id", key("arc", F.col("id") % 40).alias("arc"), key("mapbox", F.col("id") * 7 % 60).alias("mapbox")).distinct()
    stored = e.where("id % 11 = 0").select("history_id", key("arc", F.col("id") % 40).alias("place_key")).distinct()
    return importer.place_aliases(pairs, stored)


@query(f"""WITH {E}, v AS (SELECT CAST(history AS VARCHAR) AS h, 'arc:' || (k % 20) AS p, CASE WHEN id % 3 > 0 THEN kind END AS name, id / 1000.0 AS lat, CAST(k AS DOUBLE) AS revision, ts AS seen FROM e),
w AS (SELECT h, p, name, lat, revision, seen FROM v UNION ALL SELECT DISTINCT CAST(history AS VARCHAR), 'arc:' || (k % 30), 'place ' || (k % 30), 1.5, 25.0, NULL FROM e),
g AS (SELECT h, p, arg_max(name, (revision, coalesce(seen, 0), name)) FILTER (name IS NOT NULL) AS name, arg_max(lat, (revision, coalesce(seen, 0))) FILTER (name IS NOT NULL) AS lat, count(seen) AS n, min(seen) AS lo, max(seen) AS hi FROM w GROUP BY h, p)
SELECT h AS history_id, p AS poi_id, n AS "visitCount", lo AS first_seen_ts, hi AS last_seen_ts FROM g WHERE name IS NOT NULL""")
def poi_visits(spark, sf_dir):
    e = observations(spark, sf_dir).withColumnRenamed("kind", "told").withColumn("history_id", F.col("history").cast("string"))
    refs = importer._reference(
        e, kind=F.lit("stay"), start_ts=F.col("ts"), place_key=F.concat(F.lit("arc:"), (F.col("k") % 20).cast("string")), poi_name=F.when(F.col("id") % 3 > 0, F.col("told")), lat=F.col("id") / 1000.0, lon=F.lit(0.0), revision=F.col("k"), source=F.lit("arc"), ref=F.col("id"),
    )
    own = (F.col("k") % 30).cast("string")
    none = lambda t: F.lit(None).cast(t)
    places = e.select("history_id", own.alias("place_id"), F.concat(F.lit("place "), own).alias("name"), F.lit(1.5).alias("lat"), F.lit(0.0).alias("lon"), none("double").alias("radius_m"), none("string").alias("category"), none("string").alias("thoroughfare"), F.lit(25.0).alias("revision")).distinct()
    return importer.pois_of(refs, places).select("history_id", "poi_id", "visitCount", "first_seen_ts", "last_seen_ts")


@query(f"""WITH {E}, v AS (SELECT history AS h, id, ts AS s, ts + 3600 + k * 1200 AS t, id * 7919 % 1000003 AS q FROM e),
b AS (SELECT DISTINCT h, x FROM (SELECT h, s AS x FROM v UNION ALL SELECT h, t FROM v)), g AS (SELECT h, x AS a, lead(x) OVER (PARTITION BY h ORDER BY x) AS b FROM b),
o AS (SELECT g.h, g.a, g.b, arg_max(v.id, v.q) AS id FROM g JOIN v ON v.h = g.h AND v.s <= g.a AND v.t >= g.b GROUP BY 1, 2, 3),
i AS (SELECT *, CASE WHEN lag(id) OVER w = id AND lag(b) OVER w = a THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY h ORDER BY a)), n AS (SELECT *, sum(new) OVER (PARTITION BY h ORDER BY a) AS piece FROM i)
SELECT CAST(h AS VARCHAR) AS history_id, id, CAST(min(a) AS DOUBLE) AS start_ts, CAST(max(b) AS DOUBLE) AS end_ts FROM n GROUP BY h, id, piece""")
def sweep_owners(spark, sf_dir):
    """Moves of one source with qualities of their own: each second belongs to the best of those that cover it."""
    return timeline.sweep(_moves(spark, sf_dir)).select("history_id", "id", "start_ts", "end_ts")


def _moves(spark, sf_dir):
    none = lambda t: F.lit(None).cast(t)
    return observations(spark, sf_dir).select(
        F.col("history").cast("string").alias("history_id"), "id", F.lit("move").alias("kind"), F.col("ts").cast("double").alias("start_ts"), (F.col("ts") + 3600 + F.col("k") * 1200).cast("double").alias("end_ts"), (F.col("id") * 7919 % 1_000_003).cast("int").alias("quality"), F.lit(False).alias("manual"), F.lit(0.0).alias("revision"),
        F.lit("arc").alias("source"), none("double").alias("lat"), none("double").alias("lon"), none("double").alias("radius_m"),
    )


@query(f"""WITH {E}, v AS (SELECT history AS h, id, ts // 60 * 60 - CASE WHEN history % 2 = 0 THEN 315360000 ELSE 0 END AS s, 3600 + k * 1200 AS d, id * 7919 % 1000003 AS q, id % 7 = 0 AS manual, id % 2 = 0 AS of_day FROM e), w AS (SELECT *, s + d AS t FROM v),
b AS (SELECT DISTINCT h, x FROM (SELECT h, s AS x FROM w UNION ALL SELECT h, t FROM w)), g AS (SELECT h, x AS a, lead(x) OVER (PARTITION BY h ORDER BY x) AS b FROM b),
o AS (SELECT g.h, g.a, g.b, arg_max(w.id, (g.h % 2 = 0 AND w.of_day, w.manual, w.q)) AS id FROM g JOIN w ON w.h = g.h AND w.s <= g.a AND w.t >= g.b GROUP BY 1, 2, 3),
i AS (SELECT *, CASE WHEN lag(id) OVER w = id AND lag(b) OVER w = a THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY h ORDER BY a)), n AS (SELECT *, sum(new) OVER (PARTITION BY h ORDER BY a) AS piece FROM i)
SELECT CAST(h AS VARCHAR) AS history_id, id, CAST(min(a) AS DOUBLE) AS start_ts, CAST(max(b) AS DOUBLE) AS end_ts FROM n GROUP BY h, id, piece""")
def sweep_dialects(spark, sf_dir):
    """Moves of both dialects, some manual: before the cut-off that of a day counts, after it the manual one, then the better one."""
    moves = _moves(spark, sf_dir)
    shift = F.when(F.col("history_id").cast("bigint") % 2 == 0, 315_360_000).otherwise(0)
    start = F.floor(F.col("start_ts") / 60) * 60 - shift
    lasts = F.col("end_ts") - F.col("start_ts")
    told = moves.withColumn("lasts", lasts).withColumn("start_ts", start.cast("double")).withColumn("end_ts", F.col("start_ts") + F.col("lasts")).drop("lasts")
    told = told.withColumn("manual", F.col("id") % 7 == 0).withColumn("source", F.when(F.col("id") % 2 == 0, "moves").otherwise("arc"))
    return timeline.sweep(told).select("history_id", "id", "start_ts", "end_ts")


@query(f"""WITH {I}, t AS (SELECT *, CASE WHEN id % 3 > 0 THEN 'stay' ELSE 'move' END AS part FROM i), n AS (SELECT *, lead(part) OVER w AS next, lead(start_ts) OVER w AS s FROM t WINDOW w AS (PARTITION BY history ORDER BY start_ts, id))
SELECT CAST(history AS VARCHAR) AS history_id, end_ts AS start_ts, s AS end_ts FROM n WHERE part = 'stay' AND next = 'stay' AND s > end_ts""")
def gaps_between_stays(spark, sf_dir):
    told = half_hours(spark, sf_dir).select(F.col("history").cast("string").alias("history_id"), "id", F.lit(0).alias("part"), F.when(F.col("id") % 3 > 0, "stay").otherwise("move").alias("kind"), "start_ts", "end_ts")
    return timeline.filled_gaps(told)


@query(ORACLE_SQL["sweep_owners"])
def timeline_changes(spark, sf_dir):
    """As ``sweep_owners``, by changes: all moves but some, others longer than they are, and some that go; then three sets of changes that put that right."""
    right = _moves(spark, sf_dir)
    part = F.col("id") % 5
    wrong = right.where(part != 0).withColumn("end_ts", F.when(part == 1, F.col("end_ts") + 5000).otherwise(F.col("end_ts")))
    extra = right.where(part == 2).withColumn("id", -F.col("id") - 1)
    kept = Timeline(Store(spark, scratch(spark)), 8)
    kept.start(wrong.unionByName(extra))
    for change, rows in (("insert", right.where(part == 0)), ("update", right.where(part == 1)), ("delete", extra)):
        kept.apply(rows.withColumn("_change", F.lit(change)))
    return kept.read().select("history_id", "id", "start_ts", "end_ts")

