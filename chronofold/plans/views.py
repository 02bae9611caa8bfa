"""The analytical views over a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.scalars import local_date

# Fixed values.
MIN_M_PER_STEP, MAX_M_PER_STEP = 0.3, 2.5
GRAINS = {"day": {"date": "yyyy-MM-dd"}, "hour": {"date": "yyyy-MM-dd", "hour": "HH"}, "month": {"month": "yyyy-MM"}}


def daily_activity_stats(moves: DataFrame) -> DataFrame:
    """Distance and duration by local day and mode, of moves that have ended."""
    ended = moves.where("end_ts is not null")
    day = local_date("start_ts", "tz_offset_s").alias("date")
    return ended.groupBy(day, "mode").agg(F.sum(F.coalesce("distance_m", F.lit(0.0))).alias("total_distance_m"), F.sum(F.col("end_ts") - F.col("start_ts")).cast("double").alias("total_duration_s"))


def pedometer_stats(steps: DataFrame, grain: str = "day") -> DataFrame:
    """Steps, and the distance of rows with a plausible length of step, by local day, hour or month."""
    per_step = F.when(F.col("steps_delta") > 0, F.col("distance_m") / F.col("steps_delta"))
    plausible = per_step.between(MIN_M_PER_STEP, MAX_M_PER_STEP)
    when = [local_date("ts", "tz_offset_s", pattern).alias(name) for name, pattern in GRAINS[grain].items()]
    return steps.groupBy(*when).agg(F.sum(F.coalesce("steps_delta", F.lit(0))).cast("bigint").alias("total_steps"), F.sum(F.when(plausible, F.col("distance_m"))).alias("total_distance_m"))


def timeline_events(stays: DataFrame, moves: DataFrame, gaps: DataFrame) -> DataFrame:
    """The union of all kinds; each event refers to one row of its own table."""
    part = lambda df, kind, ref: df.select(F.lit(kind).alias("kind"), "start_ts", "end_ts", F.col("id").alias(ref))
    out = part(stays, "stay", "stay_id").unionByName(part(moves, "move", "move_id"), True).unionByName(part(gaps, "gap", "gap_id"), True)
    return out.select("kind", "start_ts", "end_ts", "stay_id", "move_id", "gap_id")


#: How many tasks rows without a key may go to in a join that keeps them.
SPREAD = 4096


def _with_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """A left join by a key that most rows don't have: these are spread by what they are, and not dealt to one task."""
    apart = F.when(F.col(key).isNull(), F.pmod(F.xxhash64("stay_id", "move_id", "gap_id", "start_ts"), F.lit(SPREAD))).otherwise(F.lit(0))
    none = F.pmod(F.xxhash64(key), F.lit(1))  # 0, but no literal: with one, rows would be dealt by the key alone
    return rows.withColumn("_apart", apart).join(known.withColumn("_apart", none), [key, "_apart"], "left").drop("_apart")


def enriched_events(events: DataFrame, stays: DataFrame, pois: DataFrame, moves: DataFrame, gaps: DataFrame) -> DataFrame:
    """Events with what their own tables and the places know; the offsets come from whichever row there is."""
    s = stays.select(F.col("id").alias("stay_id"), "poi_id", "centroid_lat", "centroid_lon", "radius_m", F.col("type").alias("stay_type"), F.col("tz_offset_s").alias("_s0"), F.col("end_tz_offset_s").alias("_s1"))
    p = pois.select(F.col("id").alias("poi_id"), F.col("name").alias("poi_name"), "category", "subcategory", F.col("lat").alias("poi_lat"), F.col("lon").alias("poi_lon"))
    m = moves.select(F.col("id").alias("move_id"), "mode", "distance_m", F.col("tz_offset_s").alias("_m0"), F.col("end_tz_offset_s").alias("_m1"))
    g = gaps.select(F.col("id").alias("gap_id"), "reason", "uncertainty", "notes", F.col("tz_offset_s").alias("_g0"), F.col("end_tz_offset_s").alias("_g1"))
    out = events
    for known, key in ((s, "stay_id"), (p, "poi_id"), (m, "move_id"), (g, "gap_id")):
        out = _with_known(out, known, key)
    offsets = [F.coalesce(*(f"_{x}{k}" for x in "smg")).alias(name) for k, name in ((0, "tz_offset_s"), (1, "end_tz_offset_s"))]
    return out.select("kind", "start_ts", "end_ts", "stay_id", "move_id", "gap_id", "poi_id", "poi_name", "category", "subcategory", "poi_lat", "poi_lon", "centroid_lat", "centroid_lon", "radius_m", "stay_type", "mode", "distance_m", "reason", "uncertainty", "notes", *offsets)


def top_diagnostics(messages: DataFrame, message: str, order: str, most: int = 20) -> DataFrame:
    """The most frequent messages, of equals the first seen, with ``(n times)`` after those that came again."""
    n = messages.groupBy(message).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    text = F.when(F.col("n") > 1, F.concat(message, F.lit(" ("), F.col("n").cast("string"), F.lit(" times)"))).otherwise(F.col(message))
    return n.orderBy(F.desc("n"), "first_seen").limit(most).select(text.alias("diagnostic"), "n", "first_seen")


def report(stays: DataFrame, moves: DataFrame, gaps: DataFrame, pois: DataFrame) -> DataFrame:
    """Counts and the range of time, in one row."""
    events = timeline_events(stays, moves, gaps)
    kinds = events.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("stay", "move", "gap")), F.min("start_ts").alias("first_ts"), F.max(F.coalesce("end_ts", "start_ts")).alias("last_ts"))
    return kinds.crossJoin(pois.agg(F.count("*").alias("n_pois")))
