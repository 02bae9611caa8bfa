"""Operators on small cases that the tables don't hold."""

from chronofold.operators import evidence, intervals, pedometer, windows
from chronofold.plans import views


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tombstones(spark):
    live = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("b", None), ("c", 9.0)], "id string, revision double")
    dead = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("c", None)], "id string, revision double")
    assert rows(evidence.without_deleted(live, dead, ["id"])) == [("a", 3.0), ("b", None)]


def test_fields_fill_in_order_of_rank(spark):
    df = spark.createDataFrame([(1, 3, None), (1, 2, "A"), (1, 1, "B")], "k int, q int, altitude string")
    assert rows(evidence.merged(df, ["k"], {"x": ["altitude"]}, {"x": ["q"]})) == [(1, "A")]


def test_twins_with_null_places(spark):
    df = spark.createDataFrame([("i", 1, None, None), (None, 1, None, "walk"), (None, 2, 5.0, "run")], "id string, ts int, lat double, act string")
    out = evidence.absorb_twins(df, "id", ["ts", "lat"], ["act"], {"act": ["act"]})
    assert rows(out) == [("i", 1, None, "walk"), (None, 2, 5.0, "run")]


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101)]
    out = {r.node: r.component for r in evidence.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert out == {k: 0 for k in range(31)} | {100: 100, 101: 100}


def test_ambiguous_places_are_none(spark):
    points = spark.createDataFrame([("h", 1, 0.0, 0.0, 10.0), ("h", 2, 10.0, 0.0, 10.0)], "h string, point_id int, lat double, lon double, radius_m double")
    places = spark.createDataFrame([("h", 1, 0.0002, 0.0, 60.0), ("h", 2, -0.0003, 0.0, 60.0), ("h", 3, 10.0001, 0.0, 60.0)], "h string, place_id int, place_lat double, place_lon double, place_radius_m double")
    assert [r[1:3] for r in rows(intervals.nearest_unambiguous(points, places, ["h"]))] == [(2, 3)]


def test_capped_windows(spark):
    df = spark.createDataFrame([("h", 600 * k, k) for k in range(40)] + [("h", 999_999, 99)], "h string, ts bigint, id int")
    out = [(r.start_ts, r.n) for r in windows.observation_windows(df, ["h"], "ts", "id").orderBy("start_ts").collect()]
    assert out == [(0, 36), (21_600, 4)]


def test_plausible_steps(spark):
    df = spark.createDataFrame([(0, 100, None, 0), (60, 200, 200.0, 0), (120, 300, 3000.0, 0)], "ts bigint, steps_delta int, distance_m double, tz_offset_s int")
    for grain in views.GRAINS:
        assert rows(views.pedometer_stats(df, grain).select("total_steps", "total_distance_m")) == [(600, 200.0)]


def test_pedometer_sides(spark):
    rest = [c for c in pedometer.SCHEMA.split(", ") if c.split()[0] not in ("claim_id", "day_key", "source", "start", "end", "steps", "distance", "manual", "history_id")]
    schema = "claim_id int, day_key bigint, source string, start bigint, end bigint, steps bigint, distance double, manual boolean"
    claims = [(1, 1, "arc", 0, 1000, 10, None, False), (2, 1, "moves", 0, 1000, 12, 9.0, False), (3, 1, "arc", 5000, 6000, 7, None, False)]
    df = spark.createDataFrame(claims, schema).selectExpr("*", "'h' as history_id", *(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in rest))
    assert sorted(r.claim_id for r in pedometer.chosen_side(df).collect()) == [2, 3]


def test_enriched_events(spark):
    stays = spark.createDataFrame([(1, 0.0, 10.0, 1.0, 2.0, 30.0, "anchor", 7, 3600, None)], "id int, start_ts double, end_ts double, centroid_lat double, centroid_lon double, radius_m double, type string, poi_id int, tz_offset_s int, end_tz_offset_s int")
    moves = spark.createDataFrame([(1, 10.0, 20.0, "walk", 5.0, None, None)], "id int, start_ts double, end_ts double, mode string, distance_m double, tz_offset_s int, end_tz_offset_s int")
    gaps = spark.createDataFrame([(1, 20.0, 30.0, "Unknown", None, "n", 60, 60)], "id int, start_ts double, end_ts double, reason string, uncertainty double, notes string, tz_offset_s int, end_tz_offset_s int")
    pois = spark.createDataFrame([(7, "home", "c", None, 1.0, 2.0)], "id int, name string, category string, subcategory string, lat double, lon double")
    out = views.enriched_events(views.timeline_events(stays, moves, gaps), stays, pois, moves, gaps).orderBy("start_ts").collect()
    assert [(r.kind, r.poi_name, r.mode, r.notes, r.tz_offset_s) for r in out] == [("stay", "home", None, None, 3600), ("move", None, "walk", None, None), ("gap", None, None, "n", 60)]


def test_rows_without_a_key_are_not_dealt_to_one_task(spark):
    from pyspark.sql import functions as F

    from chronofold.plans import views

    none = F.lit(None)
    own = lambda k, *c: spark.range(k).select("id", F.col("id").alias("start_ts"), (F.col("id") + 1).alias("end_ts"), none.cast("int").alias("tz_offset_s"), none.cast("int").alias("end_tz_offset_s"), *(F.lit(1).alias(x) for x in c))
    stays, moves, gaps = own(50, "poi_id", "centroid_lat", "centroid_lon", "radius_m", "type"), own(4000, "mode", "distance_m"), own(50, "reason", "uncertainty", "notes")
    pois = spark.range(3).select("id", *(F.lit(f"p{x}").alias(x) for x in ("name", "category", "subcategory", "lat", "lon")))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = views.enriched_events(views.timeline_events(stays, moves, gaps), stays, pois, moves, gaps)
        rows = out.select("kind", "poi_name", "mode", "reason", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(rows) == 4100
    assert all((r.poi_name == "pname") == (r.kind == "stay") and (r.mode == 1) == (r.kind == "move") and (r.reason == 1) == (r.kind == "gap") for r in rows)
    assert max(sum(r.at == at for r in rows) for at in {r.at for r in rows}) < 2500
