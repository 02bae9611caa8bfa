"""Interval and spatial joins against brute force, and what they expand to."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronofold.functions.scalars import EARTH_M
from chronofold.operators import intervals, spatial

YEARS_8000 = 8000 * 365 * 86_400


@pytest.fixture(scope="module")
def spans():
    """Intervals of all lengths, over boundaries of large cells too, some open to the year 9999."""
    rng = random.Random(3)
    rows = []
    for k in range(160):
        at = rng.choice([0, 2**30, 2**31 - 50, 86_400 * 512, rng.randrange(2**31)]) + rng.randrange(-200_000, 200_000)
        rows.append((rng.choice(["x", "y"]), k, at, at + rng.choice([1, 60, 3600, 90_000, 10**6, 10**8, rng.randrange(1, 300_000)])))
    return [*rows, ("x", 900, 10**9, 10**9 + YEARS_8000), ("y", 901, 0, YEARS_8000), ("x", 902, None, 5)]


def test_overlaps_equal_those_of_all_pairs(spark, spans):
    a = spark.createDataFrame(spans[::2], "h string, a_id int, a_start long, a_end long")
    b = spark.createDataFrame(spans[1::2] + spans[-2:], "h string, b_id int, b_start long, b_end long")
    got = sorted((r.a_id, r.b_id, r.overlap_s) for r in intervals.overlap_join(a, b, ["h"]).collect())
    want = [(i, j, min(t, u) - max(s, v)) for h, i, s, t in spans[::2] for g, j, v, u in spans[1::2] + spans[-2:] if h == g and None not in (s, v) and s < u and v < t]
    assert got == sorted(want) and len(want) > 300


def test_points_and_touching_equal_brute_force(spark, spans):
    rng = random.Random(5)
    points = [(rng.choice(["x", "y"]), k, rng.choice(spans[:-1])[rng.choice([2, 3])] + rng.choice([-1, 0, 1])) for k in range(300)]
    held = spark.createDataFrame(spans, "h string, id int, start_ts long, end_ts long")
    at = spark.createDataFrame(points, "h string, p int, ts long")
    for closed in (False, True):
        got = sorted((r.id, r.p) for r in intervals.points_in(held, at, ["h"], "ts", closed).select("id", "p").collect())
        assert got == sorted((i, p) for h, i, s, t in spans for g, p, ts in points if h == g and s is not None and s <= ts and (ts < t or closed and ts == t))
    others = spark.createDataFrame(spans[::7], "h string, id int, start_ts long, end_ts long")
    got = sorted(r.id for r in intervals.touching(held, others, ["h"]).collect())
    assert got == sorted(i for h, i, s, t in spans if any(h == g and None not in (s, v) and s < u and v < t for g, _, v, u in spans[::7]))


def test_a_long_interval_takes_a_few_cells(spark):
    rows = [(k * 1000, k * 1000 + 500 * 2 ** (k % 30)) for k in range(120)] + [(10**9 + 17, 10**9 + 17 + YEARS_8000)]
    df = spark.createDataFrame(rows, "s long, e long")
    ends = (F.col("s"), F.col("e"))
    cells = intervals.in_cells(df, *ends)
    per = cells.groupBy("s", "e").count().agg(F.max("count")).first()[0]
    assert per <= 10
    assert cells.where(f"e - s = {YEARS_8000}").count() <= 4


def metres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(s)))


@pytest.mark.parametrize("where", ["city", "date line", "pole", "globe"])
def test_nearest_places_equal_those_of_all_pairs(spark, where):
    rng = random.Random(where)
    lat, lon = {"city": (52.5, 13.4), "date line": (-16.8, 180.0), "pole": (89.999, 0.0), "globe": (0.0, 0.0)}[where]
    wide = 60.0 if where == "globe" else 0.004
    wrap = lambda x: (x + 180) % 360 - 180
    spot = lambda: (min(90.0, lat + rng.uniform(-wide, wide)), wrap(rng.uniform(-180, 180) if where == "pole" else lon + rng.uniform(-wide, wide) * (3 if where == "globe" else 1)))
    radius = lambda: rng.choice([None, 10.0, 80.0, 500.0, 2_000_000.0 if where == "globe" else 3000.0])
    points = [("h", k, *spot(), radius()) for k in range(150)]
    places = [("h", f"p{k}", *spot(), radius()) for k in range(120)]
    near = intervals.nearest_unambiguous(spark.createDataFrame(points, "h string, point_id int, lat double, lon double, radius_m double"), spark.createDataFrame(places, "h string, place_id string, place_lat double, place_lon double, place_radius_m double"), ["h"])
    got = {r.point_id: r.place_id for r in near.collect()}
    want = {}
    for _, i, a, b, r in points:
        found = sorted((metres(a, b, c, d), p) for _, p, c, d, s in places if metres(a, b, c, d) <= max(50, (r or 0) + (s or 0)))
        if found and (len(found) == 1 or found[1][0] - found[0][0] >= 25):
            want[i] = found[0][1]
    assert got == want and len(want) > 5


def test_many_at_one_position_are_two_places_and_one_point(spark):
    """Places and points that share positions, of several radii: as all pairs say, from two places a position."""
    rng = random.Random(4)
    spots = [(52.5 + rng.uniform(-0.003, 0.003), 13.4 + rng.uniform(-0.003, 0.003)) for _ in range(30)]
    places = [("h", f"p{k}", *rng.choice(spots[:12]), rng.choice([None, 20.0, 90.0, 200.0])) for k in range(20)] + [("h", f"q{k}", *spots[12], 30.0) for k in range(500)]
    places += [places[0], ("h", "p1", *places[1][2:4], 400.0)]
    points = [("h", k, *rng.choice(spots), rng.choice([None, 10.0, 60.0, 150.0])) for k in range(400)]
    right = spark.createDataFrame(places, "h string, place_id string, place_lat double, place_lon double, place_radius_m double")
    near = intervals.nearest_unambiguous(spark.createDataFrame([*points, points[0]], "h string, point_id int, lat double, lon double, radius_m double"), right, ["h"]).collect()
    want = {}
    for _, i, a, b, r in points:
        nearest = {}
        for _, p, c, d, s in places:
            if metres(a, b, c, d) <= max(50, (r or 0) + (s or 0)):
                nearest[p] = metres(a, b, c, d)
        found = sorted((m, p) for p, m in nearest.items())
        if found and (len(found) == 1 or found[1][0] - found[0][0] >= 25):
            want[i] = found[0][1]
    assert {r.point_id: r.place_id for r in near} == want and len(want) == len(near) > 5
    assert intervals.widest(right, ["h"]).count() <= 26


def test_cells_tell_longitudes_apart(spark):
    """Places around the globe at one latitude: each point meets those near it alone."""
    places = spark.range(3600).select(F.col("id").alias("place_id"), F.lit(48.0).alias("place_lat"), (F.col("id") / 10 - 180).alias("place_lon"), F.lit(None).cast("double").alias("place_radius_m"))
    points = spark.range(3600).select(F.col("id").alias("point_id"), F.lit(48.0001).alias("lat"), (F.col("id") / 10 - 180).alias("lon"), F.lit(10.0).alias("radius_m"))
    a = spatial.in_cells(points, "lat", "lon", F.col("radius_m")).where("_level = 0")
    b = spatial.in_cells(places, "place_lat", "place_lon", F.lit(50.0))
    assert a.join(b, ["_level", "_band", "_part"]).select("point_id", "place_id").distinct().count() < 2 * 3600
    assert intervals.nearest_unambiguous(points.withColumn("h", F.lit(1)), places.withColumn("h", F.lit(1)), ["h"]).where("point_id = place_id").count() == 3600


def test_boxes_skip_files(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(1)
    rows = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(20_000)]
    spatial.write_by_place(spark.createDataFrame(rows, "id int, lat double, lon double"), str(tmp_path / "t"), "lat", "lon", 64)
    boxes = [(10, 20, 15, 28), (-40, 170, -30, -170), (80, -180, 90, 180)]
    table = spark.read.parquet(str(tmp_path / "t"))
    for south, west, north, east in boxes:
        inside = lambda x, west=west, east=east: west <= x <= east if west <= east else x >= west or x <= east
        got = spatial.within_box(table, "lat", "lon", south, west, north, east)
        assert {r.id for r in got.collect()} == {k for k, a, b in rows if south <= a <= north and inside(b)}
        read = touched = 0
        for f in (tmp_path / "t").glob("*.parquet"):
            group = pq.ParquetFile(f).metadata.row_group(0)
            stats = [group.column(c).statistics for c in (1, 2)]
            spans = [(west, east)] if west <= east else [(west, 180), (-180, east)]
            read += stats[0].min <= north and stats[0].max >= south and any(stats[1].min <= e and stats[1].max >= w for w, e in spans)
            touched += 1
        assert touched >= 50 and read <= touched / 4
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters" in plan and "GreaterThanOrEqual(lat" in plan


def test_the_curve_keeps_order_within_a_half(spark):
    df = spark.createDataFrame([(-90.0, -180.0), (90.0, 180.0), (0.0, 0.0), (-1e-9, 0.0), (None, 1.0)], "lat double, lon double")
    keys = [r[0] for r in df.select(spatial.curve_key("lat", "lon", 2)).collect()]
    assert keys == [0, 15, 12, 6, None]
