import datetime
import random

from pyspark.sql import functions as F

from chronofold.operators import evidence, intervals, pedometer
from chronofold.plans import queries

EPOCH = datetime.datetime(2024, 3, 1)


def events(spark, folder, rows):
    """(history, id, seconds, kind) rows as the table of events in a folder."""
    full = [(u, i, EPOCH + datetime.timedelta(seconds=s), kind, 1.0 + i % 7, f'{{"k": {i % 50}}}') for u, i, s, kind in rows]
    spark.createDataFrame(full, "user_id long, event_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def smallest_reachable(edges):
    """node -> smallest reachable node, by merging sets."""
    sets = {}
    for a, b in edges:
        one = sets.get(a, {a}) | sets.get(b, {b})
        sets |= dict.fromkeys(one, one)
    return {x: min(s) for x, s in sets.items()}


def test_components_of_all_histories(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(60), i, rng.randrange(3 * 86400), rng.choice(["purchase", "signup", "view"])) for i in range(900)]
    edges = [(i, j) for u, i, s, _ in rows for v, j, t, _ in rows if v == u + 1 and u % 2 == 0 and s // 86400 == t // 86400 and 1800 - abs(s - t) >= 900]
    want = smallest_reachable(edges)
    assert len({u for u, i, _, _ in rows if i in want and u >= 20}) > 20
    got = queries.claim_components(spark, events(spark, tmp_path, rows)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_components_of_long_chains(spark):
    """Rounds go on until nothing changes, and keys keep graphs apart."""
    n = 300
    edges = spark.createDataFrame([(k, i, i + 1) for k in range(2) for i in range(n - k) if i != 150], "g int, a int, b int")
    got = evidence.components(edges, ["g"]).collect()
    assert {(r.g, r.node, r.component) for r in got} == {(k, i, 0 if i <= 150 else 151) for k in range(2) for i in range(n - k + 1)}


def claim(claim_id, source, start, end, **more):
    base = dict(history_id="h", claim_id=claim_id, source=source, kind="move", day_key=0, start=start, end=end, steps=100, distance=70.0, floors_up=None, floors_down=None, tz_offset_s=None, manual=False, sequence=None, mode="walk")
    return base | more


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in pedometer.COLUMNS) for r in rows], pedometer.SCHEMA)


def matched(a, b):
    if a["start"] is None or b["start"] is None:
        return abs(a["end"] - b["end"]) <= 90
    shared = max(0, min(a["end"], b["end"]) - max(a["start"], b["start"]))
    short = min(max(1, x["end"] - x["start"]) for x in (a, b))
    return shared / short >= 0.5 or abs(a["start"] - b["start"]) <= 90 and abs(a["end"] - b["end"]) <= 90


def test_matches_are_the_plain_ones(spark):
    """Claims without a start, without duration, at the borders of days, and equal ones."""
    rng = random.Random(6)

    def some(k, source):
        start = rng.choice([86_400, 172_800]) + rng.randint(-400, 400)
        return claim(k, source, rng.choice([None, start, start]), start + rng.choice([0, 0, 30, 200, 90_000]))

    rows = [some(k, rng.choice(["arc", "moves"])) for k in range(120)]
    a, b = ([r for r in rows if r["source"] == x] for x in ("arc", "moves"))
    frame = lambda rs, x: spark.createDataFrame([(r["claim_id"], r["start"], r["end"]) for r in rs], f"{x}_id long, {x}_start long, {x}_end long").selectExpr("1 as k", "*")
    got = [(r.a_id, r.b_id) for r in intervals.claim_matches(frame(a, "a"), frame(b, "b"), ["k"]).collect()]
    assert sorted(got) == sorted((x["claim_id"], y["claim_id"]) for x in a for y in b if matched(x, y))


def test_repeats_of_a_claim(spark):
    rows = [
        claim(1, "arc", 0, 600, sequence=0, kind="stay", mode=None, floors_up=2.0), claim(2, "arc", 600, 1200, sequence=1, floors_down=1.0),  # a stay and a move in a row: one, with the floors of both
        claim(3, "arc", 1280, 1300, sequence=2, steps=5), claim(4, "arc", 1380, 1500, sequence=3, steps=5), claim(5, "arc", 1700, 1800, sequence=4, steps=5),  # moves one after another: all
        claim(6, "arc", 2000, 2100, sequence=6, steps=9), claim(7, "arc", 2050, 2200, sequence=8, steps=9),  # overlap: one
        claim(8, "arc", 3000, 3100, sequence=9, steps=7, floors_up=1.0), claim(9, "arc", 3000, 3100, sequence=10, steps=7, floors_up=2.0),  # other floors: both
        claim(10, "arc", 3000, 3100, sequence=9, steps=7, history_id="other"),
    ]
    got = sorted((r.claim_id, r.floors_up, r.floors_down) for r in pedometer.without_repeats(table(spark, rows)).collect())
    assert got == [(2, 2.0, 1.0), (3, None, None), (4, None, None), (5, None, None), (7, None, None), (8, 1.0, None), (9, 2.0, None), (10, None, None)]


def test_sides_of_a_day(spark):
    late = 1_600_000_000
    rows = [
        claim(1, "arc", 0, 600, steps=50, floors_up=3.0), claim(2, "moves", 10, 600, steps=50, distance=None, manual=False),  # before the cut-off, equal steps: the day's, and the floors
        claim(3, "arc", late, late + 600, day_key=1), claim(4, "moves", late, late + 500, day_key=1, steps=90),  # the longer
        claim(5, "arc", late, late + 600, day_key=2), claim(6, "moves", late, late + 500, day_key=2, steps=90),  # the day adds up
        claim(7, "arc", late + 9000, late + 9100, day_key=1), claim(8, "moves", late + 20_000, late + 20_100, day_key=1),  # nothing to match
        claim(9, "arc", late, late + 600, day_key=1, history_id="other"),
    ]
    totals = spark.createDataFrame([("h", 2, 90.0), ("h", 1, 90.0)], "history_id string, day_key bigint, total double")
    got = sorted((r.claim_id, r.steps, r.distance) for r in pedometer.chosen_side(table(spark, rows), totals).collect())
    assert got == [(1, None, None), (2, 50, None), (3, 100, 70.0), (6, 90, 70.0), (7, 100, 70.0), (8, 100, 70.0), (9, 100, 70.0)]
    rows = pedometer.pedometer_rows(table(spark, [claim(1, "arc", 100, 700, day_key=5), claim(2, "moves", 100, 700, day_key=6, tz_offset_s=3600, steps=100), claim(3, "arc", 9000, 9100, steps=None)]))
    assert [tuple(r) for r in rows.collect()] == [("h", 700, 100, 70.0, None, None, 3600)]


def test_distances_of_likely_steps(spark):
    df = spark.createDataFrame([(100, 70.0, "walk"), (100, 70.0, "car"), (100, 29.0, "run"), (100, 250.0, "run"), (0, 5.0, "walk"), (100, None, "walk"), (None, 5.0, "walk"), (100, 70.0, None)], "s long, d double, m string")
    assert [r[0] for r in df.select(pedometer.plausible_distance(F.col("s"), F.col("d"), F.col("m"))).collect()] == [70.0, None, None, 250.0, None, None, None, None]


def test_touching_keeps_equal_rows(spark):
    a = spark.createDataFrame([(1, 0, 100_000), (1, 0, 100_000), (1, 200_000, 200_001), (2, 0, 5)], "k int, start_ts long, end_ts long")
    b = spark.createDataFrame([(1, 50, 60), (1, 90_000, 95_000), (2, 5, 6)], "k int, start_ts long, end_ts long")
    assert [tuple(r) for r in intervals.touching(a, b, ["k"]).collect()] == [(1, 0, 100_000)] * 2
