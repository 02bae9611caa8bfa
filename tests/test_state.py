"""Streams with state, and timelines and totals that follow changes, against the same over all rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import frames as batch_frames
from chronofold.operators import timeline, windows
from chronofold.plans.incremental import Timeline
from chronofold.plans.store import Store
from chronofold.streaming import frames, state

DAY = datetime.datetime(2024, 5, 1)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_windows_equal_those_of_a_batch(spark, tmp_path):
    """Any order within the watermark, a window of more than six hours, single rows, equal times, and a restart after each batch."""
    rng = random.Random(2)
    rows = []
    for key in ("a", "b", None):
        t = 0
        for _ in range(150):
            t += rng.choice([0, 1, 30, 300, 599, 600, 601, 900, 3000])
            rows.append((key, t))
    rows += [("long", 500 * k) for k in range(100)]
    rows = sorted(rows, key=lambda r: r[1])
    late = 3600
    batches = [[r for r in rows if at <= r[1] < at + 7000] for at in range(0, rows[-1][1] + 1, 7000)]
    for k, batch in enumerate(batches[:-1]):  # some rows come a batch later, within the watermark
        for r in [r for r in batch if r[1] > max(x[1] for x in batch) - late + 60 and rng.random() < 0.3]:
            batch.remove(r)
            batches[k + 1].append(r)
    batches.append([("z", rows[-1][1] + 100_000)])
    batches.append([("z", rows[-1][1] + 200_000)])
    schema = "k string, ts timestamp"
    stamp = lambda b: [(k, DAY + datetime.timedelta(seconds=s)) for k, s in b]
    for b in batches:
        rng.shuffle(b)
        feed(spark, tmp_path / "in", stamp(b), schema)
        out = state.capped_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "ts", f"{late} seconds")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("k", "start_ts", "end_ts", "n").collect()), key=repr)
    every = spark.createDataFrame(stamp([r for b in batches for r in b]), schema).withColumn("s", F.unix_seconds("ts")).withColumn("tie", F.lit(0))
    want = sorted((tuple(r) for r in windows.observation_windows(every, ["k"], "s", "tie").select("k", "start_ts", "end_ts", "n").collect()), key=repr)
    assert got == want and len(want) > 20
    assert max(r[2] - r[1] for r in want if r[0] == "long") <= windows.CAP_S


def test_revisions_as_changes(spark, tmp_path):
    from chronofold.streaming.latest import _winners

    rng = random.Random(6)
    schema = "id int, revision int, x string, deleted boolean"
    rows = [(rng.randrange(12), rng.choice([None, *range(9)]), f"x{k}", rng.choice([False, False, False, True, None])) for k in range(70)]
    for k in range(0, 70, 18):
        feed(spark, tmp_path / "in", rows[k : k + 18], schema)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        state.keep_current(stream, ["id"], ["revision", "x"], str(tmp_path / "out"), str(tmp_path / "c"), "deleted", 4).awaitTermination()
    store = Store(spark, str(tmp_path / "out"))
    won = _winners(spark.createDataFrame(rows, schema), ["id"], ["revision", "x"], "deleted").where("not coalesce(deleted, false)")
    assert sorted(map(tuple, store.read("current").collect())) == sorted(map(tuple, won.collect()))
    last = store.manifest()
    assert len(store.versions()) == 4
    again = won.withColumn("_change", F.lit("delete"))
    assert not state.apply_changes(store, again, ["id"], last["about"]["batch of current"], 4) and len(store.versions()) == 4


def some_events(rng, n, history=("h1", "h2")):
    rows = []
    for k in range(n):
        start = float(rng.randrange(0, 40 * 86_400, 600))
        kind = rng.choice(["stay", "move", "gap"])
        place = (50.0 + rng.randrange(4) / 100, 10.0) if kind == "stay" else (None, None)
        rows.append((rng.choice(history), k, kind, start, rng.choice([start + rng.randrange(60, 30_000), start + 600, start - 1]), rng.randrange(12), rng.random() < 0.1, float(rng.randrange(5)), rng.choice(["arc", "moves"]), *place, 50.0))
    return rows


EVENT = "history_id string, id long, kind string, start_ts double, end_ts double, quality int, manual boolean, revision double, source string, lat double, lon double, radius_m double"
SHOWN = ["history_id", "id", "part", "kind", "start_ts", "end_ts", "quality", "place_from", "absorbed"]


def test_a_timeline_follows_changes(spark, tmp_path):
    """Insertions, updates and deletions, one set after another, equal one sweep of what there is at the end, and touch few islands."""
    rng = random.Random(11)
    held = {(r[0], r[1]): r for r in some_events(rng, 120)}
    t = Timeline(Store(spark, str(tmp_path)), 4)
    t.start(spark.createDataFrame(list(held.values()), EVENT))
    show = lambda df: sorted((tuple(r) for r in df.select(*SHOWN).collect()), key=repr)
    for step in range(4):
        changes = []
        for k in range(rng.choice([1, 3])):
            old = rng.choice(sorted(held))
            new = some_events(rng, 1, (old[0],))[0]
            kind = rng.choice(["insert", "update", "delete"])
            row = (old[0], 1000 + step * 10 + k if kind == "insert" else old[1], *new[2:])
            if (row[0], row[1]) in {(c[1], c[2]) for c in changes}:
                continue
            changes.append((kind, *row))
            held.pop((row[0], row[1]), None)
            if kind != "delete":
                held[row[0], row[1]] = row
        total = t.read("islands").count()
        swept = t.apply(spark.createDataFrame(changes, f"_change string, {EVENT}"))
        assert swept <= 9 * len(changes) and swept < total
        assert show(t.read()) == show(timeline.sweep(spark.createDataFrame(list(held.values()), EVENT)))
    assert t.apply(spark.createDataFrame([("delete", "h1", 99_999, *some_events(rng, 1)[0][2:])], f"_change string, {EVENT}")) <= 3


def test_one_change_touches_its_island_and_those_beside(spark, tmp_path):
    rows = [("h", k, "move", k * 10_000.0, k * 10_000.0 + 600, 1, False, 0.0, "arc", None, None, 50.0) for k in range(60)]
    t = Timeline(Store(spark, str(tmp_path)), 2)
    t.start(spark.createDataFrame(rows, EVENT))
    assert t.read("islands").count() == 60
    assert t.apply(spark.createDataFrame([("update", *rows[30][:4], rows[30][4] + 60, *rows[30][5:])], f"_change string, {EVENT}")) <= 5
    assert t.apply(spark.createDataFrame([("insert", "h", 900, "move", 105_000.0, 105_060.0, 1, False, 0.0, "arc", None, None, 50.0)], f"_change string, {EVENT}")) <= 3
    assert t.read().count() == 61 and t.read("islands").count() == 61
    assert t.apply(spark.createDataFrame([("delete", *rows[30])], f"_change string, {EVENT}")) <= 5
    assert t.read().count() == 60 and t.read("timeline", 1).count() == 60


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_follow_frames(spark, tmp_path, seed):
    """Late and repeated batches, as one pass over all frames."""
    rng = random.Random(seed)
    schema = "stream_id int, id int, ts_start long, ts_end long, bbox_min_lat double, bbox_min_lon double, bbox_max_lat double, bbox_max_lon double"
    rows = [(rng.randrange(5), k, rng.choice([None, k * 100]), rng.choice([None, k * 100 + 300]), *(x := sorted(rng.uniform(-80, 80) for _ in range(4)))) for k in range(120)]
    rng.shuffle(rows)
    tiles = spark.createDataFrame([(k, k * 1000, k * 1000 + rng.randrange(1, 5000)) for k in range(12)], "id int, period_start long, period_end long")
    store = Store(spark, str(tmp_path))
    batches = [spark.createDataFrame(rows[k : k + 40], schema) for k in range(0, 120, 40)]
    assert [frames.fold_frames(store, b, n, tiles, buckets=3) for n, b in [(0, batches[0]), (0, batches[0]), (1, batches[1]), (2, batches[2]), (1, batches[1]), (2, batches[2])]] == [True, False, True, True, False, False]
    every = spark.createDataFrame(rows, schema)
    want = batch_frames.stream_totals(every)
    assert sorted(map(tuple, frames.totals(store).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    got = store.read("invalidations").select("frame_id", "tileset_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch_frames.stale_tiles(every, tiles).select("frame_id", "tileset_id").collect()))


def test_totals_of_a_stream(spark, tmp_path):
    schema = "stream_id int, id int, ts_start long, ts_end long, bbox_min_lat double, bbox_min_lon double, bbox_max_lat double, bbox_max_lon double"
    for k in range(3):
        feed(spark, tmp_path / "in", [(1, 10 - k, 1000 - k, 1000 + k, 0.0 - k, 0.0, 1.0 + k, 1.0)], schema)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        frames.keep_totals(spark, stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert tuple(frames.totals(Store(spark, str(tmp_path / "out"))).first()) == (1, 3, 998, 1002, -2.0, 0.0, 3.0, 1.0)
