"""The sweep: invariants, scenarios, and islands against one pass."""

from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.operators import timeline as t

H = 3600.0


def stay(i, start, end, lat=0.0, **more):
    return t.Event(i, "stay", start, end, lat=lat, lon=0.0, **more)


def move(i, start, end, **more):
    return t.Event(i, "move", start, end, **more)


def spans(events):
    return [(e.kind, e.id, e.start, e.end) for e in events]


def test_a_better_move_cuts_a_stay_in_two():
    out = t.resolve([stay(1, 9 * H, 12 * H), move(2, 10 * H, 11 * H, quality=9)])
    assert spans(out) == [("stay", 1, 9 * H, 10 * H), ("move", 2, 10 * H, 11 * H), ("stay", 1, 11 * H, 12 * H)]
    assert [e.part for e in out] == [0, 0, 1]


def test_a_worse_event_is_shifted_or_dropped():
    out = t.resolve([stay(1, 0, 100, quality=9), move(2, 50, 150), move(3, 20, 80)])
    assert spans(out) == [("stay", 1, 0, 100), ("move", 2, 100, 150)]
    assert not out[1].geometry


def test_stays_at_one_place_merge_within_a_minute():
    assert spans(t.resolve([stay(1, 0, 100), stay(2, 159, 300)])) == [("stay", 1, 0, 300)]
    assert len(t.resolve([stay(1, 0, 100), stay(2, 160, 300)])) == 2
    assert len(t.resolve([stay(1, 0, 100), stay(2, 159, 300, lat=1.0)])) == 2


def test_gaps_merge_over_any_distance_and_moves_never():
    gap = lambda i, a, b: t.Event(i, "gap", a, b)
    assert spans(t.resolve([gap(1, 0, 600), gap(2, 1200, 1800)])) == [("gap", 1, 0, 1800)]
    assert len(t.resolve([move(1, 0, 10), move(2, 10, 20)])) == 2


def test_residuals_of_one_second_between_dialects_are_absorbed():
    out = t.resolve([move(1, 0, 100, source="moves", quality=9), move(2, 10, 101, source="arc")])
    assert spans(out) == [("move", 1, 0, 101)]
    out = t.resolve([move(1, 0, 100, source="moves", quality=9), move(2, 10, 102, source="arc")])
    assert spans(out) == [("move", 1, 0, 100), ("move", 2, 100, 102)]


def test_touching_stays_are_parted():
    a, b = t.separate_stays([stay(1, 0, H), stay(2, H, 2 * H, lat=1.0)])
    assert (a.end, b.start) == (H - 30, H + 30)
    a, b = t.separate_stays([stay(1, 0, 30), stay(2, 30, 60, lat=1.0)])
    assert b.start - a.end == pytest.approx(1.0)


def test_the_day_dialect_is_preferred_by_its_own_start():
    late = t.CUTOFF_TS + 10.0
    item, day = move(1, t.CUTOFF_TS - 50.0, late + 60, source="arc", quality=9), move(2, late, late + 90, source="moves")
    assert t.preferred(item, day) and not t.preferred(day, item)
    early = move(3, t.CUTOFF_TS - 1.0, late, source="moves")
    assert t.preferred(early, item) and not t.preferred(item, early)
    other = move(4, 0.0, 10.0, source="elsewhere", quality=3)
    assert t.preferred(other, move(5, 0.0, 10.0, source="moves"))


def test_residuals_stay_between_other_sources():
    out = t.resolve([move(1, 0, 100, source="moves", quality=9), move(2, 10, 101, source="else")])
    assert spans(out) == [("move", 1, 0, 100), ("move", 2, 100, 101)]


def test_residuals_on_either_side_go_to_the_winner():
    base = t.CUTOFF_TS + 0.0
    out = t.resolve([move(1, base, base + 100, source="moves"), move(2, base + 1, base + 99, source="arc", quality=5)])
    assert spans(out) == [("move", 2, base, base + 100)]
    out = t.resolve([move(1, base, base + 100, source="moves"), move(2, base + 1, base + 60, source="arc", quality=5)])
    assert spans(out) == [("move", 2, base, base + 60), ("move", 1, base + 60, base + 100)]


def test_a_move_loses_its_route_and_quality_with_its_time():
    full = move(1, 0, 100, quality=11, route_from=1, distance_from=1)
    out = t.resolve([full, move(2, 50, 80, manual=True)])
    assert [(e.quality, e.route_from, e.distance_from, e.geometry) for e in out] == [(3, None, None, False), (0, None, None, True), (3, None, None, False)]


def test_moves_over_the_same_time_share_their_route():
    out = t.resolve([move(1, 0, 100, manual=True), move(2, 0, 100, quality=9, route_from=2, distance_from=2, start_offset=3600)])
    assert [(e.id, e.route_from, e.distance_from, e.quality, e.start_offset) for e in out] == [(1, 2, 2, 8, 3600)]
    base = t.CUTOFF_TS + 0.0
    out = t.resolve([move(1, base, base + 100, source="moves", quality=8, route_from=1), move(2, base + 1, base + 100, source="arc", manual=True)])
    assert [(e.id, e.start, e.route_from) for e in out] == [(2, base, 1)]


def test_a_merged_stay_takes_place_and_end_of_either_side():
    out = t.resolve([stay(1, 0, 100, quality=1, end_offset=0), stay(2, 50, 300, lat=0.0001, quality=6, manual=True, revision=9.0, end_offset=3600)])
    e = out[0]
    assert (e.id, e.end, e.place_from, e.lat, e.quality, e.end_offset, e.manual, e.revision, e.absorbed) == (1, 300, 2, 0.0001, 6, 3600, False, 0.0, [2])


def test_what_the_sweep_brings_together_is_joined():
    out = t.resolve([stay(1, 0, 100, quality=9), move(2, 90, 130), stay(3, 120, 200, quality=9)])
    assert spans(out) == [("stay", 1, 0, 100), ("move", 2, 100, 120), ("stay", 3, 120, 200)]
    assert spans(t.joined([stay(1, 0, 100), stay(2, 100, 200), stay(3, 230, 300), stay(4, 360, 400)])) == [("stay", 1, 0, 300), ("stay", 4, 360, 400)]
    gap = lambda i, a, b: t.Event(i, "gap", a, b)
    assert len(t.joined([gap(1, 0, 10), gap(2, 20, 30)])) == 2 and len(t.joined([gap(1, 0, 10), gap(2, 10, 30)])) == 1


def test_the_rest_of_a_shifted_event_waits_for_its_turn():
    """Time that a later, short event wins is not lost for what follows it."""
    out = t.resolve([stay(1, 0, 100, quality=9), move(2, 50, 150, quality=1), move(3, 60, 80, quality=10)])
    assert spans(out) == [("stay", 1, 0, 60), ("move", 3, 60, 80), ("stay", 1, 80, 100), ("move", 2, 100, 150)]


def test_short_sides_of_touching_stays():
    a, b = t.separate_stays([stay(1, 0, 70), stay(2, 70, 1000, lat=1.0)])
    assert (a.end, b.start) == (60, 120)
    a, b = t.separate_stays([stay(1, 0, 40), stay(2, 50, 90, lat=1.0)])
    assert (a.end, b.start) == (40, 50)


EVENTS = st.lists(
    st.tuples(st.sampled_from(t.KINDS), st.integers(0, 5000), st.integers(1, 900), st.integers(0, 9), st.booleans(), st.sampled_from(["arc", "moves"]), st.sampled_from([0.0, 1.0])), max_size=25
)


def built(rows):
    return [t.Event(k, kind, float(s), float(s + d), q, m, source=src, lat=lat, lon=0.0) for k, (kind, s, d, q, m, src, lat) in enumerate(rows, 1)]


@settings(max_examples=300, deadline=None)
@given(EVENTS)
def test_no_overlap_and_no_lost_time(rows):
    events = built(rows)
    covered = {x for e in events for x in range(int(e.start), int(e.end))}
    out = t.resolve(events)
    assert all(e.end > e.start for e in out)
    assert all(a.end <= b.start for a, b in pairwise(out))
    assert covered <= {x for e in out for x in range(int(e.start), int(e.end))}


@settings(max_examples=100, deadline=None)
@given(EVENTS, st.randoms())
def test_order_of_input_does_not_matter(rows, random):
    shuffled = built(rows)
    random.shuffle(shuffled)
    assert spans(t.resolve(built(rows))) == spans(t.resolve(shuffled))


def test_islands_equal_one_pass(spark):
    import random

    rng, rows = random.Random(7), []
    for history in range(40):
        for i in range(rng.randint(1, 40)):
            start = rng.randint(0, 20_000)
            rows.append((str(history), i, rng.choice(t.KINDS), float(start), float(start + rng.randint(1, 400)), rng.randint(0, 9), rng.random() < 0.1, rng.random(), rng.choice(["arc", "moves"]), float(rng.randint(0, 1)), 0.0, 50.0))
    schema = "history_id string, id bigint, kind string, start_ts double, end_ts double, quality int, manual boolean, revision double, source string, lat double, lon double, radius_m double"
    events = spark.createDataFrame(rows, schema)
    assert sorted(t.sweep(events).collect()) == sorted(t.sweep(events, whole=True).collect())


def test_open_events_and_rows_without_time(spark):
    schema = "history_id string, id bigint, kind string, start_ts double, end_ts double, quality int, manual boolean, revision double, source string, lat double, lon double, radius_m double"
    rows = [("h", 1, "stay", 0.0, 100.0, 5, False, 0.0, "arc", 0.0, 0.0, 50.0), ("h", 2, "move", 50.0, None, 1, False, 0.0, "arc", None, None, None), ("h", 3, "move", None, 9.0, 1, False, 0.0, "arc", None, None, None), ("h", 4, "gap", 7.0, 7.0, 1, False, 0.0, "arc", None, None, None)]
    out = t.sweep(spark.createDataFrame(rows, schema)).collect()
    assert [(r.id, r.start_ts, r.end_ts) for r in sorted(out, key=lambda r: r.start_ts)] == [(1, 0.0, 100.0), (2, 100.0, None)]
    merged = [("h", k, "stay", 100.0 * k, 100.0 * k + 50 + k, 5 + k, False, 0.0, "arc", 0.0, 0.0, 50.0) for k in (1, 2)]
    swept = t.sweep(spark.createDataFrame(merged, schema))
    assert [tuple(r) for r in t.redirects(swept).collect()] == [("h", 2, 1)]


def test_integrity_counts_what_is_wrong(spark):
    rows = [("stay", 0.0, 10.0), ("stay", 5.0, 20.0), ("move", 20.0, 20.0), ("move", 30.0, None), ("gap", 40.0, 50.0)]
    r = t.integrity(spark.createDataFrame(rows, "kind string, start_ts double, end_ts double")).first()
    assert (r.n_events, r.n_overlaps, r.n_adjacent_same_kind, r.n_open, r.n_open_not_last, r.n_non_positive) == (5, 2, 1, 1, 1, 1)
    good = spark.createDataFrame([("stay", 0.0, 10.0), ("move", 10.0, 20.0)], "kind string, start_ts double, end_ts double")
    assert t.checked(good).first().sound
    with pytest.raises(Exception, match="not sound"):
        t.checked(spark.createDataFrame(rows, "kind string, start_ts double, end_ts double")).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 120)), max_size=20), st.randoms())
def test_each_second_belongs_to_the_best_event_that_covers_it(spans_, random):
    ranks = list(range(len(spans_)))
    random.shuffle(ranks)
    events = [move(k, float(s), float(s + d), quality=ranks[k]) for k, (s, d) in enumerate(spans_)]
    owner = {}
    for e in sorted(events, key=lambda e: e.quality):
        owner |= dict.fromkeys(range(int(e.start), int(e.end)), e.id)
    got = {}
    for e in t.resolve(events):
        got |= dict.fromkeys(range(int(e.start), int(e.end)), e.id)
    assert got == owner


def test_islands_are_numbered_by_one_shuffle(spark):
    rows = [("h", 1, "stay", 0.0, 100.0), ("h", 2, "gap", 150.0, 200.0), ("h", 3, "gap", 1000.0, 1100.0), ("h", 4, "stay", 1300.0, None), ("h", 5, "move", 9000.0, 9001.0), ("g", 6, "move", 0.0, 10.0), ("g", 7, "stay", 70.0, 80.0), ("g", 8, "gap", 300.0, 310.0)]
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = t.islands(spark.createDataFrame(rows, "history_id string, id bigint, kind string, start_ts double, end_ts double"))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert {r.id: r.island for r in out.collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1, 7: 2, 8: 3}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_rows_meet_islands_in_one_pass(spark):
    """Rows and changes against islands as all pairs say; no row stands in several cells of time."""
    import random

    from chronofold.plans import incremental

    rng = random.Random(6)
    islands, at = [], {"a": 0.0, "b": 50.0}
    for k in range(60):
        h = "ab"[k % 2]
        lo = at[h] + rng.choice([60, 61, 500, 90_000])
        at[h] = lo + rng.choice([1, 30, 4000, 200_000])
        islands.append((h, lo, at[h]))
    rows = [("abc"[k % 3], k, rng.choice([lo, hi, hi + 1, lo - 1, rng.uniform(0, hi)])) for k in range(300) for _, lo, hi in [rng.choice(islands)]]
    held = spark.createDataFrame(islands, "history_id string, lo double, hi double")
    got = incremental._told(spark.createDataFrame(rows, "history_id string, id int, start_ts double"), held).collect()
    assert {r.id: r._in for r in got} == {i: any(h == g and lo <= s <= hi for g, lo, hi in islands) for h, i, s in rows} and len(got) == 300
    for seed in range(6):
        own = random.Random(seed)
        marks = [(own.choice("abc"), s, own.choice([None, s + 1, s + 300])) for s in (own.choice([hi + 60, hi + 59, lo - 61, lo, hi + 10]) for _, lo, hi in (own.choice(islands) for _ in range(4)))]
        touched = {(h, lo) for h, lo, hi in islands for g, s, e in marks if g == h and lo - 60 < (4e11 if e is None else e) and s < hi + 60}
        want = set()
        for h in "ab":
            row = sorted([(lo, True, (h, lo) in touched) for g, lo, hi in islands if g == h] + [(s, False, True) for g, s, _ in marks if g == h])
            want |= {(h, x[0]) for k, x in enumerate(row) if x[1] and any(y[2] for y in row[max(0, k - 1) : k + 2])}
        found = {(r.history_id, r.lo) for r in incremental.affected(held, spark.createDataFrame(marks, "history_id string, start_ts double, end_ts double")).collect()}
        assert touched <= found
        if not {(g, s) for g, s, _ in marks} & {(g, lo) for g, lo, _ in islands}:
            assert found == want
