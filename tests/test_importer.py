import gzip
import json

import pytest

from chronofold.plans import importer, views


def item(start, end, visit=False, **more):
    return {"isVisit": visit, "startDate": f"2024-05-01T{start}:00Z", "endDate": f"2024-05-01T{end}:00Z", "samples": [], **more}


HOME = {"placeId": "p1", "name": " Home ", "center": {"latitude": 52.0, "longitude": 13.0}, "radius": {"mean": 30}, "isHome": True}


def write(folder, files):
    for name, value in files.items():
        body = json.dumps(value).encode() if not isinstance(value, bytes) else value
        (folder / name).write_bytes(gzip.compress(body) if name.endswith(".gz") else body)
    return str(folder)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def T(clock):
    h, m = map(int, clock.split(":"))
    return 1714521600.0 + h * 3600 + m * 60


def test_items_become_a_timeline(spark, tmp_path):
    samples = [{"sampleId": f"s{k}", "date": f"2024-05-01T10:{k:02d}:00Z", "confirmedType": "cycling", "location": {"latitude": 52.0 + k / 1000, "longitude": 13.0, "horizontalAccuracy": 5}} for k in range(5, 15)]
    files = {
        "a.json": {"timelineItems": [item("08:00", "10:00", True, itemId="v1", place=HOME, lastSaved="2024-05-02T00:00:00Z"), item("10:00", "10:30", itemId="m1", samples=samples, stepCount=100)]},
        "b.json.gz": {"itemId": "v1", "isVisit": True, "startDate": "2024-05-01T08:00:00Z", "endDate": "2024-05-01T09:50:00Z", "lastSaved": "2024-05-03T00:00:00Z"},
        "c.json": {"itemId": "gone", "deleted": True},
        "d.json": {"timelineItems": [item("11:00", "12:00", itemId="gone"), item("12:00", "13:00", itemId="weak", uncertainActivityType=True)]},
        "e.json": b"[1, ",
    }
    t = importer.import_history(spark, write(tmp_path, files))
    assert rows(t["stays"], "start_ts", "end_ts", "type", "poi_id", "radius_m") == [(T("8:00"), T("9:50"), "anchor", "arc:p1", 50.0)]
    assert rows(t["moves"], "start_ts", "end_ts", "mode") == [(T("10:00"), T("10:30"), "bicycle")]
    assert t["moves"].first().distance_m == pytest.approx(1000.8, abs=1)
    assert rows(t["no_data_gaps"], "start_ts", "end_ts", "notes") == [(T("12:00"), T("13:00"), "arc_low_confidence")]
    assert rows(t["pois"], "poi_id", "name", "visitCount") == [("arc:p1", "Home", 1)]
    assert t["raw_gps"].count() == 10
    assert rows(views.pedometer_stats(t["raw_pedometer"]), "date", "total_steps") == [("2024-05-01", 100)]
    bad = [r for r in t["files"].collect() if r.error]
    assert len(bad) == 1 and bad[0].path.endswith("e.json")
    r = t["report"].first()
    assert (r.n_events, r.n_overlaps, r.n_duplicate_starts) == (3, 0, 0)


def test_days_and_items_overlap(spark, tmp_path):
    place = lambda i, lat: {"id": i, "name": f"P{i}", "type": "school", "location": {"lat": lat, "lon": 13.0}}
    seg = lambda kind, a, b, **more: {"type": kind, "startTime": f"20140401T{a}00Z", "endTime": f"20140401T{b}00Z", **more}
    day = {
        "date": "20140401",
        "segments": [
            seg("place", "0800", "0900", place=place(1, 52.0)), seg("move", "0900", "0930", activities=[{"activity": "wlk", "startTime": "20140401T090000Z", "endTime": "20140401T093000Z", "distance": 900, "steps": 1200, "trackPoints": [{"lat": 52.0, "lon": 13.0, "time": "20140401T090000Z"}, {"lat": 52.01, "lon": 13.0, "time": "20140401T093000Z"}]}]),
            seg("place", "0930", "1000", place=place(2, 52.5)), seg("place", "1000", "1100", place=place(3, 53.0)), seg("off", "1100", "1200"), seg("off", "1300", "1400"),
        ],
        "summary": [],
    }
    poorer = {"date": "20140401", "segments": day["segments"][:2], "summary": []}
    t = importer.import_history(spark, write(tmp_path, {"a.json": [day], "b.json": [poorer], "c.json": [day]}))
    assert [(r.start_ts % 86400 / 60, r.end_ts % 86400 / 60) for r in t["stays"].orderBy("start_ts").collect()] == [(480, 540), (570, 599.5), (600.5, 660)]
    assert rows(t["moves"], "mode", "distance_m", "provider") == [("walk", 900.0, "moves_export")]
    assert rows(t["no_data_gaps"], "notes") == [("generated_between_stays",), ("moves_tracking_off",)]
    r = t["report"].first()
    assert (r.n_overlaps, r.n_duplicate_starts, r.n_adjacent_same_kind, r.n_non_positive) == (0, 0, 0, 0)
    assert rows(views.daily_activity_stats(t["moves"]), "date", "mode", "total_distance_m") == [("2014-04-01", "walk", 900.0)]


def test_order_and_repeats_of_files_do_not_matter(spark, tmp_path):
    one, two = tmp_path / "1", tmp_path / "2"
    one.mkdir(), two.mkdir()
    x = {"timelineItems": [item("08:00", "10:00", True, itemId="v", place=HOME)]}
    y = {"timelineItems": [item("09:30", "11:00", itemId="m", activityType="car", lastSaved="2024-05-02T00:00:00Z")]}
    a = importer.import_history(spark, write(one, {"a.json": x, "b.json": y}))
    b = importer.import_history(spark, write(two, {"a.json": y, "b.json": x, "c.json": y, "d.json": x}))
    assert rows(a["events"], "kind", "start_ts", "end_ts") == rows(b["events"], "kind", "start_ts", "end_ts")


def at(clock, day="2024-06-10"):
    return f"{day}T{clock}:00Z"


def sample(clock, lat, lon=20.0, **more):
    return {"date": at(clock), "location": {"timestamp": at(clock), "latitude": lat, "longitude": lon, "horizontalAccuracy": 8}, **more}


def secs(clock, day="2024-06-10"):
    import datetime

    return int(datetime.datetime.fromisoformat(f"{day}T{clock}:00+00:00").timestamp())


def seg(kind, a, b, day="20150310", **more):
    return {"type": kind, "startTime": f"{day}T{a}00Z", "endTime": f"{day}T{b}00Z", **more}


def act(name, a, b, day="20150310", **more):
    return {"activity": name, "startTime": f"{day}T{a}00Z", "endTime": f"{day}T{b}00Z", **more}


def spot(lat, **more):
    return {"location": {"lat": lat, "lon": 9.0}, **more}


HISTORIES = {
    # nothing but samples: a stay, then a move, then a weak window
    "orphans": {
        "s.json": [
            *({**sample(f"06:{k:02d}", 41.0 + (k % 2) / 1e5), "movingState": "stationary"} for k in range(0, 30)), *({**sample(f"08:{k:02d}", 41.1 + k / 500), "coreMotionActivityType": "cycling"} for k in range(0, 20)), {**sample("12:00", 42.0), "movingState": "moving"}, {**sample("12:05", 42.0), "movingState": "moving"},
            {**sample("15:00", 43.0), "movingState": "stationary"},
        ]
    },
    # samples of a deleted item are known, those of a missing one are not
    "links": {
        "gone.json": {"itemId": "gone", "deleted": True, "lastSaved": at("20:00")},
        "s.json": [*({**sample(f"06:{k:02d}", 41.0), "movingState": "stationary", "timelineItemId": "gone"} for k in range(9)), *({**sample(f"10:{k:02d}", 41.0), "movingState": "stationary", "timelineItemId": "missing"} for k in range(9))],
    },
    # items without duration, most of them, between two that can be trusted
    "fragments": {
        "t.json": {
            "timelineItems": [
                {"itemId": "a", "isVisit": True, "startDate": at("06:00"), "endDate": at("07:00"), "samples": [], "center": {"latitude": 41.0, "longitude": 20.0}},
                *({"itemId": f"f{k}", "isVisit": False, "startDate": at(f"07:{k * 5:02d}"), "endDate": at(f"07:{k * 5:02d}"), "samples": [{**sample(f"07:{k * 5:02d}", 41.0 + k / 100), "coreMotionActivityType": "cycling", "sampleId": f"x{k}"}]} for k in range(1, 9)),
                {"itemId": "b", "isVisit": True, "startDate": at("09:00"), "endDate": at("10:00"), "samples": [], "center": {"latitude": 41.5, "longitude": 20.0}},
            ]
        }
    },
    # a later revision sets one field to null, lacks another, and merges into a third
    "revisions": {
        "a.json": {"timelineItems": [{"itemId": "m", "isVisit": False, "startDate": at("06:00"), "endDate": at("07:00"), "activityType": "bus", "confirmedType": "bus", "stepCount": 10, "lastSaved": at("08:00"), "samples": []}, {"itemId": "v", "isVisit": True, "startDate": at("08:00"), "endDate": at("09:00"), "samples": [], "place": {"placeId": "p", "name": "Old", "center": {"latitude": 41.0, "longitude": 20.0}}, "lastSaved": at("09:30")}]},
        "b.json": {"itemId": "m", "activityType": "train", "confirmedType": None, "stepCount": None, "lastSaved": at("09:00")},
        "c.json": {"itemId": "v", "place": {"name": "New"}, "lastSaved": at("10:00")},
        "d.json": {"placeId": "q", "name": "Stored", "center": {"latitude": 42.0, "longitude": 20.0}, "radius": {"mean": 70}, "secondsFromGMT": 7200},
        "e.json": {"itemId": "w", "isVisit": True, "startDate": at("11:00"), "endDate": at("12:00"), "placeId": "q"},
        "f.json": {"placeId": "z", "name": "Gone", "center": {"latitude": 42.0, "longitude": 20.0}, "lastSaved": at("01:00")},
        "g.json": {"placeId": "z", "deleted": True, "lastSaved": at("02:00")},
    },
    # a move of three activities, cut to its segment, and a place without a point that has one
    "activities": {
        "d.json": [{"date": "20150310", "segments": [
            seg("move", "0800", "0900", activities=[act("wlk", "0750", "0810", distance=600, steps=800), act("bus", "0810", "0850", distance=9000), act("wlk", "0850", "0900", distance=500, steps=700)]),
            seg("place", "0900", "1000", place={"name": "somewhere"}, activities=[act("run", "0920", "0940", distance=3000, steps=3000)]),
        ]}]
    },
    # two accounts of a day: the longer leads, the other adds a segment, a missing id and a manual correction
    "accounts": {
        "a.json": [{"date": "20150310", "lastUpdate": "20150311T000000Z", "segments": [seg("place", "0000", "0800", place=spot(45.0, id=1, name="Home", type="home")), seg("move", "0800", "0830", activity="car", distance=20000), seg("place", "0830", "1700", place=spot(45.2))]}],
        "b.json": [{"date": "20150310", "lastUpdate": "20150312T000000Z", "segments": [seg("place", "0830", "1700", place=spot(45.2, id=2, name="Office")), seg("move", "0801", "0830", activity="bike", manual=True), seg("off", "1700", "2000")]}],
    },
    # both sources on one walk, told twice as items, with floors; the summary adds up
    "steps": {
        "i.json": {"timelineItems": [
            {"itemId": "x", "isVisit": False, "startDate": at("08:00", "2015-03-10"), "endDate": at("08:30", "2015-03-10"), "activityType": "walking", "stepCount": 1990, "floorsAscended": 4, "samples": []},
            {"itemId": "y", "isVisit": True, "startDate": at("08:10", "2015-03-10"), "endDate": at("08:30", "2015-03-10"), "stepCount": 1990, "samples": []},
        ]},
        "d.json": [{"date": "20150310", "segments": [seg("move", "0800", "0830", activities=[act("wlk", "0800", "0830", steps=2000, distance=1500)])], "summary": [{"activity": "wlk", "steps": 2300, "distance": 1700}]}],
    },
    # a day's places where items have stays: one without a name of its own, one with another
    "matches": {
        "i.json": {"timelineItems": [
            {"itemId": "u", "isVisit": True, "startDate": at("08:00", "2015-03-10"), "endDate": at("10:00", "2015-03-10"), "samples": [], "radius": {"mean": 33}, "place": {"placeId": "cafe", "name": "Cafe", "center": {"latitude": 45.0, "longitude": 9.0}}},
            {"itemId": "v", "isVisit": True, "startDate": at("12:00", "2015-03-10"), "endDate": at("14:00", "2015-03-10"), "samples": [], "place": {"placeId": "gym", "name": "Gym", "isHome": True, "center": {"latitude": 45.5, "longitude": 9.0}}},
        ]},
        "d.json": [{"date": "20150310", "segments": [seg("place", "0810", "0950", place=spot(45.0001, id=7)), seg("place", "1150", "1400", place=spot(45.5001, id=8, name="Club"))]}],
    },
    # a day's place within a long stay of an item, before the cut-off; the item's place has no id
    "overlay": {
        "i.json": {"timelineItems": [{"itemId": "s", "isVisit": True, "startDate": at("08:00", "2015-03-10"), "endDate": at("12:00", "2015-03-10"), "place": {"name": "Lodge", "location": {"latitude": 47.0, "longitude": 9.0}}}]},
        "d.json": [{"date": "20150310", "segments": [seg("place", "1000", "1100", place=spot(47.5, id=3, name="Lake"))]}],
    },
    # two dozen moves of a second, with steps and points: one range of unknown time, and what was measured stays
    "dense": {"d.json": [{"date": "20150310", "segments": [
        {"type": "move", "startTime": f"20150310T0800{k:02d}Z", "endTime": f"20150310T0800{k + 1:02d}Z", "activities": [{"activity": "wlk", "startTime": f"20150310T0800{k:02d}Z", "endTime": f"20150310T0800{k + 1:02d}Z", "steps": 2, "trackPoints": [{"lat": 45.0, "lon": 9 + k / 1e4, "time": f"20150310T0800{k:02d}Z"}]}]} for k in range(24)
    ]}]},
    # one place by three ids; of equal moves before the cut-off the day's provenance counts; a cut move is measured again
    "places": {
        "d.json": [{"date": "20150310", "segments": [
            seg("place", "0000", "0100", place=spot(45.0, id=5)), seg("place", "0200", "0300", place=spot(45.0, id=5, foursquareId="fs", name="Bar")), seg("place", "0400", "0500", place=spot(45.0, foursquareId="fs", facebookPlaceId="fb")),
            seg("move", "1000", "1100", activities=[act("run", "1000", "1100", trackPoints=[{"lat": 45.0 + k / 1000, "lon": 9.0, "time": f"20150310T10{k:02d}00Z"} for k in range(0, 60, 5)])]),
            seg("place", "1030", "1100", place=spot(45.03, id=9, name="Finish"), manual=True),
        ]}],
        "i.json": {"timelineItems": [{"itemId": "m", "isVisit": False, "startDate": at("12:00", "2015-03-10"), "endDate": at("13:00", "2015-03-10"), "activityType": "car", "samples": []}]},
        "e.json": [{"date": "20150310", "segments": [seg("move", "1200", "1300", activity="car", distance=50000)]}],
    },
}


@pytest.fixture(scope="module")
def histories(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("histories")
    for name, files in HISTORIES.items():
        (folder / name).mkdir()
        write(folder / name, files)
    tables = importer.import_histories(spark, str(folder))
    return {name: df.toPandas().to_dict("records") for name, df in tables.items()}


def of(tables, name, history, *columns):
    import math

    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(plain(r[c]) for c in columns) for r in tables[name] if r["history_id"] == history), key=repr)


def test_time_that_only_samples_cover(histories):
    stays, moves, gaps = (of(histories, t, "orphans", "start_ts", "end_ts", *more) for t, more in (("stays", ("radius_m",)), ("moves", ("mode",)), ("no_data_gaps", ("notes",))))
    assert [(a, b) for a, b, _ in stays] == [(secs("06:00"), secs("06:30"))] and 8 <= stays[0][2] <= 10
    assert [(a, b, m) for a, b, m in moves] == [(secs("08:00"), secs("08:20"), "bicycle")]
    assert gaps == [(secs("12:00"), secs("12:06"), "arc_fragment_low_evidence")]
    assert [r[1] for r in of(histories, "raw_motion_activity", "orphans", "confidence", "is_cycling")].count(1) == 20
    assert [(a, b) for a, b in of(histories, "stays", "links", "start_ts", "end_ts")] == [(secs("10:00"), secs("10:09"))]


def test_items_without_duration(histories):
    assert of(histories, "stays", "fragments", "start_ts", "end_ts") == [(secs("06:00"), secs("07:00")), (secs("09:00"), secs("10:00"))]
    assert of(histories, "moves", "fragments", "start_ts", "end_ts", "mode") == [(secs("07:05"), secs("07:41"), "bicycle")]


def test_revisions_merge(histories):
    assert of(histories, "moves", "revisions", "mode", "provider") == [("train", "arc_import")]
    assert of(histories, "stays", "revisions", "start_ts", "poi_id", "radius_m", "tz_offset_s") == [(secs("08:00"), "arc:p", 50.0, None), (secs("11:00"), "arc:q", 70.0, 7200)]
    assert of(histories, "pois", "revisions", "poi_id", "name", "visitCount") == [("arc:p", "New", 1), ("arc:q", "Stored", 1)]
    assert of(histories, "raw_pedometer", "revisions", "steps_delta") == [(10,)]
    assert of(histories, "raw_visits", "revisions", "arrival_ts", "lat") == [(secs("11:00"), 42.0)]


def test_each_activity_is_a_move(histories):
    d = "2015-03-10"
    assert of(histories, "moves", "activities", "start_ts", "end_ts", "mode", "distance_m") == [
        (secs("08:00", d), secs("08:10", d), "walk", 600.0), (secs("08:10", d), secs("08:50", d), "bus", 9000.0), (secs("08:50", d), secs("09:00", d), "walk", 500.0), (secs("09:20", d), secs("09:40", d), "run", 3000.0),
    ]
    assert of(histories, "no_data_gaps", "activities", "start_ts", "end_ts", "notes") == [(secs("09:00", d), secs("09:20", d), "moves_place_without_location"), (secs("09:40", d), secs("10:00", d), "moves_place_without_location")]
    assert sorted(of(histories, "raw_pedometer", "activities", "steps_delta", "distance_m")) == [(700, 500.0), (800, 600.0), (3000, 3000.0)]


def test_accounts_of_a_day(histories):
    d = "2015-03-10"
    assert of(histories, "stays", "accounts", "start_ts", "end_ts", "type", "poi_id") == [(secs("00:00", d), secs("08:00", d), "anchor", "moves:1"), (secs("08:30", d), secs("17:00", d), "venue", "moves:2")]
    assert of(histories, "moves", "accounts", "start_ts", "end_ts", "mode", "distance_m") == [(secs("08:01", d), secs("08:30", d), "bicycle", 20000.0)]
    assert of(histories, "no_data_gaps", "accounts", "notes") == [("moves_tracking_off",)]


def test_steps_count_once(histories):
    d = "2015-03-10"
    assert of(histories, "raw_pedometer", "steps", "ts", "steps_delta", "distance_m", "floors_up") == [(secs("08:30", d), 2000, 1500.0, None), (secs("08:30", d), 300, None, None), (secs("08:30", d), None, None, 4.0)]


def test_places_and_routes(histories):
    d = "2015-03-10"
    assert {p for (p,) in of(histories, "stays", "places", "poi_id")} == {"moves:fb", "moves:9"}
    assert of(histories, "pois", "places", "poi_id", "name", "visitCount") == [("moves:9", "Finish", 1), ("moves:fb", "Bar", 3)]
    moves = of(histories, "moves", "places", "start_ts", "end_ts", "mode", "provider", "distance_m")
    assert [(a, b, m, p, round(x)) for a, b, m, p, x in moves] == [(secs("10:00", d), secs("10:30", d), "run", "moves_export", 3336), (secs("12:00", d), secs("13:00", d), "car", "moves_export", 50000)]
    paths = of(histories, "route_paths", "places", "sample_count", "bbox_min_lat", "bbox_max_lat", "path_quality", "codec")
    assert paths == [(7, 45.0, 45.03, "raw", "bqdc-v1")]
    assert len(of(histories, "raw_gps", "places", "ts")) == 12


def test_stays_of_both_sources(histories):
    d = "2015-03-10"
    stays = of(histories, "stays", "matches", "start_ts", "end_ts", "poi_id", "radius_m", "type")
    assert stays == [(secs("08:00", d), secs("10:00", d), "arc:cafe", 33.0, "venue"), (secs("11:50", d), secs("14:00", d), "moves:8", 50.0, "anchor")]
    links = of(histories, "stay_pois", "matches", "poi_id", "role")
    assert links == [("arc:cafe", "primary"), ("arc:gym", "secondary"), ("moves:8", "primary")]
    assert [round(x) for p, x in of(histories, "stay_pois", "matches", "poi_id", "distance_m") if p == "arc:gym"] == [11]


def test_a_days_place_within_a_stay(histories):
    d = "2015-03-10"
    assert of(histories, "stays", "overlay", "start_ts", "end_ts", "part") == [(secs("08:00", d), secs("10:00", d) - 30, 0), (secs("10:00", d) + 30, secs("11:00", d) - 30, 0), (secs("11:00", d) + 30, secs("12:00", d), 1)]
    assert of(histories, "no_data_gaps", "overlay", "notes") == [("generated_between_stays",)] * 2
    assert of(histories, "pois", "overlay", "name", "provider", "provider_poi_id") == [("Lake", "moves", "3"), ("Lodge", "arc", None)]


def test_dense_fragments_of_a_day(histories):
    d = "2015-03-10"
    assert of(histories, "no_data_gaps", "dense", "start_ts", "end_ts", "notes") == [(secs("08:00", d), secs("08:00", d) + 24, "moves_tracking_off")]
    assert not of(histories, "moves", "dense", "start_ts") and len(of(histories, "raw_gps", "dense", "ts")) == 24
    assert sum(n for (n,) in of(histories, "raw_pedometer", "dense", "steps_delta")) == 48


def test_all_timelines_are_sound(histories):
    bad = ("n_duplicate_starts", "n_overlaps", "n_adjacent_same_kind", "n_open", "n_non_positive")
    assert {r["history_id"] for r in histories["report"]} == set(HISTORIES)
    assert all(r[c] == 0 for r in histories["report"] for c in bad)
    assert not [r for r in histories["files"] if r["n_errors"]]


def test_tables_are_written_and_hold(spark, tmp_path):
    from chronofold.plans import sinks

    folder = tmp_path / "in"
    for name in ("activities", "accounts"):
        (folder / name).mkdir(parents=True)
        write(folder / name, HISTORIES[name])
    tables, heard, out = importer.import_histories(spark, str(folder)), [], str(tmp_path / "out")
    n = sinks.write_tables(tables, out, on_table=heard.append)
    written = sinks.read_tables(spark, out, list(tables))
    assert sorted(heard) == sorted(tables) and heard[-1] == "events" and n["moves"] == 5 == written["moves"].count()
    assert [r.sound and r.same for r in sinks.verified(tables, written).collect()] == [True, True]
    assert sinks.read_tables(spark, out)["migrations"].first().n_rows == sum(n.values())
    with pytest.raises(Exception, match="differs"):
        sinks.verified(tables, written | {"stays": written["stays"].limit(1)}).collect()
    with pytest.raises(ValueError, match="nothing"):
        sinks.write_tables({k: v.where("false") for k, v in tables.items()}, str(tmp_path / "none"))


@pytest.mark.parametrize("order", [0, 1, 2])
def test_ids_of_two_kinds_are_one_place(spark, tmp_path, order):
    """A stored place, an item that tells both ids and one that tells the stored id alone, in files of any order; another pair without a stored place."""
    both = {"placeId": "p", "mapboxPlaceId": "m", "name": "Home", "center": {"latitude": 31.2, "longitude": 121.4}}
    lake = {"placeId": "l", "mapboxPlaceId": "n", "name": "Lake", "center": {"latitude": 35.0, "longitude": 121.4}}
    files = [
        {"placeId": "p", "name": "Old", "center": {"latitude": 31.2, "longitude": 121.4}, "lastSaved": "2024-01-01T00:00:00Z"},
        {"timelineItems": [item("08:00", "09:00", True, itemId="visit", lastSaved="2024-05-02T00:00:00Z", center=both["center"], place=both), item("13:00", "14:00", True, itemId="swim", place=lake)]},
        {"timelineItems": [item("10:00", "11:00", True, itemId="again", place={k: both[k] for k in ("placeId", "name", "center")}), item("15:00", "16:00", True, itemId="dive", place={k: lake[k] for k in ("placeId", "name", "center")})]},
    ]
    t = importer.import_history(spark, write(tmp_path, {f"{(k + order) % 3}.json": f for k, f in enumerate(files)}))
    assert rows(t["pois"], "poi_id", "provider", "name", "visitCount", "first_seen_ts") == [("arc:p", "arc", "Home", 2, T("8:00")), ("mapbox:n", "mapbox", "Lake", 2, T("13:00"))]
    assert rows(t["stays"], "start_ts", "poi_id") == [(T("8:00"), "arc:p"), (T("10:00"), "arc:p"), (T("13:00"), "mapbox:n"), (T("15:00"), "mapbox:n")]
