import gzip
import io
import json
import zipfile
import zlib

import pytest

from chronofold.sources import archive as a

ITEM = {"isVisit": True, "startDate": "2024-05-01T10:00:00Z", "endDate": "2024-05-01T11:00:00Z", "samples": []}


def zipped(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_shapes():
    assert a.values(b'{"timelineItems":[{},{"a":1}]}') == ("timeline-items", [{}, {"a": 1}])
    assert a.values(b"[1,2]") == ("root-array", [1, 2])
    assert a.values(b'{"itemId":"x","timelineItems":[1]}')[0] == "root-object"
    assert a.values(b'{"n":{"timelineItems":[1]}}')[0] == "root-object"
    for bad in (b"", b"3", b'{"a":', b"[1,"):
        with pytest.raises(a.Damaged):
            a.values(bad)


def test_gzip_is_verified():
    good = gzip.compress(b"[1]")
    assert a.plain("x.json", good) == b"[1]"
    for bad in (good[:-9], good + good, good[:-5] + bytes([good[-5] ^ 1]) + good[-4:]):
        with pytest.raises(a.Damaged):
            a.plain("x.json.gz", bad)


def test_a_damaged_zip_entry_leaves_the_others():
    data = bytearray(zipped({"a.json": b"[1,2]", "b/c.json": b'[{"placeId":"p"}]', "d.txt": b"x"}, zipfile.ZIP_STORED))
    data[data.index(b"[1,2]") + 1] ^= 1
    rows = list(a.decoded("h.zip", bytes(data)))
    assert [(r["path"], r["raw"], bool(r["error"])) for r in rows] == [("h.zip!/a.json", None, True), ("h.zip!/b/c.json", '{"placeId":"p"}', False)]
    assert list(a.decoded("x.zip", b"PK\3\4 nonsense"))[0]["error"]
    assert zlib.crc32(b"") == 0


def test_entries_of_archives_are_dealt(spark, tmp_path):
    """Damaged archives and entries are errors beside the others."""
    (tmp_path / "many.zip").write_bytes(zipped({f"d/{k}.json": json.dumps({"placeId": f"p{k}"}) for k in range(300)}))
    good = zipped({"a.json": json.dumps([{"placeId": "x"}, {"placeId": "y"}])}, zipfile.ZIP_STORED)
    (tmp_path / "good.ZIP").write_bytes(good)
    (tmp_path / "bad.zip").write_bytes(good[:-30])
    torn = bytearray(good)
    torn[torn.index(b'"x"') + 1] ^= 1
    (tmp_path / "torn.zip").write_bytes(bytes(torn))
    (tmp_path / "lzma.zip").write_bytes(zipped({"a.json": "[]"}, zipfile.ZIP_LZMA))
    rows = a.read_archives(spark, str(tmp_path), "h").collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.split("!")[0].rsplit("/", 1)[-1], []).append(r)
    assert len(by["many.zip"]) == 300 and len({r.path for r in by["many.zip"]}) == 300 and len(by["good.ZIP"]) == 2
    assert all(len(by[n]) == 1 and by[n][0].error for n in ("bad.zip", "torn.zip", "lzma.zip")) and "method" in by["lzma.zip"][0].error


def test_large_directories(tmp_path):
    """An archive in the 64-bit format."""
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for name in ("a.json", "b.json"):
            with z.open(name, "w", force_zip64=True) as f:
                f.write(b'[{"placeId":"p"}]')
    rows = list(a.decoded("x.zip", (tmp_path / "x.zip").read_bytes()))
    assert [(r["kind"], r["error"]) for r in rows] == [("place", None)] * 2


def test_read_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/a.json").write_text(json.dumps({"timelineItems": [ITEM, ITEM | {"itemId": "i"}]}))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps([{"date": "20240501", "segments": [{"type": "off", "startTime": "20240501T000000Z", "endTime": "20240501T010000Z"}], "summary": []}]).encode()))
    (tmp_path / "c.zip").write_bytes(zipped({"p.json": json.dumps({"placeId": "p"}), "r.json": json.dumps({"dateRange": {"start": "2024-05-01T00:00:00Z", "duration": 86400}})}))
    (tmp_path / "d.json").write_text("[1, ")
    (tmp_path / "e.txt").write_text("no")
    found = a.read_archives(spark, str(tmp_path), "h")
    summary = {r.path.rsplit("/", 1)[-1]: (r.n_values, r.dialects, r.supported) for r in a.scan_summary(found).collect()}
    assert summary == {"a.json": (2, ["export-item"], True), "b.json.gz": (1, ["day"], True), "p.json": (1, ["place"], True), "r.json": (1, ["range-summary"], False), "d.json": (0, [], False)}
    keys = [r[0] for r in found.where("shape = 'timeline-items'").orderBy("pos").select(a.item_key("raw")).collect()]
    assert keys == ["time:1714557600|1714561200|stay", "id:i"]


def test_kinds_are_strict():
    item = {"isVisit": False, "startDate": "2024-05-01T10:00:00Z", "endDate": "2024-05-01T11:00:00Z"}
    place = {"type": "place", "startTime": "20240501T000000Z", "endTime": "20240501T010000Z"}
    kinds = lambda v, shape="root-array": (a.kind_of(v, shape)[0], a.kind_of(v, shape)[1] is None)
    good = [
        ({"dateRange": {"start": "x", "duration": 0}}, "range-summary"), ({"itemId": "i", "placeId": "p"}, "stored-item"), ({"placeId": "p", "sampleId": "s"}, "place"), ({"sampleId": "s", "deleted": True}, "sample"),
        ({"date": "20240501", "summary": [{"activity": "wlk", "steps": 0}]}, "day"), ({"date": "20240501", "segments": [place | {"place": {"id": 5}}]}, "day"), ({"deleted": True}, "deleted"),
        ({"date": "2024-05-01T00:00:00Z", "movingState": "moving"}, "sample"), ({"location": {"timestamp": "2024-05-01T00:00:00Z", "lat": 1, "longitude": 2}}, "sample"),
    ]
    assert [kinds(v) for v, _ in good] == [(k, True) for _, k in good]
    bad = [3, None, [], {}, {"dateRange": {"start": "x", "duration": -1}}, {"itemId": 7}, {"date": "20240501", "segments": [place]}, {"date": "20240231", "segments": [place | {"type": "off"}]}, {"date": "2024-05-01T00:00:00Z", "location": {"lat": 91, "lon": 0}}, {"sampleId": "s"}, {"date": "1960-05-01T00:00:00Z", "movingState": "x"}]
    assert [kinds(v) for v in bad] == [("unknown", False)] * len(bad)
    assert kinds(item, "timeline-items") == ("export-item", True)
    for v in (item | {"isVisit": "no"}, item | {"startDate": ""}, item | {"endDate": "later"}, {}):
        assert kinds(v, "timeline-items") == ("unknown", False)


def test_paths_tell_what_a_file_holds(spark):
    want = {
        "x/JSON/Daily/Storyline/a.json": "day", "json/full/storyline.json.gz": "day", "json\\yearly\\storyline\\a.json": "day", "export/json/monthly/a.json.gz": "export-item", "my/Export/JSON/monthly/a.json.gz": "export-item", "json/daily/a.json": "export-item",
        "b/TimelineItem/1/a.json": "stored-item", "LocomotionSample/a.json": "sample", "b/Place/a.json": "place", "TimelineRangeSummary/a.json": "range-summary", "a.json": None, "myplace/a.json": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r.p: r.k for r in df.select("p", a.path_kind("p").alias("k")).collect()} == want


def test_folders_are_histories_and_bad_values_are_told(spark, tmp_path):
    for user in ("u1", "u2"):
        (tmp_path / user).mkdir()
    (tmp_path / "u1/a.json").write_text(json.dumps({"timelineItems": [ITEM, {"isVisit": True}, ITEM | {"endDate": "?"}]}))
    (tmp_path / "u2/b.zip").write_bytes(zipped({"p.json": json.dumps({"placeId": "p"})}))
    found = a.read_archives(spark, str(tmp_path))
    assert sorted((r.history_id, r.kind, bool(r.error)) for r in found.collect()) == [("u1", "export-item", False), ("u1", "unknown", True), ("u1", "unknown", True), ("u2", "place", False)]
    got = {r.history_id: (r.supported, r.n_errors, r.error) for r in a.scan_summary(found).collect()}
    assert got == {"u1": (True, 2, "an item without isVisit, startDate or endDate"), "u2": (True, 0, None)}


def test_stream_keeps_the_latest(spark, tmp_path):
    from chronofold.streaming.latest import compact, current, merge_revisions

    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "id int, revision int, x string, deleted boolean"
    batches = [[(1, 1, "a", False), (2, 5, "b", False), (3, 9, "c", False), (4, 1, "d", None)], [(1, 3, "e", False), (2, 4, "f", False), (3, 9, None, True), (4, None, None, True)], [(4, 100, "late", False), (3, 10, "again", False)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        merge_revisions(stream, ["id"], ["revision"], out, str(tmp_path / "check"), "deleted").awaitTermination()
    want = [(1, 3, "e", False), (2, 5, "b", False), (3, 10, "again", False)]
    assert sorted(tuple(r) for r in current(spark, out, ["id"], ["revision"], "deleted").collect()) == want
    compact(spark, out, str(tmp_path / "one"), ["id"], ["revision"], "deleted")
    assert sorted(tuple(r) for r in current(spark, str(tmp_path / "one"), ["id"], ["revision"], "deleted").collect()) == want


def test_sessions_of_a_stream(spark, tmp_path):
    import datetime

    from chronofold.streaming.latest import session_windows

    at = lambda m: datetime.datetime(2024, 5, 1, 10) + datetime.timedelta(minutes=m)
    rows = [("a", at(0)), ("a", at(9)), ("a", at(18)), ("a", at(40)), ("b", at(5)), ("b", at(6)), ("z", at(600))]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = session_windows(stream, "k", "ts").writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.start_ts, r.end_ts, r.n) for r in spark.table("sessions").collect()) == [("a", at(0), at(18), 3), ("b", at(5), at(6), 2)]


def test_functions_in_sql(spark):
    import chronofold

    assert "move_mode" in chronofold.register(spark)
    assert all(callable(getattr(chronofold, name)) for name in ("import_history", "import_histories", "write_tables", "read_archives", "scan", "start")) and not hasattr(chronofold, "other")
    r = spark.sql("select import_timestamp('20200101T000000+0100') as t, import_offset('20200101T000000+0100') as o, move_mode('On Foot') as m, encode_route(array(9.0D, 9.1D), array(45.0D, 45.0D)) as c, import_timestamp(null) as n").first()
    assert (r.t, r.o, r.m, bytes(r.c[:4]), r.n) == (1577833200, 3600, "walk", b"CDQB", None)


def test_geometry_and_checksums_in_sql(spark):
    import chronofold

    chronofold.register(spark)
    r = spark.sql("""select haversine_m(0D, 0D, 0D, 1D) as d, path_length_m(array(0D, 1D, 1D), array(0D, 0D, 1D)) as l, path_length_m(array(1D), array(1D)) as z, path_bounds(array(2D, 1D), array(4D, 5D)) as b, path_bounds(cast(array() as array<double>), cast(array() as array<double>)) as e,
      crc32_update(crc32_update(4294967295, cast('ab' as binary)), cast('c' as binary)) as c, decode_route(encode_route(array(9.0D, 9.1D), array(45.0D, 45.5D))) as p, decode_route(null) as n""").first()
    assert r.d == pytest.approx(111_195, abs=1) and r.l == pytest.approx(2 * r.d, abs=1) and r.z == 0 and tuple(r.b) == (4, 1, 5, 2) and r.e is None and r.n is None
    assert r.c ^ 0xFFFFFFFF == zlib.crc32(b"abc")
    assert [(round(x.lon, 5), round(x.lat, 5)) for x in r.p] == [(9.0, 45.0), (9.1, 45.5)]
