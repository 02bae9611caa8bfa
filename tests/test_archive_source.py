"""Archives as a data source, and JSON read piece by piece."""

import gzip
import io
import json
import os
import random
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest

from chronofold.sources import archive, history_source, json_stream

ITEM = {"isVisit": True, "startDate": "2024-05-01T10:00:00Z", "endDate": "2024-05-01T11:00:00Z", "samples": []}


def cut(data: bytes, size: int):
    return (data[k : k + size] for k in range(0, len(data), size))


def some_value(rng, depth=0):
    k = rng.random()
    if depth > 3 or k < 0.3:
        return rng.choice([1, -2.5e3, True, None, 'a"b\\', "é{]}[", "", 0])
    if k < 0.6:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "itemId", "x]", "timelineItems"]): some_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_values_don_t_depend_on_pieces():
    rng = random.Random(1)
    for _ in range(400):
        v = [some_value(rng) for _ in range(rng.randrange(5))]
        size = rng.choice([1, 2, 3, 7, 100])
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        assert list(json_stream.values(cut(text, size))) == [("root-array", x) for x in v]
        inside = json.dumps({"z": some_value(rng), "timelineItems": v, "y": some_value(rng)}).encode()
        assert list(json_stream.values(cut(inside, size))) == [("timeline-items", x) for x in v]
        whole = {"z": some_value(rng), "itemId": some_value(rng), "timelineItems": v}
        assert list(json_stream.values(cut(json.dumps(whole).encode(), size))) == [("root-object", whole)]
        for part in (text[: rng.randrange(len(text))], inside[: rng.randrange(len(inside))], text + b"1"):
            with pytest.raises(json_stream.Damaged):
                list(json_stream.values(cut(part, size)))
        packed = gzip.compress(inside)
        assert b"".join(json_stream.gunzipped(cut(packed, size))) == inside
        for bad in (packed[:-1], packed + b"x", packed + packed, packed[:-5] + bytes([packed[-5] ^ 1]) + packed[-4:]):
            with pytest.raises(json_stream.Damaged):
                list(json_stream.gunzipped(cut(bad, size)))


def test_what_is_not_json():
    for bad in (b"", b" ", b"3", b'"x"', b"[1,]", b"[1 2]", b"[NaN]", b"{,}", b'{,"timelineItems":[]}', b'{"a":1,"timelineItems":[1],}', b'{"timelineItems":[1],2:3}', b'{"timelineItems":[1]', b"[[}]", b'{"a"}', b"[\xff]", b"null", b"[" * 100_000):
        with pytest.raises(json_stream.Damaged):
            list(json_stream.values([bad]))


def test_the_list_is_looked_for_so_far():
    def shape(head):
        return next(json_stream.values([json.dumps(head | {"timelineItems": [1]}).encode()]))[0]

    assert shape({"a": "x" * 900_000}) == "timeline-items" and shape({"a": "x" * 1_000_001}) == "root-object"
    assert shape({"a": [0] * 9_000}) == "timeline-items" and shape({"a": [0] * 10_001}) == "root-object"
    assert shape({"a": {"itemId": 1}}) == "timeline-items"
    assert next(json_stream.values([b'{"a": {"timelineItems": [1]}}']))[0] == "root-object"
    assert list(json_stream.values([b'{"timelineItems": {"a": 1}, "b": 2}']))[0][0] == "root-object"


def test_the_consumer_may_stop():
    def endless():
        yield b"["
        while True:
            yield b'{"placeId": "p"},'

    found = json_stream.values(endless())
    assert [next(found) for _ in range(3)] == [("root-array", {"placeId": "p"})] * 3


MEMORY = """
import sys, json, resource, zlib
sys.path.insert(0, {root!r})
from chronofold.sources import history_source as hs
item = json.dumps({{"isVisit": True, "itemId": "i", "startDate": "2024-05-01T10:00:00Z", "endDate": "2024-05-01T11:00:00Z", "x": "y" * 2000}}).encode()
def text():
    yield b'{{"timelineItems": [' + item
    for _ in range({n} // 100):
        yield b"," + b",".join([item] * 100)
    yield {end!r}
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = errors = 0
for r in hs.rows_of(text):
    rows += r[4] is None
    errors += r[4] is not None
print(rows, errors, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize(("end", "want"), [(b"]}", (100_001, 0)), (b"]", (0, 1))])
def test_a_large_text_takes_little_memory(end, want):
    """More than 200 MB, sound and cut off: all rows or one error, and less than 150 MB more memory than at the start."""
    code = MEMORY.format(root=str(Path(__file__).parent.parent), n=100_000, end=end)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert (int(out[0]), int(out[1])) == want and int(out[2]) < 150


def test_an_entry_is_whole_or_an_error():
    text = json.dumps([{"placeId": f"p{k}"} for k in range(500)]).encode()
    for held in (0, 1_000, 1 << 30):
        assert [json.loads(r[3])["placeId"] for r in history_source.rows_of(lambda: cut(text, 100), held)] == [f"p{k}" for k in range(500)]
        rows = list(history_source.rows_of(lambda: cut(text[:-1], 100), held))
        assert len(rows) == 1 and rows[0][:4] == (None,) * 4 and rows[0][4]


@pytest.fixture
def wide(tmp_path):
    with zipfile.ZipFile(tmp_path / "wide.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(20_000):
            z.writestr(f"b/{k}.json", json.dumps({"placeId": f"p{k}"}))
    return tmp_path


def test_an_archive_is_opened_once_for_each_partition(wide, monkeypatch):
    opens, listed = [], []
    opening, reading = history_source.open_file, zipfile.ZipFile._RealGetContents
    monkeypatch.setattr(history_source, "open_file", lambda where, path: opens.append(path) or opening(where, path))
    monkeypatch.setattr(zipfile.ZipFile, "_RealGetContents", lambda z: listed.append(1) or reading(z))
    reader = history_source.HistoryReader({"path": f"file:{wide}", "history": "h", "partitionBytes": str(4 << 20)})
    planned = reader.partitions()
    assert len(opens) == len(listed) == 1 and len(planned) > 3
    rows = sum(len(b) for p in planned for b in reader.read(p))
    assert rows == 20_000 and len(opens) == 1 + len(planned) and len(listed) == 1


def test_partitions_are_planned_by_decoded_size(tmp_path):
    body = json.dumps([{"placeId": "p", "x": "y" * 100_000}] * 30).encode()
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(body))
    (tmp_path / "b.json").write_bytes(body)
    for k in range(10):
        (tmp_path / f"c{k}.json").write_bytes(body[:200])
    reader = history_source.HistoryReader({"path": str(tmp_path), "history": "h", "partitionBytes": str(2 << 20)})
    shares = [[Path(e.file).name[0] for e in p.entries()] for p in reader.partitions()]
    assert shares == [["a"], ["b"], ["c"] * 10]
    estimates = {Path(e.file).name: e.estimate for p in reader.partitions() for e in p.entries()}
    assert estimates["a.json.gz"] == estimates["b.json"] == len(body)


def test_the_source_in_spark(spark, wide):
    found = archive.read_archives(spark, str(wide), "h")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("error is null").select("raw").distinct().count() == 20_000
    (wide / "bad.json").write_text('[{"placeId": "q"}, ')
    rows = archive.read_archives(spark, str(wide), "h").where("path like '%bad.json'").collect()
    assert len(rows) == 1 and rows[0].error and rows[0].raw is None


@pytest.mark.parametrize("form", ["relative", "plain", "uri", "short"])
def test_histories_are_folders_however_the_root_is_written(spark, tmp_path, form, monkeypatch):
    for user in ("ann", "bob b"):
        (tmp_path / "in" / user / "deep").mkdir(parents=True)
        (tmp_path / "in" / user / "deep" / "a.json").write_text(json.dumps({"timelineItems": [ITEM]}))
        with zipfile.ZipFile(tmp_path / "in" / user / "z.zip", "w") as z:
            z.writestr("p.json", json.dumps({"placeId": "p"}))
    folder = {"relative": os.path.relpath(tmp_path / "in"), "plain": f"{tmp_path}/in/", "uri": f"file://{tmp_path}/in", "short": f"file:{tmp_path}/in"}[form]
    want = [("ann", "export-item"), ("ann", "place"), ("bob b", "export-item"), ("bob b", "place")]
    assert sorted((r.history_id, r.kind) for r in archive.read_archives(spark, folder).collect()) == want
    monkeypatch.setattr(archive, "_history_source", lambda *a, **k: None)
    assert sorted((r.history_id, r.kind) for r in archive.read_archives(spark, folder).collect()) == want


@pytest.mark.parametrize("by_spark", [False, True])
def test_a_file_without_a_history_is_an_error(spark, tmp_path, by_spark, monkeypatch):
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann/a.json").write_text("[]")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/p.json", json.dumps({"placeId": "p"}))
    if by_spark:
        monkeypatch.setattr(archive, "_history_source", lambda *a, **k: None)
    with pytest.raises(Exception, match="histor"):
        archive.read_archives(spark, str(tmp_path)).collect()
    assert [r.kind for r in archive.read_archives(spark, str(tmp_path), "h").collect()] == ["place"]


def test_a_scan_reads_as_little_as_it_can(spark, tmp_path):
    long = json.dumps({"timelineItems": [ITEM] * 100_000})
    files = {"a.json": long, "TimelineItem/1.json": "not read", "Place/2.json": "", "b.json": json.dumps([3, {"no": 1}]), "TimelineRangeSummary/c.json": json.dumps({"dateRange": {"start": "x", "duration": 1}}), "d.json": "[1", "TimelineRangeSummary/e.json": json.dumps([{"dateRange": {"start": "x", "duration": 1}}, {"placeId": "p"}])}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.json", long)
    (tmp_path / "z.zip").write_bytes(out.getvalue())
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.supported, bool(r.error)) for r in archive.scan_folder(spark, str(tmp_path), "h").collect()}
    assert got == {
        "a.json": ("export-item", True, False), "1.json": ("stored-item", True, False), "2.json": ("place", True, False), "b.json": (None, False, False), "c.json": ("range-summary", False, False),
        "d.json": (None, False, True), "e.json": ("place", True, False), "big.json": ("export-item", True, False),
    }
    read = {r.path.rsplit("/", 1)[-1]: r.bytes_read for r in archive.scan_folder(spark, str(tmp_path), "h").collect()}
    assert read["1.json"] == read["2.json"] == 0 and read["a.json"] <= json_stream.PIECE and read["big.json"] <= 2 * json_stream.PIECE < len(long)


def test_entries_that_declare_a_wrong_size_or_checksum():
    import zlib

    body = b'[{"placeId":"p"}]'
    packed = zlib.compress(body)[2:-4]
    assert b"".join(json_stream.inflated([packed], len(body), zlib.crc32(body), 8)) == body
    assert b"".join(json_stream.inflated(cut(body, 3), len(body), zlib.crc32(body), 0)) == body
    for args in (([packed], len(body) - 1, zlib.crc32(body), 8), ([packed], len(body) + 1, zlib.crc32(body), 8), ([packed], len(body), 1, 8), ([packed[:-2]], len(body), zlib.crc32(body), 8), ([packed + b"x"], len(body), zlib.crc32(body), 8), ([body], len(body), zlib.crc32(body), 14)):
        with pytest.raises(json_stream.Damaged):
            list(json_stream.inflated(*args))


def test_exported_items_are_written_by_their_tasks(spark, tmp_path):
    """A file for each text and none beside it, read as Spark's own writer leaves them; also from no rows."""
    item = {"itemId": "é1", "isVisit": False, "startDate": "2024-01-01T00:00:00Z", "endDate": "2024-01-01T00:01:00Z"}
    kind = "history long, name string, timelineItems array<struct<itemId string, isVisit boolean, startDate string, endDate string>>"
    rows = [(h, m, [item | {"itemId": f"{h}-{m}-{k}"} for k in range(3)]) for h in (1, 2) for m in ("2024-01", "2024-02")] + [(3, "2024-01", [item])]
    texts = spark.createDataFrame(rows, kind)
    archive.write_items(texts, str(tmp_path / "own"))
    assert sorted(str(p.relative_to(tmp_path / "own")) for p in (tmp_path / "own").rglob("*") if p.is_file()) == ["history=1/2024-01.json", "history=1/2024-02.json", "history=2/2024-01.json", "history=2/2024-02.json", "history=3/2024-01.json"]
    texts.drop("name").repartition("history").write.option("maxRecordsPerFile", 1).partitionBy("history").json(str(tmp_path / "spark"))
    told = lambda name: sorted((r.history_id, r.kind, r.raw) for r in archive.read_archives(spark, str(tmp_path / name)).collect())
    assert told("own") == told("spark") and len(told("own")) == 13
    archive.write_items(texts.limit(0), str(tmp_path / "none"))
    assert told("none") == []
