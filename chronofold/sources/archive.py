"""Archives of JSON histories: plain, gzip and zip files, and what their values are.

:mod:`chronofold.sources.history_source` reads them. A file counts as a whole: if any of it is damaged, it yields one error and no
values. Files and zip entries are told apart by ``path``; the order of values
within one is ``pos``.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.scalars import timestamp_s
from chronofold.functions.times import at_least_0, point, record, records, seconds, string
from chronofold.operators.fusion import clean_account, usable, usable_summary
from chronofold.sources import json_stream
from chronofold.sources.json_stream import Damaged, plain_pieces

VALUES = "path string, shape string, pos bigint, kind string, raw string, error string"


def plain(path: str, data: bytes) -> bytes:
    return b"".join(plain_pieces(path, [data]))


def normal_path(name: str) -> str:
    return name.replace("\\", "/").lstrip("/")


def entries(path: str, data: bytes) -> Iterator[tuple[str, bytes | Damaged]]:
    """(path, bytes) of a file, or of each file in a zip; an error takes the place of the bytes."""
    if not (path.lower().endswith(".zip") or data[:4] == b"PK\x03\x04"):
        yield path, data
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError) as e:
        yield path, Damaged(f"zip: {e}")
        return
    for info in archive.infolist():
        if wanted(info):
            yield f"{path}!/{normal_path(info.filename)}", entry_bytes(archive, info)


def wanted(info: zipfile.ZipInfo) -> bool:
    return not info.is_dir() and is_json_path(normal_path(info.filename))


def entry_bytes(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes | Damaged:
    """An entry's bytes, stored or deflated, with its size and checksum verified."""
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return Damaged(f"zip: compression method {info.compress_type}")
    try:
        body = archive.read(info)
    except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError) as e:
        return Damaged(f"zip: {e}")
    return body if len(body) == info.file_size else Damaged("zip: wrong size")


def is_json_path(path: str) -> bool:
    return path.lower().endswith((".json", ".json.gz"))


def values(body: bytes) -> tuple[str, list]:
    """The shape of a JSON text and the values it stands for."""
    found = list(json_stream.values([body]))
    return (found[0][0], [v for _, v in found]) if found else (shape_of_none(body), [])


def shape_of_none(body: bytes) -> str:
    return "root-array" if body.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"[" else "timeline-items"


def is_range_summary(value: dict) -> bool:
    span = record(value.get("dateRange"))
    return string(span.get("start")) is not None and at_least_0(span.get("duration")) is not None


def is_day(value: dict) -> bool:
    """A date with any segment or summary that says something."""
    return string(value.get("date")) is not None and (any(map(usable, records(value.get("segments")))) or any(map(usable_summary, records(value.get("summary")))))


def is_observation(value: dict) -> bool:
    """A time of 1970 or later, with a place or an activity."""
    where = record(value.get("location")) or value
    ts = seconds(string(where.get("timestamp")) or string(value.get("date")))
    told = any(string(value.get(k)) for k in ("confirmedType", "coreMotionActivityType", "movingState"))
    return ts is not None and ts >= 0 and (told or point(where) is not None)


def has_identity(item: dict) -> bool:
    return string(item.get("itemId")) is not None or None not in (seconds(item.get("startDate")), seconds(item.get("endDate")))


def kind_of(value: object, shape: str) -> tuple[str, str | None]:
    """What a value is, and what is wrong with it: an exported item, a stored item, place, sample or summary, a day, something deleted, or unknown."""
    if not isinstance(value, dict):
        return "unknown", "not an object"
    if shape == "timeline-items":
        if not isinstance(value.get("isVisit"), bool) or not string(value.get("startDate")) or not string(value.get("endDate")):
            return "unknown", "an item without isVisit, startDate or endDate"
        return ("export-item", None) if has_identity(value) else ("unknown", "an item without identity")
    if is_range_summary(value):
        return "range-summary", None
    for key, kind in (("itemId", "stored-item"), ("placeId", "place"), ("sampleId", "sample")):
        if string(value.get(key)):
            if kind == "sample" and value.get("deleted") is not True and not is_observation(value):
                return "unknown", "a sample without time, or without place and activity"
            return kind, None
    if is_day(value):
        bad = seconds(f"{value['date']}T000000") is None
        return ("unknown", "a day that the calendar doesn't have") if bad else ("day", None)
    if value.get("deleted") is True:
        return "deleted", None
    return ("sample", None) if is_observation(value) else ("unknown", "nothing known")


def decoded(path: str, data: bytes) -> Iterator[dict]:
    """The values of a file or archive, with their kinds. One that isn't valid has an error and kind unknown; a damaged file has one error and no values."""
    for name, body in entries(path, data):
        yield from values_of(name, body)


def values_of(name: str, body: bytes | Damaged) -> list[dict]:
    try:
        if isinstance(body, Damaged):
            raise body
        shape, found = values(plain(name, body))
        rows = []
        for k, v in enumerate(found):
            kind, wrong = kind_of(v, shape)
            v = clean_account(v) if kind == "day" else v
            rows.append({"path": name, "shape": shape, "pos": k, "kind": kind, "raw": json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")), "error": wrong})
        return rows
    except Damaged as e:
        return [{"path": name, "shape": None, "pos": None, "kind": None, "raw": None, "error": str(e)}]


#: Folders of archives, in the order in which they decide; paths begin with a slash and are in lower case.
_FOLDERS = (
    ("day", r"/json/(daily|weekly|monthly|yearly)/storyline/|/json/full/storyline[.]json([.]gz)?$"),
    ("export-item", r"/export/json/(daily|monthly)/|^/json/(daily|monthly)/"),
    ("stored-item", r"/timelineitem/"),
    ("sample", r"/locomotionsample/"),
    ("place", r"/place/"),
    ("range-summary", r"/timelinerangesummary/"),
)


def folder_kind(path: str) -> str | None:
    """:func:`path_kind` of one path."""
    text = "/" + path.replace("\\", "/").lower()
    return next((kind for kind, pattern in _FOLDERS if re.search(pattern, text)), None)


def path_kind(path: Column | str) -> Column:
    """What a file should hold by the folder that it is in; null where the path doesn't say."""
    text = F.concat(F.lit("/"), F.lower(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(_FOLDERS):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def _batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    names = ["path", "shape", "pos", "kind", "raw", "error"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for at in range(0, len(rows), 1000):
        part = rows[at : at + 1000]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], t) for n, t in zip(names, kinds, strict=True)], names)


def decode_files(files: DataFrame) -> DataFrame:
    """(path, content) rows as values; files that are neither JSON nor zip don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches(list(decoded(path.as_py(), content.as_py() or b"")))

    json_or_zip = files.where(F.lower("path").rlike(r"\.(json|json\.gz|zip)$"))
    return json_or_zip.select("path", "content").mapInArrow(run, VALUES)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's URI with scheme and authority, as Spark resolves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _history_source(spark: SparkSession, root: str, history: str | None, **options: str) -> DataFrame | None:
    """The folder through the data source; None where its file system is one that only Spark can read."""
    from chronofold.sources import history_source

    try:
        history_source.located(root)
    except (pa.ArrowException, OSError, ImportError):
        return None
    spark.dataSource.register(history_source.HistorySource)
    options |= {"parallelism": str(spark.sparkContext.defaultParallelism)} | ({"history": history} if history is not None else {})
    return spark.read.format("history").options(**options).load(root)


def write_items(texts: DataFrame, folder: str) -> None:
    """Rows (history, name, timelineItems) as exported JSON texts, a file ``history=<history>/<name>.json`` each.

    Tasks write files themselves, as :mod:`history_source` reads them: one of
    Spark's own writer takes some twenty milliseconds, which for many small
    texts is most of the work. Where only Spark can open the file system, it writes.
    """
    from chronofold.sources import history_source

    root = qualified(texts.sparkSession, folder)
    try:
        where, top = history_source.located(root)
    except (pa.ArrowException, OSError, ImportError):
        texts.drop("name").repartition("history").write.option("maxRecordsPerFile", 1).partitionBy("history").json(folder)
        return
    where.create_dir(top, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = history_source.located(root)
        for batch in batches:
            for history, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where.create_dir(f"{top}/history={history}", recursive=True)
                with where.open_output_stream(f"{top}/history={history}/{name}.json") as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    history = F.coalesce(F.col("history").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    texts.select(history, F.coalesce("name", F.lit("none")), F.to_json(F.struct("timelineItems"))).mapInArrow(put, "n long").agg(F.sum("n")).collect()


def read_archives(spark: SparkSession, folder: str, history: str | None = None) -> DataFrame:
    """(history_id, and the columns of VALUES) of the files below a folder.

    All are of one ``history``, or else each folder right below is a history of
    its own, and a file that isn't in one is an error. Where only Spark can open
    the file system, files are read as a whole.
    """
    root = qualified(spark, folder)
    found = _history_source(spark, root, history)
    if found is not None:
        return found
    files = decode_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))
    if history is not None:
        return files.select(F.lit(history).alias("history_id"), "*")
    return files.select(history_of(root).alias("history_id"), "*")


def history_of(root: str) -> Column:
    """The folder right below the qualified ``root`` that a path lies in; an error if there is none."""
    found = F.regexp_extract("path", "^\\Q" + root + "\\E/+([^/!]+)/", 1)
    outside = F.col("path").rlike("^\\Q" + root + "\\E/+[^/]+!/") | (found == "")
    return F.when(outside, F.raise_error(F.concat(F.lit("no folder that would be a history: "), "path"))).otherwise(found)


def scan_folder(spark: SparkSession, folder: str, history: str | None = None) -> DataFrame:
    """What a folder holds, without reading it whole: history_id, path, kind, supported, bytes_read, error for each entry.

    A folder's name that tells is trusted, and nothing is read. Otherwise an
    entry is read up to its first value that can be imported.
    """
    found = _history_source(spark, qualified(spark, folder), history, mode="probe")
    if found is None:
        raise ValueError(f"only Spark can open {folder}: read it and use scan_summary")
    return found


def scan_summary(found: DataFrame) -> DataFrame:
    """For each file: its values, their kinds, whether any of it can be imported, and the first error."""
    good = F.coalesce(~F.col("kind").isin("unknown", "range-summary"), F.lit(False))
    kinds = F.array_sort(F.collect_set(F.when(F.col("kind") != "unknown", F.col("kind"))))
    by = [c for c in ("history_id", "path") if c in found.columns]
    return found.groupBy(*by).agg(F.count("raw").alias("n_values"), kinds.alias("dialects"), F.max(good).alias("supported"), F.min_by("error", F.when(F.col("error").isNotNull(), F.coalesce("pos", F.lit(-1)))).alias("error"), F.count("error").alias("n_errors"))


def item_key(raw: Column | str) -> Column:
    """``id:`` and the item's id, or ``time:`` with its window and kind; null if it has neither."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    get = lambda key: F.get_json_object(raw, f"$.{key}")
    kind = F.when(get("isVisit") == "true", "stay").otherwise("move")
    window = F.concat(F.lit("time:"), timestamp_s(get("startDate")).cast("string"), F.lit("|"), timestamp_s(get("endDate")).cast("string"), F.lit("|"), kind)
    return F.coalesce(F.concat(F.lit("id:"), F.nullif(get("itemId"), F.lit(""))), window)
