"""``spark.read.format("history")``: archives of histories as a data source with planned partitions.

Planning lists the folder and reads the directory of each zip file once. What it
makes are entries: where one begins, how long it is packed and unpacked, how it
is packed. They are dealt to partitions by the size that they are estimated to
have once decoded, in the order of their files, so that a task opens a file once
for all of its entries that it reads. There is no shuffle.

A task reads an entry piece by piece. Rows of an entry go out when it has been
read to its end without damage; what is larger than HELD_BYTES is read once to
see that it is sound and again for its rows, so that memory stays bounded.
"""

from __future__ import annotations

import json
import pickle
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronofold.sources import archive
from chronofold.sources.json_stream import PIECE, Damaged, inflated, plain_pieces, values

VALUES = "history_id string, path string, shape string, pos bigint, kind string, raw string, error string"
PROBES = "history_id string, path string, kind string, supported boolean, bytes_read bigint, error string"
#: Bytes of a partition once decoded.
PARTITION_BYTES = 64 << 20
#: Bytes of rows of one entry that a task holds until it knows that the entry is sound.
HELD_BYTES = 32 << 20
#: What deflated JSON grows to at least, for estimates.
GROWTH = 4
ROWS = 1000


class Entry(NamedTuple):
    """A JSON text: a file, or part of a zip file. ``method`` is None for a file; ``error`` is what is wrong with it already."""

    history: str
    path: str
    file: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int | None
    error: str | None
    estimate: int


class Share(InputPartition):
    """The entries of a partition."""

    def __init__(self, entries: list[Entry]) -> None:
        self.packed = zlib.compress(pickle.dumps([tuple(e) for e in entries]), 1)

    def entries(self) -> list[Entry]:
        return [Entry(*e) for e in pickle.loads(zlib.decompress(self.packed))]


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified URI and the path in it."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", uri) or uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    top, rest = re.match(r"([^:]+://[^/]*)(.*)", uri).groups()
    where, base = fs.FileSystem.from_uri(top + "/")
    return where, base.rstrip("/") + rest


def open_file(where: fs.FileSystem, path: str) -> pa.NativeFile:
    """A file for reading anywhere in it."""
    return where.open_input_file(path)


def read_at(f: pa.NativeFile, offset: int, length: int) -> Iterator[bytes]:
    f.seek(offset)
    while length > 0 and (piece := f.read(min(PIECE, length))):
        length -= len(piece)
        yield piece


def _declared(f: pa.NativeFile, end: int) -> int:
    """The size that a gzip member declares in its last four bytes."""
    f.seek(end - 4)
    return int.from_bytes(f.read(4), "little")


def entries_of(where: fs.FileSystem, info: fs.FileInfo, history: str, path: str) -> list[Entry]:
    """The entries of a file: itself, or those of a zip file, from one read of its directory."""
    lower = info.path.lower()
    if not lower.endswith(".zip"):
        estimate = info.size
        if lower.endswith(".gz"):
            with open_file(where, info.path) as f:
                estimate = max(info.size * GROWTH, _declared(f, info.size) if info.size >= 18 else 0)
        return [Entry(history, path, info.path, 0, info.size, info.size, 0, None, None, estimate)]
    out = []
    try:
        with open_file(where, info.path) as f, zipfile.ZipFile(f) as z:
            for e in z.infolist():
                if not archive.wanted(e):
                    continue
                name = archive.normal_path(e.filename)
                wrong = "zip: encrypted" if e.flag_bits & 1 else None
                out.append(Entry(history, f"{path}!/{name}", info.path, e.header_offset, e.compress_size, e.file_size, e.CRC, e.compress_type, wrong, e.file_size * (GROWTH if name.lower().endswith(".gz") else 1)))
    except (zipfile.BadZipFile, NotImplementedError, ValueError) as e:
        return [Entry(history, path, info.path, 0, 0, 0, 0, None, f"zip: {e}", 0)]
    return sorted(out, key=lambda e: e.offset)


def shares(entries: Iterable[Entry], most: int) -> list[list[Entry]]:
    """Entries in their order, cut where a share would get more than ``most`` bytes; a larger entry is a share of its own."""
    out, now, size = [], [], 0
    for e in entries:
        cost = e.estimate + 1000
        if now and size + cost > most:
            out.append(now)
            now, size = [], 0
        now.append(e)
        size += cost
    return [*out, now] if now else out


class Opened:
    """The file that a task reads from, kept open while entries are of the same file."""

    def __init__(self, root: str) -> None:
        self.where, _ = located(root)
        self.path, self.f = None, None

    def at(self, path: str) -> pa.NativeFile:
        if path != self.path:
            self.close()
            self.path, self.f = path, open_file(self.where, path)
        return self.f

    def close(self) -> None:
        if self.f is not None:
            self.f.close()
        self.path = self.f = None


def pieces(opened: Opened, e: Entry) -> Iterator[bytes]:
    """The content of an entry, decoded and verified, in pieces."""
    if e.error:
        raise Damaged(e.error)
    f = opened.at(e.file)
    if e.method is None:
        yield from plain_pieces(e.path, read_at(f, 0, e.packed))
        return
    f.seek(e.offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise Damaged("zip: no local header")
    begin = e.offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    yield from plain_pieces(e.path, inflated(read_at(f, begin, e.packed), e.size, e.crc, e.method))


def rows_of(found: Callable[[], Iterator[bytes]], held_bytes: int = HELD_BYTES) -> Iterator[tuple]:
    """(shape, pos, kind, raw, error) of an entry's values; one row with an error if any of it is damaged."""

    def rows(every: bool) -> Iterator[tuple]:
        for pos, (shape, value) in enumerate(values(found())):
            if every or held is not None:
                kind, wrong = archive.kind_of(value, shape)
                value = archive.clean_account(value) if kind == "day" else value
                yield shape, pos, kind, json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), wrong

    held, size = [], 0
    try:
        for row in rows(False):
            held.append(row)
            size += len(row[3]) + 200
            if size > held_bytes:
                held = None
    except Damaged as e:
        yield None, None, None, None, str(e)
        return
    yield from rows(True) if held is None else held


def probe(e: Entry, found: Callable[[], Iterator[bytes]]) -> tuple:
    """(kind, supported, bytes read, error) of an entry: by its folder, or else by its values up to the first that can be imported."""
    kind = archive.folder_kind(e.path)
    if kind and kind != "range-summary":
        return kind, True, 0, None
    read, kind = 0, None

    def counted() -> Iterator[bytes]:
        nonlocal read
        for piece in found():
            read += len(piece)
            yield piece

    try:
        for shape, value in values(counted()):
            of = "export-item" if shape == "timeline-items" else archive.kind_of(value, shape)[0]
            if of == "unknown":
                continue
            kind = of
            if of != "range-summary":
                return kind, True, read, None
    except Damaged as wrong:
        return None, False, read, str(wrong)
    return kind, False, read, None


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5] or "") if len(row) == len(schema) == 7 else 0
        if len(held) >= ROWS or size > PARTITION_BYTES // 8:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_VALUES = pa.schema([(n, pa.int64() if n == "pos" else pa.string()) for n in ("history_id", "path", "shape", "pos", "kind", "raw", "error")])
_PROBES = pa.schema([("history_id", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("supported", pa.bool_()), ("bytes_read", pa.int64()), ("error", pa.string())])


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.history = options.get("history")
        self.probing = options.get("mode") == "probe"
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.least = int(options.get("parallelism", 1))

    def files(self) -> list[tuple[fs.FileInfo, str, str]]:
        """(file, history, qualified path) of the JSON and zip files below the root, by path."""
        where, top = located(self.root)
        found = [i for i in where.get_file_info(fs.FileSelector(top, recursive=True)) if i.type == fs.FileType.File and re.search(r"\.(json|json\.gz|zip)$", i.path.lower())]
        out = []
        for info in sorted(found, key=lambda i: i.path):
            inner = info.path[len(top.rstrip("/")) :].lstrip("/")
            if self.history is None and "/" not in inner:
                raise ValueError(f"{inner} lies right below {self.root}: it has no folder that would be its history; name one history for all files")
            out.append((info, inner.split("/")[0] if self.history is None else self.history, f"{self.root}/{inner}"))
        return out

    def partitions(self) -> list[Share]:
        where, _ = located(self.root)
        with ThreadPoolExecutor(16) as pool:
            entries = [e for found in pool.map(lambda x: entries_of(where, *x), self.files()) for e in found]
        total = sum(e.estimate + 1000 for e in entries)
        most = max(1 << 20, min(self.most, -(-total // max(1, self.least))))
        return [Share(s) for s in shares(entries, most)] or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        opened = Opened(self.root)

        def rows() -> Iterator[tuple]:
            for e in partition.entries():
                found = lambda e=e: pieces(opened, e)
                if self.probing:
                    yield (e.history, e.path, *probe(e, found))
                else:
                    yield from ((e.history, e.path, *row) for row in rows_of(found))

        try:
            yield from _batches(rows(), _PROBES if self.probing else _VALUES)
        finally:
            opened.close()


class HistorySource(DataSource):
    """Options: ``path``, a qualified folder; ``history``, one for all files, else folders right below are histories;
    ``mode``, values or probe; ``partitionBytes`` and ``parallelism``."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return PROBES if self.options.get("mode") == "probe" else VALUES

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(dict(self.options))
