"""Token ids in files of length-delimited binary records.

A shard ``part-NNNNN.rec`` holds one record for each document:

    uint64  length of the payload
    uint32  masked CRC of those eight bytes
    payload: int64 doc_id, uint8 1 if doc_id is null, uint8 bytes of an id (2 or 4), ids
    uint32  masked CRC of the payload

all little-endian. The mask rotates the CRC-32 right by 15 bits and adds a
constant, so that data which holds checksums of its own can be framed too.
``part-NNNNN.idx`` beside it holds the offset of each record as uint64, for
reads in any order. Shards in the order of their numbers hold the documents in
ascending doc_id order, nulls first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import tokens
from chronofold.llm.common import lean, shared_dir

MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qBB")
_CRC = struct.Struct("<I")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _CRC.pack(masked(length)), payload, _CRC.pack(masked(payload))))


def unframe(read) -> bytes | None:
    """The next payload of ``read(n)``, None at the end; ValueError where a length or a checksum is wrong."""
    head = read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or masked(head[:8]) != _HEAD.unpack(head)[1]:
        raise ValueError("the length of a record is damaged")
    n = _HEAD.unpack(head)[0]
    body = read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != _CRC.unpack(body[n:])[0]:
        raise ValueError("a record is damaged")
    return body[:n]


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _BODY.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = _BODY.unpack_from(data)
    return None if null else doc_id, np.frombuffer(data, f"<u{width}", offset=_BODY.size)


def read_shard(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a shard in order, a few MB in memory at once."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_stream(name, buffer_size=1 << 22) as f:
        while (data := unframe(f.read)) is not None:
            yield parse(data)


def read_records(path: str, picks: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records with the given numbers of a shard, in that order, by its index."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name.removesuffix(".rec") + ".idx") as f:
        offsets = np.frombuffer(f.read(), "<u8")
    with where.open_input_file(name) as f:
        for k in picks:
            f.seek(int(offsets[k]))
            yield parse(unframe(f.read))


def write_token_records(docs: DataFrame, out: str, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end_id: int = 0) -> list[tuple[int, str, int, int]]:
    """Write the ids of every text, with ``end_id`` after them; (shard, path, records, ids) of each shard.

    Documents are dealt to the shards by ranges of (doc_id, hash of the text),
    so one id that many rows share doesn't fill a shard. Rows with equal ids
    stand together, ordered by that hash; each is a record of its own. Null
    ids come first, a null text counts as empty, other columns aren't read. An
    empty table gives no shards. A task writes under a name of its own and
    renames at its end, so that a task which runs again leaves the same file.
    """
    path = path or tokens.default_path()
    width = 2 if max(tokens.tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    where, folder = fs.FileSystem.from_uri(out)
    where.create_dir(folder, recursive=True)
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    @lean
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode = TaskContext.get(), tokens.encoder(path)
        where, folder = fs.FileSystem.from_uri(out)
        name = f"{folder}/part-{context.partitionId():05d}"
        own = f"{folder}/.{context.partitionId()}-{context.taskAttemptId()}"
        offsets, at, n_ids, f = [], 0, 0, None
        tail = np.array([end_id], "<u4")
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, begin in encode.batches(batch.column(1)):
                f = f or where.open_output_stream(own, buffer_size=1 << 20)
                for k in range(len(begin) - 1):
                    framed = frame(payload(doc_ids[first + k], np.append(ids[begin[k] : begin[k + 1]], tail), width))
                    f.write(framed)
                    offsets.append(at)
                    at += len(framed)
                    n_ids += int(begin[k + 1] - begin[k]) + 1
        if f:
            f.close()
            with where.open_output_stream(own + "i") as g:
                g.write(np.array(offsets, "<u8").tobytes())
            where.move(own + "i", name + ".idx")
            where.move(own, name + ".rec")
            yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "path": f"{out}/part-{context.partitionId():05d}.rec", "records": len(offsets), "ids": n_ids}])

    shards = dealt.select("doc_id", "text").mapInArrow(write, "shard long, path string, records long, ids long").collect()  # a row for each shard
    for left in where.get_file_info(fs.FileSelector(folder)):  # by tasks that didn't end
        if left.base_name.startswith("."):
            where.delete_file(left.path)
    return sorted(tuple(r) for r in shards)


def scan_token_records(spark, shards: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record, read from the files; a shard is a task."""
    starts, total = [], 0
    for _, path, _, ids in shards:
        starts.append((path, total))
        total += ids
    schema = "path string, base long"
    listed = spark.createDataFrame(spark.sparkContext.parallelize(starts, len(starts)), schema) if starts else spark.createDataFrame([], schema)

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for doc_id, ids in read_shard(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op9_token_records(spark, sf_dir: str) -> DataFrame:
    from chronofold.llm.common import table

    shards = write_token_records(table(spark, sf_dir, "documents"), shared_dir(spark))
    return scan_token_records(spark, shards)
