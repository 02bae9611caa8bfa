"""Best-fit packing of token sequences by length patterns.

The histogram of piece lengths is all that the packing depends on. Patterns of
up to three lengths that fill a sequence are enumerated, their repeat counts
are fitted to the histogram by non-negative least squares and rounded, and
what is left is packed best-fit. Each piece then finds its place from the rank
it has among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm import tokens
from chronofold.llm.common import kept, lean, stored


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All ascending triples of the given lengths, 0 for none, that sum up to ``size``."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    have[0] = True
    a = np.flatnonzero(have)
    a = a[a <= size // 3]
    found = []
    for x in a:
        b = np.arange(x, (size - x) // 2 + 1)
        b = b[have[b] & have[size - x - b] & ((b > 0) | (x == 0))]
        found.append(np.stack([np.full(len(b), x), b, size - x - b], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(counts: np.ndarray, shapes: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with least ||A x - counts||, by multiplicative steps."""
    size = len(counts)
    x = np.ones(len(shapes))
    real = shapes > 0

    def times(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(shapes[:, k], x * real[:, k], size) for k in range(3))

    def transposed(y: np.ndarray) -> np.ndarray:
        return (y[shapes] * real).sum(1)

    target = transposed(counts.astype(float))
    for _ in range(steps):
        x *= target / np.maximum(transposed(times(x)), 1e-12)
    return x


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which use each length as often as ``counts`` says.

    ``counts[l]`` is the number of pieces of length l, for l up to ``size``.
    The number of patterns is bounded by ``size`` and not by the pieces.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0

    def take(shape: tuple[int, ...], most: int) -> None:
        lengths, times = np.unique(shape, return_counts=True)
        n = int(min(most, (left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            out.append((shape, n))

    shapes = patterns(np.flatnonzero(left), size)
    if len(shapes):
        x = np.rint(fit(left, shapes))
        for k in sorted(np.flatnonzero(x > 0), key=lambda k: (-x[k], k)):
            take(tuple(int(v) for v in shapes[k][::-1] if v), int(x[k]))
    for longest in range(size, 0, -1):  # the rest: each sequence takes the longest that still fits
        while left[longest]:
            shape, room, used = [longest], size - longest, {longest: 1}
            while room:
                fits = np.flatnonzero(left[1 : room + 1])
                while len(fits) and left[fits[-1] + 1] <= used.get(int(fits[-1]) + 1, 0):
                    fits = fits[:-1]
                if not len(fits):
                    break
                length = int(fits[-1]) + 1
                shape.append(length)
                used[length] = used.get(length, 0) + 1
                room -= length
            take(tuple(shape), int(left[longest]))
    return out


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each pattern and length in it: the ranks that go there and where they lie."""
    rows, used, first = [], {}, 0
    for shape, n in planned:
        at, slots = 0, {}
        for length in shape:
            slots.setdefault(length, at)
            at += length
        for length, offset in slots.items():
            times = shape.count(length)
            rows.append((length, used.get(length, 0), times, offset, first))
            used[length] = used.get(length, 0) + times * n
        first += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "offset", "first"), table.T, strict=True))


def pieces(docs: DataFrame, *, text: str, doc_id: str, path: str, size: int, end_id: int) -> DataFrame:
    """Each document's pieces, with a rank among the pieces of its length within the task that made it."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = tokens.encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        tail = np.array([end_id], "<u4")
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, begin in encode.batches(batch.column(1)):
                rows = []
                for j in range(len(begin) - 1):
                    own = np.append(ids[begin[j] : begin[j + 1]], tail)
                    at, n = 0, len(own) % size or size
                    piece = 0
                    while at < len(own):
                        rows.append((doc_ids[first + j], piece, at, n, zlib.crc32(own[at : at + n]), part, int(seen[n])))
                        seen[n] += 1
                        at, n, piece = at + n, size, piece + 1
                if rows:
                    columns = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens: a row for each piece.

    A document is its ids and ``end_id``; only a longer one is cut, into
    ``size``-token pieces of which the first may be shorter. A null or empty
    text is ``end_id`` alone. Repeated rows, equal and null doc_ids are packed
    as documents of their own; an empty table gives no rows; other columns are
    ignored. Rows: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. What reaches the driver is the histogram, at most ``size`` rows,
    and the table of places that goes back is bounded by the patterns.
    """
    cut = stored(pieces(docs, text=text, doc_id=doc_id, path=path or tokens.default_path(), size=size, end_id=end_id))
    by_task = kept(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    where = places(plan(counts, size))
    step = int(counts.max()) + 1
    keys = where["length"] * step + where["rank"]
    base = by_task.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            j = np.searchsorted(keys, length * step + rank, "right") - 1
            ahead = rank - where["rank"][j]
            sequence = where["first"][j] + ahead // where["times"][j]
            offset = where["offset"][j] + ahead % where["times"][j] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_pattern_packing(spark, sf_dir: str) -> DataFrame:
    from chronofold.llm.common import table

    return pack(table(spark, sf_dir, "documents"))
