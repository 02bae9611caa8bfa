"""The binary codec of routes.

Layout, little-endian: magic u32, version u8, flags u8, quantization u16 in cm,
count u32, first longitude and latitude i64, then for each further point the
differences of longitude and latitude as zigzag varints of 32 bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC = 0x42514443
VERSION = 1
FLAGS = 0
DEFAULT_CM = 100
_HEADER = struct.Struct("<IBBHIqq")


def quantize(v: np.ndarray, cm: int) -> np.ndarray:
    return np.floor(np.asarray(v, float) * (1e7 / (cm / 100)) + 0.5).astype(np.int64)


def encode(lon: list[float], lat: list[float], cm: int = DEFAULT_CM) -> bytes:
    """A route as bytes; ValueError for no points, a bad quantization, bad coordinates or steps beyond 32 bits."""
    x, y = np.asarray(lon, float), np.asarray(lat, float)
    if not len(x) or len(x) != len(y):
        raise ValueError("a route needs points")
    if not 1 <= cm <= 65535:
        raise ValueError("quantization must be 1 to 65535 cm")
    if not (np.isfinite(x) & np.isfinite(y) & (abs(x) <= 180) & (abs(y) <= 90)).all():
        raise ValueError("a coordinate is invalid")
    q = np.stack([quantize(x, cm), quantize(y, cm)], 1)
    steps = np.diff(q, axis=0).ravel()
    if len(steps) and (steps.min() < -(2**31) or steps.max() >= 2**31):
        raise ValueError("a step is too long")
    out = bytearray(_HEADER.pack(MAGIC, VERSION, FLAGS, cm, len(x), int(q[0, 0]), int(q[0, 1])))
    for z in (steps << 1 ^ steps >> 63).tolist():
        while z > 127:
            out.append(z & 127 | 128)
            z >>= 7
        out.append(z)
    return bytes(out)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes of an encoded route."""
    magic, version, _, cm, count, lon, lat = _HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not an encoded route")
    b = np.frombuffer(data, np.uint8, offset=_HEADER.size)
    last = np.flatnonzero(b < 128)
    if len(last) != 2 * (count - 1) or len(b) and b[-1] >= 128:
        raise ValueError("an encoded route is cut off")
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    shift = (np.arange(len(b)) - np.repeat(begin, last - begin + 1)) * 7
    z = np.add.reduceat((b & 127).astype(np.int64) << shift, begin) if len(last) else np.zeros(0, np.int64)
    q = np.cumsum(np.concatenate([[lon, lat], z >> 1 ^ -(z & 1)]).reshape(-1, 2), 0)
    scale = 1e7 / (cm / 100)
    return q[:, 0] / scale, q[:, 1] / scale


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, NaN for null ones, and where each list begins; the last entry is their number."""
    values = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    return values, np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def encode_all(xs: pa.Array, ys: pa.Array, cm: int = DEFAULT_CM) -> pa.Array:
    """:func:`encode` for list columns of longitudes and latitudes at once; null for routes that can't be encoded."""
    (x, begin), (y, other) = _lists(xs), _lists(ys)
    n = np.diff(begin)
    good = (n > 0) & (n == np.diff(other))
    if len(x) != len(y) or not (begin == other).all():  # lengths differ somewhere: keep what agrees
        take = lambda v, at: np.concatenate([np.zeros(0), *(v[at[k] : at[k + 1]] for k in np.flatnonzero(good))])
        x, y = take(x, begin), take(y, other)
        n = np.where(good, n, 0)
        begin = np.concatenate([[0], np.cumsum(n)])
    route = np.repeat(np.arange(len(n)), n)
    valid = np.isfinite(x) & np.isfinite(y) & (abs(x) <= 180) & (abs(y) <= 90)
    good[route[~valid]] = False
    q = np.stack([quantize(np.where(valid, v, 0.0), cm) for v in (x, y)], 1)
    step = np.diff(q, axis=0, prepend=q[:1] if len(q) else np.zeros((0, 2), np.int64))
    first = begin[:-1][n > 0]
    step[first] = 0
    good[route[((step < -(2**31)) | (step >= 2**31)).any(1)]] = False
    z = (step << 1 ^ step >> 63).astype(np.uint64).ravel()
    size = 1 + sum((z >> np.uint64(7 * k) != 0).astype(np.int64) for k in range(1, 5))
    size.reshape(-1, 2)[first] = 0
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        has = size > k
        out[at[has] + k] = ((z[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    body, ends = out.tobytes(), np.concatenate([[0], np.cumsum(size.reshape(-1, 2).sum(1))])
    rows = []
    for k in range(len(n)):
        ok = good[k] and 1 <= cm <= 65535
        rows.append(_HEADER.pack(MAGIC, VERSION, FLAGS, cm, int(n[k]), *q[begin[k]].tolist()) + body[ends[begin[k]] : ends[begin[k + 1]]] if ok else None)
    return pa.array(rows, pa.binary())


def encode_route(lon: Column, lat: Column, cm: int = DEFAULT_CM) -> Column:
    """Arrays of coordinates as an encoded route; null where they can't be encoded."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for xs, ys in batches:
            yield encode_all(xs, ys, cm)

    return run(lon, lat)


def decode_route(data: Column) -> Column:
    """array<struct<lon,lat>> of an encoded route; null where it is damaged."""

    @F.arrow_udf("array<struct<lon:double,lat:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lists, there = [], []
            for x in batch.to_pylist():
                try:
                    lists.append(decode(x))
                    there.append(True)
                except (ValueError, TypeError, struct.error):
                    lists.append((np.zeros(0), np.zeros(0)))
                    there.append(False)
            lon, lat = (np.concatenate([np.zeros(0), *(p[k] for p in lists)]) for k in (0, 1))
            offsets = np.cumsum([0, *(len(x) for x, _ in lists)]).astype(np.int32)
            points = pa.StructArray.from_arrays([pa.array(lon), pa.array(lat)], ["lon", "lat"])
            yield pa.ListArray.from_arrays(pa.array(offsets), points, mask=pa.array(~np.array(there, bool)))

    return run(data)
