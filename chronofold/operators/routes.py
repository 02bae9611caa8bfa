"""Route cleaning: spikes and broken parts of a track.

A spike is decided by its neighbours, and its removal makes new neighbours, so
a track is cleaned as a whole, in an Arrow function over arrays of points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_M = 6_371_000.0
MAX_SPEED_MPS = 400.0
SAME_PLACE_M = 0.01


def distance_m(a: tuple, b: tuple) -> float:
    (_, x1, y1), (_, x2, y2) = a, b
    p1, p2 = math.radians(y1), math.radians(y2)
    s = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * EARTH_M * math.atan2(math.sqrt(s), math.sqrt(max(0.0, 1 - s)))


def plausible(a: tuple, b: tuple) -> bool:
    """Whether one can get from a to b at the highest speed; at the same second only if the place is the same."""
    seconds = b[0] - a[0]
    return distance_m(a, b) <= (MAX_SPEED_MPS * seconds if seconds > 0 else SAME_PLACE_M)


def without_spikes(points: list[tuple]) -> list[tuple]:
    """Points (ts, lon, lat) without those that neither neighbour can reach while the neighbours reach each other.

    After a removal only the points beside it can have become spikes, so the
    search goes on one step back.
    """
    left = list(points)
    k = 1
    while k < len(left) - 1:
        a, b, c = left[k - 1 : k + 2]
        if not plausible(a, b) and not plausible(b, c) and plausible(a, c):
            del left[k]
            k = max(1, k - 1)
        else:
            k += 1
    return left


def longest_part(points: list[tuple]) -> list[tuple]:
    """The part between implausible steps with most points, then the longest time, then the earliest."""
    parts: list[list[tuple]] = []
    for p in points:
        if parts and plausible(parts[-1][-1], p):
            parts[-1].append(p)
        else:
            parts.append([p])
    return max(parts, key=lambda x: (len(x), x[-1][0] - x[0][0], -x[0][0]), default=[])


def clean(points: list[tuple]) -> list[tuple]:
    return longest_part(without_spikes(points))


def length_m(points: list[tuple]) -> float:
    return float(sum(distance_m(a, b) for a, b in zip(points, points[1:], strict=False)))


def cleaned_route(points: Column) -> Column:
    """array<struct<ts,lon,lat>> as struct<points, distance_m, quality>: ``filtered`` if a point went, else ``raw``.

    Of a route without any times all points stay, in their order; of one with
    some, those with a time. Points without coordinates go.
    """

    @F.arrow_udf("points array<struct<ts:bigint,lon:double,lat:double>>, distance_m double, quality string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        point = pa.struct([("ts", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64())])
        for batch in batches:
            kept, metres, quality = [], [], []
            for route in batch.to_pylist():
                before = [(p["ts"], p["lon"], p["lat"]) for p in route or [] if None not in (p["lon"], p["lat"])]
                timed = sorted(p for p in before if p[0] is not None)
                after = clean(timed) if timed else before
                kept.append([dict(zip(("ts", "lon", "lat"), p, strict=True)) for p in after])
                metres.append(length_m(after))
                quality.append("raw" if len(after) == len(before) else "filtered")
            yield pa.StructArray.from_arrays([pa.array(kept, pa.list_(point)), pa.array(metres), pa.array(quality)], ["points", "distance_m", "quality"])

    return run(points)
