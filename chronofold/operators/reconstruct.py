"""Stays, moves and gaps out of samples alone, for time that no record covers.

An interval and its samples become one event, with gaps where it was not
observed. What it becomes depends on how far the samples lie from their middle
and on what share of them says that one stood still or moved.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from chronofold.functions.times import mode
from chronofold.operators.intervals import points_in
from chronofold.operators.routes import clean, distance_m, length_m
from chronofold.operators.windows import GAP_S

# Fixed values.
STAY_M, LEAST_STAY_M = 200.0, 10.0
MOVE_M, MOVE_MPS = 100.0, 0.5
LONGEST_STEP_S, DEFAULT_STEP_S = 300, 60
P = 0.9
UNSEEN, WEAK = "arc_fragment_unobserved", "arc_fragment_low_evidence"
VAGUE = ("stationary", "unknown", "uncertain")

POINT = "struct<ts:bigint,lon:double,lat:double,h_acc:double,activity:string,tz:int>"
EVENT = "struct<kind:string,start_ts:bigint,end_ts:bigint,notes:string,lat:double,lon:double,radius_m:double,mode:string,distance_m:double,quality:string,route:array<struct<ts:bigint,lon:double,lat:double>>,start_offset_s:int,end_offset_s:int>"


@dataclass
class Seen:
    """Samples (dicts of ts, lon, lat, h_acc, activity, tz) of one interval in order of time."""

    samples: list[dict]

    def __post_init__(self) -> None:
        placed = [(s["ts"], s["lon"], s["lat"]) for s in self.samples if s["lat"] is not None]
        self.route = clean(placed)
        self.quality = "raw" if len(self.route) == len(placed) else "filtered"
        self.length = length_m(self.route)
        errors = [s["h_acc"] for s in self.samples if s["h_acc"] is not None]
        self.error = statistics.median(errors) if errors else 0.0
        names = [(s["activity"] or "").strip().lower() for s in self.samples]
        self.still = sum(n == "stationary" for n in names) / max(1, len(names))
        self.moving = sum(n not in ("", *VAGUE) for n in names) / max(1, len(names))
        self.middle = (statistics.median(p[2] for p in self.route), statistics.median(p[1] for p in self.route)) if self.route else None

    def radius(self) -> float | None:
        """What nine in ten points lie within from the middle, and not less than the error of most."""
        if not self.route:
            return None
        far = sorted(distance_m((0, self.middle[1], self.middle[0]), p) for p in self.route)
        return max(far[int((len(far) - 1) * P)], self.error)

    def goes_far(self, lasts: float) -> bool:
        """Whether the points alone tell of a move: long and fast enough, and ending away from where it began."""
        if len(self.route) < 3 or lasts <= 0 or self.length < MOVE_M or self.length / lasts < MOVE_MPS:
            return False
        return distance_m(self.route[0], self.route[-1]) >= max(MOVE_M, 2 * self.error)

    def supports_move(self, lasts: float) -> bool:
        return self.moving >= 0.5 or self.still <= self.moving and self.goes_far(lasts)


def step_s(times: list[int]) -> float:
    """How long the last sample is taken to last: the median step of up to GAP_S, 1 to 300 s."""
    steps = [b - a for a, b in zip(times, times[1:], strict=False) if 0 < b - a <= GAP_S]
    return max(1, min(LONGEST_STEP_S, statistics.median(steps) if steps else DEFAULT_STEP_S))


def events_of(start: int, end: int, samples: list[dict]) -> list[dict]:
    """The events of an interval, in order, gapless."""
    samples = sorted(samples, key=lambda s: (s["ts"], s["lat"] is None, s["lat"] or 0, s["lon"] or 0, s["activity"] or ""))
    offsets = [s["tz"] for s in samples if s["tz"] is not None]
    first, last = (offsets[0], offsets[-1]) if offsets else (None, None)
    blank = dict.fromkeys(("notes", "lat", "lon", "radius_m", "mode", "distance_m", "quality", "route"))

    def event(kind: str, s: float, e: float, a: int | None, b: int | None, **more) -> list[dict]:
        return [blank | {"kind": kind, "start_ts": int(s), "end_ts": int(e), "start_offset_s": a, "end_offset_s": b} | more] if e > s else []

    times = [s["ts"] for s in samples]
    s, e = (max(start, times[0]), min(end, times[-1] + step_s(times))) if len(times) > 1 else (start, start)
    if e <= s:
        return event("gap", start, end, first, last, notes=WEAK)
    seen = Seen(samples)
    radius = seen.radius()
    if radius is not None and radius <= STAY_M and seen.still >= 0.5:
        core = event("stay", s, e, first, last, lat=seen.middle[0], lon=seen.middle[1], radius_m=max(LEAST_STAY_M, radius))
    elif len(seen.route) > 1 and seen.length >= MOVE_M and seen.supports_move(e - s):
        name = next((x["activity"] for x in samples if x["activity"] and x["activity"].strip().lower() != "stationary"), None)
        core = event("move", s, e, first, last, mode=mode(name), distance_m=seen.length, quality=seen.quality, route=[dict(zip(("ts", "lon", "lat"), p, strict=True)) for p in seen.route])
    else:
        core = event("gap", s, e, first, last, notes=WEAK)
    return event("gap", start, s, first, first, notes=UNSEEN) + core + event("gap", e, end, last, last, notes=UNSEEN)


def supported(visit: bool, samples: list[dict], lasts: float) -> bool:
    """Whether samples bear out an item of low confidence."""
    if len(samples) < 2:
        return False
    seen = Seen(sorted(samples, key=lambda s: s["ts"]))
    if visit:
        far = [distance_m((0, seen.middle[1], seen.middle[0]), p) for p in seen.route] if seen.route else []
        return seen.still >= 0.5 or len(far) >= 3 and max(far) <= STAY_M
    return seen.moving >= 0.5 or seen.still <= seen.moving and seen.goes_far(max(1, lasts))


def arrow_type(ddl: str) -> pa.DataType:
    """The Arrow type of a type in SQL; to be called on the driver."""
    return to_arrow_type(_parse_datatype_string(ddl))


def read_interval(start: Column, end: Column, samples: Column) -> Column:
    """:func:`events_of` for columns: array of EVENT."""
    kind = arrow_type(f"array<{EVENT}>")

    @F.arrow_udf(f"array<{EVENT}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b, lists in batches:
            yield pa.array([events_of(s, e, x or []) for s, e, x in zip(a.to_pylist(), b.to_pylist(), lists.to_pylist(), strict=True)], kind)

    return run(start, end, samples)


def borne_out(visit: Column, samples: Column, lasts: Column) -> Column:
    """:func:`supported` for columns."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for v, lists, d in batches:
            yield pa.array([supported(bool(x), s or [], t or 0) for x, s, t in zip(v.to_pylist(), lists.to_pylist(), d.to_pylist(), strict=True)], pa.bool_())

    return run(visit, samples, lasts)


def as_sample() -> Column:
    """What :data:`POINT` has, of an observation's columns."""
    return F.struct(F.col("ts").cast("bigint").alias("ts"), "lon", "lat", F.col("h_acc").alias("h_acc"), "activity", F.col("tz_offset_s").alias("tz"))


def reconstructed(intervals: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """Events (keys, and the fields of EVENT) of intervals (keys, start_ts, end_ts) by the observations (keys, ts, lon, lat, h_acc, activity, tz_offset_s) in them; the end counts too."""
    spans = intervals.where("end_ts > start_ts").select(*keys, F.col("start_ts").cast("bigint").alias("start_ts"), F.col("end_ts").cast("bigint").alias("end_ts")).distinct()
    inside = points_in(spans, observations.select(*keys, "ts", as_sample().alias("s")), keys, "ts", closed=True)
    held = inside.groupBy(*keys, "start_ts", "end_ts").agg(F.collect_list("s").alias("s"))
    every = spans.join(held, [*keys, "start_ts", "end_ts"], "left")
    out = every.select(*keys, F.explode(read_interval(F.col("start_ts"), F.col("end_ts"), F.coalesce("s", F.expr(f"cast(array() as array<{POINT}>)")))).alias("e"))
    return out.select(*keys, "e.*")
