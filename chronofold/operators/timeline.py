"""The timeline: events of several kinds without overlap.

Events of a history are split into islands that can't touch each other; each
island is swept on its own in order of time. Gaps between stays are filled
afterwards, across islands.

Two events on the same time are settled by interval arithmetic: the preferred
one keeps all of its time, and of the other what lies before it and after it is
left. What is before stays where it is; what is after waits in the queue for
its turn like any other event.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators.routes import distance_m

# Fixed values.
#: A day-dialect event that starts before this second is preferred to an item-dialect event.
CUTOFF_TS = 1_533_168_000
NEAR_S = 60
RESIDUAL_S = 1
PLACE_M = 50.0
DIALECTS = {"arc", "moves"}
KINDS = ("stay", "move", "gap")
#: What a route and a distance add to the quality of a move.
ROUTE_POINTS, DISTANCE_POINTS = 6, 2

SCHEMA = (
    "history_id string, id bigint, kind string, start_ts double, end_ts double, quality int, manual boolean, revision double, source string, lat double, lon double, radius_m double, "
    "geometry_valid boolean, route_from bigint, distance_from bigint, place_from bigint, absorbed array<bigint>, start_offset_s int, end_offset_s int, part int"
)


@dataclass
class Event:
    """``bare`` is the quality without route and distance; the three ``_from`` are ids of the events whose route, distance and place count."""

    id: int
    kind: str
    start: float
    end: float
    quality: int = 0
    manual: bool = False
    revision: float = 0.0
    source: str = ""
    lat: float | None = None
    lon: float | None = None
    radius: float = PLACE_M
    route_from: int | None = None
    distance_from: int | None = None
    place_from: int | None = None
    absorbed: list[int] = field(default_factory=list)
    start_offset: int | None = None
    end_offset: int | None = None
    part: int = 0
    geometry: bool = True

    def __post_init__(self) -> None:
        if self.place_from is None:
            self.place_from = self.id

    def turn(self) -> tuple:
        """The place in the queue."""
        return self.start, not self.manual, -self.quality, self.end - self.start, KINDS.index(self.kind), self.id, self.part

    def _rated(self, route_from: int | None, distance_from: int | None) -> None:
        for before, now, points in ((self.route_from, route_from, ROUTE_POINTS), (self.distance_from, distance_from, DISTANCE_POINTS)):
            self.quality += points * ((now is not None) - (before is not None))
        self.route_from, self.distance_from = route_from, distance_from

    def unrouted(self) -> Event:
        """A move whose time changes loses its route and its distance, and the quality that they gave."""
        if self.kind == "move":
            self._rated(None, None)
            self.geometry = False
        return self

    def take_from(self, other: Event) -> None:
        """Of moves over exactly the same time one takes from the other what it hasn't itself."""
        if self.kind == other.kind == "move" and (self.start, self.end) == (other.start, other.end):
            self._rated(other.route_from if self.route_from is None else self.route_from, other.distance_from if self.distance_from is None else self.distance_from)
            self.start_offset = other.start_offset if self.start_offset is None else self.start_offset
            self.end_offset = other.end_offset if self.end_offset is None else self.end_offset


def preferred(a: Event, b: Event) -> bool:
    """Whether a keeps its time against b; ties go to a."""
    if {a.source, b.source} == DIALECTS:
        day = a if a.source == "moves" else b
        if day.start < CUTOFF_TS:
            return day is a
    rank = lambda e: (e.manual, e.quality, e.start - e.end, e.revision if a.source == b.source else 0, -KINDS.index(e.kind), -e.id)
    return rank(a) >= rank(b)


def compatible(a: Event, b: Event) -> bool:
    """Two gaps, or two stays at one place."""
    if a.kind != b.kind or a.kind == "move":
        return False
    if a.kind == "gap":
        return True
    if None in (a.lat, a.lon, b.lat, b.lon):
        return False
    return distance_m((0, a.lon, a.lat), (0, b.lon, b.lat)) <= max(PLACE_M, a.radius + b.radius)


def absorb(a: Event, b: Event) -> None:
    """b becomes part of a: the later end with its offset, and of stays the place of higher quality."""
    if b.end >= a.end:
        a.end, a.end_offset = b.end, b.end_offset
    a.absorbed = [*a.absorbed, b.id, *b.absorbed]
    if b.kind == "stay" and b.quality > a.quality:
        a.lat, a.lon, a.radius, a.place_from, a.quality = b.lat, b.lon, b.radius, b.place_from, b.quality


def settle(winner: Event, loser: Event) -> tuple[Event | None, Event | None]:
    """What is left of the loser before and after the winner.

    Between moves of the two dialects a remainder of a second or less isn't
    left but goes to the winner.
    """
    grows = winner.kind == loser.kind == "move" and {winner.source, loser.source} == DIALECTS
    before, after = winner.start - loser.start, loser.end - winner.end
    start, end = winner.start, winner.end
    if grows and 0 < before <= RESIDUAL_S:
        winner.start, winner.start_offset, before = loser.start, loser.start_offset, 0
    if grows and 0 < after <= RESIDUAL_S:
        winner.end, winner.end_offset, after = loser.end, loser.end_offset, 0
    winner.take_from(loser)
    head = replace(loser, end=start, end_offset=winner.start_offset).unrouted() if before > 0 else None
    tail = replace(loser, start=end, start_offset=winner.end_offset, part=loser.part + (head is not None)).unrouted() if after > 0 else None
    return head, tail


def place(timeline: list[Event], event: Event, wait: Callable[[Event], None]) -> None:
    """Put an event at the end of a timeline. Nothing in the queue starts before it; what ``wait`` gets doesn't either."""
    while timeline:
        last = timeline[-1]
        if compatible(last, event) and (last.kind == "gap" or event.start - last.end < NEAR_S):
            absorb(last, event)
            return
        if last.end <= event.start:
            break
        stays = preferred(last, event)
        head, tail = settle(last, event) if stays else settle(event, last)
        if tail:
            wait(tail)
        if stays:
            return
        timeline.pop()
        if head:
            timeline.append(head)
    timeline.append(event)


def joined(events: list[Event]) -> list[Event]:
    """Neighbours that the sweep brought together and that touch, or stays within a minute, become one."""
    out: list[Event] = []
    for e in events:
        if out and compatible(out[-1], e) and (e.start == out[-1].end or e.kind == "stay" and 0 < e.start - out[-1].end < NEAR_S):
            absorb(out[-1], e)
        else:
            out.append(e)
    return out


def resolve(events: list[Event]) -> list[Event]:
    """Events without overlap; nothing is left of an event whose time others have."""
    queue = [(e.turn(), e) for e in events if e.end > e.start]
    queue = [(turn, k, e) for k, (turn, e) in enumerate(queue)]
    heapq.heapify(queue)
    timeline, count = [], len(queue)

    def wait(e: Event) -> None:
        nonlocal count
        heapq.heappush(queue, (e.turn(), count, e))
        count += 1

    while queue:
        place(timeline, heapq.heappop(queue)[2], wait)
    return joined(timeline)


def separate_stays(events: list[Event]) -> list[Event]:
    """Stays at different places get a minute between them.

    Each side gives half of what is missing or, if the other has too little,
    more; a minute of each remains. If both have too little, stays that touch
    are parted by a second at most, and others are left as they are.
    """
    for a, b in zip(events, events[1:], strict=False):
        between = b.start - a.end
        if {a.kind, b.kind} != {"stay"} or not 0 <= between < NEAR_S or compatible(a, b):
            continue
        needed, remains = NEAR_S - between, float(NEAR_S)
        spare = lambda e: max(0.0, e.end - e.start - remains)
        if spare(a) + spare(b) < needed:
            if between:
                continue
            remains = 0.001
            needed = min(1.0, spare(a) + spare(b))
        given = min(spare(a), max(needed / 2, needed - spare(b)))
        a.end, b.start = a.end - given, b.start + needed - given
    return events


def islands(events: DataFrame) -> DataFrame:
    """``events`` with the number of their island.

    An island ends where nothing reaches to within 60 s of the next start. The
    one exception are gaps, which merge over any distance: where a gap stands
    at the next start and the island before has a gap, the two are one.
    """
    w = W.partitionBy("history_id").orderBy("start_ts", "id")
    reach = F.max(F.coalesce("end_ts", F.lit(math.inf))).over(w.rowsBetween(W.unboundedPreceding, -1))
    split = events.withColumn("_cut", F.coalesce((F.col("start_ts") - reach >= NEAR_S).cast("int"), F.lit(1)))
    split = split.withColumn("_part", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    of_part = W.partitionBy("history_id", "_part")
    is_gap = F.col("kind") == "gap"
    split = split.withColumn("_has", F.max(is_gap).over(of_part)).withColumn("_from", F.min("start_ts").over(of_part))
    split = split.withColumn("_starts", F.max(is_gap & (F.col("start_ts") == F.col("_from"))).over(of_part))
    # At the first row of a part, the row before is of the part before.
    joined = F.coalesce(F.lag("_has").over(w), F.lit(False)) & F.col("_starts")
    new = F.when(F.col("_cut") == 1, (~joined).cast("int")).otherwise(0)
    numbered = split.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.select(*events.columns, "island")


COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
#: Columns that events may have beside those that they must have.
OPTIONAL = {"has_route": "boolean", "has_distance": "boolean", "start_offset_s": "int", "end_offset_s": "int"}


def _event(r: dict) -> Event:
    own = lambda column: r["id"] if r[column] else None
    return Event(
        r["id"], r["kind"], float(r["start_ts"]), math.inf if r["end_ts"] is None else float(r["end_ts"]), r["quality"] or 0, bool(r["manual"]), float(r["revision"] or 0), r["source"] or "", r["lat"], r["lon"], PLACE_M if r["radius_m"] is None else float(r["radius_m"]),
        route_from=own("has_route"), distance_from=own("has_distance"), start_offset=r["start_offset_s"], end_offset=r["end_offset_s"],
    )


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep one island after another of rows that stand together by island; memory holds the largest island."""
    rows: list[tuple] = []

    def finish(history: str, events: list[Event]) -> None:
        for e in separate_stays(resolve(events)):
            if e.end > e.start:
                end = None if e.end == math.inf else e.end
                rows.append((history, e.id, e.kind, e.start, end, e.quality, e.manual, e.revision, e.source, e.lat, e.lon, e.radius, e.geometry, e.route_from, e.distance_from, e.place_from, e.absorbed, e.start_offset, e.end_offset, e.part))

    def batch_of() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(c, _TYPES[x.split()[1]]) for c, x in zip(columns, SCHEMA.split(", "), strict=True)], COLUMNS)
        rows.clear()
        return out

    at, events = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (r["history_id"], r["island"]) != at:
                if at is not None:
                    finish(at[0], events)
                at, events = (r["history_id"], r["island"]), []
            events.append(_event(r))
        if rows:
            yield batch_of()
    if at is not None:
        finish(at[0], events)
    if rows:
        yield batch_of()


def sweep(events: DataFrame, whole: bool = False) -> DataFrame:
    """Events (history_id, id, kind, start_ts, end_ts, quality, manual, revision, source, lat, lon, radius_m) without overlap.

    Moves may have has_route and has_distance, which count 6 and 2 points of
    their quality and are lost when their time changes, and any event
    start_offset_s and end_offset_s. ``route_from``, ``distance_from`` and
    ``place_from`` are the ids of the events whose route, distance and place a
    row has; ``absorbed`` the ids of those that became part of it. A null end
    is open and lies after all others; rows without a start, and those that end
    when or before they start, are left out. With ``whole`` a history is one
    island, which gives the same rows.
    """
    given = events.where("start_ts is not null and (end_ts is null or end_ts > start_ts)")
    given = given.select("*", *(F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items() if c not in events.columns))
    dealt = given.withColumn("island", F.lit(0)) if whole else islands(given)
    return dealt.repartition("history_id", "island").sortWithinPartitions("history_id", "island").mapInArrow(_swept, SCHEMA)


def redirects(swept: DataFrame) -> DataFrame:
    """(history_id, id, to_id): events that became part of another."""
    return swept.select("history_id", F.explode("absorbed").alias("id"), F.col("id").alias("to_id"))


def filled_gaps(timeline: DataFrame) -> DataFrame:
    """The gaps between a stay and the next stay of a swept timeline: history_id, start_ts, end_ts."""
    w = W.partitionBy("history_id").orderBy("start_ts", "id", "part")
    after = timeline.withColumn("_k", F.lead("kind").over(w)).withColumn("_s", F.lead("start_ts").over(w))
    return after.where("kind = 'stay' and _k = 'stay' and _s > end_ts").select("history_id", F.col("end_ts").alias("start_ts"), F.col("_s").alias("end_ts"))


def integrity(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Seven counters of a timeline (kind, start_ts, end_ts): all but the first are 0 or, for open events, at most 1 in a sound one."""
    keys = keys or []
    w = W.partitionBy(*keys).orderBy("start_ts", "end_ts", "kind")
    before = F.max(F.coalesce("end_ts", F.lit(float("inf")))).over(w.rowsBetween(W.unboundedPreceding, -1))
    seen = events.select(*keys, "kind", "start_ts", "end_ts", (F.col("start_ts") < before).alias("o"), F.lag("kind").over(w).alias("k"), F.lag("start_ts").over(w).alias("s"), F.lead("start_ts").over(w).alias("n"))
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    out = seen.groupBy(*keys) if keys else seen
    return out.agg(
        F.count("*").alias("n_events"),
        count(F.col("start_ts") == F.col("s")).alias("n_duplicate_starts"),
        count(F.col("o")).alias("n_overlaps"),
        count((F.col("kind") == F.col("k")) & (F.col("kind") != "move")).alias("n_adjacent_same_kind"),
        count(F.col("end_ts").isNull()).alias("n_open"),
        count(F.col("end_ts").isNull() & F.col("n").isNotNull()).alias("n_open_not_last"),
        count(F.col("end_ts") <= F.col("start_ts")).alias("n_non_positive"),
    )


def is_sound() -> Column:
    """Whether the counters of :func:`integrity` are those of a sound timeline."""
    bad = F.col("n_duplicate_starts") + F.col("n_overlaps") + F.col("n_adjacent_same_kind") + F.col("n_open_not_last") + F.col("n_non_positive") + F.greatest(F.col("n_open") - 1, F.lit(0))
    return bad == 0


def checked(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The counters, with an error where an invariant is broken."""
    return integrity(events, keys).withColumn("sound", F.when(is_sound(), F.lit(True)).otherwise(F.raise_error(F.lit("the timeline is not sound")).cast("boolean")))
