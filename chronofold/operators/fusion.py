"""One day out of several accounts of it.

Accounts of a day of one history are dicts as decoded from JSON. The best
account leads; from the others come segments that it lacks and fields that its
own segments lack. What the outcome depends on is written in the functions;
the order of the accounts is not among it.
"""

from __future__ import annotations

import json
import statistics
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions.json_merge import populated, under
from chronofold.functions.times import at_least_0, iso, mode, number, record, records, seconds, string
from chronofold.operators.windows import FRAGMENT_GROUP, FRAGMENT_MEDIAN_S, FRAGMENT_RATIO, GAP_S

# Fixed values.
TRUSTED_S = 60
SAME_SHARE, SAME_RATIO = 0.8, 1.5
REVISION = "_revision"


def text_of(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@dataclass
class Told:
    """A segment or activity with the revision that it has by itself or by what it is part of."""

    value: dict
    revision: float

    @property
    def start(self) -> float:
        ts = seconds(self.value.get("startTime"))
        return float("inf") if ts is None else ts

    @property
    def end(self) -> float:
        ts = seconds(self.value.get("endTime"))
        return float("-inf") if ts is None else ts

    @property
    def lasts(self) -> float:
        return self.end - self.start

    @property
    def timed(self) -> bool:
        return self.start < float("inf") and self.end > float("-inf")

    @property
    def manual(self) -> bool:
        return self.value.get("manual") is True or any(a.get("manual") is True for a in records(self.value.get("activities")))

    @property
    def place(self) -> str | None:
        return place_ids(self.value.get("place"))[0]

    def same_time(self, other: Told) -> bool:
        return (self.start, self.end) == (other.start, other.end)

    def shared_s(self, other: Told) -> float:
        return min(self.end, other.end) - max(self.start, other.start)

    def completes(self, other: Told) -> bool:
        """Whether it tells the same as another of its type, with the same place or, of a move, exactly the same time."""
        if self.value.get("type") != other.value.get("type") or self.shared_s(other) <= 0:
            return False
        if self.value.get("type") == "place":
            known = {self.place, other.place}
            return len(known) == 1 and None not in known or None in known and self.same_time(other)
        return self.value.get("type") == "move" and self.same_time(other)

    def corrects(self, other: Told) -> bool:
        """Whether it stands for the same time, told otherwise: equal, or nearly, at places that aren't known to be two."""
        if self.same_time(other):
            return True
        short, long = sorted((self.lasts, other.lasts))
        near = short > 0 and self.shared_s(other) >= SAME_SHARE * short and long <= SAME_RATIO * short
        return near and (None in (self.place, other.place) or self.place == other.place)


def place_ids(place: object) -> tuple[str | None, int, list[str]]:
    """The best id of a place, its rank and all ids, the lasting ones of other services before its own."""
    place, found = record(place), []
    for rank, key in ((3, "facebookPlaceId"), (2, "foursquareId"), (1, "id")):
        x = place.get(key)
        x = string(x) or (f"{x:g}" if isinstance(x, float) else str(x) if number(x) is not None else None)
        if x:
            found.append((rank, x))
    best = found[0] if found else (0, None)
    return best[1], best[0], list(dict.fromkeys(x for _, x in found))


def own_revision(value: dict, otherwise: float) -> float:
    kept = at_least_0(value.get(REVISION))
    if kept is not None:
        return kept
    ts = seconds(string(value.get("lastUpdate")) or string(value.get("lastSaved")))
    return otherwise if ts is None else ts


def usable(segment: dict) -> bool:
    """Whether a segment has times, a known type and, at a place, anything that tells which."""
    if string(segment.get("startTime")) is None or string(segment.get("endTime")) is None:
        return False
    if segment.get("type") != "place":
        return segment.get("type") in ("move", "off")
    from chronofold.functions.times import point

    place = record(segment.get("place"))
    named = (string(place.get("name")) or "").strip()
    return bool(point(place.get("location")) or place_ids(place)[0] or named or place.get("type") in ("home", "work") or records(segment.get("activities")))


def usable_summary(summary: dict) -> bool:
    return string(summary.get("activity")) is not None and any(at_least_0(summary.get(k)) is not None for k in ("steps", "distance", "duration"))


def clean_account(day: dict) -> dict:
    """A day without unusable segments and summaries."""
    return day | {"segments": [s for s in records(day.get("segments")) if usable(s)], "summary": [s for s in records(day.get("summary")) if usable_summary(s)]}


def repaired(day: dict) -> dict:
    """A day of many short fragments with ranges of ``off`` in their place; what they were stands in ``fragments``."""
    told = sorted((t for t in (Told(s, 0) for s in records(day.get("segments"))) if t.timed), key=lambda t: t.start)
    positive = [t.lasts for t in told if t.lasts > 0]
    empty = len(told) - len(positive)
    broken = empty > 0 and empty >= FRAGMENT_RATIO * len(told) or positive and statistics.median(positive) < FRAGMENT_MEDIAN_S
    if len(told) < FRAGMENT_GROUP or not broken:
        return day
    out: list[dict] = []
    run: list[Told] = []

    def off() -> None:
        if run:
            last = max(run, key=lambda t: t.end)
            end = last.value["endTime"] if last.end > run[0].start else iso(run[0].start + TRUSTED_S)
            out.append({"type": "off", "startTime": run[0].value["startTime"], "endTime": end})
            run.clear()

    for t in told:
        if t.manual or t.lasts >= TRUSTED_S:
            off()
            out.append(t.value)
        else:
            if run and t.start - run[-1].end > GAP_S:
                off()
            run.append(t)
    off()
    return day | {"segments": out, "fragments": [*records(day.get("fragments")), *(t.value for t in told)]}


def worth(day: dict) -> tuple:
    """What makes an account of a day the better one, the first difference counts; the text decides between equals."""
    told = sorted((Told(s, 0) for s in records(day.get("segments"))), key=lambda t: t.start)
    lasts = [t.lasts for t in told]
    positive = [x for x in lasts if x > 0]
    overlaps = sum(a.shared_s(b) > 0 for a, b in zip(told, told[1:], strict=False))
    dense = len(told) >= FRAGMENT_GROUP and (statistics.median(positive) if positive else 0) < FRAGMENT_MEDIAN_S
    return len(positive) == len(lasts), not overlaps, not dense, sum(t.manual for t in told), sum(positive), populated(day), len(told), text_of(day)


def track(parts: Iterable[tuple[list[dict], float]]) -> list[dict]:
    """Track points of several accounts (points, revision): for each time the latest; without any times the points of the latest account, of equals the longest."""
    parts = list(parts)
    at: dict[int, tuple[float, str, dict]] = {}
    for points, revision in parts:
        for p in points:
            ts = seconds(string(p.get("time")) or string(p.get("timestamp")))
            if ts is not None:
                at[ts] = max(at.get(ts, (float("-inf"), "", {})), (revision, text_of(p), p), key=lambda x: x[:2])
    if not at:
        return max(parts, key=lambda x: (x[1], len(x[0])), default=([], 0))[0]
    return [at[ts][2] for ts in sorted(at)]


def activities(told: list[Told]) -> list[dict]:
    """Activities that correct each other, one by way of another too, become one: the manual or latest, filled from others of its mode."""
    groups: list[list[Told]] = []
    for t in sorted(told, key=lambda t: (t.start, t.end, t.revision, text_of(t.value))):
        met = [g for g in groups if any(t.corrects(x) for x in g)]
        groups = [g for g in groups if not any(g is m for m in met)] + [[t, *(x for g in met for x in g)]]
    out = []
    for group in groups:
        *others, best = sorted(group, key=lambda t: (t.value.get("manual") is True, t.revision, populated(t.value), text_of(t.value)))
        one = best.value
        for t in reversed(others):
            names = string(one.get("activity")), string(t.value.get("activity"))
            if None in names or mode(names[0]) == mode(names[1]):
                one = under(one, t.value)
        out.append(one | {"trackPoints": track((records(t.value.get("trackPoints")), t.revision) for t in group), REVISION: best.revision})
    return sorted(out, key=lambda a: (Told(a, 0).start, a.get("manual") is not True, text_of(a)))


def joined(a: Told, b: Told) -> Told:
    """One of two accounts of a segment: the manual one, else the later, else a; of one type, filled from the other."""
    first, second = (b, a) if (b.manual, b.revision) > (a.manual, a.revision) else (a, b)
    if a.value.get("type") != b.value.get("type"):
        return first
    value = under(first.value, second.value) | {"trackPoints": track((records(t.value.get("trackPoints")), t.revision) for t in (a, b)), REVISION: first.revision}
    if first.value.get("type") == "move":
        value["activities"] = activities([Told(x, own_revision(x, t.revision)) for t in (a, b) for x in records(t.value.get("activities"))])
    return Told(value, first.revision)


def summaries(days: list[dict]) -> list[dict]:
    """For each activity and group the latest summary, filled from earlier ones."""
    groups: dict[tuple, list[tuple]] = {}
    for day in days:
        for s in records(day.get("summary")):
            revision = own_revision(s, own_revision({k: day.get(k) for k in ("lastUpdate", "lastSaved")}, 0))
            groups.setdefault((string(s.get("activity")), string(s.get("group"))), []).append((revision, populated(s), text_of(s), s))
    out = []
    for group in groups.values():
        *others, best = sorted(group, key=lambda x: x[:3])
        one = best[3]
        for x in reversed(others):
            one = under(one, x[3])
        out.append(one)
    return sorted(out, key=text_of)


def fused_day(accounts: list[dict]) -> dict:
    """One account of a day out of all."""
    days = sorted((repaired(d) for d in {text_of(d): d for d in accounts}.values()), key=worth, reverse=True)
    told = lambda day: [Told(s, own_revision(s, own_revision({k: day.get(k) for k in ("lastUpdate", "lastSaved")}, 0))) for s in records(day.get("segments"))]
    chosen = told(days[0])
    whole = days[0]
    for day in days[1:]:
        whole = under(whole, day | {"segments": []})
        for t in told(day):
            k = next((k for k, x in enumerate(chosen) if t.completes(x)), None)
            if k is None:
                k = next((k for k, x in enumerate(chosen) if t.corrects(x)), None)
            if k is None:
                chosen.append(t)
            else:
                chosen[k] = joined(chosen[k], t)
    chosen.sort(key=lambda t: (t.start, not t.manual, text_of(t.value)))
    return repaired(whole | {"segments": [t.value | {REVISION: t.revision} for t in chosen], "summary": summaries(days)})


def fused_days(accounts: Column | str) -> Column:
    """:func:`fused_day` of arrays of JSON texts, as JSON text; null for none."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([text_of(fused_day([json.loads(t) for t in texts])) if texts else None for texts in batch.to_pylist()], pa.string())

    return run(F.col(accounts) if isinstance(accounts, str) else accounts)
