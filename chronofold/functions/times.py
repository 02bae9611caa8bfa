"""Timestamps and JSON fields of decoded records, in Python; :mod:`scalars` has the same for columns."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from typing import Any

from chronofold.functions.scalars import MODE_NAMES, OFFSET_LIMIT_S

_ZONE = re.compile(r"(?:Z|([+-])([0-9]{2}):?([0-9]{2}))$")
_WALLS = {15: "%Y%m%dT%H%M%S", 16: "%Y-%m-%dT%H:%M", 19: "%Y-%m-%dT%H:%M:%S"}
_MODES = {name: mode for mode, names in MODE_NAMES.items() for name in names.split()}


def _split(text: Any) -> tuple[int | None, int | None]:
    """Seconds and the zone of a timestamp, the zone null if it has none."""
    if not isinstance(text, str):
        return None, None
    text = text.strip()
    zone = _ZONE.search(text)
    wall = text[: zone.start()] if zone else text
    whole = re.sub(r"[.][0-9]{1,9}$", "", wall)
    if len(whole) not in _WALLS or not whole.isascii() or (len(whole) != 19 and whole != wall) or (len(whole) == 15 and zone and ":" in zone[0]):
        return None, None
    shift = None
    if zone:
        shift = 0 if zone[1] is None else int(zone[2]) * 3600 + int(zone[3]) * 60
        if zone[1] and (int(zone[3]) > 59 or shift > OFFSET_LIMIT_S):
            return None, None
        shift = -shift if zone[1] == "-" else shift
    try:
        at = datetime.strptime(whole, _WALLS[len(whole)]).replace(tzinfo=UTC)
    except ValueError:
        return None, None
    return int(at.timestamp()) - (shift or 0), shift


def seconds(text: Any) -> int | None:
    """Epoch seconds of an accepted timestamp; null for all else."""
    return _split(text)[0]


def zone_s(text: Any) -> int | None:
    """The zone of an accepted timestamp in seconds; null if it has none."""
    return _split(text)[1]


def iso(ts: float) -> str:
    return datetime.fromtimestamp(ts, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def string(x: Any) -> str | None:
    """A JSON string that isn't empty."""
    return x if isinstance(x, str) and x else None


def number(x: Any) -> float | None:
    return x if isinstance(x, int | float) and not isinstance(x, bool) else None


def at_least_0(x: Any) -> float | None:
    x = number(x)
    return x if x is not None and x >= 0 else None


def above_0(x: Any) -> float | None:
    x = number(x)
    return x if x is not None and x > 0 else None


def record(x: Any) -> dict:
    return x if isinstance(x, dict) else {}


def records(x: Any) -> list[dict]:
    return [v for v in x if isinstance(v, dict)] if isinstance(x, list) else []


def point(x: Any) -> tuple[float, float] | None:
    """(latitude, longitude) of a record with either pair of names, if they are on the earth."""
    x = record(x)
    lat, lon = (next((v for v in (number(x.get(a)), number(x.get(b))) if v is not None), None) for a, b in (("latitude", "lat"), ("longitude", "lon")))
    return (float(lat), float(lon)) if lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180 else None


def mode(activity: Any) -> str:
    """The mode of an activity name; ``other`` for what isn't one."""
    return _MODES.get(re.sub(r"[- /]", "_", activity.strip().lower()), "other") if isinstance(activity, str) else "other"
