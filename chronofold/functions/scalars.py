"""Column expressions: strict fields, timestamps, geography, modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
OFFSET_LIMIT_S = 50_400

# The activity names that inputs use, by mode.
MODE_NAMES = {
    "walk": "walking walk wlk on_foot onfoot foot hiking hike",
    "run": "running run rng jogging jog",
    "bicycle": "cycling cyc bicycle bike biking",
    "car": "car automotive auto driving drive vehicle",
    "bus": "bus",
    "train": "train rail commuter",
    "metro": "metro subway underground",
    "tram": "tram lrt light_rail streetcar",
    "transit": "transit trp public_transport transport",
    "eScooter": "e_scooter escooter electric_scooter kick_scooter",
    "motorcycle": "motorcycle motorbike moto scooter",
    "boat": "boat ship",
    "ferry": "ferry",
    "airplane": "flight airplane plane aircraft",
}


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c(x), r"(?U)^\s+|\s+$", "")


def activity_key(x: Column | str) -> Column:
    return F.translate(F.lower(trimmed(x)), "- /", "___")


def mode_of(x: Column | str) -> Column:
    """The mode of an activity name; ``other`` for null, empty and unknown names."""
    named = F.create_map(*(F.lit(v) for mode, names in MODE_NAMES.items() for name in names.split() for v in (name, mode)))
    return F.coalesce(F.try_element_at(named, activity_key(x)), F.lit("other"))


def valid_point(lat: Column | str, lon: Column | str) -> Column:
    return F.coalesce(c(lat).between(-90, 90) & c(lon).between(-180, 180), F.lit(False))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    a1, a2 = F.radians(c(lat1)), F.radians(c(lat2))
    s = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(c(lon2) - c(lon1)) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(s), F.sqrt(F.greatest(1 - s, F.lit(0.0))))


def positive(x: Column | str) -> Column:
    return F.when(c(x) > 0, c(x))


def non_negative(x: Column | str) -> Column:
    return F.when(c(x) >= 0, c(x))


def course(x: Column | str) -> Column:
    """Degrees in [0, 360): negative is null, more wraps."""
    return F.when(c(x) >= 0, c(x) % 360)


def course_accuracy(x: Column | str) -> Column:
    return F.when((c(x) >= 0) & (c(x) < 360), c(x))


def offset_s(x: Column | str) -> Column:
    """Whole seconds within fourteen hours, else null."""
    return F.when((c(x) == F.floor(c(x))) & (F.abs(c(x)) <= OFFSET_LIMIT_S), c(x).cast("int"))


def half_up(x: Column | str) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(c(x) + F.lit(0.5))


def valid_window(start: Column | str, end: Column | str) -> Column:
    return F.coalesce((c(start) > 0) & (c(end) > c(start)), F.lit(False))


def local_date(ts: Column | str, offset: Column | str | None = None, pattern: str = "yyyy-MM-dd") -> Column:
    """Text of local time; a null offset counts as 0."""
    shift = F.lit(0) if offset is None else F.coalesce(c(offset), F.lit(0))
    return F.date_format(F.timestamp_seconds(c(ts) + shift), pattern)


def day_key(ts: Column | str, offset: Column | str | None = None) -> Column:
    shift = F.lit(0) if offset is None else F.coalesce(c(offset), F.lit(0))
    return F.floor((c(ts) + shift) / 86400).cast("bigint")


#: A zone at the end of a timestamp.
_ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"
#: Lengths of the wall time without zone and fraction, with the pattern that reads them.
_WALLS = {15: "yyyyMMdd'T'HHmmss", 16: "yyyy-MM-dd'T'HH:mm", 19: "yyyy-MM-dd'T'HH:mm:ss"}


def _zone(text: Column) -> Column:
    """Seconds of a zone; 0 for Z and for none, null beyond fourteen hours."""
    digits = F.translate(text, "+-:", "")
    minutes = F.substring(digits, 3, 2).try_cast("int")
    size = F.substring(digits, 1, 2).try_cast("int") * 3600 + minutes * 60
    return F.when(text.isin("", "Z"), 0).when((minutes < 60) & (size <= OFFSET_LIMIT_S), F.when(text.startswith("-"), -size).otherwise(size))


def timestamp_s(x: Column | str) -> Column:
    """Epoch seconds of the accepted timestamp forms; null for all else, calendar errors among it.

    Forms: 20140401T080000+0300, 20140402T024827[Z] and ISO 8601 with optional
    seconds, up to nine digits of a fraction (dropped) and an optional zone.
    White space around them doesn't count.
    """
    text = trimmed(x)
    zone = F.regexp_extract(text, _ZONE, 1)
    wall = F.regexp_replace(text, _ZONE, "")
    whole = F.regexp_replace(wall, r"[.][0-9]{1,9}$", "")
    # the compact form has no fraction and its zone no colon
    odd = (F.length(whole) != 19) & (wall != whole) | (F.length(whole) == 15) & zone.contains(":")
    read = F.lit(None).cast("timestamp")
    for size, pattern in _WALLS.items():
        read = F.when(F.length(whole) == size, F.try_to_timestamp(F.concat(whole, F.lit("Z")), F.lit(f"{pattern}X"))).otherwise(read)
    return F.when(~odd, F.unix_seconds(read) - _zone(zone)).cast("bigint")


def timestamp_offset_s(x: Column | str) -> Column:
    """The zone of such a timestamp in seconds, 0 for Z; null if it has none."""
    zone = F.regexp_extract(trimmed(x), _ZONE, 1)
    return F.when(timestamp_s(x).isNotNull() & (zone != ""), _zone(zone)).cast("int")


def day_text_s(x: Column | str) -> Column:
    """Epoch seconds of a day written YYYYMMDD; null unless the calendar has it."""
    return F.when(c(x).rlike(r"^\d{8}$"), timestamp_s(F.concat(c(x), F.lit("T000000"))))


def strict_number(json: Column | str, path: str) -> Column:
    """A JSON number, and nothing that only looks like one."""
    found = F.get_json_object(c(json), path)
    raw = F.schema_of_variant(F.try_variant_get(F.try_parse_json(c(json)), path, "variant"))
    return F.when(raw.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), found.try_cast("double"))


def strict_string(json: Column | str, path: str) -> Column:
    """A JSON string that isn't empty."""
    value = F.try_variant_get(F.try_parse_json(c(json)), path, "variant")
    text = F.try_variant_get(F.try_parse_json(c(json)), path, "string")
    return F.when((F.schema_of_variant(value) == "STRING") & (text != ""), text)


def strict_true(json: Column | str, path: str) -> Column:
    """Whether a field is the JSON literal true."""
    value = F.try_variant_get(F.try_parse_json(c(json)), path, "variant")
    return F.coalesce((F.schema_of_variant(value) == "BOOLEAN") & F.try_variant_get(F.try_parse_json(c(json)), path, "boolean"), F.lit(False))
