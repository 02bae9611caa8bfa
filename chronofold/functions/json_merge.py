"""Revisions of JSON records: canonical text, populated fields, deep merges."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(raw: Column | str) -> Column:
    """JSON text with sorted keys; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(F.col(raw) if isinstance(raw, str) else raw))


def fingerprint(raw: Column | str) -> Column:
    """Equal for equal values, whatever the order of their keys."""
    return F.sha2(canonical(raw), 256)


def populated(value: Any) -> int:
    """How many fields of an object, and of the objects in its fields, aren't null."""
    return sum(1 + populated(v) for v in value.values() if v is not None) if isinstance(value, dict) else 0


def over(base: Any, later: Any, explicit: frozenset[str] = frozenset()) -> Any:
    """``later`` over ``base``: objects merge by field; a null changes nothing, unless the field is one of ``explicit``; an empty array doesn't replace an array."""
    if isinstance(base, dict) and isinstance(later, dict):
        out = dict(base)
        for key, value in later.items():
            if value is None:
                if key in explicit or key not in out:
                    out[key] = None
            else:
                out[key] = over(out.get(key), value)
        return out
    if later is None or (later == [] and isinstance(base, list)):
        return base
    return later


def under(base: Any, other: Any) -> Any:
    """``base`` with what it lacks filled from ``other``."""
    return over(other, base)


def merged_revisions(raws: Column | str, explicit: list[str] | None = None) -> Column:
    """Fold an array of JSON texts, from the earliest revision to the latest, into one."""
    fields = frozenset(explicit or ())

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for texts in batch.to_pylist():
                value = None
                for t in texts or []:
                    try:
                        value = over(value, json.loads(t), fields)
                    except (TypeError, ValueError):
                        continue
                out.append(None if value is None else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            yield pa.array(out, pa.string())

    return run(F.col(raws) if isinstance(raws, str) else raws)


def populated_fields(raw: Column | str) -> Column:
    """:func:`populated` of a JSON text; 0 for what isn't JSON."""

    @F.arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                try:
                    out.append(populated(json.loads(t)))
                except (TypeError, ValueError):
                    out.append(0)
            yield pa.array(out, pa.int32())

    return run(F.col(raw) if isinstance(raw, str) else raw)
