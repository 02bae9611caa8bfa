"""Functions of this package by name, for SQL."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronofold.functions import codec, times
from chronofold.functions.scalars import EARTH_M


#: SQL functions, as (parameters, result, expression); points of a path are arrays of longitudes and latitudes.
_HAVERSINE = "pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"


def _distance(a: str, b: str, c: str, d: str) -> str:
    s = f"({_HAVERSINE.format(a=a, b=b, c=c, d=d)})"
    return f"2 * {EARTH_M}D * atan2(sqrt({s}), sqrt(greatest(1 - {s}, 0D)))"


_SQL = {
    "haversine_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", _distance("lat1", "lon1", "lat2", "lon2")),
    "path_length_m": ("lon ARRAY<DOUBLE>, lat ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN size(lon) < 2 THEN 0D ELSE aggregate(sequence(1, size(lon) - 1), 0D, (n, i) -> n + {_distance('lat[i - 1]', 'lon[i - 1]', 'lat[i]', 'lon[i]')}) END"),
    "path_bounds": ("lon ARRAY<DOUBLE>, lat ARRAY<DOUBLE>", "STRUCT<min_lat: DOUBLE, min_lon: DOUBLE, max_lat: DOUBLE, max_lon: DOUBLE>", "CASE WHEN size(lon) > 0 THEN named_struct('min_lat', array_min(lat), 'min_lon', array_min(lon), 'max_lat', array_max(lat), 'max_lon', array_max(lon)) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions of this package known to SQL; returns their names.

    import_timestamp, import_offset, move_mode, encode_route, decode_route,
    crc32_update (from a state, at first 4294967295, and bytes to the next
    state), haversine_m, path_length_m and path_bounds.
    """

    def scalar(kind: str, of):
        def run(column: pa.Array) -> pa.Array:
            return pa.array([of(x) for x in column.to_pylist()])

        run.__annotations__ = {"column": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, kind)

    def route(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return codec.encode_all(xs, ys)

    def checksum(state: pa.Array, data: pa.Array) -> pa.Array:
        both = zip(state.to_pylist(), data.to_pylist(), strict=True)
        return pa.array([None if s is None or d is None else zlib.crc32(d, s ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for s, d in both], pa.int64())

    def points(data: pa.Array) -> pa.Array:
        out = []
        for d in data.to_pylist():
            try:
                out.append([{"lon": float(x), "lat": float(y)} for x, y in zip(*codec.decode(d), strict=True)])
            except (ValueError, TypeError, struct.error):
                out.append(None)
        return pa.array(out, pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))

    route.__annotations__ = {"xs": pa.Array, "ys": pa.Array, "return": pa.Array}
    checksum.__annotations__ = {"state": pa.Array, "data": pa.Array, "return": pa.Array}
    points.__annotations__ = {"data": pa.Array, "return": pa.Array}
    known = {
        "import_timestamp": scalar("bigint", times.seconds), "import_offset": scalar("int", times.zone_s), "move_mode": scalar("string", times.mode), "encode_route": F.arrow_udf(route, "binary"),
        "decode_route": F.arrow_udf(points, "array<struct<lon:double,lat:double>>"), "crc32_update": F.arrow_udf(checksum, "bigint"),
    }
    for name, f in known.items():
        spark.udf.register(name, f)
    for name, (parameters, result, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [*known, *_SQL]
