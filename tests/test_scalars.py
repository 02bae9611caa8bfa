import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.functions import codec, scalars
from chronofold.operators import routes

DAY = 1_609_372_800  # 2020-12-31, a day of a leap year, at midnight


def times():
    """Text -> seconds, made from a wall time of DAY and the forms it may have."""
    at = DAY + 23 * 3600 + 5 * 60 + 9
    out = {f"2020{d}12{d}31T23{c}05{c}09{zone}": at - shift for d, c in (("", ""), ("-", ":")) for zone, shift in (("", 0), ("Z", 0), ("+0545", 20_700), ("-0330", -12_600))}
    out |= {"2020-12-31T23:05": at - 9, "2020-12-31T23:05-03:30": at - 9 + 12_600, " \t2020-12-31T23:05:09Z\n": at}
    out |= {f"2020-12-31T23:05:09.{'7' * n}+01:00": at - 3600 for n in (1, 3, 9)}
    return out | {"20200229T000000Z": 1_582_934_400, "1969-12-31T23:59:59Z": -1, "2020-12-31T00:00:00+14:00": DAY - 50_400}


NO_TIMES = [
    "", "now", "2020-12-31", "2020-12-31 23:05:09Z", "20201231T2305Z", "20201231T230509.5Z", "20201231T230509+01:00", "2020-12-31T23:05.5Z", "2020-12-31T23:05:09.Z", "2020-12-31T23:05:09.1234567890Z",
    "2021-02-29T10:00:00Z", "20211131T100000Z", "2020-00-10T10:00:00Z", "2020-12-31T24:00:00Z", "2020-12-31T23:60:00Z", "2020-12-31T23:05:60Z", "2020-12-31T23:05:09+14:30", "2020-12-31T23:05:09+01:75", "2020-12-31T23:05:09 Z", "+2020-12-31T23:05Z", None,
]


def test_timestamps(spark):
    want = times() | dict.fromkeys(NO_TIMES)
    df = spark.createDataFrame([(k,) for k in want], "x string")
    assert {r.x: r.t for r in df.select("x", scalars.timestamp_s("x").alias("t")).collect()} == want


def test_offsets(spark):
    want = {"20201231T230509+0545": 20_700, "2020-12-31T23:05-03:30": -12_600, "2020-12-31T23:05:09Z": 0, " 20201231T230509Z ": 0, "2020-12-31T23:05:09": None, "2021-02-29T10:00:00+01:00": None}
    df = spark.createDataFrame([(k,) for k in want], "x string")
    assert {r.x: r.t for r in df.select("x", scalars.timestamp_offset_s("x").alias("t")).collect()} == want


def test_strict_json(spark):
    df = spark.createDataFrame([('{"a":1.5}',), ('{"a":"1"}',), ('{"a":true}',), ('{"a":""}',), ('{"a":"x"}',), ("no",), (None,)], "j string")
    rows = df.select(scalars.strict_number("j", "$.a"), scalars.strict_string("j", "$.a"), scalars.strict_true("j", "$.a")).collect()
    assert [tuple(r) for r in rows] == [(1.5, None, False), (None, "1", False), (None, None, True), (None, None, False), (None, "x", False), (None, None, False), (None, None, False)]


def test_bounds_of_values(spark):
    df = spark.createDataFrame([(-1.0, 400.0, 50401.0), (370.0, 359.0, -50400.0), (90.0, -1.0, 1.5)], "c double, a double, o double")
    rows = df.select(scalars.course("c"), scalars.course_accuracy("a"), scalars.offset_s("o")).collect()
    assert [tuple(r) for r in rows] == [(None, None, None), (10.0, 359.0, -50400), (90.0, None, None)]


def test_half_up_and_distance(spark):
    r = spark.range(1).select(scalars.half_up(F.lit(-2.5)), scalars.half_up(F.lit(2.5)), F.round(scalars.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), 1)).first()
    assert tuple(r) == (-2, 3, 111194.9)


POINTS = st.lists(st.tuples(st.floats(-180, 180), st.floats(-90, 90)), min_size=1, max_size=30)


@given(POINTS, st.sampled_from([100, 1000]))
def test_codec_round_trip(points, cm):
    lon, lat = zip(*points, strict=True)
    try:
        data = codec.encode(lon, lat, cm)
    except ValueError:
        return
    x, y = codec.decode(data)
    assert x == pytest.approx(lon, abs=cm * 1e-9) and y == pytest.approx(lat, abs=cm * 1e-9)


def test_codec_header_and_errors():
    data = codec.encode([13.0, 13.1, 13.2], [52.0, 52.1, 52.2])
    assert data[:4] == b"CDQB" and data[4:6] == b"\1\0" and data[6:8] == b"\x64\0" and data[8:12] == b"\3\0\0\0"
    for lon, lat, cm in (([], [], 100), ([1.0], [91.0], 100), ([1.0], [1.0], 0), ([1.0], [1.0], 65536), ([-180.0, 180.0], [0.0, 0.0], 1)):
        with pytest.raises(ValueError):
            codec.encode(lon, lat, cm)
    with pytest.raises(ValueError):
        codec.decode(data[:-1] + b"\x80")


ROUTES = st.lists(st.one_of(st.none(), st.lists(st.tuples(st.floats(-200, 200), st.one_of(st.none(), st.floats(-95, 95))), max_size=8)), max_size=8)


@given(ROUTES, st.sampled_from([1, 100, 65535]))
def test_many_routes_encode_as_each_alone(rows, cm):
    xs = pa.array([None if r is None else [x for x, _ in r] for r in rows], pa.list_(pa.float64()))
    ys = pa.array([None if r is None else [y for _, y in r] for r in rows], pa.list_(pa.float64()))

    def alone(r):
        try:
            return codec.encode([x for x, _ in r], [float("nan") if y is None else y for _, y in r], cm)
        except (ValueError, TypeError):
            return None

    assert codec.encode_all(xs, ys, cm).to_pylist() == [alone(r) for r in rows]


def test_routes_of_different_lengths_have_no_code():
    got = codec.encode_all(pa.array([[1.0, 2.0], [3.0], [4.0, 5.0]]), pa.array([[1.0], [3.0], [4.0, 6.0]])).to_pylist()
    assert got[0] is None and got[1] == codec.encode([3.0], [3.0]) and got[2] == codec.encode([4.0, 5.0], [4.0, 6.0])


def test_routes_without_times(spark):
    df = spark.createDataFrame([([(None, 1.0, 2.0), (None, 0.0, 0.0)],), ([(9, 1.0, 2.0), (None, 5.0, 5.0), (3, 1.0, 2.001)],), ([(1, None, 2.0)],), (None,), ([],)], "p array<struct<ts:bigint,lon:double,lat:double>>")
    got = [r[0] for r in df.select(routes.cleaned_route(F.col("p"))).collect()]
    assert [[tuple(p) for p in r.points] for r in got] == [[(None, 1.0, 2.0), (None, 0.0, 0.0)], [(3, 1.0, 2.001), (9, 1.0, 2.0)], [], [], []]
    assert [r.quality for r in got] == ["raw", "filtered", "raw", "raw", "raw"]


def test_spikes_go_and_flights_stay():
    line = [(k * 60, 13.0 + k / 1000, 52.0) for k in range(3)]
    assert routes.clean([*line[:2], (90, 63.0, 52.0), line[2]]) == line
    flight = [(k * 60, 13.0 + k * 0.2, 52.0) for k in range(3)]
    assert routes.clean(flight) == flight
    assert routes.clean([]) == []
