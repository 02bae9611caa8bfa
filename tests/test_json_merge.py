import json

from hypothesis import given
from hypothesis import strategies as st

from chronofold.functions import json_merge as j

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=2), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=8)


@given(VALUES, VALUES)
def test_merges_keep_what_the_other_lacks(a, b):
    assert j.over(a, None) == a and j.over(a, a) == a
    assert j.under(a, b) == j.over(b, a)
    if isinstance(a, dict) and isinstance(b, dict):
        assert set(j.over(a, b)) == set(a) | set(b)


def test_explicit_nulls_and_empty_arrays():
    assert j.over({"x": 1, "y": [1]}, {"x": None, "y": []}) == {"x": 1, "y": [1]}
    assert j.over({"x": 1}, {"x": None}, frozenset("x")) == {"x": None}


def test_columns(spark):
    rows = [('{"b":1,"a":{"c":null,"d":[1,2]}}', ['{"a":1,"b":{"x":1}}', '{"b":{"y":2},"a":null}']), ('{"a":{"d":[1,2],"c":null},"b":1}', ["bad", "[1]"]), ("no", []), (None, None)]
    df = spark.createDataFrame(rows, "raw string, raws array<string>")
    out = df.select(j.canonical("raw").alias("c"), j.fingerprint("raw").alias("f"), j.populated_fields("raw").alias("n"), j.merged_revisions("raws").alias("m")).collect()
    assert out[0].c == out[1].c and out[0].f == out[1].f and out[2].c is None
    assert [r.n for r in out] == [3, 3, 0, 0]
    assert [r.m and json.loads(r.m) for r in out] == [{"a": 1, "b": {"x": 1, "y": 2}}, [1], None, None]
