from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataquery.functions import jsons
from strataquery.operators import changes

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab/~", max_size=3), x, max_size=4), max_leaves=12)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ('{"a":1,"b":2}', '{"b":2,"a":1}', True), ("1.0", "1.00", True), ("1", "1.0", False), ("1", "true", False), ("[1]", "[1.0]", False), ('"a"', '"\\u0061"', True), ("100.0", "1e2", True), ("-0.0", "0.0", False),
        ("[1,,}", "[1,,}", None), ("NaN", "NaN", None), ("1e400", "1e400", None), ("{} x", "{} x", None), ("", "", None), (None, "1", None), ('"\\ud800"', '"\\ud800"', None), ("01", "01", None), ("[" * 100_000, "1", None),
        (str(10**40), str(10**40), True), (str(10**40), str(10**40 + 1), False), ('{"a":1,"a":2}', '{"a":2}', True),
    ],
)
def test_equality(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(jsons.json_equal(F.col("a"), F.col("b"))).first()[0] is same


def test_changes_of_documents(spark):
    pairs = {
        1: ('{"a": 1}', '{"a": "1"}', {("/a", "replace", '"1"')}), 2: ('{"a/b": 1}', '{"a": {"b": 1}}', {("/a~1b", "delete", None), ("/a", "add", '{"b":1}')}),
        3: ('{"a": "{x"}', '{"a": "{y"}', {("/a", "replace", '"{y"')}), 4: ('{"a": null}', "{}", {("/a", "delete", None)}), 5: ('{"a":1,"b":{"c":[1]}}', '{"b": {"c": [1]}, "a":1}', set()),
        6: ('{"a":{"b":1}}', '{"a":2}', {("/a", "replace", "2")}), 7: (None, "{}", {("", "add", "{}")}), 8: ("[1]", None, {("", "delete", None)}), 9: ("{", "{}", {("", "not-json", None)}), 10: (None, None, set()),
        11: ('{"a":{"b":{"c":{"d":1}}}}', '{"a":{"b":{"c":{"d":1.0,"":0}}}}', {("/a/b/c/d", "replace", "1.0"), ("/a/b/c/", "add", "0")}), None: ("1", "2", {("", "replace", "2")}),
    }
    side = lambda n: spark.createDataFrame([(k, v[n]) for k, v in pairs.items()], "k int, v string").repartition(2)
    got = [tuple(r) for r in changes.semantic_changes(side(0), side(1), "k", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, *c) for k, v in pairs.items() for c in v[2]}


def applied(value: object, found: list) -> object:
    """The document that the changes make."""
    value = json.loads(json.dumps(value))
    for path, op, new in found:
        if not path:
            return json.loads(new)
        *up, last = [p.replace("~1", "/").replace("~0", "~") for p in path[1:].split("/")]
        at = value
        for p in up:
            at = at[p]
        if op == "delete":
            del at[last]
        else:
            at[last] = json.loads(new)
    return value


@given(VALUES, VALUES)
@settings(max_examples=300, deadline=None)
def test_changes_lead_from_one_to_the_other(a, b):
    found = list(jsons.differences(a, b))
    assert jsons.encoded(applied(a, found)) == jsons.encoded(b)
    assert (not found) == (jsons.encoded(a) == jsons.encoded(b))


def test_null_keys_of_bindings(spark):
    side = lambda v: spark.createDataFrame([(None, 1, "ok", v), ("s", 2, "ok", v)], "scope string, ordinal int, state string, target int")
    got = changes.binding_delta(side(1), side(2), ["scope", "ordinal"], "state", ["target"]).collect()
    assert sorted((str(r["scope"]), r["ordinal"], r["status"]) for r in got) == [("None", 1, "changed"), ("s", 2, "changed")]
