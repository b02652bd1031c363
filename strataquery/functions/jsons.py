"""JSON texts as values: one canonical form, equality, and what sets or deletes parts of one so that it becomes another.

The canonical form has its keys in order, no blanks and every number by its kind: 1, 1.0 and true are three values, 1.0
and 1.00 are one. The built-in variant type isn't used here, for it makes 1.0 an integer inside of arrays, takes 1e400 for
a number and passes over what follows a value. What isn't JSON has no canonical form: NaN, infinities, numbers beyond
a double's range, lone surrogates, a nesting too deep to read, the empty text. Of repeated keys the last one counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

GONE = object()


def _refused(name: str) -> None:
    raise ValueError(name)


def encoded(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def read(text: str | None) -> tuple[bool, object]:
    """Whether a text is JSON, and its value."""
    try:
        value = json.loads(text or "", parse_constant=_refused)
        encoded(value).encode("utf-8")
    except (ValueError, RecursionError):
        return False, None
    return True, value


def canonical(text: Column) -> Column:
    """The canonical form of a JSON text; null where it isn't JSON."""

    @pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return pd.Series([encoded(value) if ok else None for ok, value in map(read, texts)], dtype=object)

    return form(text.cast("string"))


def kind_of(text: Column) -> Column:
    """object, array, string, integer, float, boolean or null; null where it isn't JSON."""
    c = canonical(text)
    first = F.substring(c, 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(c == "null", "null").when(c.isin("true", "false"), "boolean").when(c.rlike("[.e]"), "float").when(c.isNotNull(), "integer")


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts are the same value; null where either isn't JSON."""
    return canonical(a) == canonical(b)


def differences(before: object, after: object) -> Iterator[tuple[str, str, str | None]]:
    """(path, op, value) in the order of paths' names. Objects are compared name by name; anything else is one value, and
    what comes or goes does so as a whole. Paths are JSON pointers."""
    open_ = [("", before, after)]
    while open_:
        path, a, b = open_.pop()
        if isinstance(a, dict) and isinstance(b, dict):
            for name in sorted(a.keys() | b.keys(), reverse=True):
                step = name.replace("~", "~0").replace("/", "~1")
                open_.append((f"{path}/{step}", a.get(name, GONE), b.get(name, GONE)))
        elif b is GONE:
            yield path, "delete", None
        elif a is GONE:
            yield path, "add", encoded(b)
        elif (value := encoded(b)) != encoded(a):
            yield path, "replace", value


def text_differences(before: str | None, after: str | None) -> list[tuple[str, str, str | None]]:
    sides = [(True, GONE) if t is None else read(t) for t in (before, after)]
    if not all(ok for ok, _ in sides):
        return [("", "not-json", None)]
    return list(differences(*(value for _, value in sides)))


def json_changes(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, path, op, value) for rows of two JSON texts; a null text is no document. Rows of equal texts never reach
    Python. A text that isn't JSON gives the one row ('', 'not-json', null), for nothing can be said about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, texts in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                found = text_differences(*texts)
                rows += found
                at += [i] * len(found)
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], [key, "path", "op", "value"])

    some = pairs.where(~F.col(before).eqNullSafe(F.col(after))).select(key, before, after)
    return some.mapInArrow(run, f"`{key}` {some.schema[key].dataType.simpleString()}, path string, op string, value string")
