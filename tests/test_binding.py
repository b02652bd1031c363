from __future__ import annotations

import random

import pytest

from strataquery.functions import manifests
from strataquery.operators import binding, structure
from strataquery.sources.generations import Generations


def test_calls_are_bound(spark):
    symbols = spark.createDataFrame([("a.py", "run", "A.run"), ("a.py", "helper", "helper"), ("b.py", "load", "load"), ("c.py", "load", "load"), ("d.py", "only", "only"), ("b.py", "helper", "helper")], "path string, name string, qualname string")
    imports = spark.createDataFrame([("a.py", "b.py")], "source string, target string")
    calls = spark.createDataFrame([("a.py", "A.x", "self.run", 1), ("a.py", None, "helper", 2), ("a.py", None, "b.load", 3), ("a.py", None, "x.only", 4), ("d.py", None, "load", 5), ("a.py", None, "print", 6)], "path string, source string, target string, line int")
    got = {r["line"]: (r["status"], r["rule"], r["to_path"]) for r in binding.bind_calls(calls, symbols, imports).collect()}
    assert got == {1: ("resolved", "self", "a.py"), 2: ("resolved", "local", "a.py"), 3: ("resolved", "import", "b.py"), 4: ("resolved", "unique", "d.py"), 5: ("ambiguous", "unique", None), 6: ("unresolved", None, None)}


def test_calls_through_named_imports_and_from_outside(spark):
    symbols = spark.createDataFrame([("b.py", "load", "load"), ("c.py", "load", "load"), ("f.py", "real", "real")] + [(f"m{i}.py", "hot", "hot") for i in range(50)], "path string, name string, qualname string")
    imports = spark.createDataFrame([("a.py", "b.py"), ("a.py", "c.py")], "source string, target string")
    named = spark.createDataFrame([("a.py", "load", "c.py", "load"), ("a.py", "alias", "f.py", "real"), ("a.py", "lost", "f.py", "none")], "path string, name string, to_path string, to_name string")
    external = spark.createDataFrame([("a.py", "numpy"), ("b.py", "numpy")], "path string, name string")
    calls = spark.createDataFrame([("a.py", None, t, i) for i, t in enumerate(["load", "x.alias", "numpy.array", "lost", "hot", "numpy.load"])] + [("z.py", None, "numpy.array", 9)], "path string, source string, target string, line int")
    bound = binding.bind_calls(calls, symbols, imports, named, external)
    got = {r["line"]: (r["status"], r["rule"], r["to_path"], r["to"]) for r in bound.collect()}
    assert got == {
        0: ("resolved", "named", "c.py", "load"), 1: ("resolved", "named", "f.py", "real"), 2: ("external", None, None, None), 3: ("unresolved", None, None, None), 4: ("ambiguous", "unique", None, None),
        5: ("resolved", "named", "c.py", "load"), 9: ("unresolved", None, None, None),
    }
    plain = {r["line"]: r["status"] for r in binding.bind_calls(calls, symbols, imports).collect()}
    assert plain == {0: "ambiguous", 1: "unresolved", 2: "unresolved", 3: "unresolved", 4: "ambiguous", 5: "ambiguous", 9: "unresolved"}


def brute_owner(key, exports, defined):
    ends, loose, seen, open_ = set(), False, set(), [(key, ())]
    while open_:
        k, way = open_.pop()
        if k in defined:
            ends.add(k)
        elif k in way or not exports.get(k):
            loose = True
        elif (k, way[-1:]) not in seen:
            seen.add((k, way[-1:]))
            open_ += [(t, (*way, k)) for t in exports[k]]
    if not ends:
        return "unresolved", None, None
    return ("resolved-unique", *ends.pop()) if len(ends) == 1 and not loose else ("ambiguous", None, None)


@pytest.mark.parametrize("seed", range(3))
def test_owners_behind_facades(spark, seed):
    pick = random.Random(seed)
    key = lambda i: (f"m{i}", "n")
    exports = {key(i): [key(i + 1)] for i in range(100, 140)}  # a chain of 40, to a definition
    exports |= {key(i): [key(200 + (i + 1) % 7)] for i in range(200, 207)}  # a circle, and a chain into it
    exports |= {key(300): [key(301)], key(301): [key(203)], key(302): [key(100), key(120)], key(303): [key(302), key(300)], key(304): [key(302)], key(305): [key(305)]}
    for i in range(25):
        exports[key(i)] = [key(pick.randrange(30)) for _ in range(pick.choice([1, 1, 1, 2, 3]))]
    defined = {key(140), key(7), key(27), key(28)}
    exports = {k: sorted(set(v)) for k, v in exports.items()}
    e = spark.createDataFrame([(*k, *t) for k, v in exports.items() for t in v], "path string, name string, owner string, owner_name string").repartition(3)
    d = spark.createDataFrame(sorted(defined), "path string, name string")
    asked = sorted({*exports, *defined, key(999)})
    got = {(r["path"], r["name"]): (r["status"], r["owner"], r["owner_name"]) for r in structure.import_owners(spark.createDataFrame(asked, "path string, name string"), e, d).collect()}
    assert got == {k: brute_owner(k, exports, defined) for k in asked}
    assert got[key(100)] == ("resolved-unique", "m140", "n") and got[key(304)] == ("resolved-unique", "m140", "n") and got[key(300)][0] == "unresolved" and got[key(303)][0] == "ambiguous"


def test_occurrences_and_claims(spark):
    o = spark.createDataFrame([("a", "s", 1, "definition"), ("b", "s", 2, "reference"), ("b", "s", 2, "reference"), ("b", "t", 3, "reference")], "path string, symbol string, line int, role string")
    d, located, other = binding.stage_occurrences(o)
    assert d.count() == 1 and [tuple(r) for r in located.collect()] == [("b", "s", 2, 2)] or located.first()["n"] == 2
    assert other.first()["symbol"] == "t"
    got = {r["path"]: r["producers"] for r in binding.claims("s", ("scip", o), ("lsp", o.where("path = 'b'"))).collect()}
    assert got == {"a": "scip", "b": "lsp,scip"}
    rows = spark.createDataFrame([("t", "r", "p", None, "m", 1, None)] * 2 + [("t", "r", "p", None, "m", 2, None)], "tool string, rule string, path string, symbol string, message string, line int, column int")
    assert binding.diagnostics(rows).count() == 2
    files = spark.createDataFrame([("tests/test_x.py", "open('data/a.json')"), ("data/a.json", "{}"), ("src/x.py", "'data/a.json'")], "path string, text string")
    assert [tuple(r) for r in binding.literal_readers(files).collect()] == [("tests/test_x.py", "data/a.json")]


def test_manifests(spark):
    files = {
        "Makefile": "all: a b\n\techo hi\n.PHONY: all\nX := 1\n", "x/pyproject.toml": '[project]\nname = "n"\ndependencies = ["a"]\n', "p.json": '{"a": {"b": 1}}', "c.ini": "[s]\nk = v\n", "go.mod": "module m\nrequire (\n\tex.com/a v1.2.3\n)\n", "bad.json": "{",
    }
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {(r["namespace"], r["subject"], r["value"]) for r in manifests.parse_declarations(df).collect()}
    assert {("make.target", "all", "a b"), ("make.recipe", "all", "echo hi"), ("config", "project.name", "n"), ("config", "project.dependencies", '["a"]'), ("config", "a.b", "1"), ("config", "s.k", "v"), ("go.require", "ex.com/a", "v1.2.3")} <= got
    assert not any(s == "X" for _, s, _ in got)


def test_generations(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "index"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "producer string, v int")
    assert g.current() == 0 and g.publish(0, {"edges": df}) == 1
    assert g.replace_partitions("edges", g.table("edges"), spark.createDataFrame([("a", 9)], df.schema), "a", 1) == 2
    assert {tuple(r) for r in g.table("edges").collect()} == {("a", 9), ("b", 2)} and g.table("edges", 1).count() == 2
    with pytest.raises(RuntimeError):
        g.publish(1, {"edges": df})
