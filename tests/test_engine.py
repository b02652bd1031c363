from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataquery import operations
from strataquery.engine import Engine
from strataquery.operators import context, graph

FILES = {
    "src/core/base.py": "class Planner:\n    def plan(self, yard):\n        return yard\n",
    "src/core/__init__.py": "",
    "src/core/yard.py": "from core.base import Planner\n\n\nclass RailYardPlanner(Planner):\n    def resolve(self, x):\n        return Planner().plan(x)\n",
    "src/app.py": "import core.yard\n\ndef main():\n    return core.yard.RailYardPlanner()\n",
    "tests/test_app.py": "import app\n\ndef test_main():\n    assert app.main()\n",
    "AGENTS.md": "be brief\n",
    ".env": "SECRET=1",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    e = Engine.build(spark, str(root))
    path = str(tmp_path_factory.mktemp("index"))
    assert e.save(path) == 1 and e.save(path) == 2
    assert Engine.load(spark, path, 1).files.count() == 6
    return Engine.load(spark, path)


def test_lookups(engine):
    assert {r["name"]: r["n"] for r in engine.stats().collect()} == {"files": 6, "symbols": 6, "edges": engine.edges.count()}
    assert engine.symbol("Planner").first()["path"] == "src/core/base.py"
    assert [r["qualname"] for r in engine.outline("src/core/yard.py").collect()] == ["RailYardPlanner", "RailYardPlanner.resolve"]
    assert "Planner().plan(x)" in engine.source("RailYardPlanner.resolve").first()["text"]
    assert [(r["path"], r["line"]) for r in engine.grep("RAILYARD").collect()] == [("src/app.py", 4), ("src/core/yard.py", 4)]
    assert {r["path"] for r in engine.refs("x.Planner").collect()} == {"src/core/yard.py"}
    assert [r["qualname"] for r in engine.enclosing("src/core/yard.py", 6).collect()] == ["RailYardPlanner.resolve", "RailYardPlanner"]
    assert engine.read("src/app.py", 3, 3).first()["content"] == "def main():"


def test_search_and_graph(engine):
    assert engine.find("RailYardPlanner", 5).first()["qualname"] == "RailYardPlanner"
    assert {(r["node"], r["depth"]) for r in engine.affected(["src/core/base.py"]).collect()} == {("src/core/yard.py", 1), ("src/app.py", 2), ("tests/test_app.py", 3)}
    assert [r["node"] for r in engine.affected_tests(["src/core/base.py"]).collect()] == ["tests/test_app.py"]
    assert {(r["role"], r["path"]) for r in engine.impact(["src/core/base.py"]).collect()} == {("implementation", "src/core/yard.py"), ("implementation", "src/app.py"), ("verification", "tests/test_app.py")}
    pack = engine.context_pack("RailYardPlanner plan", 60).collect()
    assert pack and sum(r["cost"] for r in pack) <= 60 and pack[0]["confidence"] == "high"
    assert engine.context_pack("zzzz", 60).count() == 0


def test_relative_and_script_imports(spark, tmp_path):
    tree = {
        "src/pkg/__init__.py": "from .a import f\n", "src/pkg/a.py": "def f():\n    return 1\n", "src/pkg/sub/__init__.py": "", "src/pkg/sub/b.py": "from ..a import f\nfrom . import c\nfrom .... import far\n", "src/pkg/sub/c.py": "x = 1\n",
        "tests/test_b.py": "from pkg.sub.b import f\n", "top.py": "from .beside import g\n", "beside.py": "def g(): pass\n", "web/app/main.ts": "", "web/lib/util.ts": "", "web/lib/kit/index.js": "",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    e = Engine.build(spark, str(tmp_path))
    edges = {(r["source"], r["target"]) for r in e.imports().collect()}
    assert edges == {
        ("src/pkg/__init__.py", "src/pkg/a.py"), ("src/pkg/sub/b.py", "src/pkg/a.py"), ("src/pkg/sub/b.py", "src/pkg/sub/c.py"), ("tests/test_b.py", "src/pkg/sub/b.py"), ("top.py", "beside.py"),
    }
    assert [r["node"] for r in e.affected_tests(["src/pkg/a.py"]).collect()] == ["tests/test_b.py"]
    scripts = spark.createDataFrame([("web/app/main.ts", "import", t) for t in ("../lib/util", "../lib/kit", "./none", "../../../out", "../lib/util.ts")], "path string, kind string, target string")
    native = spark.createDataFrame([("a.go", "b.go"), ("a.go", "a.go")], "source string, target string")
    got = {(r["source"], r["target"]) for r in context.import_graph(e.files, scripts, native).collect()}
    assert got == {("web/app/main.ts", "web/lib/util.ts"), ("web/app/main.ts", "web/lib/kit/index.js"), ("a.go", "b.go")}


def test_states(spark, engine):
    assert {r["status"] for r in engine.delta(engine).collect()} == {"unchanged"}
    recorded = engine.files.select("path", F.when(F.col("path") == "src/app.py", "old").otherwise(F.col("file_digest")).alias("digest")).union(spark.createDataFrame([("gone", "x")], "path string, digest string"))
    fresh = {r["path"]: r["fresh"] for r in engine.freshness(recorded).collect()}
    assert fresh["src/app.py"] is False and fresh["gone"] is None and fresh["AGENTS.md"] is True
    assert engine.digests().where("path = ''").first()["size"] == sum(len(t) for p, t in FILES.items() if p != ".env")
    scope = context.instruction_scope(spark.createDataFrame([("a/b/c.py",)], "path string"), spark.createDataFrame([("AGENTS.md",), ("a/AGENTS.md",), ("a/AGENTS.override.md",), ("x/AGENTS.md",)], "path string"))
    assert [r["instruction"] for r in scope.orderBy("precedence").collect()] == ["a/AGENTS.override.md", "a/AGENTS.md", "AGENTS.md"]
    touched = context.touched_symbols(spark.createDataFrame([("src/core/base.py", 2, 2)], "path string, from_line int, to_line int"), engine.symbols)
    assert {r["qualname"] for r in touched.collect()} == {"Planner", "Planner.plan"}
    names = spark.createDataFrame([("main",), ("nope",)], "name string")
    assert {(r["name"], r["status"]) for r in context.nominations(engine.symbols, names).collect()} == {("main", "resolved-unique"), ("nope", "unresolved")}


def test_search_stages(spark, engine):
    hits = {(r["row_type"], r["path"], r["qualname"]) for r in engine.find("Planner", 20).collect()}
    assert ("symbol", "src/core/base.py", "Planner") in hits and ("file", "src/core/yard.py", "") in hits
    seen = spark.createDataFrame([("src/app.py", "YardMain", "scip YardMain#", 3)], "path string, display_name string, symbol string, line int")
    assert ("native-definition", "src/app.py", "YardMain") in {(r["row_type"], r["path"], r["qualname"]) for r in engine.find("YardMain", 5, definitions=seen).collect()}
    roles = {(r["role"], r["path"]) for r in engine.action_map("test of RailYardPlanner main").collect()}
    assert ("edit", "src/core/yard.py") in roles and ("verify", "tests/test_app.py") in roles
    assert [tuple(r) for r in engine.verifiers(["src/core/base.py"]).collect()] == [("src/core/base.py", "tests/test_app.py", 3)]
    sections = {(r["section"], r["path"]) for r in engine.brief("plan", ["src/core/base.py"]).collect()}
    assert {("changed", "src/core/base.py"), ("affected", "src/app.py"), ("verify", "tests/test_app.py")} <= sections


def test_operations(spark, engine, tmp_path):
    assert operations.call(engine, "symbol", name="Planner").count() == 1
    for op, args in (("nothing", {}), ("symbol", {"nom": "x"})):
        with pytest.raises(ValueError):
            operations.call(engine, op, **args)
    kept = operations.Results(engine, 1, str(tmp_path))
    first = sorted(map(tuple, kept.get("outline", path="src/core/yard.py").select("qualname").collect()))
    assert sorted(map(tuple, kept.get("outline", path="src/core/yard.py").select("qualname").collect())) == first and (kept.hits, kept.misses) == (1, 1)
    assert operations.action_key(1, "find", {"a": 1, "b": 2}) == operations.action_key(1, "find", {"b": 2, "a": 1}) != operations.action_key(2, "find", {"a": 1, "b": 2})
    costs = {r["answer"]: (r["n_rows"], r["tokens"] > 0) for r in operations.economics(engine, {"languages": engine.languages(), "refs": engine.refs("x.Planner")}).collect()}
    assert costs["languages"][1] and costs["refs"] == (engine.refs("x.Planner").count(), True)
    assert operations.intelligence(engine, "snapshot").count() == 6 and operations.intelligence(engine, "delta", before=engine).where("status <> 'unchanged'").count() == 0
    assert {r["part"]: r["value"] for r in operations.intelligence(engine, "explain", query="callers of x").collect()}["intent"] == '"relationship"'
    with pytest.raises(ValueError):
        operations.intelligence(engine, "delta")


def test_owner_behind_reexports(spark, tmp_path):
    for name, text in {"pkg/__init__.py": "from pkg.mid import Thing\n", "pkg/mid.py": "from pkg.core import Real as Thing\n", "pkg/core.py": "class Real: ...\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    e = Engine.build(spark, str(tmp_path))
    assert tuple(e.import_owner("pkg/__init__.py", "Thing").first())[2:] == ("resolved-unique", "pkg/core.py", "Real")
    assert e.import_owner("pkg/core.py", "Nothing").first()["status"] == "unresolved"


def test_refresh_of_changed_paths(spark, tmp_path):
    for name, text in {"a.py": "def f(): ...\n", "b.py": "def g(): ...\n", "c.py": "X = 1\n"}.items():
        (tmp_path / name).write_text(text)
    before = Engine.build(spark, str(tmp_path))
    before.files = graph.cut(before.files)
    (tmp_path / "a.py").write_text("import b\ndef h(): b.g()\n")
    (tmp_path / "b.py").unlink()
    (tmp_path / "d.py").write_text("def d(): ...\n")
    after, changes = before.refreshed(str(tmp_path), ["a.py", "b.py", "d.py", "../x"])
    assert {(r["path"], r["status"]) for r in changes.collect()} == {("a.py", "changed"), ("b.py", "removed"), ("d.py", "added")}
    assert {r["qualname"] for r in after.symbols.collect()} == {"h", "d", "X"} and {r["target"] for r in after.edges.where("kind = 'call'").collect()} == {"b.g"}
