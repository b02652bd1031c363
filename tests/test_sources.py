from __future__ import annotations

import json

from pyspark.sql import functions as F

from strataquery.functions import parse
from strataquery.sources import repository as R
from strataquery.streaming import journal as J

CODE = '''import os, importlib
from pkg.mod import thing as t
import functools

class Base: ...

class A(Base):
    @functools.lru_cache
    def m(self, x: pkg.T):
        if os.path.exists(x):
            return open(x)
        return t(x)

def f():
    A.m.cache_clear()
    return importlib.import_module("x")
'''


def test_scan_and_parse(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"src/a.py": CODE, "src/.env": "S=1", "node_modules/x.py": "x", "docs/r.md": "# r", "go/m.go": "func Run(a int) {}\ntype T struct {}\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = R.scan(spark, str(root), [("docs/*", None, "outline")])
    got = {r["path"]: (r["language"], r["evidence_visibility"], r["module_name"]) for r in files.collect()}
    assert got == {"src/a.py": ("python", "source", "a"), "docs/r.md": ("markdown", "outline", None), "go/m.go": ("go", "source", None)}
    symbols = {(r["qualname"], r["kind"]) for r in parse.parse_symbols(files).collect()}
    assert symbols == {("Base", "class"), ("A", "class"), ("A.m", "method"), ("f", "function"), ("Run", "function"), ("T", "struct")}
    edges = {(r["source"], r["kind"], r["target"]) for r in parse.parse_edges(files).collect()}
    assert {(None, "import", "pkg.mod.thing"), ("A", "inherits", "Base"), ("A.m", "call", "t"), ("A.m", "parameter-type", "pkg.T")} <= edges
    findings = parse.parse_findings(files)
    kinds = {r["kind"] for r in findings.collect()}
    assert {"dynamic-import", "cache-owner", "cache-invalidation", "filesystem-check", "filesystem-use"} <= kinds
    assert [(r["check_line"], r["use_line"]) for r in parse.check_use_pairs(findings).collect()] == [(10, 11)]
    assert R.unparsed(files, spark.createDataFrame([], "artifact_key string")).count() == 3
    R.export_snapshot(files.select("path"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert json.loads(R.as_json(files.select("path", "language").limit(1)).first()[0]).keys() == {"language", "path"}


GO = """package m
import (
\t"fmt"
\tx "ex.org/y"
)
// func No() {}
type T struct {
\ta int
}
type (
\tA interface { M() }
\tG[K any] struct{ k K }
)
func Run(a int, f func() error) (r struct{ x int }, err error) {
\ts := "func Fake() {"
}
func (t *T) M(x int) {}
func ext(a int) int
func last() {}
"""
RUST = """use std::{io, fmt::{self, Display as D}};
#[derive(Debug)]
pub struct S<T> { a: T }
impl<T: Clone> fmt::Display for S<T> where T: D {
    fn fmt(&self) -> R { let c = '{'; "fn no() {" ; x }
    pub async fn go<'a>(x: &'a str) {}
}
trait Tr { fn need(&self); }
mod inner { pub unsafe extern "C" fn f() {} }
macro_rules! mac { () => { fn hid() {} } }
const fn cf() -> i32 { 3 }
"""


def test_outlines():
    found = parse.parse_file("m.go", GO, "go")
    assert [(r["qualname"], r["kind"], r["start_line"], r["end_line"]) for r in found if r["record"] == "symbol"] == [
        ("T", "struct", 7, 9), ("A", "interface", 11, 11), ("G", "struct", 12, 12), ("Run", "function", 14, 16), ("T.M", "method", 17, 17), ("ext", "function", 18, 18), ("last", "function", 19, 19)
    ]
    assert [r["target"] for r in found if r["record"] == "edge"] == ["fmt", "ex.org/y"]
    found = parse.parse_file("m.rs", RUST, "rust")
    assert [(r["qualname"], r["kind"]) for r in found if r["record"] == "symbol"] == [("S", "struct"), ("S.fmt", "method"), ("S.go", "method"), ("Tr", "trait"), ("Tr.need", "method"), ("inner", "module"), ("f", "function"), ("mac", "macro"), ("cf", "function")]
    assert [r["target"] for r in found if r["record"] == "edge"] == ["std::io", "std::fmt", "std::fmt::Display"]
    for odd in ("func (", "type (", "import", "func", "impl", "use {", "{{{", "fn", "'", '"', "/*"):
        parse.parse_file("x", odd, "go"), parse.parse_file("x", odd, "rust")


MODULE = '''"""doc"""
import os.path, json as j
from .core import Planner as P, plan
from .other import *
from .second import plan
LIMIT: "Optional[pkg.N]" = 3
type Pair[T] = tuple[T, T]
__all__ = ["P", "plan", "LIMIT", "run", "gone"]

def run(a: "list[pkg.A] | None", *b: Literal["x"]) -> dict[str, pkg.B]:
    global LIMIT
    sys.modules["x"] = None
'''


def test_bindings_and_exports(spark):
    files = spark.createDataFrame([("m/__init__.py", MODULE, "python"), ("n.py", "import a\n_x = 1\ny = a.b\n", "python"), ("bad.py", "def (", "python")], "path string, text string, language string")
    parsed = parse.parse_all(files)
    assert {(r["name"], r["kind"]) for r in parse.parse_symbols(parsed).where("path LIKE 'm/%'").collect()} == {("LIMIT", "binding"), ("Pair", "type"), ("__all__", "binding"), ("run", "function")}
    typed = {(r["source"], r["kind"], r["target"]) for r in parse.parse_edges(parsed).where("kind LIKE '%type'").collect()}
    assert typed == {(None, "attribute-type", "Optional"), (None, "attribute-type", "pkg.N"), ("run", "parameter-type", "list"), ("run", "parameter-type", "pkg.A"), ("run", "parameter-type", "Literal"), ("run", "return-type", "dict"), ("run", "return-type", "str"), ("run", "return-type", "pkg.B")}
    bound = {(r["name"], r["kind"], r["target"]) for r in parse.parse_bindings(parsed).where("path LIKE 'm/%' AND kind <> 'all'").collect()}
    assert {("os", "module", "os"), ("j", "module", "json"), ("P", "reexport", ".core.Planner"), ("*", "star", ".other"), ("run", "declaration", None)} <= bound
    out = {(r["path"], r["name"]): (r["kind"], r["target"]) for r in parse.exports(parse.parse_bindings(parsed)).collect()}
    assert out == {("m/__init__.py", "P"): ("reexport", ".core.Planner"), ("m/__init__.py", "plan"): ("ambiguous", None), ("m/__init__.py", "LIMIT"): ("value", None), ("m/__init__.py", "run"): ("declaration", None), ("m/__init__.py", "gone"): ("unknown", None), ("n.py", "a"): ("module", "a"), ("n.py", "y"): ("value", "a.b")}
    assert {(r["path"], r["kind"]) for r in parse.parse_findings(parsed).collect()} == {("bad.py", "parse-error"), ("m/__init__.py", "global-write"), ("m/__init__.py", "module-identity")}


def test_captures(spark, tmp_path):
    lock = {"lockfileVersion": 3, "packages": {"": {"name": "root", "version": "1.0.0", "dependencies": {"a": "^1", "b": "^2"}}, "node_modules/a": {"version": "1.1.0", "dependencies": {"b": "^1"}}, "node_modules/a/node_modules/b": {"version": "1.5.0"}, "node_modules/b": {"version": "2.0.0"}}}
    (tmp_path / "package-lock.json").write_text(json.dumps(lock))
    nodes, edges = R.npm_lock(spark, str(tmp_path / "package-lock.json"))
    assert {(r["component"], r["version"]) for r in nodes.collect()} == {("root", "1.0.0"), ("a", "1.1.0"), ("b", "1.5.0"), ("b", "2.0.0")}
    assert {(r["source"], r["target"]) for r in edges.collect()} == {("", "node_modules/a"), ("", "node_modules/b"), ("node_modules/a", "node_modules/a/node_modules/b")}
    n, e = R.uv_lock(spark, '[[package]]\nname="x"\nversion="1"\n[package.source]\nregistry="r"\n[[package.dependencies]]\nname="y"\nmarker="m"\n')
    assert n.first() == ("x", "1", "registry") and e.first() == ("x", "y", "m")
    (tmp_path / "list.txt").write_text("[INFO]    g:a:jar:1.0:compile -- module m\n[INFO] g:b:jar:tests:2.0:test\nnoise\n")
    assert {tuple(r) for r in R.maven_list(spark, str(tmp_path / "list.txt")).collect()} == {("g:a", "1.0", "compile"), ("g:b", "2.0", "test")}
    tree = {"groupId": "g", "artifactId": "r", "children": [{"groupId": "g", "artifactId": "a", "version": "1", "scope": "compile", "children": [{"groupId": "g", "artifactId": "b", "version": "2", "scope": "test"}]}]}
    assert {(r[0], r[1]) for r in R.maven_tree(spark, json.dumps(tree)).collect()} == {("g:r", "g:a"), ("g:a", "g:b")}
    (tmp_path / "i.json").write_text(json.dumps({"documents": [{"relative_path": "a.py", "occurrences": [{"range": [4, 0, 3], "symbol": "s", "symbol_roles": 1}, {"range": [6, 0, 3], "symbol": "s", "symbol_roles": 0}]}]}))
    assert {(r["line"], r["role"]) for r in R.scip(spark, str(tmp_path / "i.json")).collect()} == {(5, "definition"), (7, "reference")}


def test_streams(spark, tmp_path):
    rows = [("s", 0, "a"), ("s", 1, "b"), ("t", 0, "a"), ("t", 2, "c"), ("u", 0, "x"), ("u", 1, "")]
    df = spark.createDataFrame(rows, "source string, seq long, path string")
    want = {("s", "DIRTY", 2, 2), ("t", "UNKNOWN", 2, 2), ("u", "CLEAN", 2, 0)}
    assert {tuple(r) for r in J.journal_batch(df, "source", "seq", "path").collect()} == want
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = J.journal(stream).writeStream.outputMode("update").format("memory").queryName("journal").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("journal").collect()} == want
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "1.json").write_text("\n".join(json.dumps(dict(zip(("source", "seq", "path"), r, strict=True))) for r in rows))
    q = J.journal(J.watched(spark, str(tmp_path / "w"))).writeStream.outputMode("update").format("memory").queryName("watched").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("watched").collect()} == want
    changes = [(0, "a", 1), (0, "a", 2), (0, "b", 1), (1, "a", 3), (1, "b", None), (2, "c", 9)]
    schema = "seq long, path string, value long"
    for n, part in enumerate(([c for c in changes if c[0] == 0], [c for c in changes if c[0] > 0])):
        spark.createDataFrame(part, schema).repartition(1).write.mode("append").parquet(str(tmp_path / "changes"))
        J.refresh(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "changes")), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination(120)
        got = sorted((r["path"], r["value"]) for r in J.table_of(spark, str(tmp_path / "t"), schema).collect())
        assert got == ([("a", 1), ("a", 2), ("b", 1)] if not n else [("a", 3), ("c", 9)])
