from __future__ import annotations

import json

import pytest

from strataquery.sources import projects as P


def edges(graph) -> set:
    return {tuple(r) for r in graph[1].select("source", "target", "kind").collect()}


def names(graph) -> set:
    return {r["project"] for r in graph[0].collect()}


def test_captured_graphs(spark, tmp_path):
    w = lambda name, value: ((tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value)), str(tmp_path / name))[1]
    nx = P.nx_graph(spark, w("nx-graph.json", {"graph": {"nodes": {"a": {"data": {"root": "libs/a"}}, "b": {"data": {"root": "apps/b"}}}, "dependencies": {"b": [{"source": "b", "target": "a", "type": "static"}, {"source": "b", "target": "npm:x", "type": "static"}], "a": []}}}))
    assert names(nx) == {"a", "b"} and edges(nx) == {("b", "a", "static")}
    pants = P.pants_targets(spark, w("pants.json", [{"address": "src/x:lib", "target_type": "python_sources", "dependencies": ["src/y:lib"]}, {"address": "src/y:lib", "dependencies": []}]))
    assert {tuple(r) for r in pants[0].collect()} == {("src/x:lib", "src/x"), ("src/y:lib", "src/y")} and edges(pants) == {("src/x:lib", "src/y:lib", "dependency")}
    gradle = P.gradle_projects(spark, w("gradle.json", {"projects": [{"path": ":app", "projectDir": "app", "dependencies": [{"configuration": "api", "path": ":core"}]}, {"path": ":core", "projectDir": "core", "dependencies": []}]}))
    assert edges(gradle) == {(":app", ":core", "api")}
    cargo = P.cargo_packages(spark, w("cargo.json", {"packages": [{"name": "a", "manifest_path": "/w/a/Cargo.toml", "dependencies": [{"name": "b", "path": "/w/b"}, {"name": "serde", "kind": None}]}, {"name": "b", "manifest_path": "/w/b/Cargo.toml", "dependencies": []}]}))
    assert edges(cargo) == {("a", "b", "normal")} and ("b", "/w/b") in {tuple(r) for r in cargo[0].collect()}
    vite = P.vite_graph(spark, w("vite.json", {"modules": {"a.ts": ["b.ts"], "b.ts": []}}))
    assert edges(vite) == {("a.ts", "b.ts", "import")}
    both = P.enriched(spark, {"nx": str(tmp_path / "nx-graph.json"), "cargo": str(tmp_path / "cargo.json")})
    assert {(r["provider"], r["project"]) for r in both[0].collect()} == {("nx", "a"), ("nx", "b"), ("cargo", "a"), ("cargo", "b")} and both[1].count() == 2
    with pytest.raises(ValueError):
        P.enriched(spark, {"bazel": "x"})


def test_manifests(spark, tmp_path):
    files = {
        "m/pom.xml": "<project><artifactId>root</artifactId><modules><module>core</module><module>web</module></modules></project>",
        "m/core/pom.xml": "<project><parent><artifactId>root</artifactId></parent><artifactId>core</artifactId></project>",
        "m/web/pom.xml": "<project><parent><artifactId>root</artifactId></parent><artifactId>web</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>core</artifactId></dependency><dependency><artifactId>junit</artifactId><scope>test</scope></dependency></dependencies></project>",
        "g/go.mod": "module ex.org/a\n\nrequire (\n\tex.org/b v1.0.0\n\tgithub.com/x/y v2.0.0 // indirect\n)\n",
        "g/b/go.mod": "module ex.org/b\n\nrequire ex.org/c v0.1.0\n",
        "g/c/go.mod": "module ex.org/c\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    maven = P.maven_modules(spark, str(tmp_path / "m"))
    assert names(maven) == {"root", "core", "web"} and edges(maven) == {("root", "core", "module"), ("root", "web", "module"), ("web", "core", "compile")}
    assert edges(P.go_modules(spark, str(tmp_path / "g"))) == {("ex.org/a", "ex.org/b", "require"), ("ex.org/b", "ex.org/c", "require")}


def test_declared_and_collected(spark, tmp_path):
    text = '[[project]]\nname="a"\nroot="a"\ninputs=["api.json"]\n[[project]]\nname="b"\ninputs=["api.json","own.txt"]\n[[link]]\nsource="a"\ntarget="b"\n'
    graph = P.declared_links(spark, text)
    assert names(graph) == {"a", "b"} and edges(graph) == {("a", "b", "declared"), ("a", "input:api.json", "shared-input"), ("b", "input:api.json", "shared-input")}
    with pytest.raises(ValueError):
        P.declared_links(spark, '[[project]]\nname="a"\n[[link]]\nsource="a"\ntarget="z"\n')
    (tmp_path / "t.json").write_text(json.dumps({"suite": "unit", "tests": ["t/a.py::x", "t/a.py::C::y", "t/a.py::x"]}))
    assert {tuple(r) for r in P.collected_tests(spark, str(tmp_path / "t.json")).collect()} == {("unit", "t/a.py", "x"), ("unit", "t/a.py", "C::y")}
    (tmp_path / "i.json").write_text("\n".join(json.dumps(x) for x in [{"importer": "a.ts", "specifier": "./b", "resolved": "b.ts", "external": False}, {"importer": "a.ts", "specifier": "react", "external": True}, {"importer": "a.ts", "specifier": "./q", "external": False}]))
    assert {(r["specifier"], r["state"], r["target"]) for r in P.resolved_imports(spark, str(tmp_path / "i.json")).collect()} == {("./b", "resolved", "b.ts"), ("react", "external", None), ("./q", "unresolved", None)}
    (tmp_path / "m.json").write_text("\n".join(json.dumps({"file": f, "text": "t", "range": {"start": {"line": n, "column": 0}, "end": {"line": n + 1, "column": 3}}}) for f, n in (("b", 1), ("a", 5), ("a", 2))))
    assert [(r["path"], r["start_line"]) for r in P.structural_matches(spark, str(tmp_path / "m.json"), 2).collect()] == [("a", 3), ("a", 6)]
    assert P.input_patterns([{"file": "./a.py"}, {"directory": "src/"}, {"glob": "x/*.py"}]) == ["a.py", "src/**", "x/*.py"]
    for bad in ({"file": "../x"}, {"file": "a*"}, {"path": "x"}, {"directory": "/etc"}):
        with pytest.raises(ValueError):
            P.input_patterns([bad])
