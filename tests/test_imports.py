from __future__ import annotations

import random

from strataquery.operators import context, lookup

FILES = "path string, module_name string"
EDGES = "path string, kind string, target string"


def brute(files: list, edges: list) -> set:
    """Import by import, the candidates one after the other."""
    modules, paths, out = [(p, m) for p, m in files if m is not None], {p for p, _ in files}, set()
    for path, kind, target in edges:
        if kind != "import" or target is None:
            continue
        if target.startswith(("./", "../")):
            steps, folder = target.split("/"), path.split("/")[:-1]
            if (ups := steps.count("..")) <= len(folder):
                base = "/".join(folder[: len(folder) - ups] + [s for s in steps if s not in ("", ".", "..")])
                out |= {(path, base + e) for e in lookup.SCRIPT_ENDS if base + e in paths and not any(base + f in paths for f in lookup.SCRIPT_ENDS[: lookup.SCRIPT_ENDS.index(e)])}
            continue
        dots = len(target) - len(target.lstrip("."))
        for own in {m for p, m in modules if p == path} if dots and any(p == path for p, _ in modules) else {None}:
            name = target
            if own is not None:
                package = own if path.rsplit("/", 1)[-1] in ("__init__.py", "__init__.pyi") else own.rpartition(".")[0]
                parts = [x for x in package.split(".") if x]
                if dots - 1 > len(parts):
                    continue
                name = ".".join([*parts[: len(parts) - dots + 1], target.lstrip(".")])
            known = name.split(".")
            for n in range(len(known), 0, -1):
                if hit := {(path, p) for p, m in modules if m == ".".join(known[:n])}:
                    out |= hit
                    break
    return {(a, b) for a, b in out if a != b}


def test_imports_against_brute_force(spark):
    pick = random.Random(3)
    files = [("a/__init__.py", "a"), ("a/b.py", "a.b"), ("a/c/__init__.py", "a.c"), ("a/c/d.py", "a.c.d"), ("a/c/e.pyi", "a.c.e"), ("z/b.py", "a.b"), ("top.py", "top"), ("odd.py", ".x..y.z"), ("plain.py", None), ("tail.py", "a.")]
    files += [(p, None) for p in ("w/u.ts", "w/u/index.js", "w/u", "w/k.ts", "w/k.ts.js", "w/v/index.ts", "w/v/index.jsx", "w/v/x.tsx", "r.js", ".ts", "w//t.ts", "/q.ts", "w/..ts", "w/...ts", "index.js")]
    names = ["a", "a.b", "a.b.f", "a.c.d.g", "b", ".b", ".", "..", "..b", "...", "....a", ".c.d", ".y.z", "top.f", "", "a.", None]
    specs = ["./u", "./u/", "./k", "./k.ts", "./v", "././v/index", "../r", "../w/u", "../../r", "./", "../", "./.", "./..", "./...", "../", ".//t", "./v/../k", "./t", "../q", "./none", "../index"]
    edges = [(pick.choice(files)[0], pick.choice(["import"] * 9 + ["call"]), t) for t in (names + specs) * 25]
    got = [tuple(r) for r in context.import_graph(spark.createDataFrame(files * 2, FILES), spark.createDataFrame(edges * 2, EDGES)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(files, edges)


def test_an_import_is_not_dealt_out_by_endings(spark):
    """Endings are tried by the files: what is exploded for a specifier is nothing."""
    files = spark.createDataFrame([("w/u.ts", None)], FILES)
    got = context.import_graph(files, spark.createDataFrame([("w/a.ts", "import", "./u")] * 3, EDGES))
    assert [tuple(r) for r in got.collect()] == [("w/a.ts", "w/u.ts")]
    plan = got._jdf.queryExecution().optimizedPlan()
    made = [x for x in plan.toString().splitlines() if "explode" in x]
    assert made and not any("source_path" in x or "base#" in x.split("explode", 1)[1].split("[", 1)[0] for x in made)
