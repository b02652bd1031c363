"""Source parsers: text in, typed rows out, every file parsed once. Python by the standard library's ast, Go and Rust by
a scanner of their declarations (see `outline`).

Rows are of one table, told apart by `record`: symbol, edge, finding, binding (what a module's names stand for) and export
(what it lets out)."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.functions.outline import OUTLINES

SYMBOLS = ["path", "name", "qualname", "kind", "signature", "start_line", "end_line", "parent"]
EDGES = ["path", "source", "kind", "target", "line"]
FINDINGS = ["path", "kind", "subject", "line"]
BINDINGS = ["path", "name", "kind", "target", "line"]
RECORDS = "record string, path string, name string, qualname string, kind string, signature string, start_line int, end_line int, parent string, source string, target string, subject string, line int"
NAMES = [c.split()[0] for c in RECORDS.split(", ")]


def _walk(node: ast.AST, names: list[str]) -> Iterator[tuple[ast.AST, list[str]]]:
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            yield child, names
            yield from _walk(child, [*names, child.name])
        else:
            yield child, names
            yield from _walk(child, names)


def _dotted(node: ast.AST) -> str | None:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


def python_symbols(path: str, tree: ast.Module, lines: list[str]) -> list[tuple]:
    """Classes, functions and methods; names that the module itself binds, and its type aliases."""
    out, seen = [], {}
    for n, names in _walk(tree, []):
        if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            qual = ".".join([*names, n.name])
            seen[qual] = seen.get(qual, 0) + 1
            unique = qual if seen[qual] == 1 else f"{qual}@L{n.lineno}"
            kind = "class" if isinstance(n, ast.ClassDef) else "method" if names else "function"
            args = "" if isinstance(n, ast.ClassDef) else ast.unparse(n.args)
            out.append((path, n.name, unique, kind, f"{n.name}({args})", n.lineno, n.end_lineno, ".".join(names) or None))
        elif not names:
            kind, found = "binding", []
            if isinstance(n, ast.Assign):
                found = [t.id for t in n.targets if isinstance(t, ast.Name)]
            elif isinstance(n, ast.AnnAssign) and n.value is not None and isinstance(n.target, ast.Name):
                found = [n.target.id]
            elif isinstance(n, ast.TypeAlias):
                kind, found = "type", [n.name.id]
            out += [(path, name, name, kind, lines[n.lineno - 1].strip()[:400], n.lineno, n.end_lineno, None) for name in found]
    return out


def annotated(node: ast.AST | None) -> list[str]:
    """Names that an annotation mentions, those inside strings, unions and parameters included, each once."""
    if node is None:
        return []
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return annotated(ast.parse(node.value, mode="eval").body)
        except (SyntaxError, ValueError):
            return []
    whole = _dotted(node)
    if whole:
        return [whole]
    literal = isinstance(node, ast.Subscript) and (_dotted(node.value) or "").rpartition(".")[2] == "Literal"
    inner = [node.value] if literal else list(ast.iter_child_nodes(node))
    return list(dict.fromkeys(t for c in inner for t in annotated(c)))


def python_edges(path: str, tree: ast.Module) -> list[tuple]:
    """Imports, calls by name, base classes, and types of parameters, returns and attributes."""
    out = []
    for n, names in _walk(tree, []):
        source = ".".join(names) or None
        if isinstance(n, ast.Import):
            out += [(path, source, "import", a.name, n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [(path, source, "import", "." * n.level + ".".join(filter(None, [n.module, a.name])), n.lineno) for a in n.names]
        elif isinstance(n, ast.Call) and (target := _dotted(n.func)):
            out.append((path, source, "call", target, n.lineno))
        elif isinstance(n, ast.ClassDef):
            out += [(path, ".".join([*names, n.name]), "inherits", t, n.lineno) for b in n.bases if (t := _dotted(b))]
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            own, a = ".".join([*names, n.name]), n.args
            for arg in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]:
                out += [(path, own, "parameter-type", t, arg.lineno) for t in annotated(arg.annotation)]
            out += [(path, own, "return-type", t, n.lineno) for t in annotated(n.returns)]
        elif isinstance(n, ast.AnnAssign):
            out += [(path, source, "attribute-type", t, n.lineno) for t in annotated(n.annotation)]
    return out


def _static_names(node: ast.AST | None) -> list[str] | None:
    """The strings of a list, tuple or set of nothing but strings."""
    if isinstance(node, ast.List | ast.Tuple | ast.Set) and all(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in node.elts):
        return [x.value for x in node.elts]
    return None


def python_bindings(path: str, tree: ast.Module) -> list[tuple]:
    """(path, name, kind, target, line) of a module's own names in order: module, reexport, star, declaration or value;
    and `all`, one row for each name that a static __all__ lists (`dynamic-all` where it can't be read)."""
    out = []
    for n in tree.body:
        if isinstance(n, ast.Import):
            out += [(path, a.asname or a.name.partition(".")[0], "module", a.name if a.asname else a.name.partition(".")[0], n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            for a in n.names:
                dotted = module + ("" if module.endswith(".") or not module else ".") + a.name
                out.append((path, "*", "star", module, n.lineno) if a.name == "*" else (path, a.asname or a.name, "reexport", dotted, n.lineno))
        elif isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            out.append((path, n.name, "declaration", None, n.lineno))
        elif isinstance(n, ast.Assign | ast.AnnAssign | ast.AugAssign):
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            names = [t.id for t in targets if isinstance(t, ast.Name)]
            if "__all__" in names:
                listed = _static_names(n.value)
                out += [(path, x, "all", None, n.lineno) for x in listed] if listed is not None else [(path, "__all__", "dynamic-all", None, n.lineno)]
            elif n.value is not None and not isinstance(n, ast.AugAssign):
                out += [(path, x, "value", _dotted(n.value), n.lineno) for x in names]
    return out


#: Calls that load code by other ways than an import statement.
LOADERS = ("importlib.import_module", "__import__", "exec", "eval", "importlib.util.spec_from_file_location", "importlib.reload", "runpy.run_path", "runpy.run_module")


def python_findings(path: str, tree: ast.Module) -> list[tuple]:
    """Risks that the syntax shows: dynamic imports, changes of the import system, process-local caches, their
    invalidation, unguarded globals, threads, file checks before use."""
    out = []
    for n, names in _walk(tree, []):
        owner = ".".join(names) or "<module>"
        if isinstance(n, ast.Call):
            called = _dotted(n.func) or ""
            if called in LOADERS:
                out.append((path, "dynamic-import", called, n.lineno))
            elif called.startswith("sys.path.") or called.startswith(("sys.meta_path.", "sys.path_hooks.")):
                out.append((path, "module-identity", called, n.lineno))
            elif called.rpartition(".")[2] in ("Thread", "ThreadPoolExecutor", "ProcessPoolExecutor", "create_task", "run_in_executor"):
                out.append((path, "concurrency-entry", owner, n.lineno))
            elif called.endswith(".cache_clear"):
                out.append((path, "cache-invalidation", called.removesuffix(".cache_clear"), n.lineno))
            elif called in ("os.path.exists", "os.path.isfile") or called.endswith(".exists"):
                out.append((path, "filesystem-check", owner, n.lineno))
            elif called == "open" or called.endswith((".read_text", ".write_text", ".unlink")):
                out.append((path, "filesystem-use", owner, n.lineno))
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            for d in n.decorator_list:
                name = _dotted(d.func if isinstance(d, ast.Call) else d) or ""
                if name.rpartition(".")[2] in ("lru_cache", "cache"):
                    out.append((path, "cache-owner", n.name, n.lineno))
        elif isinstance(n, ast.Assign | ast.Delete) and any(isinstance(t, ast.Subscript) and _dotted(t.value) == "sys.modules" for t in n.targets):
            out.append((path, "module-identity", "sys.modules", n.lineno))
        elif isinstance(n, ast.Global):
            out += [(path, "global-write", g, n.lineno) for g in n.names]
    return out


def _record(record: str, names: list[str], values: tuple) -> dict:
    return dict(zip(names, values, strict=True), record=record)


def parse_file(path: str, text: str, language: str) -> list[dict]:
    """All rows of one file; a Python file that doesn't parse gives one finding."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError) as e:
            return [_record("finding", FINDINGS, (path, "parse-error", type(e).__name__, getattr(e, "lineno", None)))]
        lines = text.split("\n")
        parts = (("symbol", SYMBOLS, python_symbols(path, tree, lines)), ("edge", EDGES, python_edges(path, tree)), ("finding", FINDINGS, python_findings(path, tree)), ("binding", BINDINGS, python_bindings(path, tree)))
        return [_record(record, names, r) for record, names, rows in parts for r in rows]
    out = []
    for record, name, qualname, kind, signature, start, end, parent, target in OUTLINES[language](text) if language in OUTLINES else []:
        if record == "symbol":
            out.append(_record("symbol", SYMBOLS, (path, name, qualname, kind, signature, start, end, parent)))
        else:
            out.append(_record("edge", EDGES, (path, None, kind, target, start)))
    return out


def parse_all(files: DataFrame) -> DataFrame:
    """Rows of all records of files (path, text, language)."""

    schema = pa.schema([(n, pa.int32() if n in ("start_line", "end_line", "line") else pa.string()) for n in NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for p, t, l in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in parse_file(p, t, l)]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

    return files.select("path", F.coalesce("text", F.lit("")).alias("text"), "language").mapInArrow(run, RECORDS)


def _of(record: str, names: list[str]):
    def pick(files: DataFrame) -> DataFrame:
        rows = files if "record" in files.columns else parse_all(files)
        return rows.where(F.col("record") == record).select(*names)

    return pick


#: Each takes files (path, text, language), or what `parse_all` has made of them.
parse_symbols, parse_edges, parse_findings, parse_bindings = _of("symbol", SYMBOLS), _of("edge", EDGES), _of("finding", FINDINGS), _of("binding", BINDINGS)


def exports(bindings: DataFrame) -> DataFrame:
    """(path, name, kind, target): what a module lets out, the last binding of each name: what __all__ lists, or all names
    without an underscore where there is none; more than one reexport of a name is `ambiguous`."""
    listed = bindings.where("kind = 'all'").select("path", "name").distinct()
    open_ = bindings.join(bindings.where("kind IN ('all', 'dynamic-all')").select("path").distinct(), "path", "left_anti").where(~F.col("name").startswith("_") & (F.col("name") != "*")).select("path", "name").distinct()
    own = bindings.where("kind NOT IN ('all', 'dynamic-all')").groupBy("path", "name").agg(F.max_by(F.struct("kind", "target"), "line").alias("b"), F.count_distinct(F.when(F.col("kind") == "reexport", F.col("target"))).alias("n"))
    rows = listed.union(open_).join(own, ["path", "name"], "left")
    return rows.select("path", "name", F.when(F.col("n") > 1, "ambiguous").otherwise(F.coalesce("b.kind", F.lit("unknown"))).alias("kind"), F.when(F.col("n") <= 1, F.col("b.target")).alias("target"))


def check_use_pairs(findings: DataFrame) -> DataFrame:
    """A file check and a later use in the same function."""
    one = lambda kind, name: findings.where(F.col("kind") == kind).select("path", "subject", F.col("line").alias(name))
    return one("filesystem-check", "check_line").join(one("filesystem-use", "use_line"), ["path", "subject"]).where("check_line < use_line")
