"""Declarations in build files: Make targets, package.json and pyproject facts, go.mod requirements, configuration keys."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECLARATIONS = "path string, namespace string, subject string, value string, line int"


def make_targets(path: str, text: str) -> list[tuple]:
    out, target = [], None
    for i, line in enumerate(text.split("\n"), 1):
        if line.startswith("\t") and target:
            out.append((path, "make.recipe", target, line.strip(), i))
        elif m := re.match(r"^([A-Za-z0-9_./%-]+(?:\s+[A-Za-z0-9_./%-]+)*)\s*::?(?!=)\s*([^#=]*)", line):
            target = m[1].split()[0]
            out += [(path, "make.target", t, m[2].strip(), i) for t in m[1].split() if t != ".PHONY"]
        elif line.strip() and not line.startswith((" ", "#")):
            target = None
    return out


def _leaves(value: object, key: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{key}.{k}" if key else str(k))
    else:
        yield key, value if isinstance(value, str) else json.dumps(value, sort_keys=True, default=str)


def key_values(path: str, text: str) -> list[tuple]:
    """Keys of a TOML, JSON or INI file with their values; arrays are one value."""
    try:
        if path.endswith(".toml"):
            return [(path, "config", k, v, None) for k, v in _leaves(tomllib.loads(text))]
        if path.endswith(".json"):
            return [(path, "config", k, v, None) for k, v in _leaves(json.loads(text))]
    except (ValueError, RecursionError):
        return []
    out, section = [], ""
    for i, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"^\s*\[([^\]]+)\]\s*$", line):
            section = m[1] + "."
        elif m := re.match(r"^\s*([^#;=:\s][^=:]*?)\s*[=:]\s*(.*?)\s*$", line):
            out.append((path, "config", section + m[1], m[2], i))
    return out


def go_requirements(path: str, text: str) -> list[tuple]:
    rows = re.finditer(r"(?m)^(?:require\s+|\t)([\w./-]+\.[\w./-]+)\s+(v[\w.+-]+)", text)
    return [(path, "go.require", m[1], m[2], text.count("\n", 0, m.start()) + 1) for m in rows]


def declarations_of(path: str, text: str) -> list[tuple]:
    name = path.rpartition("/")[2]
    if name in ("Makefile", "makefile", "GNUmakefile") or name.endswith(".mk"):
        return make_targets(path, text)
    if name == "go.mod":
        return go_requirements(path, text)
    if name.endswith((".toml", ".json", ".ini", ".cfg")):
        return key_values(path, text)
    return []


def parse_declarations(files: DataFrame) -> DataFrame:
    """Declarations of files (path, text)."""
    names = [c.split()[0] for c in DECLARATIONS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["text"], strict=True) for r in declarations_of(p, t or "")]
            if rows:
                out = pd.DataFrame(rows, columns=names)
                yield out.assign(line=out["line"].astype("Int32"))

    return files.select("path", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, DECLARATIONS)
