"""Values that must be the same everywhere: canonical JSON, portable scalars, packed metadata, identifier variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PORTABLE = 2**53 - 1


def canonical_json(columns: dict[str, Column]) -> Column:
    """A JSON object with its keys in order and no blanks; nulls are written, not dropped."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def canonical_map(pairs: Column) -> Column:
    """A map's JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))), {"ignoreNullFields": "false"})


def portable_integer(value: Column) -> Column:
    """An integer that every JSON reader keeps: 0 to 2^53 - 1."""
    return F.coalesce(value.between(0, PORTABLE), F.lit(False))


def nonblank(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


#: Bits of the packed fields, low to high.
PACKED = {"size": 40, "mode": 12, "flags": 8}


def pack_metadata(size: Column, mode: Column, flags: Column) -> Column:
    """File size, mode and flags in one long; null where a field doesn't fit."""
    out, at, fits = F.lit(0).cast("long"), 0, F.lit(True)
    for column, bits in zip((size, mode, flags), PACKED.values(), strict=True):
        c = column.cast("long")
        fits = fits & c.between(0, (1 << bits) - 1)
        out = out.bitwiseOR(F.shiftleft(c, at))
        at += bits
    return F.when(fits, out)


def unpack_metadata(packed: Column) -> Column:
    fields, at = [], 0
    for name, bits in PACKED.items():
        fields.append(F.shiftrightunsigned(packed, at).bitwiseAND((1 << bits) - 1).alias(name))
        at += bits
    return F.struct(*fields)


def symbolic_terms(name: Column, most: int = 8) -> Column:
    """Variants under which an identifier may be written, the given one first: snake, kebab, camel and Pascal case."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z])([A-Z][a-z])", "$1_$2")), r"[^a-z0-9]+"), lambda x: x != "")
    pascal = F.array_join(F.transform(parts, F.initcap), "")
    camel = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.initcap), ""))
    return F.slice(F.array_distinct(F.array_compact(F.array(name, F.array_join(parts, "_"), F.array_join(parts, "-"), F.when(F.size(parts) > 0, camel), pascal))), 1, most)


#: Surfaces of an index by signs of the lower-cased path, the first that holds.
SURFACES = [
    ("lockfile", r"(^|/)(package-lock\.json|pnpm-lock\.yaml|go\.sum|[^/]*\.lock)$"),
    ("openapi", r"(openapi|swagger)[^/]*$"),
    ("generated", r"(^|/)(generated|gen|dist|build)(/|$)|(\.generated\.[tj]s|_generated\.py)$"),
    ("snapshot", r"snapshot|\.snap$"),
    ("fixture", r"(^|/)(fixtures?|testdata)(/|$)"),
    ("translation", r"(^|/)(locales?|i18n|translations)(/|$)"),
    ("test", r"^tests?/|/tests/|^(?!(.*/)?src/)(.*/)?test_[^/]*$|\.(test|spec)\.tsx?$"),
    ("docs", r"\.(md|rst|adoc)$|^docs/|/docs/"),
    ("config", r"(^|/)(pyproject\.toml|package\.json|tsconfig\.json|makefile)$|\.(toml|ya?ml)$"),
    ("source", r"\.(pyi?|tsx?|jsx?|go|rs|java|kts?|c|h|cpp|hpp)$"),
]


def surface_of(path: Column) -> Column:
    """One label of what an indexed path is."""
    low, out = F.lower(path), F.lit("other")
    for name, pattern in reversed(SURFACES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out
