"""Version predicates as vectorised functions: PEP 440 by `packaging`, npm ranges by a comparator of our own.

Results are match, nonmatch or unclassified (what can't be parsed). An npm range desugars into bounds on whole versions,
prerelease part included: a prerelease satisfies a range only if one of its bounds is a prerelease of the same core."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

NUMBER = r"0|[1-9][0-9]*"
IDENT = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
TAIL = rf"(?:-({IDENT}(?:\.{IDENT})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?"
FULL = re.compile(rf"^v?({NUMBER})\.({NUMBER})\.({NUMBER}){TAIL}$")
PARTIAL = re.compile(rf"^v?({NUMBER}|[xX*])(?:\.({NUMBER}|[xX*])(?:\.({NUMBER}|[xX*]){TAIL})?)?$")
COMPARATOR = re.compile(r"(\^|~>?|>=|<=|>|<|=)?\s*([^\s<>=^~|]+)")
LARGEST = 2**53 - 1
#: The lowest prerelease: as an upper bound it keeps all prereleases of a core out.
LOWEST = ((0, 0, ""),)

Key = tuple  # (core, released, prerelease identifiers), in the order of precedence
Bound = tuple[str, Key]


def pep440(version: str | None, spec: str, prereleases: bool = False) -> str:
    from packaging.specifiers import InvalidSpecifier, SpecifierSet
    from packaging.version import InvalidVersion, Version

    try:
        return "match" if SpecifierSet(spec).contains(Version(version or ""), prereleases=prereleases) else "nonmatch"
    except (InvalidVersion, InvalidSpecifier):
        return "unclassified"


def _identifiers(pre: str | None) -> tuple:
    """Numbers before words; numbers by value, words by their characters."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in pre.split(".")) if pre else ()


def _key(core: tuple, pre: tuple = ()) -> Key:
    if max(core) > LARGEST or any(n > LARGEST for _, n, _ in pre):
        raise ValueError(core)
    return core, not pre, pre


def npm_key(text: str) -> Key | None:
    m = FULL.match(text.strip()) if len(text) <= 256 else None
    try:
        return _key((int(m[1]), int(m[2]), int(m[3])), _identifiers(m[4])) if m else None
    except ValueError:
        return None


def _partial(text: str) -> tuple[list[int], tuple]:
    """The given leading numbers (none for x or *), and the prerelease part of a whole version."""
    m = PARTIAL.match(text)
    if not m:
        raise ValueError(text)
    nums: list[int] = []
    for g in m.groups()[:3]:
        if g is None or g in "xX*":
            break
        nums.append(int(g))
    return nums, _identifiers(m[4]) if len(nums) == 3 else ()


def _after(nums: list[int], place: int) -> Key:
    """The lowest version whose number at a place is one higher."""
    return _key((*nums[:place], nums[place] + 1, *[0] * (2 - place)), LOWEST)


def _bounds(op: str, text: str) -> list[Bound]:
    nums, pre = _partial(text)
    whole = len(nums) == 3
    low = _key((*nums, *[0] * (3 - len(nums))), pre)
    if not nums:
        return [("<", _key((0, 0, 0), LOWEST))] if op in ("<", ">") else []
    if op == "^":
        # up to the first number that isn't 0, or the last that is given
        place = next((i for i, n in enumerate(nums) if n), len(nums) - 1)
        return [(">=", low), ("<", _after(nums, place))]
    if op in ("~", "~>"):
        return [(">=", low), ("<", _after(nums, min(1, len(nums) - 1)))]
    if whole:
        return [(op or "=", low)]
    last = len(nums) - 1
    beyond = _after(nums, last)
    if op == ">":
        return [(">=", (beyond[0], True, ()))]
    if op == "<=":
        return [("<", beyond)]
    if op == "<":
        return [("<", (low[0], False, LOWEST))]
    return [(">=", low)] if op == ">=" else [(">=", low), ("<", beyond)]


def npm_range(spec: str) -> list[list[Bound]]:
    """Alternatives, each the bounds that must all hold."""
    out = []
    for alternative in spec.split("||"):
        a = alternative.strip()
        if h := re.match(r"^(\S+)\s+-\s+(\S+)$", a):
            bounds = _bounds(">=", h[1]) + _bounds("<=", h[2])
        else:
            if COMPARATOR.sub("", a).strip():
                raise ValueError(a)
            bounds = [b for op, text in COMPARATOR.findall(a) for b in _bounds(op, text)]
        out.append(bounds)
    return out


def _holds(own: Key, op: str, bound: Key) -> bool:
    return {"=": own == bound, ">": own > bound, ">=": own >= bound, "<": own < bound, "<=": own <= bound}[op]


def npm(version: str | None, spec: str) -> str:
    own = npm_key(version or "")
    try:
        alternatives = npm_range(spec)
    except ValueError:
        return "unclassified"
    if own is None:
        return "unclassified"
    for bounds in alternatives:
        if all(_holds(own, op, b) for op, b in bounds) and (own[1] or any(not b[1] and b[0] == own[0] for _, b in bounds)):
            return "match"
    return "nonmatch"


def version_state(version: str, spec: str, ecosystem: str = "pypi", prereleases: bool = False) -> F.Column:
    check = (lambda v, s: pep440(v, s, prereleases)) if ecosystem == "pypi" else npm

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {v: check(v, spec) for v in s.unique()}
        return s.map(known)

    return run(F.col(version))
