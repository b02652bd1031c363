"""Declarations of Go and Rust, by a scanner over their tokens: comments and literals are set aside, brackets are matched,
and only places where the grammar allows a declaration are looked at. Rows are (record, name, qualname, kind, signature,
start_line, end_line, parent, target)."""

from __future__ import annotations

import re
from bisect import bisect_right

ASIDE = {
    "go": r"//[^\n]*|/\*.*?(?:\*/|\Z)",
    "rust": r"//[^\n]*|/\*.*?(?:\*/|\Z)",
}
TEXT = {
    "go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'',
    "rust": r'b?r(?P<h>#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.|[^\'\\\n])\'',
}
SCAN = {k: re.compile(rf"(?P<aside>{ASIDE[k]})|(?P<text>{TEXT[k]})|(?P<word>[^\W\d]\w*|\d\w*)|(?P<mark>[^\s\w])", re.S) for k in ASIDE}
PAIRS = {"{": "}", "(": ")", "[": "]"}


class Tokens:
    """Tokens of a source: texts, kinds, places, and for each opening bracket the index of the one that closes it."""

    def __init__(self, source: str, language: str) -> None:
        self.source = source
        found = [m for m in SCAN[language].finditer(source) if m.lastgroup != "aside" and not m.group("aside")]
        self.kind = ["text" if m.group("text") else "word" if m.group("word") else "mark" for m in found]
        self.text = [m.group() for m in found]
        self.at = [m.start() for m in found]
        self._lines = [m.end() for m in re.finditer("\n", source)]
        self.close = {}
        open_: list[int] = []
        for i, (k, t) in enumerate(zip(self.kind, self.text, strict=True)):
            if k == "mark" and t in PAIRS:
                open_.append(i)
            elif k == "mark" and t in PAIRS.values() and open_ and PAIRS[self.text[open_[-1]]] == t:
                self.close[open_.pop()] = i

    def __len__(self) -> int:
        return len(self.text)

    def line(self, i: int) -> int:
        return bisect_right(self._lines, self.at[min(i, len(self) - 1)]) + 1

    def after(self, i: int) -> int:
        """Past a bracket's whole content, or past one token."""
        return self.close.get(i, i) + 1

    def seek(self, i: int, end: int, *stops: str) -> int:
        """The first of some marks from i on, outside brackets; `end` if there is none."""
        while i < end and self.text[i] not in stops:
            i = self.after(i)
        return min(i, end)

    def signature(self, i: int, j: int) -> str:
        stop = self.at[j] if j < len(self) else len(self.source)
        return " ".join(self.source[self.at[i] : stop].split())[:400]


def row(t: Tokens, kind: str, name: str, parent: str | None, start: int, body: int, last: int) -> tuple:
    return ("symbol", name, f"{parent}.{name}" if parent else name, kind, t.signature(start, body), t.line(start), t.line(last), parent, None)


def imported(t: Tokens, target: str, at: int) -> tuple:
    return ("import", None, None, "import", None, t.line(at), t.line(at), None, target)


def go(source: str) -> list[tuple]:
    t, out, i = Tokens(source, "go"), [], 0
    n = len(t)
    while i < n:
        word = t.text[i]
        if word == "import" and i + 1 < n:
            stop = t.after(i + 1) if t.text[i + 1] == "(" else i + (3 if t.kind[i + 1] != "text" else 2)
            out += [imported(t, t.text[j][1:-1], j) for j in range(i + 1, min(stop, n)) if t.kind[j] == "text"]
            i = stop
        elif word == "func" and i + 1 < n:
            j, owner = i + 1, None
            if t.text[j] == "(":  # a receiver: its type is the first name after the variable's, or the only one
                names = [t.text[k] for k in range(j + 1, t.close.get(j, j)) if t.kind[k] == "word"]
                owner = names[1] if len(names) > 1 and t.text[j + 1] == names[0] and t.text[j + 2] != "[" else names[0] if names else None
                j = t.after(j)
            if j < n and t.kind[j] == "word":
                body = _go_body(t, j + 1, t.line(j))
                has = body < n and t.text[body] == "{"
                out.append(row(t, "method" if owner else "function", t.text[j], owner, i, body, t.close.get(body, body) if has else max(i, body - 1)))
                i = t.after(body) if has else body
            else:
                i = j
        elif word == "type" and i + 1 < n:
            grouped = t.text[i + 1] == "("
            j, end = (i + 2, t.close.get(i + 1, n)) if grouped else (i + 1, n)
            while j < end and t.kind[j] == "word":
                start, name = (j if grouped else i), t.text[j]
                k = t.after(j + 1) if j + 1 < end and t.text[j + 1] == "[" and t.line(j) == t.line(j + 1) else j + 1
                form = t.text[k] if k < end and t.text[k] in ("struct", "interface") else "type"
                last = t.close.get(k + 1, k) if form != "type" and k + 1 < end and t.text[k + 1] == "{" else k
                while last + 1 < end and t.line(last + 1) == t.line(last):  # the rest of the line
                    last = t.after(last + 1) - 1
                out.append(row(t, form, name, None, start, k + 1 if form != "type" else last + 1, last))
                j = last + 1
                if not grouped:
                    break
            i = t.after(i + 1) if grouped else max(j, i + 1)
        else:
            i = t.after(i)
    return out


def _go_body(t: Tokens, i: int, line: int) -> int:
    """The brace that opens a function's body, which stands on the line where its signature ends, or what follows it."""
    while i < len(t):
        if t.text[i] == "{" and t.text[i - 1] not in ("struct", "interface"):
            return i
        if t.line(i) > line and t.kind[i] == "word" and t.text[i - 1] not in (",", "(", "[", "]"):
            return i
        i, line = t.after(i), t.line(t.after(i) - 1)
    return i


ITEMS = {"struct": "struct", "enum": "enum", "union": "union", "trait": "trait", "mod": "module", "type": "type", "const": "constant", "static": "constant"}


def rust(source: str) -> list[tuple]:
    t, out = Tokens(source, "rust"), []
    _rust_items(t, 0, len(t), None, out)
    return out


def _rust_items(t: Tokens, i: int, end: int, parent: str | None, out: list[tuple]) -> None:
    start = i
    while i < end:
        word = t.text[i]
        if word == "use":
            stop = t.seek(i, end, ";")
            out += [imported(t, path, i) for path in _use_paths(t, i + 1, stop)]
            i = start = stop + 1
        elif word == "fn" and i + 1 < end:
            body = t.seek(i + 2, end, "{", ";")
            out.append(row(t, "method" if parent else "function", t.text[i + 1], parent, start, body, t.close.get(body, body)))
            i = start = t.after(body)
        elif word == "impl":
            body = t.seek(i + 1, end, "{", ";")
            _rust_items(t, body + 1, t.close.get(body, body), _rust_type(t, i + 1, body), out)
            i = start = t.after(body)
        elif word in ITEMS and i + 1 < end and t.kind[i + 1] == "word" and t.text[i + 1] not in ("fn", "unsafe", "extern", "async"):
            body = t.seek(i + 2, end, "{", ";") if word not in ("const", "static", "type") else t.seek(i + 2, end, ";")
            name = t.text[i + 2] if t.text[i + 1] == "mut" and i + 2 < end else t.text[i + 1]
            out.append(row(t, ITEMS[word], name, parent, start, body, t.close.get(body, body)))
            if word in ("trait", "mod") and body < end and t.text[body] == "{":
                _rust_items(t, body + 1, t.close.get(body, body), f"{parent}.{name}" if parent and word == "mod" else name if word == "trait" else parent, out)
            i = start = t.after(body)
        elif word == "macro_rules" and i + 2 < end:
            body = t.seek(i + 3, end, "{", "(", "[")
            out.append(row(t, "macro", t.text[i + 2], parent, start, body, t.close.get(body, body)))
            i = start = t.after(body)
        elif word == "#":  # an attribute
            i = t.after(i + 1 if i + 1 < end and t.text[i + 1] != "!" else i + 2)
            start = i
        elif t.kind[i] == "word" and word in ("pub", "async", "unsafe", "extern", "default", "const") or (t.kind[i] == "text" and t.text[i - 1] == "extern") or (word == "(" and t.text[i - 1] == "pub"):
            i = t.after(i)
        else:
            i = start = t.after(i)


def _rust_type(t: Tokens, i: int, end: int) -> str | None:
    """The last name of an implementation's type, without parameters: after `for` where there is one."""
    depth, names, bare = 0, [], []
    for j in range(i, end):
        if t.text[j] == "<":
            depth += 1
        elif t.text[j] == ">" and t.text[j - 1] not in "-=":
            depth -= 1
        elif depth == 0 and t.text[j] == "where":
            break
        elif depth == 0 and t.text[j] == "for":
            names, bare = [], []
        elif depth == 0 and t.kind[j] == "word":
            names.append(t.text[j])
    return names[-1] if names else None


def _use_paths(t: Tokens, i: int, end: int) -> list[str]:
    """Paths of a use tree, each branch whole; renames are dropped."""
    prefix, out = "", []
    while i < end:
        word = t.text[i]
        if word == "{":
            stop, part = t.close.get(i, end), i + 1
            while part < stop:
                cut = t.seek(part, stop, ",")
                out += [(prefix + p).removesuffix("::self") for p in _use_paths(t, part, cut)]
                part = cut + 1
            return out
        if word == "as":
            break
        prefix += word
        i += 1
    return [prefix.removesuffix("::self")] if prefix else out


OUTLINES = {"go": go, "rust": rust}
