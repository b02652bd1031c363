from __future__ import annotations

import random

from strataquery.operators import structure
from strataquery.sources.stored import Parts

ROWS = "k int, next int, low int, high int, loose boolean"


def brute(rows):
    """By what each key reaches; a key that leads to a circle is loose, with some end if it has one."""
    keys, out = {r[0] for r in rows}, {}
    for key in keys:
        seen, todo = {key}, [key]
        while todo:
            at = todo.pop()
            for k, n, *_ in rows:
                if k == at and n is not None and n not in seen:
                    seen.add(n), todo.append(n)
        ends = [r[2] for r in rows if r[0] in seen and r[2] is not None]
        back = {a: {n for k, n, *_ in rows if k == a and n is not None} for a in seen}
        live = dict(back)
        while free := [a for a, ns in live.items() if not any(n in live for n in ns)]:
            for a in free:
                del live[a]
        loose = bool(live) or any(r[4] for r in rows if r[0] in seen)
        if ends or not live:
            out[key] = (None if not ends else "one" if min(ends) == max(ends) and not loose else "more", loose)
    return out


def state(r):
    return None if r["low"] is None else "one" if r["low"] == r["high"] and not r["loose"] else "more"


def test_settled_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        for _ in range(rng.choice([1, 1, 2, 3])):
            kind = rng.random()
            rows.append((k, rng.randrange(40), None, None, False) if kind < 0.55 else (k, None, *[rng.randrange(100, 104)] * 2, False) if kind < 0.95 else (k, None, None, None, True))
    got = {r["k"]: (state(r), r["loose"]) for r in structure.settled(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == brute(rows)


def test_a_round_writes_only_what_waits(spark, monkeypatch):
    """A flight of steps, each passed on by two: a step leaves the table in its round, so the rounds don't add up to the
    square of the flight's length, nor does a round read what earlier ones settled."""
    written, add = [], Parts.add

    def spy(self, df, sums=None):
        told = add(self, df, sums)
        if "/settled-" in self.base:
            written.append(self.rows[-1])
        return told

    monkeypatch.setattr(Parts, "add", spy)
    rows = [(k, None, 7, 7, False) for k in range(12)] + [(k, k - 1, None, None, False) for k in range(1, 6)]
    got = structure.settled(spark.createDataFrame(rows, ROWS)).collect()
    assert {(r["k"], r["low"], r["high"], r["loose"]) for r in got} == {(k, 7, 7, False) for k in range(12)}
    assert written == [17, 10, 8, 6, 4, 2, 0]
