from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataquery.engine import Engine
from strataquery.operators import incremental, packets
from strataquery.sources.stored import Parts

MOST = lambda own, theirs: F.greatest(own, F.coalesce(F.array_max(theirs), own))


def brute_values(own: dict, needs: dict) -> dict:
    out, left = {}, dict(needs)
    while ready := [n for n in own if n not in out and all(d in out for d in left.get(n, ()))]:
        for n in ready:
            out[n] = max([own[n], *(out[d] for d in left.get(n, ()))])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cutoff_matches_a_whole_evaluation(spark, seed):
    pick = random.Random(seed)
    needs = {n: sorted({pick.randrange(n) for _ in range(pick.randrange(4))}) for n in range(1, 40)} | {50: [51], 51: [50], 52: [50, 3]}  # a circle and what depends on it
    names = [*range(40), 50, 51, 52]
    was = {n: pick.randrange(20) for n in names}
    touched = pick.sample(names, 9)
    now = was | {n: pick.randrange(20) for n in touched}
    df = lambda own: spark.createDataFrame(sorted(own.items()), "node int, v int").repartition(2)
    edges = spark.createDataFrame([(n, d) for n, ds in needs.items() for d in ds], "source int, target int")
    before = packets.evaluated(df(was), edges, "v", MOST, 60)
    old, new = brute_values(was, needs), brute_values(now, needs)
    assert {r["node"]: r["value"] for r in before.collect() if r["settled"]} == old
    again = incremental.recomputed(df(now), edges, before, spark.createDataFrame([(n,) for n in touched], "node int"), "v", MOST)
    got = {r["node"]: (r["value"], r["changed"]) for r in again.collect()}
    upon = {n for n, ds in needs.items() if n in old and any(old[d] != new[d] for d in ds)}
    assert again.count() == len(got) and got == {n: (new[n], old[n] != new[n]) for n in (set(touched) & old.keys()) | upon}
    assert {r["node"]: r["value"] for r in incremental.overlaid(before, again).where("value IS NOT NULL").collect()} == new


def test_nothing_changed(spark):
    nodes, edges = spark.createDataFrame([(1, 5), (2, 3)], "node int, v int"), spark.createDataFrame([(1, 2)], "source int, target int")
    before = packets.evaluated(nodes, edges, "v", MOST, 9)
    assert incremental.recomputed(nodes, edges, before, nodes.limit(0), "v", MOST).count() == 0
    same = incremental.recomputed(nodes, edges, before, nodes.where("node = 2"), "v", MOST)
    assert [tuple(r) for r in same.collect()] == [(2, 3, False)]  # what depends on it isn't looked at


@pytest.mark.parametrize("seed", range(2))
def test_counts_after_edits_equal_a_rebuild(spark, seed):
    pick = random.Random(seed)
    rows = {f"p{i}": [pick.choice("abcdef") for _ in range(pick.randrange(5))] for i in range(20)}
    table = lambda at: spark.createDataFrame([(p, k if k != "f" else None) for p, ks in at.items() for k in ks], "path string, k string")
    kept = incremental.KeptCounts(table(rows), ["k"])
    for step in range(4):
        after = dict(rows)
        paths = pick.sample(sorted(rows), 4)
        for p in paths[:3]:
            after[p] = [pick.choice("abcdefgh") for _ in range(pick.randrange(5))]
        after.pop(paths[3])
        after[f"new{step}"] = ["a", "h"]
        changed = spark.createDataFrame([(p,) for p in [*paths, f"new{step}"]], "path string")
        before, now = table(rows), table(after)
        n = kept.change(incremental.changed_rows(before, changed), incremental.changed_rows(now, changed))
        count = lambda at: Counter(None if k == "f" else k for ks in at.values() for k in ks)
        assert n == sum(count(rows)[k] != count(after)[k] for k in count(rows) | count(after))
        rows = after
        assert {r["k"]: r["n"] for r in kept.df.collect()} == dict(count(rows))
    small = kept.compacted()
    assert len(small.parts.rows) == 1 and {r["k"]: r["n"] for r in small.df.collect()} == dict(count(rows))


def test_engine_keeps_counts(spark, tmp_path, tmp_path_factory):
    (tmp_path / "a.py").write_text("import b\n\ndef alpha():\n    return b.beta()\n")
    (tmp_path / "b.py").write_text("def beta():\n    return 1\n")
    index = str(tmp_path_factory.mktemp("index"))
    Engine.build(spark, str(tmp_path)).save(index)
    before = Engine.load(spark, index)
    counts = before.kept_counts()
    (tmp_path / "b.py").write_text("def gamma():\n    return alpha()\n")
    (tmp_path / "c.md").write_text("alpha\n")
    after, _ = before.refreshed(str(tmp_path), ["b.py", "c.md"])
    changed = after.refresh_counts(before, counts, ["b.py", "c.md"])
    whole = after.kept_counts()
    for name, kept in counts.items():
        assert sorted(map(str, kept.df.collect())) == sorted(map(str, whole[name].df.collect()))
    assert changed["languages"] == 1 and {r["token"]: r["n"] for r in counts["terms"].df.collect()}["alpha"] == 3


def test_rounds_write_only_what_waits(spark, monkeypatch):
    """A line and leaves: what has settled is not written again in later rounds, and nothing is broadcast."""
    written, add = [], Parts.add

    def spy(self, df, sums=None):
        told = add(self, df, sums)
        written.append(self.rows[-1])
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        return told

    monkeypatch.setattr(Parts, "add", spy)
    nodes = spark.createDataFrame([(n, n % 4) for n in range(30)], "node int, v int")
    edges = spark.createDataFrame([(n, n - 1) for n in range(1, 6)] + [(5, 20), (8, 9), (9, 8), (10, 77)], "source int, target int")
    got = packets.evaluated(nodes, edges, "v", MOST, 9)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    own = {n: (n % 4, 0) for n in range(30)} | {1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (3, 4), 5: (3, 5)} | dict.fromkeys((8, 9, 10), (None, None))
    assert {r["node"]: (r["value"], r["height"]) for r in got.collect()} == own
    assert written == [31, 9, 8, 7, 6, 5, 3]


def test_waves_broadcast_nothing(spark, monkeypatch):
    """What a wave meets is merged, so that no wave sends tables through the driver."""
    plans, add = [], Parts.add

    def spy(self, df, sums=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return add(self, df, sums)

    nodes, edges = spark.createDataFrame([(1, 5), (2, 3), (3, 1)], "node int, v int"), spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "source int, target int")
    before = packets.evaluated(nodes, edges, "v", MOST, 9)
    now = nodes.withColumn("v", F.when(F.col("node") == 3, 9).otherwise(F.col("v")))
    monkeypatch.setattr(Parts, "add", spy)
    got = incremental.recomputed(now, edges, before, nodes.where("node = 3"), "v", MOST)
    assert sorted(map(tuple, got.collect())) == [(1, 9, True), (2, 9, True), (3, 9, True)]
    assert len(plans) == 10 and not any("Broadcast" in p for p in plans)
