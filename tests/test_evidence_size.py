from __future__ import annotations

from strataquery.operators import changes, dependency


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_claims_are_counted_without_a_join(spark):
    """A null is like no other claim; repeated claims count once."""
    table = lambda rows: spark.createDataFrame(rows, "producer string, k int")
    before, after = table([("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", 1), (None, 1)]), table([("a", 2), ("a", 3), ("a", 3), ("a", None), ("c", 1), (None, 1)])
    got = changes.claim_delta(before, after, ["k"])
    assert got.columns == ["producer", "added", "removed", "kept"]
    assert {tuple(r) for r in got.collect()} == {("a", 2, 2, 1), ("b", 0, 1, 0), ("c", 1, 0, 0), (None, 1, 1, 0)}
    assert "Join" not in _plan(got)


def test_chains_are_not_grouped(spark):
    uses = spark.createDataFrame([("p", 1), ("p", 1), ("q", 1), ("r", 2)], "path string, node int")
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 2)], "source int, target int")
    verifiers = spark.createDataFrame([("p", "v"), ("p", "v"), ("p", "w"), ("r", "v")], "path string, verifier string")
    got = dependency.verification_chains(uses, edges, verifiers)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == [(1, 1, "p", "v"), (1, 1, "p", "w"), (1, 2, "p", "v"), (1, 2, "p", "w"), (2, 2, "r", "v")]
    assert "Aggregate" not in _plan(got).split("Join", 1)[0]
