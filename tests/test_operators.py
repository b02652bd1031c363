from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataquery.functions import text as T
from strataquery.functions import versions
from strataquery.operators import aggregate, delta, evidence, graph, lookup, rank, topk


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("token", "terms"),
    [
        ("RailYardPlanner", {"railyardplanner", "rail", "yard", "planner"}), ("HTTPServer2X", {"httpserver2x", "http", "server"}), ("__init__", {"__init__", "init"}),
        ("snake_case_9", {"snake_case_9", "snake", "case"}), ("parseJSONv2", {"parsejsonv2", "parse", "jso", "nv"}), ("i18n", {"i18n", "18"}), ("X", {"x"}), ("_", {"_"}),
    ],
)
def test_identifier_terms(spark, token, terms):
    assert set(one(spark, T.identifier_terms(F.lit(token)))) == terms


def test_paths(spark):
    assert one(spark, T.normal_path(F.lit("./a//b/"))) == "a/b"
    assert one(spark, T.normal_path(F.lit("a/../b"))) is None and one(spark, T.normal_path(F.lit("/a"))) is None
    assert one(spark, T.module_name(F.lit("src/pkg/__init__.py"))) == "pkg"
    assert one(spark, T.is_test_path(F.lit("tests/test_a.py"))) and not one(spark, T.is_test_path(F.lit("src/contest.py")))
    assert one(spark, T.language_of(F.lit("a/b.RS"))) == "rust"
    assert one(spark, T.token_estimate(F.lit(""))) == 0 and one(spark, T.token_estimate(F.lit("abcde"))) == 2
    assert one(spark, F.array(*[T.is_secret_path(F.lit(p)) for p in ("x/.env", ".env.local", "k.pem", "envy.py")])) == [True, True, True, False]


def test_prefix_takes_whole_segments(spark):
    df = spark.createDataFrame([("src",), ("src/a",), ("src2/b",), ("src0",), ("src/å.py",)], "path string")
    assert {r[0] for r in df.where(lookup.under("path", "src")).collect()} == {"src", "src/a", "src/å.py"}


def test_interval_union(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("a", 2, 2), ("b", 1, 2), ("b", 5, 5)], "path string, start_line int, end_line int")
    assert {tuple(r) for r in aggregate.interval_union(df).collect()} == {("a", 6, 1), ("b", 3, 2)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 30)), min_size=1, max_size=30))
def test_interval_union_is_a_set(spark, spans):
    df = spark.createDataFrame([("a", s, s + n) for s, n in spans], "path string, start_line int, end_line int")
    assert aggregate.interval_union(df).first()["covered"] == len({i for s, n in spans for i in range(s, s + n + 1)})


CHAIN = [(i, i + 1, None) for i in range(20)] + [(20, 5, None), (3, 30, "extra"), (30, 31, None), (2, 40, None), (4, 40, None), (40, 41, None)]


def test_graph(spark):
    e = spark.createDataFrame(CHAIN, "source long, target long, marker string")
    n = spark.createDataFrame([(i, "m" if i == 41 else None) for i in [*range(21), 30, 31, 40, 41]], "node long, marker string")
    start = spark.createDataFrame([(0,)], "node long")
    found, left = graph.walk(e, n, start, 6)
    depths = {r["node"]: r["depth"] for r in found.collect()}
    assert depths == {0: 0, 1: 1, 2: 2, 3: 3, 40: 3, 4: 4, 5: 5, 6: 6}
    assert {tuple(r) for r in left.collect()} == {("conditional-edge", 3), ("conditional-edge", 40), ("depth-limit", 6)}
    paths = graph.simple_paths(e, start, 40, 6)
    assert [tuple(r) for r in paths.orderBy("depth").collect()] == [([0, 1, 2, 40], 3), ([0, 1, 2, 3, 4, 40], 5)]
    # 7, 6, 5; then the chain 4 .. 0 and, round the cycle, 20 .. 11
    assert graph.reverse_levels(e, spark.createDataFrame([(7,)], "node long"), 12).count() == 3 + 5 + 10


def test_delta(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, None, "p")], "k int, v string, source string")
    b = spark.createDataFrame([(2, "z", "q"), (3, None, "q"), (4, "w", "q")], "k int, v string, source string")
    assert {tuple(r) for r in delta.keyed_delta(a, b, ["k"], ["v"]).collect()} == {(1, "removed"), (2, "changed"), (3, "unchanged"), (4, "added")}
    paths = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d",), ("c/d/e",)], "path string")
    assert {r[0] for r in delta.collapse_descendants(paths).collect()} == {"a", "ab", "c/d"}


def test_bounds(spark):
    df = spark.range(1100).withColumn("path", F.lpad(F.col("id").cast("string"), 5, "0"))
    out = topk.bounded(df, ["path"], 1024).collect()
    assert len(out) == 1024 and all(r["truncated"] for r in out) and out[0]["path"] == "00000"
    assert not topk.bounded(df, ["path"], 1100).first()["truncated"]
    rows = spark.createDataFrame([("a", i, c) for i, c in enumerate([5, 9, 3, 2])], "k string, o int, cost int")
    assert sorted(r["o"] for r in topk.within_budget(rows, "k", ["o"], "cost", 10).collect()) == [0, 2, 3]


def test_whole_groups(spark):
    """Budget and cover over groups of more than 64 rows, against plain loops."""
    costs = [(g, i, (i * 37 + len(g)) % 23 + 10 * (i < 70)) for g in ("a", "bb") for i in range(150)]
    got = topk.fill_budget(spark.createDataFrame(costs, "k string, o int, cost int"), "k", ["o"], "cost", 700).collect()
    want, used = set(), {"a": 0, "bb": 0}
    for g, i, c in costs:
        if used[g] + c <= 700:
            used[g] += c
            want.add((g, i, c))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    sets = {i: [f"t{(i * k) % 101}" for k in range(1, 2 + i % 9)] for i in range(120)}
    frame = spark.createDataFrame([("g", i, v) for i, v in sets.items()], "g string, i int, terms array<string>")
    covered, want = set(), []
    for k in range(5):
        best = min((i for i in sets if i not in {w[1] for w in want}), key=lambda i: (-len(set(sets[i]) - covered), i))
        want.append(("g", best, k + 1, len(set(sets[best]))))
        covered |= set(sets[best])
    assert sorted(map(tuple, topk.greedy_cover(frame, "g", "i", "terms", 5).collect()), key=lambda r: r[2]) == want


def test_budget_and_cover_read_whole_tables(spark, tmp_path):
    """A file of rank 65 and a term of more than three letters take part."""
    from strataquery.catalog import QUERIES

    docs = [(i, "word " * 1001, "en", "s") for i in range(64)] + [(64, "longer terms make this one the best " * 20, "en", "s"), (65, "tiny", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    picks = {r["pick"]: r["path"] for r in QUERIES["diversity_topk"](spark, str(tmp_path)).collect()}
    assert picks[1].endswith("/64.txt") and len(picks) == 8
    fit = {r["path"].split("/")[-1]: r["rn"] for r in QUERIES["skip_budget"](spark, str(tmp_path)).collect()}
    assert fit["64.txt"] == 65 and fit["65.txt"] == 66


def test_versions():
    assert versions.pep440("1.4.0", ">=1.2,<2") == "match" and versions.pep440("x", ">=1") == "unclassified"
    ok = lambda v, s: versions.npm(v, s) == "match"
    assert ok("1.2.9", "^1.2.3") and not ok("2.0.0", "^1.2.3") and ok("0.2.5", "^0.2.3") and not ok("0.3.0", "^0.2.3")
    assert ok("1.2.9", "~1.2.0") and ok("1.9.0", "1.x") and ok("3.0.0", "1.x || >=3") and ok("2.3.0", "1.0.0 - 2.3.0") and not ok("2.3.1", "1.0.0 - 2.3.0")
    assert ok("1.0.0-rc.1", "1.0.0-rc.1") and not ok("1.0.0-rc.1", "^1.0.0") and versions.npm("git+x", "^1") == "unclassified"


@pytest.mark.parametrize(
    ("version", "spec", "state"),
    [
        ("1.2.3-beta.4", "^1.2.3-beta.2", "match"), ("1.2.3-beta.4", ">=1.2.3-beta.1 <2.0.0", "match"), ("1.2.3", ">1.2.3-alpha", "match"), ("1.3.0-beta.1", "^1.2.3", "nonmatch"), ("1.3.0-beta.1", ">=1.2.3-beta.1 <2.0.0", "nonmatch"),
        ("1.2.3", "1.2.x", "match"), ("1.3.0", "1.2.x", "nonmatch"), ("0.3.0", "^0.2.3", "nonmatch"), ("0.0.4", "^0.0.3", "nonmatch"), ("0.0.9", "^0.0", "match"), ("0.9.0", "^0.x", "match"), ("2.4.0", "1.2.3 - 2.3", "nonmatch"),
        ("1.2.3", ">1.2", "nonmatch"), ("1.2.9", "<=1.2", "match"), ("1.0.0-a", "*", "nonmatch"), ("1.0.0", "latest", "unclassified"), ("1.2", "*", "unclassified"), ("2.5.0", "1.2.3 || 2", "match"), ("9007199254740992.0.0", "*", "unclassified"),
    ],
)
def test_npm_ranges(version, spec, state):
    assert versions.npm(version, spec) == state


def test_prereleases_are_asked_for():
    assert versions.pep440("2.0a1", ">=1.0") == "nonmatch" and versions.pep440("2.0a1", ">=1.0", True) == "match"


def test_blobs_and_values(spark, tmp_path):
    from strataquery.sources import repository as R

    files = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "path string, text string").withColumn("file_digest", F.sha2("text", 256))
    R.store_blobs(files, str(tmp_path / "cas"))
    R.store_blobs(files.union(spark.createDataFrame([("d", "z", "wrong")], files.schema)), str(tmp_path / "cas"))
    assert spark.read.parquet(str(tmp_path / "cas")).count() == 3 and [r[0] for r in R.corrupt_blobs(spark, str(tmp_path / "cas")).collect()] == ["wrong"]


def test_limits_are_errors_or_omissions(spark):
    from strataquery.operators import dependency

    edges = spark.createDataFrame([(i, i + 1, None) for i in range(6)] + [(0, 10, "m")], "source long, target long, marker string")
    nodes = spark.createDataFrame([(i, None) for i in range(12)], "node long, marker string")
    start = spark.createDataFrame([(0,)], "node long")
    found, left = dependency.bounded_walk(edges, nodes, start, 4, 2, 100)
    assert [tuple(r) for r in found.collect()] == [(1, 1), (2, 2)] and {tuple(r) for r in left.collect()} == {("conditional-edge", 0), ("depth-limit", 4), ("result-limit", None)}
    found, left = dependency.bounded_walk(edges, nodes, start, 4, 9, 2)
    assert found.count() == 2 and ("visit-limit", None) in {tuple(r) for r in left.collect()}
    assert dependency.bounded_paths(edges, start, 5, 9, 9, 3)[1] == ["visit-limit"]
    with pytest.raises(ValueError):
        dependency.verification_chains(start.withColumn("path", F.lit("p")), edges, spark.createDataFrame([("p", "v")], "path string, verifier string"), 2)
    with pytest.raises(ValueError):
        dependency.batch({str(i): start for i in range(33)})



def test_a_common_weight_is_ranked_in_parts(spark, monkeypatch):
    from strataquery.operators import schedule

    items = spark.range(500).select("id", F.when(F.col("id") < 400, 3).otherwise(F.col("id") % 7 + 1).cast("long").alias("w"))
    sums = []
    for together in (100_000, 16):
        monkeypatch.setattr(schedule, "TOGETHER", together)
        rows = schedule.balanced(items, "id", "w", 4).collect()
        assert len(rows) == len({r["id"] for r in rows}) == 500
        sums.append(sorted(sum(r["w"] for r in rows if r["part"] == p) for p in range(4)))
    assert sums[0] == sums[1] and sums[0][-1] - sums[0][0] <= 7


def test_packets_grow_with_the_budget(spark):
    from strataquery.operators import context

    items = spark.createDataFrame(
        [("t", "edit", "a", 5, 1.0, True), ("t", "edit", "b", 1, 9.0, True), ("t", "verify", "c", 4, 2.0, True), ("t", "docs", "d", 2, 7.0, False), ("t", "docs", "e", 1, 8.0, False), ("u", "docs", "x", 50, 1.0, False), ("v", "edit", "y", 0, 1.0, True)],
        "task string, role string, path string, cost long, gain double, mandatory boolean",
    )
    got = {(r["task"], r["budget"]): (r["items"], r["used"], r["roles"], r["missing"], r["safe"]) for r in context.budget_sweep(items, [1, 5, 9, 10, 13, 100]).collect()}
    assert [got["t", b] for b in (1, 5, 9, 10, 13, 100)] == [(1, 1, 1, 1, False), (2, 5, 2, 0, True), (2, 5, 2, 0, True), (3, 10, 2, 0, True), (5, 13, 2, 0, True), (5, 13, 2, 0, True)]
    assert got["u", 1] == (0, 0, 0, 0, True) and got["u", 100] == (1, 50, 0, 0, True) and got["v", 1] == (1, 0, 1, 0, True)
    with pytest.raises(ValueError):
        context.budget_sweep(items, [])


def test_a_field_is_cut_once_for_all_terms(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "x y x zz"), ("b", "y"), ("c", ""), ("d", None)], "path string, text string").select("path", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    plans = []
    monkeypatch.setattr(rank, "cut", lambda df: plans.append(df) or df)
    got = {r["path"]: (r["len_tokens"], r["tf_tokens"]) for r in rank.term_counts(docs, ["x", "y", "q"], ["tokens"]).collect()}
    assert got["a"] == (4, [2, 1, 0]) and got["b"] == (1, [0, 1, 0]) and got["c"] == (0, [0, 0, 0])
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("[a-z]+") == 1


def test_identities_tell_null_from_empty(spark):
    from strataquery.operators import packets

    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("", "a"), ("-", "")], "x string, y string")
    got = [r[0] for r in df.select(packets.context_identity({"x": F.col("x"), "y": F.col("y")}, "d")).collect()]
    assert None not in got and len(set(got)) == 5


def test_evidence(spark):
    c = spark.createDataFrame([("a", "g", "complete", "complete"), ("b", "g", "complete", "complete"), ("a", "h", "complete", "cut")], "context string, kind string, completeness string, truncation string")
    d = spark.createDataFrame([("a",), ("b",), ("c",)], "context string")
    assert {tuple(r) for r in evidence.coverage_complete(c).collect()} == {("g", True), ("h", False)}
    assert {tuple(r) for r in evidence.coverage_complete(c, d).collect()} == {("g", False), ("h", False)}


def test_rank():
    assert rank.query_terms("RailYardPlanner x") == ["railyardplanner", "planner", "rail", "yard"]
    assert rank.formulate({"a": "Ab", "bc": "bc"}, {"a": 1, "bc": 50}, 100) == ["a", "bc"]
    intents = {"who depends on it": "relationship", "hello there": "hybrid", "hello": "identifier", "a.b": "identifier", "fix src/a.py": "path", "the settings of setup.cfg": "path", "env settings": "config", "spec of the class": "test", "which method": "structural", "how does it flow": "conceptual"}
    assert {q: rank.route(q)["intent"] for q in intents} == intents
    assert rank.route("what happens if the owner changes")["domains"] == ["ownership", "source", "architecture", "contract"] and not rank.route("a/b.py")["caller_expansion"]


def test_merkle(spark):
    df = spark.createDataFrame([("a/x", "1", 1), ("a/b/y", "2", 2), ("z", "3", 3)], "path string, digest string, size long")
    t = {r["path"]: r for r in aggregate.merkle_tree(df, "path", "digest", "size").collect()}
    assert set(t) == {"", "a", "a/b"} and t[""]["size"] == 6 and t[""]["children"] == 2
    again = {r["path"]: r["digest"] for r in aggregate.merkle_tree(df.orderBy("size"), "path", "digest", "size").collect()}
    assert {k: r["digest"] for k, r in t.items()} == again


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 40), st.integers(0, 15)), min_size=1, max_size=25), st.integers(1, 9))
@settings(max_examples=12, deadline=None)
def test_interval_union_over_buckets(spark, spans, width):
    df = spark.createDataFrame([(str(k), s, s + n) for k, s, n in spans], "path string, start_line int, end_line int")
    want = {}
    for k in {str(k) for k, _, _ in spans}:
        held = sorted({x for j, s, n in spans if str(j) == k for x in range(s, s + n + 1)})
        want[k] = (len(held), sum(x - 1 not in held for x in held))
    assert {r["path"]: (r["covered"], r["islands"]) for r in aggregate.interval_union(df, width=width).collect()} == want


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=25), st.integers(0, 12))
@settings(max_examples=12, deadline=None)
def test_prefix_budget(spark, rows, budget):
    df = spark.createDataFrame([(k, n, c) for n, (k, c) in enumerate(rows)], "k int, n int, c int")
    want = set()
    for k in (0, 1):
        used = 0
        for n, (j, c) in enumerate(rows):
            if j == k:
                used += c
                if used > budget:
                    break
                want.add((n, used))
    assert {(r["n"], r["used"]) for r in topk.prefix_budget(df, ["k"], ["n"], "c", budget).collect()} == want
