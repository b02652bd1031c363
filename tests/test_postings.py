from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strataquery.engine import Engine
from strataquery.functions.text import line_terms
from strataquery.sources.postings import Postings
from strataquery.sources.stored import Parts, stored


def rows_read(df) -> int:
    """Rows that the scan of a one-table plan handed on, after its row groups and pages were pruned."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan
    leaf = plan.collectLeaves().apply(0)
    while not leaf.metrics().contains("numOutputRows") or not leaf.metrics().contains("numFiles"):
        leaf = leaf.plan().collectLeaves().apply(0)  # a finished stage
    return leaf.metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def corpus(spark):
    pick = random.Random(3)
    word = lambda: "".join(pick.choices("abcdefghij", k=4))
    texts = [(f"f{i:04}", "\n".join(" ".join(["common", *(word() for _ in range(8)), "getHTTPName_x2" if i % 50 == 0 else "plain"]) for _ in range(10))) for i in range(800)]
    texts += [("once", "a rareword stands here\nand_here rareword"), ("empty", ""), ("none", None), ("edge", "prelicensed underneath\nnothing")]
    return spark.createDataFrame(texts, "path string, text string").repartition(4)


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return Postings.write(corpus, str(tmp_path_factory.mktemp("index") / "at"), row_group=4096)


def test_postings_are_those_of_the_lines(spark, corpus, index):
    lines = corpus.select("path", F.posexplode(F.split("text", "\n")).alias("at", "content")).select("path", (F.col("at") + 1).alias("line"), F.explode(line_terms(F.col("content"))).alias("token"))
    want = {tuple(r) for r in lines.select("token", "path", "line").collect()}
    rows = index.rows().collect()
    assert {(r["token"], r["path"], n) for r in rows for n in r["lines"]} == want
    assert all(r["lines"] == sorted(set(r["lines"])) for r in rows) and len(rows) == len({(r["token"], r["path"]) for r in rows})
    held = {}
    for r in rows:
        held.setdefault(r["path"], []).append(r)
    assert all(r["file_terms"] == len(v) for v in held.values() for r in v)
    paths = {}
    for t, p, _ in want:
        paths.setdefault(t, set()).add(p)
    assert {r["token"]: r["df"] for r in index.terms().collect()} == {t: len(p) for t, p in paths.items()}
    assert {r["token"] for r in index.of(["getHTTPName_x2", "http"]).collect()} == {"gethttpname_x2", "http"}
    assert {tuple(r) for r in index.frequencies(["common", "nowhere"]).collect()} == {("common", 800)}


def test_a_rare_term_reads_few_row_groups(index):
    total = index.rows().count()
    assert [(r["path"], r["lines"]) for r in index.of(["rareword"]).collect()] == [("once", [1, 2])]
    assert rows_read(index.of(["rareword"])) < total / 10
    assert rows_read(index.of(["rareword", "and_here"])) < total / 5
    assert rows_read(index.of(["common"])) < total / 2


def test_a_frequent_term_is_spread(spark, corpus, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = spark.range(4000).select(F.format_string("p%05d", "id").alias("path"), F.lit("same").alias("text"))
        index = Postings.write(hot, str(tmp_path / "hot"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.of(["same"]).count() == 4000
    assert max(r["count"] for r in index.rows().groupBy(F.input_file_name().alias("file")).count().collect()) < 1500


@pytest.mark.parametrize("literal", ["licensed under", "rareword stands", "RAREWORD", "getHTTP", "name_x2 ", "nothing", "here", " plain\ncommon", "x2", "and_here rare"])
def test_files_with_a_literal(corpus, index, literal):
    want = {r["path"] for r in corpus.where(F.contains(F.lower("text"), F.lit(literal.lower()))).select("path").collect()}
    got = {r["path"] for r in index.files_with(literal).collect()}
    assert want <= got and (len(got) == len(want) or literal in ("x2", " plain\ncommon", "here", "name_x2 "))


def test_files_with_nothing_to_ask_for(index):
    assert index.files_with(" 1 + 2 ") is None


def test_engine_reads_the_index(spark, corpus, tmp_path):
    symbols = spark.createDataFrame([], "path string, name string, qualname string, kind string, signature string, start_line int, end_line int")
    edges = spark.createDataFrame([], "path string, source string, kind string, target string, line int")
    plain = Engine(corpus.where("text IS NOT NULL"), symbols, edges)
    fast = plain.indexed(str(tmp_path / "i"))
    for q in ("rareword common", "getHTTPName_x2", "zzz"):
        assert sorted(map(tuple, plain.lexical(q, 50).collect())) == sorted(map(tuple, fast.lexical(q, 50).collect()))
        assert sorted(map(tuple, plain.grep(q, 50).collect())) == sorted(map(tuple, fast.grep(q, 50).collect()))
    assert "EqualTo(token,rareword)" in fast.lexical("rareword")._jdf.queryExecution().toString()


def test_parts_and_stored_tables(spark):
    parts = Parts(spark, "t")
    assert [parts.add(spark.range(n).withColumn("k", F.lit(n))) for n in (3, 0, 5)] == [3, 0, 5]
    assert parts.df.count() == 8 and parts.part(0).count() == 3 and parts.part(-1).count() == 5 and parts.rows == [3, 0, 5]
    assert stored(spark.range(0)).count() == 0


def test_writing_shuffles_no_postings(spark, corpus, tmp_path, monkeypatch):
    """What is dealt to other tasks is at most the texts and the counts of tokens, and the postings are written once."""
    from strataquery.sources import postings as P

    made = []
    monkeypatch.setattr(P, "postings_rows", lambda *a, rows=P.postings_rows: made.append(rows(*a, run_bytes=1)) or made[-1])
    index = Postings.write(corpus, str(tmp_path / "runs"))
    assert index.rows().rdd.getNumPartitions() >= 1 and not hasattr(P, "stored")
    assert sorted(map(tuple, index.rows().collect())) == sorted(map(tuple, Postings.write(corpus, str(tmp_path / "whole")).rows().collect()))
    assert made[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1  # the fixture's own repartition


def test_runs_are_in_order():
    import pyarrow as pa

    from strataquery.sources.postings import in_order

    rows = [(t, p, [i], i) for i, (t, p) in enumerate([("b", "y"), ("a", "z"), ("é", "x"), ("b", "x"), ("a", "y"), ("Z", "y")])]
    got = in_order(pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["token", "path", "lines", "file_terms"])).to_pylist()
    assert [(r["token"], r["path"]) for r in got] == sorted((r[0], r[1]) for r in rows) and all(r["lines"] == [r["file_terms"]] for r in got)
