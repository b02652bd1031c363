from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquery.llm import embed, topk
from strataquery.llm.queries import ORACLE, QUERIES
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, rep long, n long, codes array<long>"


def vectors() -> list[tuple]:
    rng = np.random.default_rng(1)
    out: list[tuple] = []
    for c in range(6):
        centre = rng.normal(size=24)
        out += [(len(out) + k, (centre + rng.normal(size=24) * 0.1 * k).tolist()) for k in range(8)]
    out += [(len(out) + k, rng.normal(size=24).tolist()) for k in range(30)]
    same = out[0][1]
    out += [(200, same), (201, same), (202, [2 * x for x in same]), (203, None), (204, [0.0] * 24), (205, []), (206, [None] * 24), (207, [math.nan] * 24), (208, [math.inf] * 24), (209, same[:5]), (210, same[:5]), (None, same), (220, [-x for x in same]), (240, same), (260, [1e-30] * 24)]
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, v, 0, None, None, None, None, None) for i, v in vectors()], SCHEMA).repartition(3)


def usable(i, v) -> bool:
    return i is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_near_duplicates(df):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed.near_duplicate_vectors(df).collect()}
    vs = [(i, np.array(np.float32(v), float)) for i, v in vectors() if usable(i, v) and any(v)]
    links = {i: set() for i, _ in vectors()}
    for a, (i, x) in enumerate(vs):
        for j, y in vs[:a]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                links[i].add(j)
                links[j].add(i)
    found = sum(n for n, _, _ in got.values())
    assert found >= 0.97 * sum(map(len, links.values())) and all(got[i][0] <= len(links[i]) for i in got)
    for i in (200, 201, 202, 240, 0):
        assert got[i][1] == 0
    for i in (203, 204, 205, 206, 207, 208):
        assert got[i] == (0, i, True)
    assert got[209] == (1, 209, True) and got[210] == (1, 209, False)


def test_large_buckets_are_cut(df, monkeypatch):
    whole = sorted(map(tuple, embed.near_duplicate_vectors(df.where("vec_id IS NOT NULL")).collect()))
    monkeypatch.setattr(embed, "BLOCK", 4)
    assert sorted(map(tuple, embed.near_duplicate_vectors(df.where("vec_id IS NOT NULL")).collect())) == whole


def test_recall_at_the_threshold():
    """Pairs at a cosine of just over 0.9 meet in some bucket."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o = rng.normal(size=x.shape)
    o -= (o * x).sum(1)[:, None] * x
    o /= np.linalg.norm(o, axis=1)[:, None]
    y = 0.91 * x + math.sqrt(1 - 0.91**2) * o
    for hashes, least in ((1, 0.99), (2, 0.93)):
        a, b = embed.codes(x, hashes), embed.codes(y, hashes)
        met = (a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))
        assert met.mean() >= least, (hashes, met.mean())


@pytest.mark.parametrize(("d", "hashes"), [(64, 3), (64, 4), (128, 2), (16, 4)])
def test_recall_holds_with_more_hashes(d, hashes):
    """Other pairs than those that set the number of tables, at a cosine of 0.9."""
    x, y = embed.pairs_at(0.9, d, 1500, 99)
    plan = embed.tables_for(d, hashes, 0.9)
    a, b = embed.codes(x, *plan), embed.codes(y, *plan)
    assert plan[0] == hashes and ((a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))).mean() >= 0.985


def test_links_hold_with_more_hashes(spark, monkeypatch):
    """As in a table so large that three hashes are joined; a second dimension has its own numbers."""
    monkeypatch.setattr(embed, "FILL", 3e-4)
    x, y = embed.pairs_at(0.905, 64, 300, 7)
    values = [v.tolist() for v in np.concatenate((x, y))] + [[1.0, 0.1, 0.0], [1.0, 0.0, 0.0]]
    few = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>")
    assert embed.plan_for({64: 600}, 0.9)[64][0] == 3
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_duplicate_vectors(few).collect()}
    assert sum(got[300 + i] == (1, i) for i in range(300)) >= 294 and got[601] == (1, 600)


def test_top_k(df):
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vs = [(i, np.floor(64 * np.array(np.float32(v), float)).astype(int)) for i, v in vectors() if usable(i, v)]
    for i, q in vs:
        if i % 20 == 0:
            want = sorted(((-int(q @ x), j) for j, x in vs if j != i and len(x) == len(q)))[:5]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]


def test_top_k_in_blocks(df, monkeypatch):
    whole = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 7 == 0).collect()))
    for name, size in (("BLOCK", 9), ("LEAST", 3), ("CHUNK", 3), ("PIVOTS", 2), ("LEAF", 2)):
        monkeypatch.setattr(topk, name, size)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 7 == 0).collect())) == whole


def test_large_components(spark):
    big = spark.createDataFrame([(0, [1e9, 2.0]), (20, [3e9, -1.0]), (40, [1e30, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(big, F.col("vec_id") % 20 == 0).collect()}
    assert got[(0, 20)] == 64 * 10**9 * 192 * 10**9 + 128 * -64 if 64 * 10**9 * 192 * 10**9 < 2**63 else got[(0, 20)] == 2**63 - 1
    assert got[(0, 40)] == 2**63 - 1


def test_components_beyond_single_precision(spark):
    """No candidate is lost where squares overflow or distances to pivots are far larger than those of the rows."""
    rows = [(0, [1e37, 1.0]), (1, [2e37, -3.0]), (2, [1e300, 0.0]), (3, [1.7e308, 1.0]), (4, [-1e200, 5.0]), (5, [1.0, 2.0]), (6, [0.5, -2.0]), (20, [1.0, 1.0]), (40, [1e155, -1e155])]
    rows += [(100 + i, [16000.0 + i / 64, -16000.0 + (i * 7 % 11) / 64]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=60).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    most = 1.7976931348623157e308
    whole = {i: [int(min(max(math.floor(64 * x) if abs(64 * x) < math.inf else math.copysign(most, x), -most), most)) for x in v] for i, v in rows}
    for i in (0, 20, 40, 100, 120):
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), -(2**63)), 2**63 - 1), j) for j in whole if j != i)
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(scores)]


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed.near_duplicate_vectors(none).count() == 0 and topk.top_k(none, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(oracle(SF).sql(ORACLE[name]).df())
