from __future__ import annotations

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataquery.engine import Engine
from strataquery.operators import task as T

FILES = {
    "src/wagon/couple.py": "def couple_wagon(rake):\n    return buffer_gap_17(rake)\n",
    "src/wagon/brake.py": "def brake_rake(rake):\n    return rake\n",
    "src/wagon/gauge.py": "def gauge_of(track):\n    return track\n",
    "tests/test_couple.py": "from wagon.couple import couple_wagon\n\ndef test_couple():\n    assert buffer_gap_17 and couple_wagon\n",
    "docs/ownership.md": "ownership of the brake and the contract of every rake\n",
    **{f"src/other/m{i}.py": f"def thing_{i}(track):\n    return 'plain brake track {i}'\n" for i in range(30)},
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return Engine.build(spark, str(root)).indexed(str(tmp_path_factory.mktemp("i") / "x"))


def test_a_rare_identifier_answers(engine):
    rows = engine.find_task("Why does buffer_gap_17 return a wrong rake").collect()
    assert {r["route"] for r in rows} == {"rare-identifier"} and [r["path"] for r in rows] == ["tests/test_couple.py", "src/wagon/couple.py"]
    assert {r["score"] for r in rows} <= {1000.0, 900.0}
    # Words of authority at large call for the whole search, and so does an identifier that no test holds.
    assert {r["route"] for r in engine.find_task("the policy behind buffer_gap_17 and brake").collect()} == {"fusion"}
    assert {r["route"] for r in engine.find_task("thing_7 with brake").collect()} == {"fusion"}


def test_an_island_answers(engine):
    rows = engine.find_task("couple the wagon").collect()
    assert {r["route"] for r in rows} == {"lexical-island"} and [r["path"] for r in rows][0] == "tests/test_couple.py" and "src/wagon/couple.py" in {r["path"] for r in rows}
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_views_are_fused(engine):
    assert engine.find_task("Who owns the brake of a track", 5).count() == 5
    rows = engine.find_task("Who owns the brake of a track", 60).collect()
    assert {r["route"] for r in rows} == {"fusion"}
    assert "docs/ownership.md" in {r["path"] for r in rows}  # only the view of governance asks for it
    assert [(-r["score"], r["path"]) for r in rows] == sorted((-r["score"], r["path"]) for r in rows)
    with pytest.raises(ValueError):
        engine.find_task("is the")
    plain = Engine(engine.files, engine.symbols, engine.edges.drop("target_short"), engine.parsed)
    assert plain.find_task("brake", 3).count() == 3  # writes its postings first


def test_views_of_a_task():
    df = {"brake": 3, "wagon": 500, "privacy": 0, "buffergap": 2}
    one = T.views("Should the brake leak into the Wagon or BufferGap", df, 1000, 20, 2)
    assert [v.name for v in one] == ["base", "governance", "evidence"]
    assert one[0].terms == ("buffergap", "brake")  # a capital inside tells more than a rare word
    assert one[1].terms[2:] == tuple(T.GOVERNANCE_TERMS.split()) and one[2].terms[2:] == ("privacy", "security", "confidentiality", "redaction", "exposure")
    assert [v.name for v in T.views("brake wagon", df, 1000)] == ["base"]  # equal views count once
    assert T.views("unknown words", {}, 1000)[0].terms == ("unknown", "words")


@given(st.integers(0, 10_000))
@settings(max_examples=5, deadline=None)
def test_fusion_matches_brute_force(spark, seed):
    pick = random.Random(seed)
    chosen = [T.View("base", ("a",), 1.2, 9), T.View("governance", ("b",), 1.0, 9), T.View("evidence", ("c",), 0.8, 9)]
    rows = [(v.name, i + 1, f"p{pick.randrange(6)}", float(pick.randrange(4)), i) for v in chosen for i in range(pick.randrange(1, 12))]
    score, best = defaultdict(float), {}
    for at, v in enumerate(chosen):
        seen = []
        for _, place, path, s, line in sorted(r for r in rows if r[0] == v.name):
            if path not in seen:
                seen.append(path)
                score[path] += v.weight / (60 + len(seen))
            best[path] = max(best.get(path, (-1.0,)), (s, -at, -place, line))
    want = sorted(((round(s * 1000, 6), p, best[p][-1]) for p, s in score.items()), key=lambda x: (-x[0], x[1]))[:4]
    hits = spark.createDataFrame(rows, "view string, place int, path string, score double, line int").repartition(2)
    assert [(r["score"], r["path"], r["line"]) for r in T.fused(hits, chosen, 4).collect()] == want
