from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from strataquery.operators import topk
from strataquery.plans.text import conditional_distinct
from strataquery.sources.stored import Parts


def test_lines_are_told_by_the_text(spark, tmp_path):
    """Lines of two rows of one path count once, and no posting of another word is dealt out."""
    rows = [(1, "the a1\n\nthe\n? !\nthe x1", "en", "s"), (1, "the\nzz\nq\nthe", "en", "s"), (2, "the the\nthe", "en", "s"), (3, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = conditional_distinct(spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("s/en/1.txt", 4, 5)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(lines" not in plan


def test_cover_writes_its_terms_once(spark, monkeypatch):
    written, add = defaultdict(int), Parts.add

    def spy(self, df, sums=None):
        told = add(self, df, sums)
        written[self.base.rsplit("/", 1)[1].split("-")[0]] += self.rows[-1]
        return told

    monkeypatch.setattr(Parts, "add", spy)
    rows = [("g", i, [f"t{i}", f"t{i + 1}"]) for i in range(50)] + [("h", 0, []), ("h", 1, ["t"])]
    got = topk.greedy_cover(spark.createDataFrame(rows, "g string, i int, ts array<string>"), "g", "i", "ts", 4)
    assert sorted(map(tuple, got.orderBy(F.col("g"), "pick").collect())) == [("g", 0, 1, 2), ("g", 2, 2, 2), ("g", 4, 3, 2), ("g", 6, 4, 2), ("h", 0, 2, 0), ("h", 1, 1, 1)]
    assert sum(written.values()) <= 52 + 6 + 9  # a row an item, the picks and their terms
