from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from strataquery.operators import aggregate, lookup
from strataquery.sources.grams import Grams
from tests.test_postings import rows_read

ROWS = [("src/yard.py", "Wagon", "yard.Wagon", "class Wagon"), ("src/yard.py", "couple", "yard.Wagon.couple", "def couple(self)"), ("lib/ab.py", "ab", "ab", None), ("lib/É.py", "Énorm", "É.Énorm", "x"), ("src/track.py", "aaa", "a.aaa", "aaaa")] + [
    (f"gen/m{i}.py", f"name{i}", f"gen.name{i}", f"def name{i}(x{i * 7919})") for i in range(3000)
]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(ROWS, "path string, name string, qualname string, signature string").repartition(3)


@pytest.fixture(scope="module")
def index(symbols, tmp_path_factory):
    return Grams.write([(symbols, ["path", "name", "qualname", "signature"])], str(tmp_path_factory.mktemp("grams") / "at"), row_group=4096)


@pytest.mark.parametrize("term", ["WAGON", "yard", "ab", "énorm", "a", "aaaa", "name299", "e29", "nowhere", "wag on", "m1.py", ""])
def test_values_and_rows(symbols, index, term):
    want = {v.lower() for r in ROWS for v in r if v and term.lower() in v.lower()} | ({""} if term == "" else set())
    assert {r["value"] for r in index.values_with(term).collect()} == want
    plain = lookup.substring_candidates(symbols, symbols.select("path").distinct(), term, 20)
    fast = lookup.indexed_candidates(symbols, symbols.select("path").distinct(), index, term, 20)
    assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in plain.collect()]


def test_a_rare_gram_reads_little(index):
    assert rows_read(index._read("grams").where(F.col("gram") == "wag")) < index._read("grams").count() / 20


def test_digest_of_a_large_folder(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 19_990, "big").otherwise("small").alias("p"), F.format_string("n%d", "id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("d"), F.lit(2).cast("long").alias("s"))
    a, b = (aggregate.merkle_level(df, "p", "n", "d", "s") for df in (rows, rows.repartition(7).orderBy(F.rand(3))))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and {r["p"]: (r["size"], r["children"]) for r in a.collect()} == {"big": (39_980, 19_990), "small": (20, 10)}
    cells: dict = {}
    for i in range(19_990, 20_000):
        cells.setdefault(hashlib.md5(f"n{i}".encode()).hexdigest()[:3], []).append((f"n{i}", f"6:n{i}{hashlib.sha256(str(i).encode()).hexdigest()}2"))
    whole = "\n".join(f"{c}:{hashlib.sha256(chr(10).join(v for _, v in sorted(x)).encode()).hexdigest()}" for c, x in sorted(cells.items()))
    assert {r["p"]: r["digest"] for r in a.collect()}["small"] == hashlib.sha256(whole.encode()).hexdigest()
    changed = rows.withColumn("d", F.when(F.col("n") == "n7", "x").otherwise(F.col("d")))
    now = {r["p"]: r["digest"] for r in aggregate.merkle_level(changed, "p", "n", "d", "s").collect()}
    then = {r["p"]: r["digest"] for r in a.collect()}
    assert now["big"] != then["big"] and now["small"] == then["small"]
    # The large folder's rows are dealt by cell: many tasks hold some.
    parts = rows.where("p = 'big'").withColumn("_cell", F.substring(F.md5(F.col("n").cast("binary")), 1, 3)).groupBy("_cell").count()
    assert parts.count() > 3_000 and parts.agg(F.max("count")).first()[0] < 40
