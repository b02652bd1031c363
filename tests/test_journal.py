from __future__ import annotations

import pytest

from strataquery.plans.registry import ORACLE, QUERIES
from strataquery.streaming import journal as J
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def zone(spark):
    """A session away from UTC, in a zone that turns its clock."""
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/St_Johns")
    yield
    spark.conf.set("spark.sql.session.timeZone", was)


@pytest.mark.parametrize("name", ["debounced_batches", "extra_sessions", "freshness_map", "module_prefixes", "symbols_of_files"])
def test_zone_of_the_session(spark, zone, name):
    import strataquery.catalog  # noqa: F401

    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(oracle(SF).sql(ORACLE[name]).df())


def test_clock_without_a_zone(spark, zone):
    """Hours that the session's zone leaves out or has twice, and times before 1970."""
    said = ["2024-03-10 02:30:00.000001", "2024-03-10 03:00:00", "2024-11-03 01:59:59.999999", "1969-12-31 23:59:59.5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").selectExpr("i", "CAST(t AS timestamp_ntz) AS ts", "'k' AS key")
    got = [r[0] for r in df.orderBy("i").select(J.epoch_micros(df, "ts")).collect()]
    assert got == [1710037800000001, 1710039600000000, 1730599199999999, -500000]
    assert {(r["slot"], r["events"]) for r in J.debounced(df, "ts", "key", 60_000).collect()} == {(28500630, 1), (28500660, 1), (28843319, 1), (-1, 1)}
    assert J.sessions(df.where("i < 2"), "ts", "key", 1799).count() == 2  # half an hour apart by the clock
