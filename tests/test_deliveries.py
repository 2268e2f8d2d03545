from datetime import datetime

import pytest

from folioweave.operators import deliveries
from folioweave.operators.deliveries import latest, latest_of_few

T = [datetime(2025, 1, d) for d in (1, 2, 3)]


def test_latest(spark):
    rows = [(1, T[0], "a", 0), (1, T[2], "b", 0), (1, None, "c", 0), (2, T[0], "x", 1), (2, T[0], "x", 1), (3, None, None, None)]
    df = spark.createDataFrame(rows, "k INT, received_at TIMESTAMP, v STRING, n INT")
    assert sorted((r.k, r.v) for r in latest(df, "k").collect() if r.k != 3) == [(1, "b"), (2, "x")]
    assert latest(df, "k").columns == df.columns and latest(df.limit(0), "k").count() == 0


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, T[0], str(i)) for i in range(50)]
    pick = lambda r: latest(spark.createDataFrame(r, "k INT, received_at TIMESTAMP, v STRING").repartition(4), "k").first().v
    assert pick(rows) == pick(rows[::-1])


def test_null_keys_maps_and_clashing_names(spark):
    rows = [(None, T[0], {"a": 1}, 1), (None, T[1], {"a": 1}, 1), (None, T[0], {"a": 1}, 1), (1, T[0], None, 2)]
    df = spark.createDataFrame(rows, "k INT, received_at TIMESTAMP, content MAP<STRING, INT>, alone INT")
    got = latest(df, "k")
    assert got.columns == df.columns and got.count() == 3


def test_a_key_of_very_many_rows(spark):
    df = spark.range(20_000).selectExpr("IF(id % 3 = 0, 7, id) AS k", "timestamp_seconds(id) AS received_at", "id")
    rows = {r.k: r.id for r in latest(df, "k").collect()}
    assert len(rows) == len({7 if i % 3 == 0 else i for i in range(20_000)}) and rows[7] == 19_998


@pytest.mark.parametrize("shipped", [100, 1])
def test_few_repeated_keys(spark, monkeypatch, shipped):
    monkeypatch.setattr(deliveries, "MAX_SHIPPED_KEYS", shipped)
    rows = [(1, T[0], "a"), (1, T[2], "b"), (2, T[0], "x"), (2, T[0], "x"), (3, T[1], "y"), (None, T[0], "n"), (None, T[0], "n"), (None, T[1], "n")]
    df = spark.createDataFrame(rows, "k INT, received_at TIMESTAMP, v STRING")
    kept = lambda d: sorted(map(str, d.collect()))
    assert kept(latest_of_few(df, "k")) == kept(latest(df, "k")) and latest_of_few(df.limit(0), "k").count() == 0
