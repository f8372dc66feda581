"""Row numbers and running totals against plain loops."""

import io
import contextlib
import random

import pytest
from pyspark.sql import functions as F

from clusterloom.operators import ordered


def rows_of(seed, n=300):
    rng = random.Random(seed)
    # a third of all rows share one key, some are equal throughout, some keys are null
    return [
        (rng.choice([None, 7, 7, 7, rng.randrange(50)]), rng.choice([None, float("nan"), 0.5, rng.random()]), rng.randrange(4))
        for _ in range(n)
    ]


def sort_key(row):
    return tuple((x is not None, x != x, 0 if x is None or x != x else x) for x in row)


@pytest.mark.parametrize("n_ranges", [1, 3, 40])
def test_row_numbers(spark, n_ranges):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "k int, x double, `a.b` int").repartition(5)
    numbered = ordered.global_row_number(df, ["k", "x"], "n", n_ranges)
    got = sorted(numbered.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(1, len(rows) + 1))
    assert [sort_key(r[:3]) for r in got] == sorted(map(sort_key, rows))


def test_copies_of_a_row_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ordered, "NUMBERS_PER_ROW", 4)
    df = spark.createDataFrame([(1, "a")] * 11 + [(0, "b")], "k int, s string")
    got = sorted(ordered.global_row_number(df, ["k"]).collect(), key=lambda r: r["row_number"])
    assert [r["row_number"] for r in got] == list(range(1, 13))
    assert got[0]["s"] == "b"


@pytest.mark.parametrize("n_ranges", [1, 6])
@pytest.mark.parametrize("value, kind", [("v", "bigint"), ("v", "double"), ("v", "decimal(10,2)")])
def test_running_totals(spark, n_ranges, value, kind):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, rng.randrange(30)]), rng.choice([None, rng.randrange(9)])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, v int").withColumn("v", F.col("v").cast(kind))
    got = ordered.running_total(df, ["k"], value, n_ranges=n_ranges).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sum(v or 0 for k, v in rows if k is None or (r["k"] is not None and k <= r["k"]))
        assert float(r["running_total"]) == want


def test_shares_end_at_one(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(100)], "k int, v double")
    got = {r["k"]: r["s"] for r in ordered.running_total(df, ["k"], "v", "s", share=True, n_ranges=7).collect()}
    assert got[99] == pytest.approx(1.0) and got[0] == 0.0
    assert got[49] == pytest.approx(0.5)
    zero = spark.createDataFrame([(1, 0.0)], "k int, v double")
    assert ordered.running_total(zero, ["k"], "v", "s", share=True).first()["s"] is None


def test_empty_tables_and_names(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert ordered.global_row_number(empty, ["k"]).count() == 0
    assert ordered.running_total(empty, ["k"], "v").count() == 0
    assert ordered.weighted_draws(empty, "k", "v", 3).count() == 0
    clash = spark.createDataFrame([(1, 2, 3, 4)], "__copies0 int, __range0 int, `__BEFORE0` int, k int")
    assert ordered.global_row_number(clash, ["k"]).first()["row_number"] == 1
    with pytest.raises(ValueError):
        ordered.global_row_number(clash, ["k"], "k")


def test_no_window_without_a_partition(spark):
    df = spark.range(1000).withColumn("v", F.rand(1))
    for result in (ordered.global_row_number(df, ["id"]), ordered.running_total(df, ["id"], "v")):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            result.explain()
        assert "Window" in text.getvalue()
        assert "SinglePartition" not in text.getvalue()


def test_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([0.0, 1.0, 3.0, -1.0, None])], "k int, w double")
    picks = [r["k"] for r in ordered.weighted_draws(df, "k", "w", 400).collect()]
    assert set(picks) == {1, 2}
    assert 250 < picks.count(2) < 350
