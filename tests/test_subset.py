import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import subset


def points(spark, values):
    return spark.createDataFrame(
        [(i, f"p{i}", float(v)) for i, v in enumerate(values)], "id bigint, name string, x double"
    )


def test_golden_order(spark):
    picks = subset.minmax_subset(points(spark, [0, 1, 10, 6]), "id", "name", ["x"], 3, start_pk=0)
    rows = [tuple(r) for r in picks.orderBy("pick").collect()]
    assert rows == [(0, 0, "p0", None), (1, 2, "p2", 10.0), (2, 3, "p3", 4.0), (3, 1, "p1", 1.0)]


def test_ties_and_early_end(spark):
    picks = subset.minmax_subset(
        points(spark, [0, 5, -5, 5, 0]), "id", "name", ["x"], 10, start_pk=0
    )
    assert [r["id"] for r in picks.orderBy("pick").collect()] == [0, 1, 2]


@pytest.mark.parametrize("candidates", [1, 3, 500])
def test_candidates_do_not_change_the_picks(spark, monkeypatch, candidates):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 5))
    df = spark.createDataFrame(
        [(i, i % 7, row.tolist()) for i, row in enumerate(data)], "id bigint, label int, v array<double>"
    ).repartition(5)
    passes = []
    near = subset.with_nearest_dist2
    monkeypatch.setattr(subset, "with_nearest_dist2", lambda *a: passes.append(1) or near(*a))
    picks = subset.minmax_subset(
        df, "id", "label", "v", 8, start_pk=11, candidates=candidates, storage=None
    ).orderBy("pick").collect()
    assert len(passes) == {1: 8, 500: 1}.get(candidates, len(passes)) and len(passes) <= 8
    near = ((data - data[11]) ** 2).sum(axis=1)
    expected = [11]
    for _ in range(8):
        expected.append(int(near.argmax()))
        near = np.minimum(near, ((data - data[expected[-1]]) ** 2).sum(axis=1))
    assert [r["id"] for r in picks] == expected
    distances = [r["dist"] for r in picks[1:]]
    assert all(b <= a for a, b in zip(distances, distances[1:]))


def test_random_start_is_reproducible(spark):
    df = points(spark, range(50))
    starts = {
        subset.minmax_subset(df.repartition(n), "id", "name", ["x"], 0, seed=5).first()["id"]
        for n in (1, 7)
    }
    assert len(starts) == 1
    assert starts == {subset.pick_item(df, "id", ["x"], seed=5)[0]}


def test_missing_features_are_left_out(spark):
    df = points(spark, [0, 1]).union(spark.createDataFrame([(9, "none", None)], "id bigint, name string, x double"))
    picks = subset.minmax_subset(df, "id", "name", ["x"], 5, start_pk=0)
    assert [r["id"] for r in picks.orderBy("pick").collect()] == [0, 1]


def test_unknown_start(spark):
    with pytest.raises(ValueError):
        subset.minmax_subset(points(spark, [1]), "id", "name", ["x"], 1, start_pk=77)


def test_distance_table_is_a_map(spark):
    table = subset.distance_table(points(spark, [0, 3]), "id", ["x"], [4.0])
    assert [r["dist"] for r in table.orderBy("id").collect()] == [4.0, 1.0]
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
