"""Models whose centroids are a table: against plain loops, the literal form and a stopped run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.functions.vectors import VECTOR
from clusterloom.generations import Generations
from clusterloom.operators import kmeans as km
from clusterloom.operators import kmeans_large as large


def points(n, d, seed, spread=4.0):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(n, d)) + rng.integers(0, 9, size=(n, 1)) * spread, 3)


def frame(spark, rows, name="x"):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], f"id long, {name} array<double>").repartition(4)


@pytest.mark.parametrize("d, n_pivots, block, chunk", [(2, 7, 11, 5), (8, 3, 4096, 256), (1, 1, 7, 3), (3, 60, 50, 1)])
def test_assigned_to_the_nearest(spark, monkeypatch, d, n_pivots, block, chunk):
    monkeypatch.setattr(large, "ITEMS_PER_BLOCK", block)
    monkeypatch.setattr(large, "CENTROIDS_PER_CHUNK", chunk)
    items, centres = points(300, d, 1), points(60, d, 2)
    centres[40:50] = centres[10:20]  # equal centroids: the lowest id wins
    items[:30] = items[0]
    items[30:60] = centres[:30]
    table = frame(spark, items, VECTOR).withColumn("cell", F.lit("kept"))
    model = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cid int, vector array<double>")
    got = {r["id"]: (r["cid"], r["cell"]) for r in large.assign_large(table, model, n_pivots).collect()}
    d2 = ((items[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert got == {i: (int(row.argmin()), "kept") for i, row in enumerate(d2)}


def test_cells_out_of_reach_are_not_met(spark, monkeypatch):
    monkeypatch.setattr(large, "ITEMS_PER_BLOCK", 20)
    monkeypatch.setattr(large, "CENTROIDS_PER_CHUNK", 4)
    centres = np.array([[float(i), 0.0] for i in range(0, 4000, 10)])
    pivots, radii = centres[::20], np.full(20, 100.0)
    batch_of = large._reach(pivots, radii)
    import pyarrow as pa
    near = pa.RecordBatch.from_pydict({
        "id": [1], "cell": pa.array([3], pa.int32()), "far": [5.0],
        "items": pa.array([[[600.0, 1.0]]]), "centroids": pa.array([[[610.0, 0.0]]]),
    })
    [reach] = list(batch_of([near]))
    assert reach.column("cell").to_pylist() == [3]


@pytest.mark.parametrize("init, empty", [("random", "drop"), ("hash", "zero"), ("roundrobin", "drop")])
def test_loop_agrees_with_the_literal_form(spark, monkeypatch, init, empty):
    df = frame(spark, points(400, 3, 3, 9.0))
    options = dict(init=init, empty=empty, max_iter=4, seed=3, changed_at_most=0)
    want = km.kmeans_fit(df, "id", "x", 12, **options)
    monkeypatch.setattr(km, "MAX_CENTROID_VALUES", 12)
    got = km.kmeans_fit(df, "id", "x", 12, **options)
    assert isinstance(got, large.LargeKMeansModel) and not isinstance(want, large.LargeKMeansModel)
    assert (got.passes, got.changes) == (want.passes, want.changes)
    centroids = {r["cid"]: r["vector"] for r in got.centroids.collect()}
    assert set(centroids) == {c for c, _ in want.centroids}
    for cid, vector in want.centroids:
        assert centroids[cid] == pytest.approx(vector)
    assert sorted(map(tuple, got.assign(df).select("id", "cid").collect())) == sorted(
        map(tuple, want.assign(df).select("id", "cid").collect()))


def test_missing_features_and_columns(spark, monkeypatch):
    monkeypatch.setattr(km, "MAX_CENTROID_VALUES", 4)
    rows = [(i, float(i % 3) * 10, None if i == 4 else 1.0, "held") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a double, `b.c` double, cell string").withColumnRenamed("b.c", "b")
    model = km.kmeans_fit(df, "id", ["a", "b"], 3, init="roundrobin", max_iter=2)
    got = {r["id"]: r for r in model.assign(df).collect()}
    assert model.n_excluded == 1 and got[4]["cid"] is None and got[4]["cell"] == "held"
    assert all(r["cid"] == i % 3 for i, r in got.items() if i != 4)
    with pytest.raises(ValueError, match="k-means"):
        km.kmeans_fit(df, "id", ["a", "b"], 3, init="plus")


class Lost(Exception):
    pass


@pytest.mark.parametrize("changed_at_most", [None, 0])
def test_a_stopped_loop_goes_on(spark, monkeypatch, tmp_path, changed_at_most):
    df = frame(spark, points(300, 2, 5, 2.0))
    options = dict(init="hash", max_iter=6, changed_at_most=changed_at_most)
    whole = km.kmeans_fit(df, "id", "x", 9, folder=f"{tmp_path}/whole", **options)
    plain, calls = large.assign_large, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 4:
            raise Lost
        return plain(*args)

    monkeypatch.setattr(large, "assign_large", failing)
    with pytest.raises(Lost):
        km.kmeans_fit(df, "id", "x", 9, folder=f"{tmp_path}/parts", **options)
    assert Generations(spark, f"{tmp_path}/parts").numbers() == [3, 4]
    before = len(calls)
    again = km.kmeans_fit(df, "id", "x", 9, folder=f"{tmp_path}/parts", **options)
    assert len(calls) - before <= 3  # the rounds that were done are not done again
    assert (again.passes, again.changes) == (whole.passes, whole.changes)
    assert sorted(map(str, again.centroids.collect())) == sorted(map(str, whole.centroids.collect()))
    with pytest.raises(ValueError, match="other arguments"):
        km.kmeans_fit(df, "id", "x", 9, folder=f"{tmp_path}/parts", **(options | {"max_iter": 7}))


def test_a_generation_without_facts_does_not_count(spark, tmp_path):
    made = Generations(spark, f"{tmp_path}/g")
    assert made.numbers() == []
    made.write(1, "t", spark.range(3))
    made.commit(1, {"a": 1})
    made.write(2, "t", spark.range(5))
    assert made.numbers() == [1] and made.facts(1) == {"a": 1} and made.read(1, "t").count() == 3
