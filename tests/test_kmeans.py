import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.functions import vectors
from clusterloom.operators import kmeans as km


def line(spark, values, partitions=1):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, x double").repartition(partitions)


def cloud(spark, n=600, d=3, seed=0):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, d)) + rng.integers(0, 4, size=(n, 1)) * 5
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    columns = [f"x{j}" for j in range(d)]
    return spark.createDataFrame(rows, ", ".join(["id bigint", *[f"{c} double" for c in columns]])), columns


def lloyd(points, labels, k, passes, empty):
    """Plain numpy reference of the loop."""
    for n in range(passes):
        centres = {}
        for c in range(k):
            members = points[labels == c]
            if len(members):
                centres[c] = members.mean(axis=0)
            elif empty == "zero":
                centres[c] = np.zeros(points.shape[1])
        ids = sorted(centres)
        dist = np.stack([((points - centres[c]) ** 2).sum(axis=1) for c in ids])
        labels = np.asarray(ids)[dist.argmin(axis=0)]
    return labels


def test_roundrobin_golden(spark):
    df = line(spark, [0, 1, 10, 11])
    first = km.kmeans_fit(df, "id", ["x"], 2, init="roundrobin", max_iter=1)
    assert first.centroids == [(0, [5.0]), (1, [6.0])]
    assert [r["cid"] for r in first.assign(df).orderBy("id").collect()] == [0, 0, 1, 1]
    settled = km.kmeans_fit(df, "id", ["x"], 2, init="roundrobin", max_iter=9, changed_at_most=0)
    assert settled.centroids == [(0, [0.5]), (1, [10.5])]
    assert settled.changes == [0]
    assert settled.passes == 2


@pytest.mark.parametrize("empty, expected", [
    ("drop", [(0, [5.0])]), ("zero", [(0, [5.0]), (1, [0.0]), (2, [0.0])]),
])
def test_empty_clusters(spark, empty, expected):
    df = line(spark, [5, 5, 5])
    model = km.kmeans_fit(df, "id", ["x"], 3, init="roundrobin", max_iter=2, empty=empty)
    assert model.centroids == expected


def test_ties_go_to_the_lowest_cluster(spark):
    df = line(spark, [5])
    got = km.kmeans_assign(df, ["x"], [(0, [0.0]), (3, [10.0]), (7, [10.0])]).first()
    assert got["cid"] == 0
    got = km.kmeans_assign(line(spark, [9]), ["x"], [(0, [0.0]), (3, [10.0]), (7, [10.0])]).first()
    assert got["cid"] == 3


@pytest.mark.parametrize("empty", ["drop", "zero"])
def test_equals_plain_lloyd(spark, empty):
    df, columns = cloud(spark)
    points = np.array([[r[c] for c in columns] for r in df.orderBy("id").collect()])
    model = km.kmeans_fit(df, "id", columns, 4, init="roundrobin", max_iter=6, empty=empty)
    got = [r["cid"] for r in model.assign(df).orderBy("id").collect()]
    assert got == lloyd(points, np.arange(len(points)) % 4, 4, 6, empty).tolist()


def test_numpy_and_codegen_forms_agree(spark, monkeypatch):
    df, columns = cloud(spark, d=4)
    as_array = df.select("id", F.array(*columns).alias("v"))
    options = dict(init="roundrobin", max_iter=5, changed_at_most=3)
    narrow = km.kmeans_fit(df, "id", columns, 5, **options)
    monkeypatch.setattr(vectors, "UNROLL_LIMIT", 0)
    wide = km.kmeans_fit(df, "id", columns, 5, **options)
    arrays = km.kmeans_fit(as_array, "id", "v", 5, **options)
    assert narrow.changes == wide.changes == arrays.changes
    for a, b, c in zip(narrow.centroids, wide.centroids, arrays.centroids):
        assert a[0] == b[0] == c[0]
        assert np.allclose(a[1], b[1], rtol=1e-12) and np.allclose(a[1], c[1], rtol=1e-12)
    wide_cids = wide.assign(df).select("id", "cid")
    monkeypatch.undo()
    narrow_cids = wide.assign(df).select("id", "cid")
    assert wide_cids.exceptAll(narrow_cids).count() == 0


def test_partition_independence(spark):
    df, columns = cloud(spark)
    one, many = (
        km.kmeans(df.repartition(n), "id", columns, 4, init="random").select("id", "cid")
        for n in (1, 17)
    )
    assert one.exceptAll(many).count() == 0


def test_within_cluster_sum_never_rises(spark):
    df, columns = cloud(spark)
    sums = []
    for passes in (1, 2, 3, 5):
        model = km.kmeans_fit(df, "id", columns, 4, init="roundrobin", max_iter=passes)
        table, spec = vectors.feature_table(df, columns)
        near = vectors.with_nearest_dist2(table, spec, [v for _, v in model.centroids], "d2")
        sums.append(near.agg(F.sum("d2")).first()[0])
    assert all(later <= earlier + 1e-9 for earlier, later in zip(sums, sums[1:]))


def test_rows_with_missing_features_are_counted_and_have_no_cluster(spark):
    df = line(spark, [0, None, 10, 11, float("nan")])
    model = km.kmeans_fit(df, "id", ["x"], 2, init="roundrobin", max_iter=2)
    assert model.n_excluded == 2
    got = {r["id"]: r["cid"] for r in model.assign(df).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and {i for i, c in got.items() if c is None} == {1, 4}
    for clusters in (km.kmeans_fixed_rounds(df, "id", ["x"], 2), km.kmeans_roundrobin(df, "id", ["x"], 2),
                     km.kmeans_join_back(df, "id", ["x"], 2).withColumnRenamed("cluster", "cid")):
        assert {r["id"] for r in clusters.collect() if r["cid"] is None} == {1, 4}
        assert clusters.count() == 5
    assert km.kmeans_plus_plus(df, "id", ["x"], 2, storage=None).count() == 2


def test_roundrobin_needs_an_integral_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, x double")
    with pytest.raises(ValueError, match="integral"):
        km.kmeans_roundrobin(df, "id", ["x"], 2)


def test_missing_array_elements(spark):
    df = spark.createDataFrame(
        [(0, [0.0, 1.0]), (1, [None, 1.0]), (2, None), (3, [5.0, 5.0])], "id bigint, v array<double>"
    )
    model = km.kmeans_fit(df, "id", "v", 2, init="roundrobin", max_iter=1)
    assert model.n_excluded == 2
    wide = km.KMeansModel([(i, [float(i), 1.0]) for i in range(40)], "v", 1)
    for m in (model, wide):
        assert {r["id"] for r in m.assign(df).collect() if r["cid"] is None} == {1, 2}


def test_uneven_arrays_are_an_error(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0])], "id bigint, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="must all have"):
        km.kmeans_fit(df, "id", "v", 2)


@pytest.mark.parametrize("bad", [
    dict(k=1), dict(k=2, features=[]), dict(k=2, max_iter=0), dict(k=2, init="other"),
    dict(k=2, empty="other"), dict(k=10**8, init="plus"),
])
def test_bad_arguments(spark, bad):
    bad = {"features": ["x"], **bad}
    with pytest.raises(ValueError):
        km.kmeans_fit(line(spark, [1, 2]), "id", **bad)


def test_no_usable_row(spark):
    with pytest.raises(ValueError, match="no row"):
        km.kmeans_fit(line(spark, [None, None]), "id", ["x"], 2)


def test_validate_counts(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (1, 2.0), (2, None), (None, 3.0)], "id bigint, x double"
    )
    row = km.kmeans_validate(df, "id", ["x"], 2).first()
    assert tuple(row) == (4, 1, 1, 1, False)
    good = km.kmeans_validate(line(spark, [1, 2]), "id", ["x"], 2).first()
    assert tuple(good) == (2, 0, 0, 0, True)


def test_changes_between_tables(spark):
    old = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id bigint, cid int")
    new = spark.createDataFrame([(1, 0), (2, 0), (3, 2)], "id bigint, cid int")
    assert km.kmeans_changes_between(old, new, "id").first()["n_changed"] == 2


def test_plus_plus_picks_distinct_points_and_stops(spark):
    df = line(spark, [1, 1, 1, 9, 9])
    seeds = km.kmeans_plus_plus(df, "id", ["x"], 4).collect()
    assert sorted(r["x"] for r in seeds) == [1.0, 9.0]


def test_weighted_draw_follows_the_weights(spark):
    # from 0, the squared distances are 1, 4 and 9: draws come in these shares
    df = line(spark, [0, 1, 2, 3])
    table, spec = vectors.feature_table(df, ["x"], keep=["id"])
    table = table.persist()
    draws = [km._pick_several(table, spec, "id", [[0.0]], seed, 1)[0][0] for seed in range(60)]
    table.unpersist()
    shares = [draws.count(v) / len(draws) for v in (1.0, 2.0, 3.0)]
    assert np.allclose(shares, [1 / 14, 4 / 14, 9 / 14], atol=0.2)


def test_highest_key(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "id bigint, x double, y double")
    got = km.kmeans_join_back(df, "id", ["x", "y"], 2, n_rounds=2, max_key=4)
    assert got.columns == ["id", "cluster", "x", "y"]
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3, 4]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_assignment_has_no_shuffle_and_a_round_has_one(spark):
    df, columns = cloud(spark)
    centres = [(c, [float(c)] * 3) for c in range(4)]
    assert "Exchange" not in plan_of(km.kmeans_assign(df, columns, centres))
    table, spec = vectors.feature_table(df, columns, keep=["id"])
    plan = plan_of(km.kmeans_round(table.filter(vectors.USABLE), spec, centres, centres))
    assert plan.count("Exchange") == 1
    assert "Python" not in plan and "Join" not in plan


def test_only_needed_columns_are_read(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = plan_of(km.kmeans_assign(events, ["value"], [(0, [1.0]), (1, [9.0])]).select("event_id", "cid"))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_skewed_table(spark):
    """A third of the rows in one spot, and keys far beyond 32 bits."""
    df = spark.range(3000).select(
        (F.col("id") * 7_000_000_000).alias("id"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 97).cast("double").alias("x"),
    )
    got = km.kmeans(df, "id", ["x"], 3, init="plus", max_iter=4)
    assert got.count() == 3000
    assert got.filter("x = 5.0").select("cid").distinct().count() == 1


def test_slices_are_fixed_rounds_within_each(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(120, 2))
    rows = [(i, *map(float, r), i % 5) for i, r in enumerate(data)] + [(500, None, 1.0, 0), (501, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, g int")
    slices = {"even": F.col("id") % 2 == 0, "low": F.col("id") < 50, "none": F.lit(False), "some": F.col("g") > 2}
    got = km.kmeans_sliced(df, "id", ["x", "y"], 3, slices, n_rounds=4, keep=["g"])
    assert got.columns == ["slice", "id", "g", "cid"]
    found = {(r["slice"], r["id"]): r["cid"] for r in got.collect()}
    want = {}
    for name in ("even", "low", "some"):
        part = df.filter(slices[name])
        want |= {(name, r["id"]): r["cid"] for r in km.kmeans_fixed_rounds(part, "id", ["x", "y"], 3, 4).collect()}
    assert found == want and found["even", 500] is None


@pytest.mark.parametrize("draws, parts", [(4, 4), (7, 2), (3, 1)])
def test_several_draws_of_a_pass_are_those_of_single_ones(spark, monkeypatch, draws, parts):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(600, 2)) + rng.integers(0, 12, size=(600, 1)) * 6.0
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double").cache()
    passes = []
    plain = km._races
    monkeypatch.setattr(km, "_races", lambda *args: passes.append(1) or plain(*args))

    def seeds(n_draws):
        monkeypatch.setattr(km, "DRAWS_PER_PASS", n_draws)
        passes.clear()
        rows = km.kmeans_plus_plus(df, "id", ["x", "y"], 24, seed=5, storage=None).collect()
        return sorted(map(tuple, rows)), len(passes)

    single, n_single = seeds(1)
    monkeypatch.setattr(km, "RACE_PARTS", parts)
    several, n_several = seeds(draws)
    assert several == single and len(single) == 24
    assert n_single == 23 and n_several <= 16
    if (draws, parts) == (7, 2):
        assert n_several <= 12


def test_slices_beyond_generated_code(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 5), *map(float, rng.integers(0, 40, 2))) for i in range(300)] + [(300, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, g int, x double, y double")
    slices = {"low": F.col("g") < 3, "odd": F.col("g") % 2 == 1, "none": F.col("g") > 9}

    def clusters():
        return sorted(map(str, km.kmeans_sliced(df, "id", ["x", "y"], 6, slices, n_rounds=4).collect()))

    want = clusters()
    monkeypatch.setattr(vectors, "UNROLL_LIMIT", 0)
    assert clusters() == want and len(want) == 181 + 120
