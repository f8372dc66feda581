import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.functions.fdist import f_quantile
from clusterloom.operators.ftest import f_test_pairs, f_test_two_groups, f_test_vs_control


def test_quantile_golden():
    assert np.allclose(f_quantile([0.025, 0.975], 10, 20), [0.29252, 2.77367], atol=5e-6)


@pytest.mark.parametrize("d1", [1, 2, 7, 300, 20000, 10**6])
@pytest.mark.parametrize("d2", [1, 3, 40, 50000])
def test_quantile_against_the_jvm(spark, d1, d2):
    jvm = spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(d1), float(d2))
    for p in (0.025, 0.5, 0.975):
        x = f_quantile(p, d1, d2)[0]
        assert jvm.cumulativeProbability(float(x)) == pytest.approx(p, rel=1e-6)


def test_quantile_properties():
    d1, d2 = np.array([3.0, 50.0, 1e9, 1e12]), np.array([9.0, 2.0, 1e11, 1e12])
    low, high = f_quantile(0.01, d1, d2), f_quantile(0.99, d2, d1)
    assert np.allclose(low, 1 / high, rtol=1e-9)
    # for very many degrees of freedom ln F is normal
    assert np.log(f_quantile(0.975, 1e12, 1e12)[0]) == pytest.approx(1.959963985 * 2e-6, rel=1e-6)
    assert np.isnan(f_quantile([0.0, 1.0, 0.5], [1, 1, 0], 1)).all()


def groups(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v), 0.5) for g, s, n in (("a", 1, 50), ("b", 1.05, 60), ("c", 9, 40))
            for v in rng.normal(scale=s, size=n)]
    return spark.createDataFrame(rows, "g string, x double, y double")


def test_two_groups(spark):
    df = groups(spark)
    row = f_test_two_groups(df, "g", ["x", "y"], "a", "b").first()
    back = f_test_two_groups(df, "g", ["x", "y"], "b", "a").first()
    assert (row["n1"], row["n2"]) == (50, 60)
    assert row["f"] == pytest.approx(1 / back["f"])
    assert row["accept"] and back["accept"]
    assert not f_test_two_groups(df, "g", "x", "c", "a").first()["accept"]


def test_missing_group_and_zero_variance(spark):
    row = f_test_two_groups(groups(spark), "g", "x", "a", "zz").first()
    assert row["n2"] is None and row["f"] is None and row["accept"] is None
    constant = groups(spark).withColumn("x", F.lit(1.0))
    assert f_test_two_groups(constant, "g", "x", "a", "b").first()["f"] is None


def test_against_a_control_and_given_pairs(spark):
    df = groups(spark)
    rows = f_test_vs_control(df, "g", "x", "c").orderBy("group1").collect()
    assert [(r["group1"], r["group2"]) for r in rows] == [("a", "c"), ("b", "c")]
    pairs = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "none")], "group1 string, group2 string")
    given = f_test_pairs(df, "g", "x", pairs).orderBy("group1").collect()
    assert [(r["group1"], r["group2"]) for r in given] == [("a", "c"), ("c", "a")]
    single = f_test_two_groups(df, "g", "x", "a", "c").first().asDict()
    for name, value in single.items():
        assert rows[0][name] == given[0][name] == value
    assert given[1]["f"] == pytest.approx(1 / given[0]["f"])


def test_control_has_no_cross_join(spark):
    plan = f_test_vs_control(groups(spark), "g", "x", "a")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_group_filter_reaches_the_source(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    test = f_test_two_groups(lineitem, "l_returnflag", ["l_quantity", "l_tax"], "A", "N")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(l_returnflag, [A,N])]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in plan
