"""Table functions called from SQL."""

import pytest
from pyspark.sql import functions as F

from clusterloom.functions.tables import register_table_functions
from tests.test_similarity import brute_force, random_words


@pytest.fixture(scope="module")
def sql(spark):
    register_table_functions(spark)
    items, queries = random_words(60, 2, 1), random_words(9, 2, 2)
    spark.createDataFrame(list(enumerate(items)), "id long, words array<int>").repartition(5).createOrReplaceTempView("knn_items")
    spark.createDataFrame([(w,) for w in queries], "words array<int>").createOrReplaceTempView("knn_queries")
    spark.sql("DECLARE OR REPLACE VARIABLE some_queries ARRAY<ARRAY<INT>>")
    spark.sql("SET VAR some_queries = (SELECT collect_list(words) FROM knn_queries)")
    spark.createDataFrame(
        [(1, "a", [0.0, 0.0]), (2, "b", [9.0, 9.5]), (3, "c", [None, 1.0]), (4, "d", None), (5, "e", [5.0, 5.0])],
        "id long, name string, v array<double>",
    ).createOrReplaceTempView("vectors")
    return spark.sql, items, queries


@pytest.mark.parametrize("argument, k", [("", 5), (", k => 3", 3), (", k => 9", 9)])
def test_knn_with_default_and_named_arguments(sql, argument, k):
    run, items, queries = sql
    result = run(f"SELECT * FROM knn_similarity(items => TABLE(knn_items), queries => some_queries{argument})")
    assert result.dtypes == [("id", "bigint"), ("score", "float")]
    got = {r["id"]: r["score"] for r in result.collect()}
    assert [got[i] for i in range(len(items))] == pytest.approx(brute_force(items, queries, k), abs=1e-6)


def test_knn_moves_no_rows(sql):
    run, *_ = sql
    result = run("SELECT * FROM knn_similarity(items => TABLE(knn_items), queries => some_queries)")
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning" not in plan
    parted = run("SELECT * FROM knn_similarity(items => TABLE(knn_items) PARTITION BY id, queries => some_queries)")
    assert parted.count() == 61


def test_null_arguments_and_errors(sql):
    run, *_ = sql
    none = run("SELECT * FROM knn_similarity(items => TABLE(knn_items), queries => CAST(NULL AS ARRAY<ARRAY<INT>>))")
    assert none.collect() == []
    for queries, k, said in [
        ("array(array(1, 2), array(1))", 1, "one length"), ("array(array(1, NULL))", 1, "without nulls"),
        ("array(array(1, 2))", 2, "between 1 and"), ("array(array(1, 2))", 0, "at least 1"), ("array(1, 2)", 1, "word arrays"),
    ]:
        with pytest.raises(Exception, match=said):
            run(f"SELECT * FROM knn_similarity(items => TABLE(knn_items), queries => {queries}, k => {k})").collect()


def test_nearest_centroid(sql):
    run, *_ = sql
    result = run("SELECT * FROM nearest_centroid(items => TABLE(vectors), centroids => array(array(0D, 1D), array(10D, 9D)), first_id => 1)")
    assert result.columns == ["id", "name", "cid", "dist2"]
    assert sorted(map(tuple, result.collect())) == [
        (1, "a", 1, 1.0), (2, "b", 2, 1.25), (3, "c", None, None), (4, "d", None, None), (5, "e", 1, 41.0)]
    with pytest.raises(Exception, match="must have 1 elements"):
        run("SELECT * FROM nearest_centroid(items => TABLE(vectors), centroids => array(array(0D)))").collect()


def test_matrices_come_apart(sql):
    run, *_ = sql
    assert [tuple(r) for r in run("SELECT * FROM matrix_unnest(array(array(7, 1), array(8, 2)))").collect()] == [(7, 1), (8, 2)]
    rows = run("SELECT * FROM matrix_rows((SELECT collect_list(v) FROM vectors WHERE id < 3))").collect()
    assert sorted((r["row"], r["vector"]) for r in rows)[0][0] == 0 and len(rows) == 2


def test_many_rows_in_portions(spark, sql):
    run, *_ = sql
    spark.range(0, 20000, 1, 3).select("id", F.array(F.col("id").cast("double")).alias("v")).createOrReplaceTempView("many")
    result = run("SELECT * FROM nearest_centroid(items => TABLE(many), centroids => array(array(100D), array(15000D)))")
    assert result.filter("cid = 1").count() == 20000 - 7551
