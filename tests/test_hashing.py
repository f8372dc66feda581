from pyspark.sql import functions as F

from clusterloom.functions.hashing import mix32, with_mix32, with_uniform

GOLDEN = [2389907270, 1134484726, 4266872727, 3283889963, 2964702588, 566031088]


def test_mix32_golden():
    assert [mix32(x) for x in range(1, 7)] == GOLDEN


def test_column_form_equals_scalar_form(spark):
    keys = [0, 1, 2, 5, 2**31 - 1, 2**32 - 2, 2**40 + 3]
    df = spark.createDataFrame([(k,) for k in keys], "id bigint")
    got = {r["id"]: r["h"] for r in with_mix32(df, "id", "h", offset=1).collect()}
    assert got == {k: mix32((k + 1) & 0xFFFFFFFF) for k in keys}


def test_uniform_is_uniform_distinct_and_partition_independent(spark):
    df = spark.range(0, 20000, 1, 3)
    drawn = with_uniform(df, "id", "u", seed=7, draw=2)
    facts = drawn.agg(
        F.min("u"), F.max("u"), F.avg("u"), F.count_distinct("u"), F.var_samp("u")
    ).first()
    assert 0 < facts[0] and facts[1] <= 1
    assert abs(facts[2] - 0.5) < 0.01
    assert facts[3] == 20000
    assert abs(facts[4] - 1 / 12) < 0.002
    again = with_uniform(df.repartition(17), "id", "u", seed=7, draw=2)
    assert drawn.exceptAll(again).count() == 0


def test_uniform_uses_the_whole_key_and_the_draw(spark):
    df = spark.createDataFrame([(1,), (1 + 2**32,), (1 + 2**33,)], "id bigint")
    values = {r["u"] for d in range(3) for r in with_uniform(df, "id", "u", 1, d).collect()}
    assert len(values) == 9


def test_uniform_of_text_keys(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert with_uniform(df, "id", "u", 1).select("u").distinct().count() == 2
