import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import similarity as sim


def table(spark, words, id_name="id", type_="int"):
    rows = [(i, w) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, f"{id_name} bigint, words array<{type_}>")


def tanimoto(a, b):
    shared = sum(((x & y) & 0xFFFFFFFF).bit_count() for x, y in zip(a, b))
    joined = sum(((x | y) & 0xFFFFFFFF).bit_count() for x, y in zip(a, b))
    return shared / joined if joined else 0.0


def brute_force(items, queries, k):
    return [
        float(np.float32(sum(sorted((tanimoto(q, d) for q in queries), reverse=True)[:k]) / k))
        for d in items
    ]


def random_words(n, width, seed):
    rng = random.Random(seed)
    words = [[rng.getrandbits(32) - 2**31 for _ in range(width)] for _ in range(n)]
    # a third of all rows share one fingerprint; one has no bit at all
    return [words[0] if i % 3 == 0 else w for i, w in enumerate(words)] + [[0] * width]


@pytest.mark.parametrize("query, item, expected", [
    ([0b1100], [0b1000], 0.5), ([0], [0], 0.0), ([0b1100], [-1], 0.0625),
])
def test_tanimoto_golden(spark, query, item, expected):
    pair = spark.createDataFrame([(1, query, item)], "id int, q array<bigint>, d array<bigint>")
    rows = sim.tanimoto_rows(pair, "q", "d", 1)
    assert rows.columns == ["id", "q", "d", "similarity"]
    assert rows.first()["similarity"] == expected


@pytest.mark.parametrize("item, k, expected", [
    ([0b1000], 1, 0.5), ([0], 2, 0.0), ([-1], 2, 0.0625),
])
def test_knn_golden(spark, item, k, expected):
    queries = table(spark, [[0b1100], [0b1010]])
    row = sim.knn_similarity(table(spark, [item]), queries, k, "id").first()
    assert tuple(row) == (0, expected)


@pytest.mark.parametrize("k", [0, 3])
def test_k_out_of_range(spark, k):
    queries = table(spark, [[0b1100], [0b1010]])
    with pytest.raises(ValueError):
        sim.knn_similarity(queries, queries, k, "id")


def test_invalid_fingerprints(spark):
    good = table(spark, [[1, 2]])
    with pytest.raises(ValueError):
        sim.knn_similarity(good, table(spark, [[1, 2], [1]]), 1, "id")
    with pytest.raises(ValueError):
        sim.knn_similarity(good, good.limit(0), 1, "id")
    for bad in ([[1]], [[1, None]], [None]):
        with pytest.raises(Exception, match="fingerprints must have"):
            sim.knn_similarity(table(spark, bad), good, 1, "id").collect()


@pytest.mark.parametrize("n_queries, k", [(7, 3), (60, 1), (60, 9)])
def test_all_forms_agree_with_brute_force(spark, monkeypatch, n_queries, k):
    items, queries = random_words(90, 2, 1), random_words(n_queries, 2, 2)
    expected = brute_force(items, queries, k)
    left, right = table(spark, items), table(spark, queries)

    def scores(**options):
        rows = sim.knn_similarity(left, right, k, "id", **options).orderBy("id").collect()
        assert [r["id"] for r in rows] == list(range(len(items)))
        return [r["score"] for r in rows]

    monkeypatch.setattr(sim, "UNROLL_LIMIT", 10**6)
    assert scores() == pytest.approx(expected, abs=1e-6)
    monkeypatch.setattr(sim, "UNROLL_LIMIT", 0)
    assert scores() == pytest.approx(expected, abs=1e-6)
    for shipped in (30 * 16, 1000 * 16):
        assert scores(max_shipped_bytes=shipped) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("per_chunk, per_block, n_queries", [(4, 3, 60), (7, 1000, 30), (1000, 5, 9)])
def test_blocks_in_order_of_bits(spark, per_chunk, per_block, n_queries):
    rng = random.Random(9)

    def skewed(n):  # few to all of 64 bits, so that bounds decide
        return [[sum((rng.random() < p) << i for i in range(32)) - 2**31 for _ in range(2)] for p in
                (rng.random() for _ in range(n))] + [[0, 0], [-1, -1]]

    items, queries = skewed(80), skewed(n_queries)
    left = table(spark, items).withColumnRenamed("words", "__words")
    right = table(spark, queries).select("words").withColumnRenamed("words", "__words")
    rows = sim._knn_by_bits(left, right, 3, "id", 2, per_chunk, per_block).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(len(items)))
    assert [r["score"] for r in rows] == pytest.approx(brute_force(items, queries, 3), abs=1e-6)


def test_chunks_out_of_reach_are_not_read(spark):
    # items of few bits against queries of few and of many bits
    few = [[1 << (i % 30) | 1 << (i % 7), 0] for i in range(40)]
    many = [[-1, -(i + 1)] for i in range(200)]
    left = table(spark, few).withColumnRenamed("words", "__words")
    right = table(spark, few + many).select("words").withColumnRenamed("words", "__words")
    result = sim._knn_by_bits(left, right, 2, "id", 2, per_chunk=20, per_block=20)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    chunks = sim._chunks(right, 2, 20)
    assert chunks.count() >= 12
    met = chunks.filter(chunks["hi"] <= 8).count()  # 2 bits at most and a similarity of 1 / 4 at least
    assert met <= 4


def test_rows_of_given_pairs(spark):
    left, right = random_words(40, 3, 3), random_words(40, 3, 4)
    pairs = spark.createDataFrame(list(zip(range(41), left, right)), "id int, a array<bigint>, b array<bigint>")
    rows = sim.tanimoto_rows(pairs, "a", "b", 3)
    got = [r["similarity"] for r in rows.orderBy("id").collect()]
    assert got == [tanimoto(a, b) for a, b in zip(left, right)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    with pytest.raises(Exception, match="must have 2 words"):
        sim.tanimoto_rows(pairs, "a", "b", 2).collect()


def test_knn_is_a_map(spark):
    items = table(spark, random_words(20, 2, 5))
    plan = sim.knn_similarity(items, items.limit(5), 2, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
