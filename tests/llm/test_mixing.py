import numpy as np
import pytest

from clusterloom.llm.mixing import capped_targets, mix_sources, mixed_documents, sainte_lague

SCHEMA = "doc_id long, text string, source string, n_chars long, size string, shard string"


def by_quotients(shares, seats):
    given = [0] * len(shares)
    for _ in range(seats):
        given[max(range(len(shares)), key=lambda i: (shares[i] / (2 * given[i] + 1), -i))] += 1
    return given


def test_seats_follow_the_highest_quotients():
    draw = np.random.default_rng(1)
    for _ in range(300):
        shares = draw.integers(0, 50, draw.integers(1, 9)).astype(float)
        seats = int(draw.integers(0, 60))
        want = by_quotients(list(shares), seats) if shares.sum() else [0] * len(shares)
        assert list(sainte_lague(shares, seats)) == want


def test_targets():
    assert capped_targets([100, 100], [1, 3], 3) == [50, 150]
    assert capped_targets([10, 990], [1, 1], 3) == [30, 970]
    # one that stops lifts another above its own limit
    assert capped_targets([100, 1, 10], [1, 5, 1], 3) == pytest.approx([78, 3, 30])
    assert capped_targets([0, 5], [1, 1], 3) == [0, 5]
    assert capped_targets([], [], 3) == []


def rows(n=4000):
    draw = np.random.default_rng(2)
    out = [(i, " ".join(["wörd"] * int(draw.integers(0, 60))), ["s1", "s2", None, "\U0001F600", "\uffee"][int(draw.choice(5, p=[0.6, 0.1, 0.1, 0.1, 0.1]))], 1, "x", "y") for i in range(n)]
    out += [(n, None, "s1", 1, "", ""), (n + 1, "", None, 1, "", ""), (None, "a b", "s2", 1, "", ""),
            (n + 2, "w " * 20_000, "s2", 1, "", ""), (n + 3, " \t\n", "blank", 1, "", ""), (5, "twice", "s1", 0, "", ""), (5, "twice", "s1", 0, "", "")]
    return out


def test_mix_keeps_to_targets_and_limits(spark):
    data = rows()
    found = mix_sources(spark.createDataFrame(data, SCHEMA), rows_per_shard=500).collect()
    again = mix_sources(spark.createDataFrame(data, SCHEMA).repartition(3), rows_per_shard=500).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert len(found) == len(data)
    sizes, taken, target, total = {}, {}, {}, 0
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r.passes * r["size"] + sum(s.hi - s.lo for s in r.ranges)
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.source_size >= r["size"]
        total += r["size"]
    assert all(r.source_size == sizes[r.source] for r in found)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert [target[s] for s in order] == capped_targets([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))], 3)
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    assert sum(target.values()) == pytest.approx(total)


def test_mixed_documents_hold_the_words_taken(spark):
    table = spark.createDataFrame(rows(600), SCHEMA)
    decided = mix_sources(table).collect()
    mixed = mixed_documents(table)
    assert mixed.columns == table.columns and mixed.dtypes == table.dtypes
    got = mixed.collect()
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in decided)
    assert all(r.n_chars == len(r.text) for r in got)


def test_empty_tables(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert mix_sources(table).collect() == [] and mixed_documents(table).collect() == []
    blank = spark.createDataFrame([(1, None, None, 0, "", ""), (2, "", "s", 0, "", "")], SCHEMA)
    assert [(r.taken, r.target) for r in mix_sources(blank).collect()] == [(0, 0.0), (0, 0.0)]


@pytest.mark.parametrize("sizes", [(3, 7, 10), (3, 3), (1, 1, 1, 1), (40, 2, 33), (31, 64, 5)])
def test_small_sources_come_near_their_targets(spark, sizes):
    data = [(10 * i + j, "w " * (n // 2 + j * (n % 2)), f"s{i}", 1, "", "") for i, n in enumerate(sizes) for j in (0, 1)]
    found = mix_sources(spark.createDataFrame(data, SCHEMA)).collect()
    taken, target = {}, {}
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    assert sum(taken.values()) == sum(sizes)
    assert mixed_documents(spark.createDataFrame(data, SCHEMA)).count() > 0
