import math

import numpy as np
import pytest

from clusterloom.llm.embeddings import close_pairs, decode, encode, near_duplicate_vectors, rotation

SCHEMA = "vec_id long, embedding array<double>, label string, component_id string, rep long"


def brute(rows, threshold=0.93):
    def fit(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    linked = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i][:3], rows[j][:3]
            if la is not None and la == lb and fit(a) and fit(b) and len(a) == len(b):
                a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    linked[i].append(j)
                    linked[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in linked[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(linked[i]), least, rows[i][0] == least))
    return sorted(map(str, out))


def data(seed, n, dim, labels):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 5, dim))
    rows = []
    for i in range(n):
        v = centres[draw.integers(len(centres))] + draw.normal(size=dim) * draw.choice([0.0, 0.1, 0.28, 0.4])
        rows.append((int(i * 7 % n), (v * draw.choice([1e-3, 1.0, 50.0])).tolist(), str(draw.choice(labels)), "c", 1))
    return rows


def found(spark, rows, **options):
    result = near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), **options)
    assert result.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(str(tuple(r)) for r in result.collect())


@pytest.mark.parametrize("block_size", [2048, 16])
def test_matches_all_pairs(spark, block_size):
    rows = data(1, 300, 24, ["a", "b"])
    assert found(spark, rows, block_size=block_size) == brute(rows)


def test_edge_rows(spark):
    v, inf, nan = [0.5, 0.2, -0.1], math.inf, math.nan
    rows = [
        (9, v, "a", "", 0), (3, v, "a", "", 0), (3, v, "a", "", 0), (4, [5.0, 2.0, -1.0], "a", "", 0),
        (5, None, "a", "", 0), (6, [], "a", "", 0), (7, [0.0, -0.0, 0.0], "a", "", 0), (8, [1.0, None, 2.0], "a", "", 0),
        (10, [nan, 1.0, 1.0], "a", "", 0), (11, [inf, 1.0, 1.0], "a", "", 0), (12, v, None, "", 0), (13, v, None, "", 0),
        (14, v, "b", "", 0), (15, [0.5, 0.2], "a", "", 0), (16, [0.5, 0.2, -0.1, 0.0], "a", "", 0), (None, v, "a", "", 0),
        (None, [-1.0, 0.0, 0.0], "a", "", 0), (17, [1e300, 1e300, 0.0], "c", "", 0), (18, [1e-300, 1e-300, 0.0], "c", "", 0),
        (19, [0.0, 1.0], "d", "", 0), (20, [-0.0, 1.0], "d", "", 0),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert len(found(spark, rows[4:6])) == 2


def test_many_copies_are_one_class(spark):
    rows = [(i, [1.0, 2.0], "a", "", 0) for i in range(3000)]
    assert found(spark, rows) == sorted(str((i, 2999, 0, i == 0)) for i in range(3000))


def test_estimates_and_bounds():
    draw = np.random.default_rng(3)
    dim, turn = 64, rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(dim))
    a = draw.normal(size=(400, dim))
    b = a + draw.normal(size=a.shape) * draw.uniform(0, 0.6, (400, 1))
    unit_a, unit_b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    turned, _, _ = encode(unit_b, turn)
    _, codes, factor = encode(unit_a, turn)
    estimate = (decode(codes, dim) * turned).sum(axis=1) / factor
    true = (unit_a * unit_b).sum(axis=1)
    off = np.sqrt(1 / factor**2 - 1) * np.sqrt(1 - true**2)
    assert (np.abs(estimate - true) <= off + 1e-6).all()
    assert abs((estimate - true).mean()) < 0.01
    left, right, recomputed = close_pairs(a, b, 0.93, turn)
    want = {(i, j) for i, j in zip(*np.nonzero(unit_a @ unit_b.T >= 0.93))}
    assert set(zip(left.tolist(), right.tolist())) == want
    assert len(want) <= recomputed < 0.02 * 400 * 400
