"""Tree positions against a plain walk."""

import random

import pytest

from clusterloom.operators import tree


def walk(edges, root):
    """pid -> (topmost ancestor, depth, size, position) by recursion with a stack of our own."""
    children = {}
    for pid, ppid, rank in edges:
        children.setdefault(ppid, []).append((rank, pid))
    out, position, stack = {}, 0, [(pid, pid, 0) for _, pid in sorted(children.get(root, []), reverse=True)]
    while stack:
        pid, top, depth = stack.pop()
        position += 1
        out[pid] = [top, depth, 1, position]
        stack += [(child, top, depth + 1) for _, child in sorted(children.get(pid, []), reverse=True)]
    parent = {pid: ppid for pid, ppid, _ in edges}
    for pid in sorted(out, key=lambda p: -out[p][3]):
        if parent[pid] in out:
            out[parent[pid]][2] += out[pid][2]
    return {pid: tuple(v) for pid, v in out.items()}


def tree_of(spark, edges, root=1):
    df = spark.createDataFrame(edges, "pid long, ppid long, rank int").repartition(5)
    rows = tree.preorder(df, root, ["rank"]).collect()
    return {r["pid"]: (r["root"], r["depth"], r["size"], r["position"]) for r in rows}


@pytest.mark.parametrize("seed, near", [(1, 1000), (2, 3), (3, 30)])
def test_random_trees_with_cycles_and_orphans(spark, seed, near):
    rng = random.Random(seed)
    edges = [(pid, max(1, pid - rng.randrange(1, near)), rng.randrange(5)) for pid in range(2, 400)]
    edges += [(1000, 1001, 0), (1001, 1000, 0), (1002, 1000, 0)]  # a cycle and what hangs on it
    edges += [(2000, 1999, 0), (2001, 2000, 0)]  # the parent is not there
    assert tree_of(spark, edges) == walk(edges, 1)


def test_one_parent_of_all(spark):
    edges = [(pid, 1 if pid == 2 else 2, -pid) for pid in range(2, 500)]
    assert tree_of(spark, edges) == walk(edges, 1)


def test_chain_of_5000(spark):
    edges = [(pid, pid - 1, 0) for pid in range(2, 5002)]
    got = tree_of(spark, edges)
    assert got == {pid: (2, pid - 2, 5002 - pid, pid - 1) for pid in range(2, 5002)}


def test_empty(spark):
    assert tree_of(spark, []) == {}
    assert tree_of(spark, [(5, 6, 0)]) == {}
