"""Sizes, depths and pre-order positions of trees given by parent pointers.

No row ever holds a path. Every round moves the pointer of each open node to where
the node it points at has got, which doubles the distance covered, so the number of
rounds is the logarithm of the depth, whatever the number of nodes:

* on the way up a node adds what its pointer has passed (depth, or a position);
* what points at a node just now are its descendants at a distance of a power of
  two, and each of these knows its own descendants nearer than that: so the sum over
  them doubles how far down a node has counted.

A node's position is 1 for itself, the sizes of its earlier siblings' trees, and its
parent's position. The sums over siblings are a running total over the whole table, so
a parent with very many children is no large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import stored
from clusterloom.operators.ordered import running_total


def sizes_below(edges: DataFrame, root: int) -> DataFrame:
    """``(pid, ppid, root, depth, size)`` of every node below ``root``.

    ``edges`` has one row per ``pid`` with its ``ppid``. ``root`` of a row is its topmost
    ancestor, ``size`` the number of nodes in its tree, itself included. Nodes that hang
    on a missing node or on a cycle are left out.
    """
    at_root = F.col("up") == root
    still_open = stored(edges.select(
        "pid", F.col("ppid").alias("up"), F.col("pid").alias("root"),
        F.lit(0).alias("depth"), F.lit(1).cast("long").alias("size"),
    ))
    linked = still_open.filter(at_root)
    still_open = still_open.filter(~at_root)
    credits = []
    n_linked = linked.count()
    while n_linked:
        # nodes at the pointers' present distance hand what they have counted to where they point
        credit = still_open.groupBy("up").agg(F.sum("size").alias("more"))
        credits.append(credit)
        reached = linked.unionByName(still_open).select(
            F.col("pid").alias("up"), F.col("up").alias("next_up"),
            F.col("root").alias("upper_root"), F.col("depth").alias("upper_depth"),
        )
        moved = stored(
            still_open.join(reached, "up").join(credit.withColumnRenamed("up", "pid"), "pid", "left").select(
                "pid", F.col("next_up").alias("up"), F.col("upper_root").alias("root"),
                (F.col("depth") + F.col("upper_depth") + 1).alias("depth"),
                (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
            )
        )
        counts = moved.agg(F.count_if(at_root).alias("linked"), F.count_if(~at_root).alias("open")).first()
        linked = linked.unionByName(moved.filter(at_root))
        still_open = moved.filter(~at_root)
        n_linked = counts["linked"] if counts["open"] else 0
    found = linked.select("pid", "root", "depth", F.lit(None).cast("long").alias("more"))
    for credit in credits:
        found = found.unionByName(credit.select(F.col("up").alias("pid"), "more"), allowMissingColumns=True)
    sizes = found.groupBy("pid").agg(
        F.max("root").alias("root"), F.max("depth").alias("depth"),
        (1 + F.coalesce(F.sum("more"), F.lit(0))).alias("size"),
    ).filter("root IS NOT NULL")
    return edges.select("pid", "ppid").join(sizes, "pid").select("pid", "ppid", "root", "depth", "size")


def preorder(edges: DataFrame, root: int, rank: Sequence[str]) -> DataFrame:
    """``(pid, root, depth, size, position)`` of every node below ``root``.

    ``edges`` has one row per ``pid``: ``pid``, ``ppid`` and the columns in ``rank``, which
    order siblings (then ``pid`` does). ``position`` counts the nodes in pre-order from 1.
    """
    nodes = stored(
        edges.select("pid", *rank).join(sizes_below(edges, root), "pid").select(
            "pid", "ppid", *rank, "root", "depth", "size"
        )
    )
    totals = stored(running_total(nodes, ["ppid", *rank, "pid"], "size", "reached"))
    before = F.col("reached").cast("long") - F.col("size")
    firsts = totals.groupBy("ppid").agg(F.min(before).alias("first"))
    state = stored(totals.join(firsts, "ppid").select(
        "pid", F.col("ppid").alias("up"), (before - F.col("first") + 1).alias("position")
    ))
    at_root = F.col("up") == root
    placed, still_open = state.filter(at_root), state.filter(~at_root)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest.bit_length()):
        reached = placed.unionByName(still_open).select(
            F.col("pid").alias("up"), F.col("up").alias("next_up"), F.col("position").alias("upper")
        )
        moved = stored(still_open.join(reached, "up").select(
            "pid", F.col("next_up").alias("up"), (F.col("position") + F.col("upper")).alias("position")
        ))
        placed, still_open = placed.unionByName(moved.filter(at_root)), moved.filter(~at_root)
    return nodes.select("pid", "root", "depth", "size").join(placed.select("pid", "position"), "pid")
