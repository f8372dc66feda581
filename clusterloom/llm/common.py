"""What several of the training-data operators share.

Every operator first narrows its input to the columns that it needs, so further
columns, whatever their names, neither reach a shuffle nor clash with a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import cut_lineage

#: The white space that ends a word, in the form of a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys looked at for each range when ranges are chosen. The choice moves rows
#: between tasks; it has no part in any result.
SAMPLED_PER_RANGE = 64


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def range_bounds(df: DataFrame, keys: Sequence[str], n_ranges: int) -> list[tuple]:
    """At most ``n_ranges - 1`` ascending key tuples that cut ``df`` into even ranges.

    Taken from the ``SAMPLED_PER_RANGE * n_ranges`` rows with the smallest hash of
    the keys, so that a rerun gives the same bounds.
    """
    size = SAMPLED_PER_RANGE * n_ranges
    picked = df.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(size)
    ordered = picked.orderBy(*keys).collect()
    if not ordered:
        return []
    step = len(ordered) / n_ranges
    cuts = [tuple(ordered[min(int(i * step), len(ordered) - 1)]) for i in range(1, n_ranges)]
    return list(dict.fromkeys(cuts))


def range_of(keys: Sequence[Column], bounds: list[tuple], types: Sequence[str]) -> Column:
    """How many of ``bounds`` are not above the key: a binary search in generated code."""
    if not bounds:
        return F.lit(0)

    def struct_of(values: Sequence[Column]) -> Column:
        return F.struct(*[v.cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, types))])

    table = F.array(*[struct_of([F.lit(v) for v in bound]) for bound in bounds])
    key = struct_of(keys)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda found, step: F.when(
            (found + step <= len(bounds)) & (F.get(table, found + step - 1) <= key), found + step
        ).otherwise(found),
    )


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` with the smallest node that links reach, for linked nodes.

    Alternates large-star and small-star steps until nothing changes. A step is
    a minimum for each node, which combines before the shuffle, and a join with
    it, which Spark splits where a node has very many links; neighbours are never
    gathered. Each round is cut off by a reliable checkpoint.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    links = cut_lineage(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )

    def summary(df: DataFrame):
        return df.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()

    before = summary(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is handed to the smallest one
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(
            small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        after = summary(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("u"), "v").distinct()
    return links.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
