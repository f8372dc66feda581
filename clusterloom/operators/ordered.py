"""Row numbers and running totals over a whole table.

A window without a partition would bring all rows into one task. Here the rows are
cut into ranges of their keys, each range is numbered or summed on its own, and
what the ranges before it hold is added in a second pass. The driver sees one
number for each range.

Keys ascend, nulls first and NaN last, as Spark sorts them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clusterloom.functions.hashing import with_uniform
from clusterloom.lineage import cut_lineage

#: Keys looked at for each range when ranges are chosen. The choice moves rows
#: between tasks; it has no part in any result.
SAMPLED_PER_RANGE = 64
#: Numbers of equal rows that are dealt out by one row.
NUMBERS_PER_ROW = 1 << 16


def n_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unused_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        n = 0
        while f"__{name}{n}" in taken:
            n += 1
        names.append(f"__{name}{n}")
        taken.add(names[-1])
    return names


def quoted(name: str) -> Column:
    """A column whose name may hold dots or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def range_bounds(df: DataFrame, keys: Sequence[str], n_ranges: int) -> list[tuple]:
    """At most ``n_ranges - 1`` ascending key tuples that cut ``df`` into even ranges.

    Taken from the ``SAMPLED_PER_RANGE * n_ranges`` rows with the smallest hash of
    the keys, so that a rerun gives the same bounds.
    """
    size = SAMPLED_PER_RANGE * n_ranges
    columns = [quoted(k) for k in keys]
    picked = df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(size)
    ordered = picked.orderBy(*columns).collect()
    if not ordered:
        return []
    step = len(ordered) / n_ranges
    cuts = [tuple(ordered[min(int(i * step), len(ordered) - 1)]) for i in range(1, n_ranges)]
    return [c for i, c in enumerate(cuts) if not i or c != cuts[i - 1]]


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


def _ranged(df: DataFrame, keys: Sequence[str], n_ranges: int, out: str) -> DataFrame:
    """``df`` with the number of each row's range, cut off from what made it."""
    kinds = dict(df.dtypes)
    bounds = range_bounds(df, keys, n_ranges)
    return cut_lineage(
        df.withColumn(out, range_of([quoted(k) for k in keys], bounds, [kinds[k] for k in keys]))
    )


def _before_each_range(ranged: DataFrame, at: str, amount: Column, n_ranges: int, zero) -> Column:
    """What all earlier ranges hold, as an expression of the range's number."""
    held = dict(ranged.groupBy(at).agg(F.sum(amount)).collect())
    sums = [zero if held.get(r) is None else held[r] for r in range(n_ranges)]
    return F.get(F.array(*map(F.lit, accumulate([zero, *sums[:-1]]))), F.col(at))


def global_row_number(
    df: DataFrame, order: Sequence[str], out: str = "row_number", n_ranges: int | None = None
) -> DataFrame:
    """``df`` with the numbers 1, 2, 3 … in ascending ``order``.

    Rows equal in ``order`` are numbered by their other columns, so a rerun agrees.
    Rows equal in all columns travel as one with their count, which is combined
    before the shuffle, and come apart again after they are numbered: many copies of
    a row are no large range. Columns must be of types that can be sorted; an empty
    table gives an empty result.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    n_ranges = n_ranges or n_partitions(df)
    copies, at, before, part = unused_names(df, "copies", "range", "before", "part")
    keys = [*order, *[c for c in df.columns if c not in order]]
    counted = df.groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias(copies))
    ranged = _ranged(counted, keys, n_ranges, at)
    offset = _before_each_range(ranged, at, F.col(copies), n_ranges, 0)
    within = Window.partitionBy(at).orderBy(*map(quoted, keys))
    numbered = ranged.select(
        *map(quoted, df.columns), copies,
        (F.sum(copies).over(within) - F.col(copies) + offset).alias(before),
    )
    parts = F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {NUMBERS_PER_ROW}"))
    first = F.col(part) * NUMBERS_PER_ROW + 1
    last = F.least(F.col(copies), first + (NUMBERS_PER_ROW - 1))
    numbers = F.sequence(F.col(before) + first, F.col(before) + last)
    return numbered.withColumn(part, F.explode(parts)).select(
        *map(quoted, df.columns), F.explode(numbers).alias(out)
    )


def running_total(
    df: DataFrame, order: Sequence[str], value: str, out: str = "running_total",
    share: bool = False, n_ranges: int | None = None,
) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with its own.

    Rows equal in ``order`` share one total, which is what SQL's default frame says.
    ``share`` divides by the sum of all rows (null where that is 0). Null values add
    nothing. Values are summed for each key before the shuffle, so a key that very
    many rows share is one row of the ranges; the totals are joined back to the rows
    by key, and that join can be split by the planner. Sums are in double precision
    for floats, else in 38 decimal digits; an empty table gives an empty result.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    n_ranges = n_ranges or n_partitions(df)
    amount, at, total = unused_names(df, "amount", "range", "total")
    given = df.schema[value].dataType
    floats = isinstance(given, T.FractionalType) and not isinstance(given, T.DecimalType)
    kind = "double" if floats else f"decimal(38,{given.scale if isinstance(given, T.DecimalType) else 0})"
    added = F.coalesce(F.sum(quoted(value).cast(kind)), F.lit(0).cast(kind))
    cells = df.groupBy(*map(quoted, order)).agg(added.cast(kind).alias(amount))
    ranged = _ranged(cells, order, n_ranges, at)
    held = dict(ranged.groupBy(at).agg(F.sum(amount).cast(kind)).collect())
    zero = 0.0 if floats else 0
    reached = list(accumulate([zero, *[held.get(r) or zero for r in range(n_ranges)]]))
    offset = F.get(F.array(*[F.lit(x).cast(kind) for x in reached[:-1]]), F.col(at))
    within = Window.partitionBy(at).orderBy(*map(quoted, order))
    sums = F.sum(amount).over(within) + offset
    if share:
        sums = F.try_divide(sums, F.lit(reached[-1]).cast(kind)).cast("double")
    names = unused_names(df, *[f"key{i}" for i in range(len(order))])
    totals = ranged.select(
        *[quoted(k).alias(n) for k, n in zip(order, names)], sums.alias(total)
    )
    same = F.lit(True)
    for key, name in zip(order, names):
        same = same & quoted(key).eqNullSafe(F.col(name))
    return df.join(totals, same).select(*map(quoted, df.columns), F.col(total).alias(out))


def weighted_draws(
    df: DataFrame, pk: str, weight: str, n: int, seed: int = 1, n_ranges: int | None = None
) -> DataFrame:
    """``(draw, pk)`` of ``n`` draws with replacement, with probabilities by ``weight``.

    A draw is the first row, by key, whose share of the running total is above a
    uniform number, as a roulette wheel does it. All draws are found in one
    aggregate over the shares. Rows whose weight is null or not above 0 are never
    drawn; without any other there are no draws.
    """
    spark = df.sparkSession
    at = F.col("share")
    usable = df.select(quoted(pk).alias("pk"), quoted(weight).cast("double").alias("weight")).filter("weight > 0")
    shares = running_total(usable, ["pk"], "weight", "share", share=True, n_ranges=n_ranges)
    drawn = spark.range(n).select(F.col("id").cast("int").alias("draw"))
    numbers = [r["u"] for r in with_uniform(drawn, "draw", "u", seed).orderBy("draw").collect()]
    # the share of the last row may fall short of 1 by rounding, so it is drawn where none is above
    firsts = [F.min(F.when(at > u, F.struct(at, F.col("pk")))).alias(f"d{i}") for i, u in enumerate(numbers)]
    best = shares.agg(*firsts, F.max(F.struct(at, F.col("pk"))).alias("last"))
    picks = F.array(*[
        F.struct(F.lit(i).alias("draw"), F.coalesce(F.col(f"d{i}"), F.col("last"))["pk"].alias(pk))
        for i in range(n)
    ])
    return best.filter(F.col("last").isNotNull()).select(F.inline(picks))
