"""Diverse subsets by farthest-point (min-max) selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.hashing import with_uniform
from clusterloom.functions.vectors import USABLE, feature_table, filled, with_nearest_dist2


def distance_table(
    df: DataFrame, pk: str, features: str | Sequence[str], pivot: Sequence[float]
) -> DataFrame:
    """``(pk, dist)``: Euclidean distance of every item to ``pivot``, map-only.

    An item with a missing feature has no distance.
    """
    table, spec = feature_table(df, features, keep=[pk], size=len(pivot))
    near = with_nearest_dist2(filled(table, spec), spec, [pivot], "__d2")
    return near.select(pk, F.when(F.col(USABLE), F.sqrt("__d2")).alias("dist"))


def pick_item(
    df: DataFrame, pk: str, features: str | Sequence[str], seed: int = 1
) -> tuple[object, list[float]]:
    """Key and features of one uniformly drawn item."""
    table, spec = feature_table(df, features, keep=[pk])
    drawn = with_uniform(table.filter(USABLE), pk, "__u", seed)
    row = drawn.agg(F.min(F.struct("__u", pk, *spec.columns)).alias("r")).first()["r"]
    if row is None:
        raise ValueError("no row has all features")
    return row[pk], spec.values(row)


def _distance2(a: Sequence[float], b: Sequence[float]) -> float:
    """Summed in feature order, as the expression over the table is."""
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return total


def minmax_subset(
    df: DataFrame,
    pk: str,
    label: str,
    features: str | Sequence[str],
    n_rounds: int,
    *,
    seed: int = 1,
    start_pk: object | None = None,
    candidates: int = 64,
    storage: StorageLevel | None = StorageLevel.MEMORY_AND_DISK,
) -> DataFrame:
    """``(pick, pk, label, dist)`` of ``n_rounds + 1`` items.

    Starts at a drawn item (or ``start_pk``); every round adds the item farthest
    from the subset, the lowest key on ties.  Ends early when all items coincide
    with a picked one.  Items with a missing feature are never picked.

    A pass over the table brings the ``candidates`` farthest items to the driver,
    a bounded take.  Distances only fall, so as long as the best of these,
    measured against the newest picks, still comes before the last one as the
    pass saw it, no other item can be farther, and it is the next pick without
    another pass.  ``storage=None`` rereads the source in every pass.
    """
    if n_rounds < 0:
        raise ValueError("n_rounds must not be negative")
    if candidates < 1:
        raise ValueError("candidates must be at least 1")
    table, spec = feature_table(df, features, keep=[pk, label])
    items = table.filter(USABLE).drop(USABLE)
    if storage is not None:
        items = items.persist(storage)
    try:
        if start_pk is None:
            ranked = with_uniform(items, pk, "__rank", seed)
        else:
            ranked = items.filter(F.col(pk) == F.lit(start_pk)).withColumn("__rank", F.lit(0.0))
        start = ranked.agg(F.min(F.struct("__rank", pk, label, *spec.columns)).alias("r")).first()["r"]
        if start is None:
            raise ValueError("no item to start from")
        picks: list[tuple] = [(0, start[pk], start[label], None)]
        chosen = [spec.values(start)]
        while len(picks) <= n_rounds:
            ranked = with_nearest_dist2(items, spec, chosen, "__d2")
            order = [F.col("__d2").desc(), F.col(pk).asc_nulls_first()]
            best = ranked.filter("__d2 > 0").orderBy(*order).limit(candidates).collect()
            if not best:
                break
            seen_all = len(best) < candidates
            last = best[-1]["__d2"], best[-1][pk]
            open_items = [[r["__d2"], r[pk], r[label], spec.values(r)] for r in best]
            while len(picks) <= n_rounds:
                farthest = max(item[0] for item in open_items)
                ties = [item for item in open_items if item[0] == farthest]
                pick = min(ties, key=lambda item: (item[1] is not None, item[1]))
                if farthest == 0:
                    break
                if not seen_all and (farthest < last[0] or (farthest == last[0] and _after(pick[1], last[1]))):
                    break  # an item that the pass did not bring may be farther
                picks.append((len(picks), pick[1], pick[2], farthest**0.5))
                chosen.append(pick[3])
                for item in open_items:
                    item[0] = min(item[0], _distance2(item[3], pick[3]))
            if seen_all and farthest == 0:
                break
    finally:
        if storage is not None:
            items.unpersist()
    schema = df.select(
        F.lit(0).alias("pick"), pk, label, F.lit(0.0).cast("double").alias("dist")
    ).schema
    for field in schema.fields:
        field.nullable = True
    return df.sparkSession.createDataFrame(picks, schema)


def _after(key: object, other: object) -> bool:
    """Whether ``key`` comes later in key order, null first."""
    return key is not None and (other is None or key > other)
