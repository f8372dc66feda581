"""k-means over a DataFrame.

The driver holds the centroids only.  One round is a single job: a map that
finds each row's nearest centroid, and a partial/final aggregate that returns
one row per cluster.  Row state never has to be stored between rounds, because
both the previous and the current cluster follow from centroids that are
literals in the plan; so there is no join, and no lineage that grows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.functions.hashing import with_mix32, with_uniform
from clusterloom.functions.vectors import (
    USABLE,
    VECTOR,
    Features,
    batch_matrix,
    feature_table,
    filled,
    nearest_in_batch,
    nearest_sql,
    unrolls,
    with_nearest,
    with_nearest_dist2,
)
from clusterloom.operators.kmeans_large import LargeKMeansModel, kmeans_fit_large

# Centroid values the driver ships with every task (64 MB of doubles); more are a table.
MAX_CENTROID_VALUES = 1 << 23

# k-means++: draws that one pass looks ahead, and parts of the rows that each keep a candidate.
DRAWS_PER_PASS = 4
RACE_PARTS = 4

INITS = ("random", "plus", "hash", "roundrobin")

Centroids = list[tuple[int, list[float]]]


@dataclass(frozen=True)
class KMeansModel:
    """Final centroids, and how the loop got there."""

    centroids: Centroids
    features: str | tuple[str, ...]
    passes: int
    changes: list[int] = field(default_factory=list)
    n_excluded: int = 0

    def assign(self, df: DataFrame, out: str = "cid") -> DataFrame:
        """``out`` beside all columns of ``df``; null for rows with a missing feature.

        ``n_excluded`` says how many rows the fit left out for that reason.
        """
        size = len(self.centroids[0][1])
        keep = [c for c in df.columns if c != out]
        table, spec = feature_table(df, _feature_argument(self.features), size=size, keep=keep)
        nearest = with_nearest(filled(table, spec), spec, *_unzip(self.centroids), "__nearest")
        return nearest.select(F.when(F.col(USABLE), F.col("__nearest")).alias(out), *keep)


def _feature_argument(features: str | Sequence[str]) -> str | list[str]:
    return features if isinstance(features, str) else list(features)


def _unzip(centroids: Centroids) -> tuple[list[int], list[list[float]]]:
    return [c for c, _ in centroids], [v for _, v in centroids]


def check_arguments(k: int, n_features: int, max_iter: int = 1) -> None:
    """Argument rules that need no data."""
    if k < 2:
        raise ValueError("k must be at least 2")
    if n_features < 1:
        raise ValueError("at least one feature is needed")
    if max_iter < 1:
        raise ValueError("max_iter must be at least 1")


def kmeans_validate(df: DataFrame, pk: str, features: str | Sequence[str], k: int) -> DataFrame:
    """One row: row count, rows with a missing feature, keys that repeat, verdict.

    Rows are counted per key first, so a key that many rows share is combined on
    the map side before anything is shuffled.
    """
    table, spec = feature_table(df, features, keep=[pk])
    check_arguments(k, spec.size)
    per_key = table.groupBy(pk).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col(USABLE)).alias("n_missing")
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.when(F.col(pk).isNull(), F.col("n"))), F.lit(0)).alias("n_null_keys"),
        F.count_if((F.col("n") > 1) & F.col(pk).isNotNull()).alias("n_repeated_keys"),
    ).withColumn(
        "valid",
        (F.col("n_rows") > 0)
        & (F.col("n_missing") == 0)
        & (F.col("n_null_keys") == 0)
        & (F.col("n_repeated_keys") == 0),
    )


# --- initial clusters ------------------------------------------------------


def init_hash(df: DataFrame, pk: str, k: int, seed: int = 1, out: str = "cid") -> DataFrame:
    """Add ``out`` = hash(seed + pk) mod k."""
    hashed = with_mix32(df, pk, "__h", offset=seed)
    return hashed.withColumn(out, F.pmod("__h", F.lit(k)).cast("int")).drop("__h")


def init_roundrobin(df: DataFrame, pk: str, k: int, out: str = "cid") -> DataFrame:
    """Add ``out`` = pk mod k (the key plays the row number, so it must be integral)."""
    if not isinstance(df.schema[pk].dataType, T.IntegralType):
        raise ValueError(f"round-robin clusters need an integral key, and {pk} is none")
    return df.withColumn(out, F.pmod(F.col(pk), F.lit(k)).cast("int"))


def init_random_labels(df: DataFrame, pk: str, k: int, seed: int = 1, out: str = "cid") -> DataFrame:
    """Add ``out`` = floor(u * k) for a seeded uniform u of the key."""
    drawn = with_uniform(df, pk, "__u", seed)
    label = F.least(F.floor(F.col("__u") * k), F.lit(k - 1)).cast("int")
    return drawn.withColumn(out, label).drop("__u")


def init_random(
    df: DataFrame, pk: str, features: Sequence[str], k: int, seed: int = 1
) -> DataFrame:
    """Centroids ``(cid, feature means)`` of a random partition into ``k`` parts."""
    return kmeans_update(init_random_labels(df, pk, k, seed), "cid", features)


def _pick_first(items: DataFrame, spec: Features, pk: str, seed: int) -> list[float] | None:
    """A uniform pick: the row with the smallest draw, found by one aggregate."""
    drawn = with_uniform(items, pk, "__u", seed, draw=0)
    best = drawn.agg(F.min(F.struct("__u", pk, *spec.columns)).alias("r")).first()["r"]
    return None if best is None else spec.values(best)


def _races(
    items: DataFrame, spec: Features, pk: str, chosen: list[list[float]], seed: int, n_draws: int
) -> list[list[Row]]:
    """One pass: the best race of each of the next draws in each part of the rows.

    The smallest of ``-ln(u) / weight`` is a draw with probability proportional to the
    weight, the squared distance to ``chosen`` (exponential races), so no running total
    over the whole table is needed.
    """
    weight = F.col("__w")
    weighed = with_nearest_dist2(items, spec, chosen, "__w").filter(weight > 0)
    for j in range(n_draws):
        weighed = with_uniform(weighed, pk, f"__u{j}", seed, draw=len(chosen) + j)
    part = F.pmod(F.xxhash64(pk), F.lit(RACE_PARTS))
    best = [
        F.min(F.when(part == p, F.struct((-F.ln(f"__u{j}") / weight).alias("race"), pk, weight, *spec.columns)))
        for j in range(n_draws) for p in range(RACE_PARTS)
    ]
    row = list(weighed.agg(*best).first())
    return [[r for r in row[at:at + RACE_PARTS] if r] for at in range(0, len(row), RACE_PARTS)]


def _pick_several(
    items: DataFrame, spec: Features, pk: str, chosen: list[list[float]], seed: int, n_draws: int
) -> list[list[float]]:
    """The next picks, one at least if any row is left, at most ``n_draws``, from one pass.

    A pick brings distances down and so only makes races longer. A later draw's best
    race therefore still wins if its own row has kept its distance, and it is shorter
    than what the best ones of all parts that have not kept theirs were before.
    """
    picks: list[list[float]] = []
    for heats in _races(items, spec, pk, chosen, seed, n_draws):
        kept, lost = [], []
        for heat in heats:
            values = spec.values(heat)
            nearer = any(_dist2(values, pick) < heat["__w"] for pick in picks)
            (lost if nearer else kept).append(heat)
        if not kept:
            break
        best = min(kept, key=lambda heat: (heat["race"], heat[1]))
        if any(heat["race"] <= best["race"] for heat in lost):
            break
        picks.append(spec.values(best))
    return picks


def _dist2(a: Sequence[float], b: Sequence[float]) -> float:
    """Added from left to right, as the expression on the rows is."""
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return total


def _plus_centroids(items: DataFrame, spec: Features, pk: str, k: int, seed: int) -> Centroids:
    first = _pick_first(items, spec, pk, seed)
    chosen = [] if first is None else [first]
    while chosen and len(chosen) < k:
        following = _pick_several(items, spec, pk, chosen, seed, min(DRAWS_PER_PASS, k - len(chosen)))
        if not following:  # fewer than k distinct points
            break
        chosen += following
    return list(enumerate(chosen))


def kmeans_plus_plus(
    df: DataFrame,
    pk: str,
    features: str | Sequence[str],
    k: int,
    seed: int = 1,
    storage: StorageLevel | None = StorageLevel.MEMORY_AND_DISK,
) -> DataFrame:
    """k-means++ seeds as ``(cid, feature values)``; ``storage=None`` rereads the source."""
    table, spec = feature_table(df, features, keep=[pk])
    check_arguments(k, spec.size)
    if storage is not None:
        table = table.persist(storage)
    try:
        centroids = _plus_centroids(table.filter(USABLE), spec, pk, k, seed)
    finally:
        if storage is not None:
            table.unpersist()
    return centroid_table(df, centroids, features)


def centroid_table(df: DataFrame, centroids: Centroids, features: str | Sequence[str]) -> DataFrame:
    """Centroids held on the driver as a DataFrame."""
    if isinstance(features, str):
        rows, schema = centroids, f"cid int, `{features}` array<double>"
    else:
        rows = [(cid, *values) for cid, values in centroids]
        schema = ", ".join(["cid int", *[f"`{c}` double" for c in features]])
    return df.sparkSession.createDataFrame(rows, schema)


# --- single steps ----------------------------------------------------------


def kmeans_assign(
    df: DataFrame, features: str | Sequence[str], centroids: Centroids, out: str = "cid"
) -> DataFrame:
    """Add the nearest centroid of every row; a map without a shuffle."""
    return KMeansModel(centroids, features, passes=1).assign(df, out)


def kmeans_update(df: DataFrame, cid: str, features: Sequence[str]) -> DataFrame:
    """Mean of each feature per cluster."""
    return df.groupBy(cid).agg(*[F.avg(c).alias(c) for c in features])


def kmeans_changes(df: DataFrame, previous: str, current: str) -> DataFrame:
    """How many rows moved to another cluster, when both ids sit in one row."""
    return df.agg(F.count_if(F.col(previous) != F.col(current)).alias("n_changed"))


def kmeans_changes_between(old: DataFrame, new: DataFrame, pk: str, cid: str = "cid") -> DataFrame:
    """The same count for two cluster maps kept in separate tables."""
    before = old.select(pk, F.col(cid).alias("__old"))
    return kmeans_changes(before.join(new, pk), "__old", cid)


# --- the loop --------------------------------------------------------------


def _partial_sums(centres: Centroids | None, earlier: Centroids | None):
    """Per task: cluster sizes, sums and moved rows, in numpy on Arrow batches.

    Emits one row per cluster and task, so it is the map side of the aggregate.
    """
    def lookup(centroids):
        if centroids is None:
            return None
        ids, vectors = _unzip(centroids)
        return np.asarray(ids), np.asarray(vectors, dtype=np.float64)

    now, before = lookup(centres), lookup(earlier)

    def run(batches):
        sizes: dict[int, int] = {}
        moved: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = batch_matrix(batch.column(0))
            if now is None:
                cids = batch.column(1).to_numpy(zero_copy_only=False)
            else:
                cids = now[0][nearest_in_batch(matrix, now[1])[0]]
            differs = np.zeros(len(cids), dtype=bool)
            if before is not None:
                differs = before[0][nearest_in_batch(matrix, before[1])[0]] != cids
            order = np.argsort(cids, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(cids[order]) != 0])
            totals = np.add.reduceat(matrix[:, order], starts, axis=1)
            counts = np.diff(np.r_[starts, len(cids)])
            changes = np.add.reduceat(differs[order].astype(np.int64), starts)
            for i, cid in enumerate(cids[order][starts].tolist()):
                sizes[cid] = sizes.get(cid, 0) + int(counts[i])
                moved[cid] = moved.get(cid, 0) + int(changes[i])
                sums[cid] = sums.get(cid, 0.0) + totals[:, i]
        if sizes:
            ids = sorted(sizes)
            yield pa.RecordBatch.from_pydict({
                "cid": pa.array(ids, pa.int32()),
                "n": pa.array([sizes[c] for c in ids], pa.int64()),
                "moved": pa.array([moved[c] for c in ids], pa.int64()),
                "sums": pa.array([sums[c].tolist() for c in ids], pa.list_(pa.float64())),
            })

    return run


def _round_in_numpy(
    items: DataFrame, spec: Features, centres: Centroids | None, earlier: Centroids | None
) -> DataFrame:
    columns = [spec.array.alias(VECTOR)] + ([F.col("__cid")] if centres is None else [])
    partial = items.select(*columns).mapInArrow(
        _partial_sums(centres, earlier), "cid int, n bigint, moved bigint, sums array<double>"
    )
    means = ", ".join(f"sum(sums[{i}]) / sum(n)" for i in range(spec.size))
    return partial.groupBy("cid").agg(
        F.sum("moved").alias("moved"), F.expr(f"array({means})").alias("means")
    )


def _nearest_columns(
    spec: Features, centres: Centroids, earlier: Centroids | None, step: int
) -> list[str]:
    """Select list of the first (distances) or second (nearest id) projection."""
    columns = []
    for name, centroids in (("__cid", centres), ("__before", earlier)):
        if centroids is not None:
            distances, nearest = nearest_sql(spec, *_unzip(centroids))
            columns.append(
                f"{nearest.format(ds='ds' + name)} AS {name}" if step else f"{distances} AS ds{name}"
            )
    return columns


def _round_in_codegen(
    items: DataFrame, spec: Features, centres: Centroids | None, earlier: Centroids | None
) -> DataFrame:
    if centres is None:
        labelled = items.select("__cid", *spec.columns)
    else:
        labelled = items.selectExpr(*spec.columns, *_nearest_columns(spec, centres, earlier, 0))
        labelled = labelled.selectExpr(*spec.columns, *_nearest_columns(spec, centres, earlier, 1))
    moved = "0" if earlier is None else "count_if(__before != __cid)"
    means = ", ".join(f"avg({e})" for e in spec.elements)
    return labelled.groupBy(F.col("__cid").alias("cid")).agg(
        F.expr(moved).alias("moved"), F.expr(f"array({means})").alias("means")
    )


def kmeans_round(
    items: DataFrame,
    spec: Features,
    centres: Centroids | None = None,
    earlier: Centroids | None = None,
) -> DataFrame:
    """``(cid, moved, means)`` of one round, from one partial/final aggregate.

    Without ``centres`` the clusters are read from ``__cid``.  With ``earlier``,
    ``moved`` counts the rows whose cluster differs under those centroids.
    """
    wide = not unrolls(spec, 1 if centres is None else len(centres))
    build = _round_in_numpy if wide else _round_in_codegen
    return build(items, spec, centres, earlier)


def _collect_round(round_df: DataFrame, k: int, empty: str) -> tuple[Centroids, int]:
    rows = round_df.collect()  # at most k rows
    means = {r["cid"]: list(r["means"]) for r in rows}
    if empty == "zero" and means:
        width = len(next(iter(means.values())))
        means = {c: means.get(c, [0.0] * width) for c in range(k)}
    return sorted(means.items()), sum(r["moved"] for r in rows)


def _labelled(items: DataFrame, pk: str, k: int, init: str, seed: int) -> DataFrame:
    """The items with their first clusters as ``__cid``."""
    if init == "random":
        return init_random_labels(items, pk, k, seed, "__cid")
    if init == "hash":
        return init_hash(items, pk, k, seed, "__cid")
    return init_roundrobin(items, pk, k, "__cid")


def kmeans_fit(
    df: DataFrame,
    pk: str,
    features: str | Sequence[str],
    k: int,
    *,
    init: str = "random",
    max_iter: int = 10,
    changed_at_most: int | None = None,
    empty: str = "drop",
    seed: int = 1,
    storage: StorageLevel | None = StorageLevel.MEMORY_AND_DISK,
    folder: str | None = None,
) -> KMeansModel | LargeKMeansModel:
    """Run the loop and return the centroids of its last assignment pass.

    ``max_iter`` is the number of assignment passes.  ``changed_at_most`` stops
    early once no more than that many rows move between two passes.  ``empty``
    says what happens to a cluster without rows: ``drop`` it, or move it to the
    origin (``zero``).  ``storage=None`` rereads the source in every round,
    for tables whose features do not fit on the executors.

    Beyond ``MAX_CENTROID_VALUES`` centroid values the centroids are a table and not on
    the driver, and so may they be below with a ``folder``: rounds are stored there, and a
    call with the same arguments goes on from the last one. k-means++ holds its picks on
    the driver, so it is refused then.
    """
    if init not in INITS:
        raise ValueError(f"init must be one of {INITS}")
    if empty not in ("drop", "zero"):
        raise ValueError("empty must be 'drop' or 'zero'")
    table, spec = feature_table(df, features, keep=[pk])
    check_arguments(k, spec.size, max_iter)
    if storage is not None:
        table = table.persist(storage)
    try:
        counts = table.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(~F.col(USABLE)).alias("missing")
        ).first()
        if counts["n"] == counts["missing"]:
            raise ValueError("no row has all features")
        items = table.filter(USABLE)
        if folder is not None or k * spec.size > MAX_CENTROID_VALUES:
            if init == "plus":
                raise ValueError(f"k-means++ needs k * features up to {MAX_CENTROID_VALUES}, and no folder")
            n_pivots = max(1, min(math.isqrt(k), MAX_CENTROID_VALUES // spec.size))
            named = features if isinstance(features, str) else list(features)
            return kmeans_fit_large(
                df, pk, features, k, _labelled(items, pk, k, init, seed), spec, n_pivots, max_iter=max_iter,
                changed_at_most=changed_at_most, empty=empty, n_excluded=counts["missing"], folder=folder,
                arguments={"pk": pk, "features": named, "k": k, "init": init, "max_iter": max_iter,
                           "changed_at_most": changed_at_most, "empty": empty, "seed": seed},
            )
        if init == "plus":
            centroids = _plus_centroids(items, spec, pk, k, seed)
        else:
            labelled = _labelled(items, pk, k, init, seed)
            centroids, _ = _collect_round(kmeans_round(labelled, spec), k, empty)
        earlier: Centroids | None = None
        changes: list[int] = []
        passes = 1
        while passes < max_iter:
            following, moved = _collect_round(
                kmeans_round(items, spec, centroids, earlier), k, empty
            )
            if earlier is not None:
                changes.append(moved)
                if moved <= changed_at_most:
                    break
            if changed_at_most is not None:
                earlier = centroids
            centroids = following
            passes += 1
    finally:
        if storage is not None:
            table.unpersist()
    return KMeansModel(
        centroids=centroids,
        features=features if isinstance(features, str) else tuple(features),
        passes=passes,
        changes=changes,
        n_excluded=counts["missing"],
    )


def kmeans(df: DataFrame, pk: str, features: str | Sequence[str], k: int, **options) -> DataFrame:
    """``cid`` beside all columns of ``df``; options as for :func:`kmeans_fit`."""
    return kmeans_fit(df, pk, features, k, **options).assign(df)


def kmeans_fixed_rounds(
    df: DataFrame, pk: str, features: str | Sequence[str], k: int, n_rounds: int = 10, seed: int = 1
) -> DataFrame:
    """``(pk, cid)`` after exactly ``n_rounds``: hash init, empty clusters at the origin."""
    clusters = kmeans(df, pk, features, k, init="hash", max_iter=n_rounds, empty="zero", seed=seed)
    return clusters.select(pk, "cid")


def kmeans_roundrobin(
    df: DataFrame, pk: str, features: str | Sequence[str], k: int, n_rounds: int = 20
) -> DataFrame:
    """``(pk, cid)`` after exactly ``n_rounds``, with round-robin init."""
    clusters = kmeans(df, pk, features, k, init="roundrobin", max_iter=n_rounds, empty="zero")
    return clusters.select(pk, "cid")


def kmeans_sliced(
    df: DataFrame,
    pk: str,
    features: Sequence[str],
    k: int,
    slices: dict[str, Column],
    n_rounds: int = 10,
    seed: int = 1,
    keep: Sequence[str] = (),
    storage: StorageLevel | None = StorageLevel.MEMORY_AND_DISK,
) -> DataFrame:
    """``(slice, pk, cid)`` and ``keep``: the fixed-rounds form within each slice, in one loop.

    A slice is a condition on the rows, and a row may be in several.  Each round is
    one job for all slices together: rows meet the centroids of their slices, and
    the aggregate has one row for each slice and cluster.  Rows with a missing
    feature have a null cluster.
    """
    names = list(slices)
    # an array of the slices that a row is in
    inside = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in enumerate(slices.values())]),
        lambda s: s.isNotNull(),
    )
    narrow = df.select(pk, *keep, *[c for c in features if c not in (pk, *keep)], inside.alias("__in"))
    table, spec = feature_table(narrow, features, keep=[pk, *keep, "__in"])
    check_arguments(k, spec.size * len(names), n_rounds)
    if storage is not None:
        table = table.persist(storage)
    try:
        each = table.filter(USABLE).withColumn("__slice", F.explode("__in"))
        clusters = init_hash(each, pk, k, seed, "__cid")
        for _ in range(n_rounds):
            means = clusters.groupBy("__slice", "__cid").agg(F.array(*[F.avg(c) for c in spec.columns]).alias("m"))
            found = {(r["__slice"], r["__cid"]): list(r["m"]) for r in means.collect()}  # k rows a slice
            centroids = [
                [(c, found.get((s, c), [0.0] * spec.size)) for c in range(k)] for s in range(len(names))
            ]
            clusters = _with_nearest_of_slice(each, spec, centroids)
    finally:
        if storage is not None:
            table.unpersist()
    every = filled(table, spec).withColumn("__slice", F.explode("__in"))
    labelled = _with_nearest_of_slice(every, spec, centroids)
    slice_name = F.element_at(F.array(*map(F.lit, names)), F.col("__slice") + 1)
    return labelled.select(
        slice_name.alias("slice"), pk, *keep, F.when(F.col(USABLE), F.col("__cid")).alias("cid")
    )


def _with_nearest_of_slice(items: DataFrame, spec: Features, centroids: list[Centroids]) -> DataFrame:
    """Add ``__cid``, the nearest of the centroids of the row's ``__slice``.

    Up to the limit of other forms as generated code, beyond it in numpy on Arrow batches.
    """
    if not unrolls(spec, sum(map(len, centroids))):
        ids = np.asarray(_unzip(centroids[0])[0], dtype=np.int32)  # the same in every slice
        vectors = [np.asarray(_unzip(own)[1], dtype=np.float64) for own in centroids]

        @F.arrow_udf("int")
        def nearest_of_slice(slices: pa.Array, rows: pa.Array) -> pa.Array:
            of, matrix = slices.to_numpy(), batch_matrix(rows)
            found = np.empty(len(of), dtype=np.int32)
            for s in np.unique(of):
                here = np.flatnonzero(of == s)
                found[here] = ids[nearest_in_batch(np.ascontiguousarray(matrix[:, here]), vectors[s])[0]]
            return pa.array(found)

        return items.withColumn("__cid", nearest_of_slice("__slice", spec.array))
    distances, nearest = None, None
    for s, own in enumerate(centroids):
        squares, pick = nearest_sql(spec, *_unzip(own))
        here = F.col("__slice") == s
        distances = F.when(here, F.expr(squares)) if distances is None else distances.when(here, F.expr(squares))
        nearest = pick  # the ids are the same in every slice
    return items.withColumn("__ds", distances).withColumn("__cid", F.expr(nearest.format(ds="__ds"))).drop("__ds")


def kmeans_join_back(
    df: DataFrame,
    pk: str,
    features: Sequence[str],
    k: int,
    n_rounds: int = 10,
    max_key: object | None = None,
) -> DataFrame:
    """``(pk, cluster, features)``, of the items with ``pk <= max_key`` if one is given.

    The assignment is a column added to the source row, so the join of cluster
    ids with their source rows needs no shuffle at all.
    """
    items = df if max_key is None else df.filter(F.col(pk) <= F.lit(max_key))
    clusters = kmeans(items, pk, features, k, init="hash", max_iter=n_rounds, empty="zero")
    return clusters.select(pk, F.col("cid").alias("cluster"), *features)
