"""k-means with more centroids than the driver can hold or a task should.

Centroids are a table. Some of them, few enough to be shipped, are pivots; every
centroid belongs to its nearest pivot, and centroids are written in order of their
pivot and their distance to it, a chunk of them to a row. Items are put into blocks by
their nearest pivot. A block first meets the chunk that lies nearest; with the
distances found there, the triangle inequality says which other pivots can have a
nearer centroid for any of its items, and the block meets only those pivots' chunks, the
nearest first. Inside, an item passes over chunks that are too far away for it.

Distances are added in the order in which the other forms add them, and ties go to the
lowest id, so all forms assign alike. Rounds are generations in a folder, from which the
loop goes on if the driver is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.vectors import USABLE, VECTOR, Features, feature_table
from clusterloom.generations import Generations
from clusterloom.lineage import new_folder, stored
from clusterloom.operators.ordered import quoted

ITEMS_PER_BLOCK = 4096
CENTROIDS_PER_CHUNK = 256
#: Distances are compared with this much room, so that rounding never hides a centroid.
ROOM = 1 + 1e-9


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows x features of a list array of equal lengths."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _dist2(items: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, items x centres, added feature by feature."""
    total = np.zeros((len(items), len(centres)))
    for a, b in zip(items.T, centres.T):
        difference = a[:, None] - b[None, :]
        total += difference * difference
    return total


def _nearest_pivot(pivots: np.ndarray, vector_at: int):
    """Adds ``cell`` and ``away``: the nearest pivot and how far it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 18) // len(pivots))
        for batch in batches:
            matrix = _matrix(batch.column(vector_at))
            cells, away = [np.empty(0, np.int32)], [np.empty(0)]
            for at in range(0, len(matrix), step):
                d2 = _dist2(matrix[at:at + step], pivots)
                cells.append(d2.argmin(axis=1).astype(np.int32))
                away.append(np.sqrt(d2.min(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(cells)), pa.array(np.concatenate(away))],
                names=[*batch.schema.names, "cell", "away"],
            )

    return run


def _packed(size: int, columns: list[str]):
    """Consecutive rows of a cell as one: ``(id, cell, near, far)`` and lists of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1 if len(cells) else []
            bounds = [0, *map(int, cuts), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                for at in range(lo, hi, size):
                    part = batch.slice(at, min(size, hi - at))
                    away = part.column("away")
                    lists = [pa.ListArray.from_arrays([0, part.num_rows], part.column(c)) for c in columns]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task << 32 | n]), pa.array([int(cells[at])], pa.int32()),
                         *[pa.array([f(away).as_py()], pa.float64()) for f in (pc.min, pc.max)], *lists],
                        names=["id", "cell", "near", "far", *columns],
                    )
                    n += 1

    return run


def _reach(pivots: np.ndarray, radii: np.ndarray):
    """``(block, cell, at)``: the cells that can hold a centroid nearer than the one found.

    Rows are ``(id, cell, far, items, centroids)``, the centroids of a near chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for block, cell, far, items, centroids in zip(*[c for c in batch.columns]):
                found = np.sqrt(_dist2(_matrix(items.values), _matrix(centroids.values)).min(axis=1).max())
                apart = np.sqrt(_dist2(pivots[[cell.as_py()]], pivots)[0])
                # an item is at least this far from any centroid of the cell
                least = apart - far.as_py() - radii
                cells = np.flatnonzero((least <= found * ROOM + 1e-300) & (radii >= 0))
                out[0] += [block.as_py()] * len(cells)
                out[1] += cells.tolist()
                out[2] += apart[cells].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64())],
                names=["block", "cell", "at"],
            )

    return run


def _visits(pivots: np.ndarray):
    """The nearest centroid of each item of a block, from the chunks that follow it.

    Rows are ``(block, at, cell, near, far, held, vectors, cids)``; a block itself, whose
    ``at`` is negative, comes before its chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = items = best = cid = None

        def result():
            return pa.RecordBatch.from_arrays([held, pa.array(cid, pa.int32())], names=["held", "cid"])

        for batch in batches:
            for _, at, cell, near, far, own, vectors, cids in zip(*batch.columns):
                if at.as_py() < 0:
                    if held is not None:
                        yield result()
                    held, items = own.values, _matrix(vectors.values)
                    best, cid = np.full(len(items), np.inf), np.full(len(items), np.iinfo(np.int32).max)
                    continue
                away = np.sqrt(_dist2(items, pivots[[cell.as_py()]])[:, 0])
                least = np.maximum(away - far.as_py(), near.as_py() - away)
                open_ = np.flatnonzero(least <= np.sqrt(best) * ROOM + 1e-300)
                if not len(open_):
                    continue
                ids = cids.values.to_numpy()
                order = np.argsort(ids, kind="stable")  # so that the first of equal distances has the lowest id
                d2 = _dist2(items[open_], _matrix(vectors.values)[order])
                first = d2.argmin(axis=1)
                d2, ids = d2.min(axis=1), ids[order][first]
                better = (d2 < best[open_]) | ((d2 == best[open_]) & (ids < cid[open_]))
                best[open_[better]], cid[open_[better]] = d2[better], ids[better]
        if held is not None:
            yield result()

    return run


def assign_large(table: DataFrame, centroids: DataFrame, n_pivots: int) -> DataFrame:
    """``table`` with ``cid``, the nearest of ``centroids (cid int, vector array<double>)``.

    ``table`` has a column ``__v`` (vectors without nulls), and any others. ``n_pivots``
    vectors pass the driver and are shipped.
    """
    picked = centroids.orderBy(F.xxhash64("cid"), "cid").limit(n_pivots).select("vector").collect()
    pivots = np.asarray([r["vector"] for r in picked], dtype=np.float64)
    near_pivot = centroids.select("cid", "vector").mapInArrow(
        _nearest_pivot(pivots, 1), "cid int, vector array<double>, cell int, away double"
    )
    chunks = stored(
        near_pivot.repartition("cell").sortWithinPartitions("cell", "away")
        .withColumnsRenamed({"cid": "cids", "vector": "vectors"})
        .mapInArrow(_packed(CENTROIDS_PER_CHUNK, ["cids", "vectors"]),
                    "id bigint, cell int, near double, far double, cids array<int>, vectors array<array<double>>")
    )
    found = dict(chunks.groupBy("cell").agg(F.max("far")).collect())  # no more than there are pivots
    radii = np.array([found.get(cell, -1.0) for cell in range(len(pivots))])
    others = [c for c in table.columns if c != VECTOR]
    items = table.select(F.struct(*map(quoted, others)).alias("held"), F.col(VECTOR).cast("array<double>").alias("vector"))
    kinds = dict(items.dtypes)
    celled = items.mapInArrow(
        _nearest_pivot(pivots, 1), f"held {kinds['held']}, vector array<double>, cell int, away double"
    )
    blocks = stored(
        celled.repartitionByRange("cell", "away", F.xxhash64("vector")).sortWithinPartitions("cell", "away")
        .withColumnRenamed("vector", "vectors").mapInArrow(
            _packed(ITEMS_PER_BLOCK, ["held", "vectors"]),
            f"id bigint, cell int, near double, far double, held array<{kinds['held']}>, vectors array<array<double>>")
    )
    first = chunks.groupBy("cell").agg(F.min_by("vectors", F.struct("near", "id")).alias("centroids"))
    reach = blocks.select("id", "cell", "far", "vectors").join(first, "cell").select(
        "id", "cell", "far", "vectors", "centroids"
    ).mapInArrow(_reach(pivots, radii), "block bigint, cell int, at double")
    met = reach.join(chunks, "cell").select(
        "block", (F.col("at") + F.col("near")).alias("at"), "cell", "near", "far",
        F.lit(None).cast(f"array<{kinds['held']}>").alias("held"), "vectors", "cids",
    )
    own = blocks.select(
        F.col("id").alias("block"), F.lit(-1.0).alias("at"), "cell", "near", "far", "held", "vectors",
        F.lit(None).cast("array<int>").alias("cids"),
    )
    stream = own.unionByName(met).repartition("block").sortWithinPartitions("block", "at")
    assigned = stream.mapInArrow(_visits(pivots), f"held {kinds['held']}, cid int")
    return assigned.select("cid", *[F.col("held").getField(c).alias(c) for c in others])


@dataclass(frozen=True)
class LargeKMeansModel:
    """Centroids ``(cid, vector)`` as a table, and how the loop got there."""

    centroids: DataFrame
    features: str | tuple[str, ...]
    size: int
    n_pivots: int
    passes: int
    changes: list[int] = field(default_factory=list)
    n_excluded: int = 0

    def assign(self, df: DataFrame, out: str = "cid") -> DataFrame:
        """``out`` beside all columns of ``df``; null for rows with a missing feature."""
        names = self.features if isinstance(self.features, str) else list(self.features)
        keep = [c for c in df.columns if c != out]
        held = F.struct(*map(quoted, keep)).alias("held")
        table, spec = feature_table(df, names, size=self.size, keep=[held])
        whole = table.filter(USABLE).select("held", spec.array.cast("array<double>").alias(VECTOR))
        assigned = assign_large(whole, self.centroids, self.n_pivots).select("cid", "held")
        missing = table.filter(~F.col(USABLE)).select(F.lit(None).cast("int").alias("cid"), "held")
        return assigned.unionByName(missing).select(
            F.col("cid").alias(out), *[F.col("held").getField(c).alias(c) for c in keep]
        )


def _means(assigned: DataFrame, size: int, k: int, empty: str) -> DataFrame:
    """Mean vectors by ``cid``; with ``zero``, the origin for clusters without rows."""
    mean = F.array(*[F.avg(F.col(VECTOR)[i]) for i in range(size)])
    means = assigned.groupBy("cid").agg(mean.alias("vector"))
    if empty == "zero":
        every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cid"))
        origin = F.array(*[F.lit(0.0)] * size)
        means = every.join(means, "cid", "left").select("cid", F.coalesce("vector", origin).alias("vector"))
    return means


def kmeans_fit_large(
    df: DataFrame,
    pk: str,
    features: str | Sequence[str],
    k: int,
    labelled: DataFrame,
    spec: Features,
    n_pivots: int,
    *,
    max_iter: int,
    changed_at_most: int | None,
    empty: str,
    n_excluded: int,
    arguments: dict,
    folder: str | None = None,
) -> LargeKMeansModel:
    """The loop over stored generations; ``labelled`` has the first clusters as ``__cid``.

    With a ``folder`` that holds generations of the same arguments, goes on from the last.
    """
    spark = df.sparkSession
    generations = Generations(spark, folder or new_folder(spark, "kmeans"))
    table, _ = feature_table(df, features, size=spec.size, keep=[quoted(pk).alias("pk")])
    items = table.filter(USABLE).select("pk", spec.array.cast("array<double>").alias(VECTOR))
    done = generations.numbers()
    if done:
        number = done[-1]
        facts = generations.facts(number)
        if facts["arguments"] != arguments:
            raise ValueError(f"{generations.folder} holds a loop with other arguments: {facts['arguments']}")
    else:
        number, facts = 1, {"arguments": arguments, "changes": [], "done": max_iter == 1}
        first = labelled.select(F.col("__cid").alias("cid"), spec.array.cast("array<double>").alias(VECTOR))
        generations.write(1, "centroids", _means(first, spec.size, k, empty))
        generations.commit(1, facts)
    while not facts["done"]:
        centroids = generations.read(number, "centroids")
        with_vectors = assign_large(items.withColumn("vector", F.col(VECTOR)), centroids, n_pivots)
        assigned = with_vectors.select("cid", "pk", F.col("vector").alias(VECTOR))
        changes = facts["changes"]
        if changed_at_most is not None:
            assigned = generations.write(number, "clusters", assigned)
            if number > 1:
                before = generations.read(number - 1, "clusters").select("pk", F.col("cid").alias("before"))
                moved = assigned.join(before, "pk").filter("cid <> before").count()
                changes = [*changes, moved]
                if moved <= changed_at_most:
                    facts = facts | {"changes": changes, "done": True}
                    generations.commit(number, facts)
                    break
        generations.write(number + 1, "centroids", _means(assigned, spec.size, k, empty))
        number, facts = number + 1, facts | {"changes": changes, "done": number + 1 >= max_iter}
        generations.commit(number, facts)
    return LargeKMeansModel(
        centroids=generations.read(number, "centroids"), features=features if isinstance(features, str) else tuple(features),
        size=spec.size, n_pivots=n_pivots, passes=number, changes=facts["changes"], n_excluded=n_excluded,
    )
