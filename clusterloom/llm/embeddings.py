"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are turned by a seeded random rotation and kept as one sign bit for
each dimension, with two stored factors: the cosine between vector and code, and
the tangent of that angle. For a vector q and a coded vector o the dot product of
q with the code, over the stored cosine, is an unbiased estimate of the cosine of
o and q. It is off by at most ``tan(angle) * sin(o, q)``, so that

* an estimate below ``c - tan * sqrt(1 - c * c)`` proves the pair to be under the
  threshold c,
* a dot product above ``cos(acos(c) - angle)`` proves it to be over,
* and only the pairs between are computed again, in double precision.

Equal vectors are one class. The classes of a label are parted into cells around
pivots, cells into blocks of a bounded number of classes, and only blocks whose
cells come close enough are compared, each pair of blocks in its own task. From a
pair of blocks come sums of links for each class and the few links that connect
them, never the linked pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import cut_lineage
from clusterloom.llm.common import connected_components

THRESHOLD = 0.93
SEED = 7
#: Classes in a block; two blocks meet in a task.
BLOCK_SIZE = 2048
#: Vectors that serve as centres of cells. They steer which blocks are compared,
#: by bounds that always hold, and have no part in the result.
PIVOTS = 256
#: Room for the rounding of single-precision dot products.
_SLACK = 1e-5


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, packed sign bits, and cosines between vectors and codes."""
    turned = unit @ turn
    signs = turned > 0
    factor = np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])
    return turned, np.packbits(signs, axis=1), factor


def decode(codes: np.ndarray, size: int) -> np.ndarray:
    """Unit vectors of the codes, in single precision."""
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32)
    return (2 * signs - 1) / np.float32(np.sqrt(size))


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions in a and b of the pairs with cosine >= threshold, and how many were recomputed."""
    size = a.shape[1]
    unit_a, unit_b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    turned, _, _ = encode(unit_b, turn)
    _, codes, factor = encode(unit_a, turn)
    dots = decode(codes, size) @ turned.T.astype(np.float32)
    factor = np.minimum(factor, 1.0)
    angle = np.arccos(factor)
    estimate_least = threshold - np.tan(angle) * np.sqrt(1 - threshold**2)
    possible = dots >= (factor * estimate_least - _SLACK)[:, None]
    left, right = np.nonzero(possible)
    certain = np.where(angle < np.arccos(threshold), np.cos(np.arccos(threshold) - angle), 2.0)
    sure = dots[left, right] > certain[left] + _SLACK
    open_left, open_right = left[~sure], right[~sure]
    exact = np.empty(len(open_left))
    for start in range(0, len(exact), 1 << 16):
        part = slice(start, start + (1 << 16))
        exact[part] = np.einsum("ij,ij->i", unit_a[open_left[part]], unit_b[open_right[part]])
    found = exact >= threshold
    return (
        np.concatenate([left[sure], open_left[found]]),
        np.concatenate([right[sure], open_right[found]]),
        len(exact),
    )


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Largest component 1, so that squares neither overflow nor vanish."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


class _Groups:
    """Disjoint sets of the positions in a pair of blocks."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _compare(threshold: float, seed: int):
    """Links of one pair of blocks; a block paired with itself is compared within."""

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pair["vector"].to_numpy()).astype(np.float64)
        ids, weight = pair["rep"].to_numpy(), pair["copies"].to_numpy()
        first = np.flatnonzero(pair["side"].to_numpy() == 0)
        second = np.flatnonzero(pair["side"].to_numpy() == 1)
        within = len(second) == 0
        if within:
            second = first
        turn, groups = rotation(vectors.shape[1], seed), _Groups(len(ids))
        links, edges = np.zeros(len(ids), dtype=np.int64), []
        for start in range(0, len(first), 512):
            rows = first[start : start + 512]
            other = second[start:] if within else second
            left, right, _ = close_pairs(vectors[rows], vectors[other], threshold, turn)
            left, right = rows[left], other[right]
            if within:
                left, right = left[left < right], right[left < right]
            np.add.at(links, left, weight[right])
            np.add.at(links, right, weight[left])
            # most pairs of a dense group say nothing new
            roots = np.fromiter(map(groups.find, range(len(ids))), np.int64, len(ids))
            new = roots[left] != roots[right]
            pairs = np.unique(np.stack([roots[left[new]], roots[right[new]]]), axis=1)
            edges += [(a, b) for a, b in pairs.T.tolist() if groups.join(a, b)]
        linked = np.flatnonzero(links)
        a = np.array([ids[x] for x, _ in edges], dtype=np.int64)
        b = np.array([ids[y] for _, y in edges], dtype=np.int64)
        return pd.DataFrame({
            "rep": np.concatenate([ids[linked], a]),
            "links": np.concatenate([links[linked], np.zeros(len(a), dtype=np.int64)]),
            "to": pd.array([None] * len(linked) + b.tolist(), dtype="Int64"),
        })

    return run


def _cells(pivots: np.ndarray):
    """For each class its cell, the nearest of the first pivots, and the angle to it."""

    def run(batches):
        for batch in batches:
            vectors = _scaled(np.stack(batch["vector"].to_numpy()))
            n_cells = batch["n_cells"].to_numpy()
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            dots = np.where(np.arange(len(pivots)) < n_cells[:, None], unit @ pivots.T, -2.0)
            cell = dots.argmax(axis=1)
            near = np.clip(dots[np.arange(len(cell)), cell], -1, 1)
            yield batch.assign(vector=list(vectors), cell=cell, angle=np.arccos(near)).drop(columns="n_cells")

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                           label_col: str = "label", threshold: float = THRESHOLD,
                           block_size: int = BLOCK_SIZE, seed: int = SEED) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Vectors of equal, known label link with cosine >= ``threshold``. ``n_links``
    counts the other rows linked directly, copies included; ``component_id`` is
    the smallest id that links reach, and ``kept`` marks the row that has it.

    A vector that is null, empty or zero, or holds a null, NaN or infinity, links
    with nothing, and so do vectors of different length or of a null label; such
    a row is its own component. Rows with a null id have a null component unless
    linked to one with an id. Repeated rows are copies: each links to the others,
    and all that have the smallest id are kept.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    # finite: neither null nor NaN nor infinite, which x - x = 0 says at once
    valid = F.coalesce(
        F.forall("vector", lambda x: F.coalesce((x - x) == 0, F.lit(False)))
        & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull(),
        F.lit(False),
    )
    rows = rows.withColumn("vector", F.when(valid, F.col("vector")))
    known = F.col("vector").isNotNull()
    classes = cut_lineage(
        rows.filter(known).groupBy("label", "vector")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        # the class is named by a number of its own, as ids may be null or repeated
        .withColumn("rep", F.monotonically_increasing_id())
    )
    # one rotation for each length of vector, and cells for each label by its size
    sizes = classes.withColumn("dim", F.size("vector")).groupBy("label", "dim").agg(
        F.count(F.lit(1)).alias("n")
    )
    n_cells = F.greatest(F.lit(1), F.least(F.lit(PIVOTS), F.col("n") / block_size)).cast("int")
    sized = classes.select("rep", "label", "copies", F.size("vector").alias("dim"), "vector").join(
        sizes.select("label", "dim", n_cells.alias("n_cells")), ["label", "dim"]
    )
    kind = dict(classes.dtypes)["label"]
    found = spark.createDataFrame([], "rep long, links long, to long")
    for dim in [r.dim for r in sizes.select("dim").distinct().orderBy("dim").collect()]:
        own = sized.filter(F.col("dim") == dim)
        most = sizes.filter(F.col("dim") == dim).agg(F.max(n_cells)).first()[0]
        picked = own.orderBy(F.xxhash64("vector"), "rep").limit(most).select("vector").collect()
        pivots = _scaled(np.array([r.vector for r in picked]))
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
        celled = own.mapInPandas(
            _cells(pivots),
            f"label {kind}, dim int, rep long, copies long, vector array<double>, cell int, angle double",
        )
        between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
        found = found.unionByName(_linked(celled, between, threshold, block_size, seed))
    found = cut_lineage(found)
    links = found.filter("to IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("to IS NOT NULL"), "rep", "to")
    named = (
        classes.join(links, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(
        "label", "vector", "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    linked = rows.filter(known).join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.filter(~known).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _linked(celled: DataFrame, between: np.ndarray, threshold: float, block_size: int, seed: int) -> DataFrame:
    """``(rep, links, to)`` of the classes of one vector length."""
    counts = celled.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    n_blocks = F.ceil(F.col("n") / block_size).cast("int")
    cells = cut_lineage(counts.select("label", "cell", "radius", n_blocks.alias("n_blocks")))
    blocks = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    a = blocks.select("label", *[F.col(c).alias(f"{c}_a") for c in ("cell", "radius", "block")])
    b = blocks.select("label", *[F.col(c).alias(f"{c}_b") for c in ("cell", "radius", "block")])
    # at most PIVOTS * PIVOTS rows
    n = len(between)
    angles = celled.sparkSession.createDataFrame(pd.DataFrame({
        "cell_a": np.repeat(np.arange(n, dtype=np.int32), n),
        "cell_b": np.tile(np.arange(n, dtype=np.int32), n),
        "apart": between.ravel(),
    }))
    # two vectors of linked cells are no further apart than this
    reach = F.col("radius_a") + F.col("radius_b") + float(np.arccos(threshold)) + _SLACK
    same_cell = F.col("cell_a") == F.col("cell_b")
    ordered = (F.col("cell_a") < F.col("cell_b")) | (same_cell & (F.col("block_a") <= F.col("block_b")))
    pairs = a.join(b, "label").filter(ordered).join(F.broadcast(angles), ["cell_a", "cell_b"])
    pairs = pairs.filter(same_cell | (F.col("apart") <= reach))
    itself = same_cell & (F.col("block_a") == F.col("block_b"))
    name = F.struct("label", "cell_a", "block_a", "cell_b", "block_b").alias("pair")
    sides = pairs.select(
        "label", name,
        F.explode(F.when(itself, F.array(F.struct(F.lit(0).alias("side"), F.col("cell_a").alias("cell"), F.col("block_a").alias("block"))))
                  .otherwise(F.array(
                      F.struct(F.lit(0).alias("side"), F.col("cell_a").alias("cell"), F.col("block_a").alias("block")),
                      F.struct(F.lit(1).alias("side"), F.col("cell_b").alias("cell"), F.col("block_b").alias("block"))))).alias("s"),
    ).select("label", "pair", "s.side", "s.cell", "s.block")
    placed = celled.join(cells.select("label", "cell", "n_blocks"), ["label", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")
    )
    met = placed.join(sides, ["label", "cell", "block"]).select("pair", "side", "rep", "copies", "vector")
    return met.groupBy("pair").applyInPandas(_compare(threshold, seed), "rep long, links long, to long")
