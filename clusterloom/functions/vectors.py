"""Feature vectors: cleaning, distances and nearest centre, with no shuffle.

A feature set is either several numeric columns or one array column of fixed
length.  Few centre values are written into the expression, which stays inside
whole-stage codegen; many go through numpy on Arrow batches, because generated
code beyond the JIT's method limit runs several times slower.  Both add the
squared differences in feature order, so distances agree to the last bit. Means
do not: numpy and ``avg`` add rows in different order, so centroids of the two
forms may differ in the last bits, and a row on a border in its cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest (centres x features) written out as generated code.
UNROLL_LIMIT = 64
# Rows x centres in one numpy block of a task: few enough to stay in the CPU cache.
BLOCK_CELLS = 1 << 15

VECTOR = "__v"
USABLE = "__usable"


@dataclass(frozen=True)
class Features:
    """Working columns of a feature set, as laid out by :func:`feature_table`."""

    size: int
    is_array: bool

    @property
    def columns(self) -> list[str]:
        return [VECTOR] if self.is_array else [f"__f{i}" for i in range(self.size)]

    @property
    def elements(self) -> list[str]:
        """SQL of every single feature."""
        if self.is_array:
            return [f"{VECTOR}[{i}]" for i in range(self.size)]
        return self.columns

    @property
    def array(self) -> Column:
        return F.col(VECTOR) if self.is_array else F.array(*self.columns)

    def values(self, row) -> list[float]:
        return list(row[VECTOR]) if self.is_array else [row[c] for c in self.columns]


def feature_table(
    df: DataFrame,
    features: str | Sequence[str],
    keep: Sequence[str | Column] = ("*",),
    size: int | None = None,
) -> tuple[DataFrame, Features]:
    """``keep`` columns, the features, and whether none is missing.

    Only these columns are read from the source.  A null or NaN feature makes
    the row unusable; an array of another length than ``size`` (by default, the
    length of the first one) is an error.
    """
    if isinstance(features, str):
        if size is None:
            head = df.filter(F.col(features).isNotNull()).select(F.size(features)).first()
            size = head[0] if head else 0
        spec = Features(size=size, is_array=True)
        column = F.col(features)
        checked = F.when(F.size(column) != spec.size, F.raise_error(F.lit(
            f"arrays in {features} must all have {spec.size} elements"
        ))).otherwise(column)
        if not isinstance(df.schema[features].dataType.elementType, T.FloatType | T.DoubleType):
            checked = checked.cast(T.ArrayType(T.DoubleType()))
        # single precision stays as it is: half the bytes, and arithmetic widens it
        values = [checked.alias(VECTOR)]
        usable = F.col(VECTOR).isNotNull() & F.forall(
            VECTOR, lambda x: x.isNotNull() & ~F.isnan(x)
        )
    else:
        spec = Features(size=len(features), is_array=False)
        values = [
            F.col(name).cast("double").alias(out)
            for name, out in zip(features, spec.columns)
        ]
        usable = F.lit(True)
        for name in spec.columns:
            usable = usable & F.col(name).isNotNull() & ~F.isnan(name)
    table = df.select(*keep, *values)
    return table.withColumn(USABLE, F.coalesce(usable, F.lit(False))), spec


def filled(table: DataFrame, spec: Features) -> DataFrame:
    """The table with zeros for the features of unusable rows, which keeps their rows countable."""
    usable = F.col(USABLE)
    if spec.is_array:
        kind = table.schema[VECTOR].dataType.elementType
        zeros = F.array_repeat(F.lit(0).cast(kind), spec.size)
        return table.withColumn(VECTOR, F.when(usable, F.col(VECTOR)).otherwise(zeros))
    return table.withColumns({c: F.when(usable, F.col(c)).otherwise(F.lit(0.0)) for c in spec.columns})


def sql_double(x: float) -> str:
    return f"{float(x)!r}D"


def squared_distance_sql(elements: Sequence[str], centre: Sequence[float]) -> str:
    return " + ".join(
        f"({e} - {sql_double(c)}) * ({e} - {sql_double(c)})" for e, c in zip(elements, centre)
    )


def batch_matrix(vectors: pa.Array) -> np.ndarray:
    """An Arrow list array of equal lengths as a (features x rows) matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(vectors), -1).T, dtype=np.float64)


def block_distances(matrix: np.ndarray, centres: np.ndarray):
    """Yield (row slice, squared distances centres x rows) in bounded blocks."""
    rows = matrix.shape[1]
    step = max(1, BLOCK_CELLS // len(centres))
    for lo in range(0, rows, step):
        part = slice(lo, min(lo + step, rows))
        total = np.zeros((len(centres), part.stop - part.start))
        difference = np.empty_like(total)
        for values, coordinate in zip(matrix[:, part], centres.T):
            np.subtract(values[None, :], coordinate[:, None], out=difference)
            np.multiply(difference, difference, out=difference)
            total += difference
        yield part, total


def nearest_in_batch(matrix: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest centre (lowest on ties) and its squared distance."""
    position = np.empty(matrix.shape[1], dtype=np.int32)
    dist2 = np.empty(matrix.shape[1])
    for part, distances in block_distances(matrix, centres):
        position[part] = distances.argmin(axis=0)
        dist2[part] = distances.min(axis=0)
    return position, dist2


def unrolls(spec: Features, n_centres: int) -> bool:
    return n_centres * spec.size <= UNROLL_LIMIT


def with_nearest_dist2(
    df: DataFrame, spec: Features, centres: Sequence[Sequence[float]], out: str
) -> DataFrame:
    """Add the squared distance to the nearest of ``centres``."""
    if unrolls(spec, len(centres)):
        distances = [squared_distance_sql(spec.elements, c) for c in centres]
        sql = distances[0] if len(distances) == 1 else f"least({', '.join(distances)})"
        return df.withColumn(out, F.expr(sql))
    matrix = np.asarray(centres, dtype=np.float64)

    @F.arrow_udf("double")
    def nearest_dist2(vectors: pa.Array) -> pa.Array:
        return pa.array(nearest_in_batch(batch_matrix(vectors), matrix)[1])

    return df.withColumn(out, nearest_dist2(spec.array))


def nearest_sql(spec: Features, ids: Sequence[int], centres: Sequence[Sequence[float]]) -> tuple[str, str]:
    """SQL of all squared distances, and of the nearest id given them as ``{ds}``."""
    distances = ", ".join(squared_distance_sql(spec.elements, c) for c in centres)
    names = ", ".join(str(int(i)) for i in ids)
    position = "cast(array_position({ds}, array_min({ds})) AS INT)"
    return f"array({distances})", f"element_at(array({names}), {position})"


def with_nearest(
    df: DataFrame, spec: Features, ids: Sequence[int], centres: Sequence[Sequence[float]], out: str
) -> DataFrame:
    """Add the id of the nearest of ``centres``; the lowest id wins a tie.

    ``ids`` must ascend, so that the first position is also the lowest id.
    """
    if unrolls(spec, len(centres)):
        distances, nearest = nearest_sql(spec, ids, centres)
        with_all = df.withColumn("__ds", F.expr(distances))
        return with_all.withColumn(out, F.expr(nearest.format(ds="__ds"))).drop("__ds")
    matrix = np.asarray(centres, dtype=np.float64)
    labels = np.asarray(ids, dtype=np.int32)

    @F.arrow_udf("int")
    def nearest_id(vectors: pa.Array) -> pa.Array:
        return pa.array(labels[nearest_in_batch(batch_matrix(vectors), matrix)[0]])

    return df.withColumn(out, nearest_id(spec.array))
