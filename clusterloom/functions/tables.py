"""Whole-table functions for SQL.

``register_table_functions`` makes these callable from ``spark.sql``:

* ``knn_similarity(items => TABLE(...), queries => <array of word arrays>, k => 5)``
  gives the first column of the items and ``score``;
* ``nearest_centroid(items => TABLE(...), centroids => <array of vectors>, first_id => 0)``
  gives all columns of the items but the vector, and ``cid`` and ``dist2``;
* ``matrix_unnest(matrix)`` gives the rows ``(id, k)`` of an array of pairs, and
  ``matrix_rows(matrix)`` the rows ``(row, vector)`` of an array of arrays.

A table argument without PARTITION BY stays where it is: each task hands its own rows to
numpy, some thousand at a time. The array argument is what is shipped to all tasks; it is
checked to be small, and tables too large for it have the DataFrame forms. As with the
functions they stand for, a null array argument gives no rows, and a null inside is an
error; the columns of the result follow from the arguments' types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from clusterloom.functions.bits import WORD_MASK

ROWS_AT_A_TIME = 4096
#: Values of an array argument that are shipped to all tasks.
MAX_SHIPPED_VALUES = 1 << 22

_ROW_COLUMNS = "the table argument needs columns (id, array), the array last"


def _checked_table(items: AnalyzeArgument) -> list[T.StructField]:
    if not items.isTable or not isinstance(items.dataType, T.StructType):
        raise ValueError("items must be a TABLE argument")
    fields = items.dataType.fields
    if len(fields) < 2 or not isinstance(fields[-1].dataType, T.ArrayType):
        raise ValueError(_ROW_COLUMNS)
    return fields


def _checked_matrix(rows: list, name: str, kind) -> np.ndarray:
    if not rows or any(r is None or len(r) != len(rows[0]) or any(x is None for x in r) for r in rows) or not rows[0]:
        raise ValueError(f"{name} must be arrays of one length, at least one, without nulls")
    if len(rows) * len(rows[0]) > MAX_SHIPPED_VALUES:
        raise ValueError(f"{name} has more than {MAX_SHIPPED_VALUES} values; use the DataFrame form")
    return np.asarray(rows, dtype=kind)


def _words(rows: list, name: str) -> np.ndarray:
    return (_checked_matrix(rows, name, np.int64) & WORD_MASK).astype(np.uint32)


class _Buffered:
    """Hands rows on some thousand at a time; what is left when the input ends as well."""

    def __init__(self):
        self.rows: list = []
        self.given = None

    def _scored(self) -> Iterator[tuple]:
        raise NotImplementedError

    def _add(self, row) -> Iterator[tuple]:
        self.rows.append(tuple(row))
        if len(self.rows) >= ROWS_AT_A_TIME:
            yield from self._scored()
            self.rows = []

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from self._scored()
            self.rows = []


class KnnSimilarity(_Buffered):
    """``(id, score)``: the mean of an item's ``k`` best similarities to the queries."""

    @staticmethod
    def analyze(items: AnalyzeArgument, queries: AnalyzeArgument, k: AnalyzeArgument | None = None) -> AnalyzeResult:
        fields = _checked_table(items)
        kind = queries.dataType
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.ArrayType):
            raise ValueError("queries must be an array of word arrays")
        if k is not None and k.isConstantExpression and (k.value is None or k.value < 1):
            raise ValueError("k must be at least 1")
        return AnalyzeResult(T.StructType([
            T.StructField(fields[0].name, fields[0].dataType), T.StructField("score", T.FloatType())
        ]))

    def eval(self, items, queries, k=5):
        if queries is None or k is None:
            return
        if self.given is None:
            self.given, self.k = _words(queries, "queries"), k
            if not 1 <= k <= len(self.given):
                raise ValueError("k must lie between 1 and the number of queries")
        yield from self._add((items[0], items[-1]))

    def _scored(self):
        from clusterloom.operators.similarity import running_mean, top_scores

        items = _words([words for _, words in self.rows], "fingerprints")
        scores = running_mean(top_scores(items, self.given, self.k)).astype(np.float32)
        yield from zip((key for key, _ in self.rows), scores.tolist())


class NearestCentroid(_Buffered):
    """The items with ``cid`` and ``dist2`` instead of their vectors; null where it has nulls."""

    @staticmethod
    def analyze(
        items: AnalyzeArgument, centroids: AnalyzeArgument, first_id: AnalyzeArgument | None = None
    ) -> AnalyzeResult:
        fields = _checked_table(items)
        if not isinstance(centroids.dataType, T.ArrayType) or not isinstance(centroids.dataType.elementType, T.ArrayType):
            raise ValueError("centroids must be an array of vectors")
        return AnalyzeResult(T.StructType([
            *fields[:-1], T.StructField("cid", T.IntegerType()), T.StructField("dist2", T.DoubleType())
        ]))

    def eval(self, items, centroids, first_id=0):
        if centroids is None or first_id is None:
            return
        if self.given is None:
            self.given, self.first = _checked_matrix(centroids, "centroids", np.float64), first_id
        yield from self._add(items)

    def _scored(self):
        from clusterloom.functions.vectors import nearest_in_batch

        size = self.given.shape[1]
        usable = []
        for n, row in enumerate(self.rows):
            vector = row[-1]
            if vector is not None and len(vector) != size:
                raise ValueError(f"vectors must have {size} elements, as the centroids have")
            if vector is not None and all(x is not None and x == x for x in vector):
                usable.append(n)
        found = {}
        if usable:
            matrix = np.asarray([self.rows[n][-1] for n in usable], dtype=np.float64).T
            position, dist2 = nearest_in_batch(np.ascontiguousarray(matrix), self.given)
            found = dict(zip(usable, zip((position + self.first).tolist(), dist2.tolist())))
        for n, row in enumerate(self.rows):
            yield *row[:-1], *found.get(n, (None, None))


def register_table_functions(spark: SparkSession) -> None:
    """Registers the functions above in this session."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("knn_similarity", udtf(KnnSimilarity))
    spark.udtf.register("nearest_centroid", udtf(NearestCentroid))
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION matrix_unnest(matrix ARRAY<ARRAY<BIGINT>>)
        RETURNS TABLE(id BIGINT, k BIGINT)
        RETURN SELECT get(r, 0), get(r, 1) FROM explode(matrix) AS t(r)
    """)
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION matrix_rows(matrix ARRAY<ARRAY<DOUBLE>>)
        RETURNS TABLE(row INT, vector ARRAY<DOUBLE>)
        RETURN SELECT n, v FROM posexplode(matrix) AS t(n, v)
    """)
