"""Rows as matrices, and back.

One value with all rows of a table would have to fit into one task, so a matrix comes in
blocks of bounded height, each of consecutive rows in the order of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.ordered import global_row_number, quoted

HEIGHT = 4096


def matrix_blocks(df: DataFrame, pk: str, columns: Sequence[str], height: int = HEIGHT) -> DataFrame:
    """``(block, first_row, ids, matrix)``: ``height`` rows of ``columns`` at a time, in order of ``pk``.

    ``first_row`` counts from 1; ``ids`` are the keys of the rows and ``matrix`` their
    values, by row, as doubles. A null value, or a null key, is an error, as matrices have
    none. Blocks are full but for the last; an empty table has none.
    """
    if height < 1 or not columns:
        raise ValueError("a block needs at least one row and one column")
    missing = quoted(pk).isNull()
    for c in columns:
        missing = missing | quoted(c).isNull()
    values = F.array(*[quoted(c).cast("double") for c in columns])
    error = F.raise_error(F.lit("a matrix cannot hold nulls"))
    rows = df.select(quoted(pk).alias("id"), F.when(missing, error).otherwise(values).alias("v"))
    numbered = global_row_number(rows, ["id"], "n")
    block = F.expr(f"(n - 1) div {height}").alias("block")
    in_order = F.array_sort(F.collect_list(F.struct("n", "id", "v"))).alias("rows")
    return numbered.groupBy(block).agg(in_order).select(
        "block", F.col("rows")[0]["n"].alias("first_row"), F.col("rows.id").alias("ids"), F.col("rows.v").alias("matrix")
    )


def rows_of_blocks(blocks: DataFrame, pk: str, columns: Sequence[str]) -> DataFrame:
    """The rows of :func:`matrix_blocks`, with their numbers as ``row``."""
    together = F.arrays_zip("ids", "matrix")
    rows = blocks.select("first_row", F.posexplode(together).alias("at", "r"))
    return rows.select(
        (F.col("first_row") + F.col("at")).alias("row"), F.col("r.ids").alias(pk),
        *[F.col("r.matrix")[i].alias(c) for i, c in enumerate(columns)],
    )
