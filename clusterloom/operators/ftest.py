"""F-tests for equal variance between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.fdist import f_quantile_udf


def _summed(values: str | Sequence[str] | Column) -> Column:
    if isinstance(values, Column):
        return values
    names = [values] if isinstance(values, str) else list(values)
    total = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return total


def group_variance(df: DataFrame, group: str, values: str | Sequence[str] | Column) -> DataFrame:
    """``(group, n, var)``: row count and sample variance of the summed values."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp(_summed(values)).alias("var")
    )


def _with_test(pairs: DataFrame, alpha: float) -> DataFrame:
    """Add ``f``, its acceptance bounds and the verdict to two-group rows."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    df1 = (F.col("n1") - 1).cast("double")
    df2 = (F.col("n2") - 1).cast("double")
    return (
        pairs.withColumn("f", F.try_divide("var1", "var2"))
        .withColumn("lower", f_quantile_udf(F.lit(alpha / 2), df1, df2))
        .withColumn("upper", f_quantile_udf(F.lit(1 - alpha / 2), df1, df2))
        .withColumn("accept", F.col("f").between(F.col("lower"), F.col("upper")))
    )


def f_test_two_groups(
    df: DataFrame,
    group: str,
    values: str | Sequence[str] | Column,
    numerator: object,
    denominator: object,
    alpha: float = 0.05,
) -> DataFrame:
    """One row ``(n1, var1, n2, var2, f, lower, upper, accept)``."""
    chosen = df.filter(F.col(group).isin(numerator, denominator))
    stats = group_variance(chosen, group, values)

    def of(name: object, column: str) -> Column:
        return F.max(F.when(F.col(group) == F.lit(name), F.col(column)))

    pair = stats.agg(
        of(numerator, "n").alias("n1"),
        of(numerator, "var").alias("var1"),
        of(denominator, "n").alias("n2"),
        of(denominator, "var").alias("var2"),
    )
    return _with_test(pair, alpha)


def f_test_pairs(
    df: DataFrame,
    group: str,
    values: str | Sequence[str] | Column,
    pairs: DataFrame,
    alpha: float = 0.05,
) -> DataFrame:
    """The test for each row ``(group1, group2)`` of ``pairs``; one row for each."""
    stats = group_variance(df, group, values)

    def side(n: int) -> DataFrame:
        return stats.select(
            F.col(group).alias(f"group{n}"), F.col("n").alias(f"n{n}"), F.col("var").alias(f"var{n}")
        )

    chosen = pairs.select("group1", "group2")
    return _with_test(chosen.join(side(1), "group1").join(side(2), "group2"), alpha)


def f_test_vs_control(
    df: DataFrame,
    group: str,
    values: str | Sequence[str] | Column,
    control: object,
    alpha: float = 0.05,
) -> DataFrame:
    """The test of every other group, as ``group1``, against ``control``.

    The control's one row of statistics is looked up first; it is part of every
    result row.
    """
    stats = group_variance(df, group, values)
    found = stats.filter(F.col(group) == F.lit(control)).first()
    if found is None:
        raise ValueError(f"there is no group {control!r}")
    others = stats.filter(F.col(group) != F.lit(control)).select(
        F.col(group).alias("group1"), F.lit(control).cast(df.schema[group].dataType).alias("group2"),
        F.col("n").alias("n1"), F.col("var").alias("var1"),
        F.lit(found["n"]).alias("n2"), F.lit(found["var"]).cast("double").alias("var2"),
    )
    return _with_test(others, alpha)
