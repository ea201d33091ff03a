"""Rounding and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def signed(value: Column, digits: int | None = None) -> Column:
    """A number with its sign, whole or with so many decimals (halves to even)."""
    return F.format_string("%+d", value) if digits is None else F.format_string(f"%+.{digits}f", F.bround(value, digits))


def nearest_rank(rows: DataFrame, group: str, value: str, q: float, name: str, times: Column | None = None) -> DataFrame:
    """For each group the value at the index round_half_even((n - 1) * q) of its sorted values. times: how often a row counts, once without.

    Values are counted first, so that the window runs over distinct values, not over rows.
    """
    counts = rows.groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg((F.count("*") if times is None else F.sum(times)).alias("n"))
    upto = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("every", F.sum("n").over(Window.partitionBy("g")))
    index = F.when(F.lit(q) <= 0, 0).when(F.lit(q) >= 1, F.col("every") - 1).otherwise(F.bround((F.col("every") - 1) * F.lit(q), 0).cast("long"))
    return ranked.filter(F.col("upto") > index).groupBy(F.col("g").alias(group)).agg(F.min("v").alias(name))
