"""Row choice by key, two-way differences, paging, conditional counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order (the latest, with descending columns); all columns stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def unique_only(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and value of the keys that have exactly one distinct value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and change: added (right only) or removed (left only)."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(True))
    both = a.join(b, list(keys), "full_outer").where("__l IS NULL OR __r IS NULL")
    return both.select(*keys, F.when(F.col("__l").isNull(), "added").otherwise("removed").alias("change"))


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """One page in total order, with the total number of rows and whether more follow; the total is an aggregate of its own, so no window gathers all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("total", total).withColumn("truncated", F.col("total") > offset + limit)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sorted_set(c: Column | str) -> Column:
    """Distinct values in order, as one string."""
    return F.array_join(F.array_sort(F.collect_set(c)), ",")
