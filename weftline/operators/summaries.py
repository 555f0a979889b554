"""Aggregations that the platform's tasks use: distinct in order, unions, truth over rows, latest and count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, first_seen): each value once, with the place where it came first."""
    return df.groupBy(column).agg(F.min(order).alias("first_seen"))


def bag_union(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, repeated ones too."""
    return reduce(DataFrame.unionByName, tables)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def all_of(test: Column) -> Column:
    """Whether the test holds in all rows; it holds in none of no rows."""
    return F.coalesce(F.bool_and(test), F.lit(True))


def any_of(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def mean(x: Column) -> Column:
    return F.avg(x)


def latest_and_count(df: DataFrame, key: str, at: str) -> DataFrame:
    """(key, latest, n) in one pass."""
    return df.groupBy(key).agg(F.max(at).alias("latest"), F.count("*").alias("n"))
