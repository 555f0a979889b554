"""Labelled documents for training: fold by crc32 of the id, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32(id as text) mod parts; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def training_labels(labels: DataFrame, label: str, parts: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y) of the rows outside the held-out fold: one per id (the larger label), nulls dropped."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    return rows.filter(fold("doc_id", parts) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))


def bounded_sample(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most per_class rows of each class, chosen by a hash of the id, and the sizes of the classes."""
    sizes = {y: n for y, n in labels.groupBy("y").count().collect()}
    parts = [labels.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), sizes
