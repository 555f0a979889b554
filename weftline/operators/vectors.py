"""Vector scoring and top-k retrieval as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

METRICS = ("reference", "cosine", "inner", "jaccard", "hamming")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Folded from the left in doubles, so results do not depend on the plan."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def magnitude(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """v / |v|; a zero vector raises."""
    size = magnitude(v)
    return F.when(size == 0, F.raise_error(F.lit("a zero vector has no direction"))).otherwise(F.transform(doubles(v), lambda x: x / size))


def inner(a: Column, b: Column) -> Column:
    """The distance 1 - a.b."""
    return F.lit(1.0) - dot(a, b)


def score(a: Column, b: Column, metric: str = "reference", both_normalized: bool = False) -> Column:
    """reference: 1 - inner/(|a||b|), or inner alone for normalized pairs; cosine: a.b/(|a||b|); jaccard, hamming: ours."""
    if metric == "reference":
        return inner(a, b) if both_normalized else F.lit(1.0) - inner(a, b) / (magnitude(a) * magnitude(b))
    if metric == "cosine":
        return dot(a, b) / (magnitude(a) * magnitude(b))
    if metric == "inner":
        return inner(a, b)
    if metric == "jaccard":
        return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    if metric == "hamming":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    raise ValueError(f"metric must be one of {METRICS}")


def against(corpus: DataFrame, query: DataFrame) -> DataFrame:
    """corpus with the one row of query: a broadcast of one row, which is checked when the plan runs."""
    one = query.agg(*[F.when(F.count("*") != 1, F.raise_error(F.lit("the query must be one row"))).otherwise(F.first(c)).alias(c) for c in query.columns])
    return corpus.crossJoin(F.broadcast(one))


def top_k(corpus: DataFrame, query: list[float] | DataFrame, k: int | None, vector: str = "embedding", tie: str = "vec_id", metric: str = "cosine") -> DataFrame:
    """Rows of corpus by descending score against one query: a list of numbers (a literal: no join) or a table of one row (query).

    With k one TakeOrdered; k None keeps all rows, without an order, which would sort the whole corpus.
    """
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    if isinstance(query, DataFrame):
        out = against(corpus, query).withColumn("score", score(F.col(vector), F.col("query"), metric)).drop("query")
    else:
        out = corpus.withColumn("score", score(F.col(vector), F.array(*[F.lit(float(x)) for x in query]), metric))
    return out if k is None else out.orderBy(F.desc("score"), tie).limit(k)


def top_k_of_each(corpus: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", tie: str = "vec_id", query_id: str = "query_id", query: str = "query", rows: int = 1024) -> DataFrame:
    """(query_id, tie, score): the k best by cosine for each query of a stated query table (query_id, query).

    The queries are read in blocks of `rows`, which bounds what a task is sent; each block meets every Arrow batch
    of the corpus in one matrix product, which keeps k for each query; then k of those few.
    """
    kind = queries.schema[query_id].dataType.simpleString()
    tie_kind = corpus.schema[tie].dataType.simpleString()
    src = corpus.select(F.col(tie).alias("t"), doubles(F.col(vector)).alias("v"))

    def block(ids: list[Any], q: np.ndarray) -> DataFrame:
        size = np.linalg.norm(q, axis=1)

        def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    v, t = np.stack(pdf["v"].to_numpy()), pdf["t"].to_numpy()
                    scores = (q @ v.T) / np.outer(size, np.linalg.norm(v, axis=1))
                    top = [np.lexsort((t, -s))[:k] for s in scores]
                    yield pd.DataFrame({query_id: np.repeat(np.array(ids), [len(x) for x in top]), tie: t[np.concatenate(top)], "score": np.concatenate([s[x] for s, x in zip(scores, top)])})

        return src.mapInPandas(best, f"{query_id} {kind}, {tie} {tie_kind}, score double")

    found: list[DataFrame] = []
    held: list[Any] = []
    for row in queries.select(query_id, doubles(F.col(query)).alias("x")).toLocalIterator():
        held.append(row)
        if len(held) == rows:
            found.append(block([r[0] for r in held], np.array([r[1] for r in held], float)))
            held = []
    if held or not found:
        found.append(block([r[0] for r in held], np.array([r[1] for r in held], float).reshape(len(held), -1)) if held else corpus.limit(0).select(F.lit(None).cast(kind).alias(query_id), tie, F.lit(0.0).alias("score")))
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), tie))
    return reduce(DataFrame.unionByName, found).withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def checked_vectors(df: DataFrame, columns: list[str], normalized: list[str] | None = None) -> DataFrame:
    """df, whose vectors must not be empty, must be of one length in each row and, where flags are named, all normalized or none."""
    first = columns[0]
    bad = [F.when(F.size(first) < 1, F.raise_error(F.lit("a vector is empty")))]
    bad += [F.when(F.size(c) != F.size(first), F.raise_error(F.lit("vectors differ in length"))) for c in columns[1:]]
    bad += [F.when(F.col(n) != F.col(normalized[0]), F.raise_error(F.lit("some vectors are normalized, others not"))) for n in (normalized or [])[1:]]
    return df.filter(F.coalesce(*[b.cast("boolean") for b in bad], F.lit(True)))


def mean_pooled(vectors: Column, normal: bool = False) -> Column:
    """The mean of an array of vectors (of tokens), normalized if wanted."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), doubles(F.get(vectors, F.lit(0))), lambda s, v: F.zip_with(s, doubles(v), lambda a, b: a + b))
    mean = F.transform(total, lambda x: x / F.size(vectors))
    return normalize(mean) if normal else mean


def checked_dimension(v: Column, native: int) -> Column:
    return F.when(F.size(v) == native, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {native} dimensions, got "), F.size(v).cast("string"))))
