"""Array lifting: cartesian fan-out of array inputs and ordered collection of the outputs."""

from __future__ import annotations

from dataclasses import replace
from itertools import product
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.graph import Operator


def combinations(df: DataFrame, keys: list[str], number: str = "child") -> DataFrame:
    """One row for each combination of the keys' elements, the last key fastest; an empty or null array counts as one null.

    A chain of generators: rows are multiplied where they are, without a join or shuffle.
    """
    if not keys:
        raise ValueError("keys must not be empty")
    sizes = {k: F.greatest(F.lit(1), F.size(k)) for k in keys}
    out = df.select("*", *[sizes[k].cast("long").alias(f"_n_{k}") for k in keys])
    for k in keys:
        others = [c for c in out.columns if c != k]
        out = out.select(*others, F.posexplode_outer(k).alias(f"_p_{k}", k))
    index = F.lit(0).cast("long")
    for k in keys:
        index = index * F.col(f"_n_{k}") + F.coalesce(F.col(f"_p_{k}"), F.lit(0))
    return out.select(*df.columns, (index + 1).alias(number))


def collect(df: DataFrame, by: list[str], order: str, values: list[str], compat: bool = False) -> DataFrame:
    """Rows back to one row of arrays for each group, in order; null values keep their places, or with compat are left out.

    A group becomes one row, so it must fit in one: for groups beyond that use collect_parts.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *values)))
    out = df.groupBy(*by).agg(rows.alias("_rows"))
    got = lambda v: F.filter(F.col(f"_rows.{v}"), lambda x: x.isNotNull()) if compat else F.col(f"_rows.{v}")
    return out.select(*by, *[got(v).alias(v) for v in values])


def collect_parts(df: DataFrame, by: list[str], order: str, values: list[str], width: int) -> DataFrame:
    """As collect, with one row for each `width` steps of a whole-number order: (by, part, values). No group is too large."""
    parts = df.withColumn("part", F.floor(F.col(order) / width))
    return collect(parts, [*by, "part"], order, values)


def lift(op: Operator, keys: list[str]) -> Operator:
    """An operator that also takes arrays for its keys: it runs once for each combination, the last key fastest, and collects the outputs.

    An empty array counts as one None. The runs are children named <task>-child-1 and on; they are no part of the JSON.
    """
    if not keys:
        raise ValueError("keys must not be empty")

    def run(**values: Any) -> dict[str, Any]:
        lists = {k: v if isinstance(v := values.get(k), list) else [v] for k in keys}
        if not any(isinstance(values.get(k), list) for k in keys):
            return op.run(**values)
        outs = [op.run(**{**values, **dict(zip(keys, c))}) for c in product(*[x or [None] for x in lists.values()])]
        return {p.id: [o.get(p.id) for o in outs] for p in op.outputs}

    ports = [replace(p, kind="any") if p.id in keys else p for p in op.inputs]
    return Operator(f"{op.type}Lifted", run, ports, [replace(p, kind="any") for p in op.outputs], op.side_effects)


def children(task_id: str, n: int) -> list[str]:
    """The ids of a lifted task's runs."""
    return [f"{task_id}-child-{k}" for k in range(1, n + 1)]
