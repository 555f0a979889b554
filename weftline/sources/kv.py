"""Keyed tables: upsert, point get, equality search, scan, delete, count; and model catalogs over them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what names of tables and columns may be.
NAME = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_-]*$")


def last_write(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last by order: max_by needs no sort and combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def fingerprint(values: list[str]) -> Column:
    """SHA-256 of the row's JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(values))), 256)


def fingerprint_of(value: object, deep: bool = True) -> str:
    """SHA-256 of a value's JSON with the keys of all its objects in order, or of the outermost alone."""
    if not deep and isinstance(value, Mapping):
        text = json.dumps({k: value[k] for k in sorted(value)}, separators=(",", ":"), default=str)
    else:
        text = json.dumps(value, sort_keys=deep, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def checked_names(table: str | None, keys: list[str], values: list[str]) -> None:
    for name in [*([table] if table is not None else []), *keys, *values]:
        if not NAME.match(name):
            raise ValueError(f"{name!r} cannot be a name")
    both = {*keys} & {*values}
    if both:
        raise ValueError(f"{sorted(both)} would be both keys and values")


class KVTable:
    """An immutable view of a keyed table; every change gives a new one. Null keys are keys like any other."""

    def __init__(self, df: DataFrame, keys: list[str], searchable: list[str] | None = None, name: str | None = None):
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise ValueError(f"missing key columns {missing}")
        self.values = [c for c in df.columns if c not in keys]
        checked_names(name, keys, self.values)
        self.df, self.keys, self.name = df, keys, name
        self.searchable = {keys[0], *(searchable or [])}
        unknown = self.searchable - {*df.columns}
        if unknown:
            raise ValueError(f"searchable columns not in schema: {sorted(unknown)}")

    def _with(self, df: DataFrame) -> KVTable:
        return KVTable(df, self.keys, [*self.searchable], self.name)

    def put(self, rows: DataFrame, order: list[str] | None = None) -> KVTable:
        """Upsert: rows replace those with their keys. Of rows with one key the last by order stays (by all values, if none is given)."""
        new = last_write(rows.select(*self.df.columns, *[c for c in order or [] if c not in self.df.columns]), self.keys, order or self.values or self.keys).select(*self.df.columns)
        theirs = new.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys])
        return self._with(self.df.join(theirs, same, "left_anti").unionByName(new))

    def put_one(self, key: object, value: object) -> KVTable:
        """Upsert of one row: objects, or plain values where there is one key or one value column."""
        row = {**self.key_of(key), **self._object(value, self.values, "value")}
        return self.put(self.df.sparkSession.createDataFrame([tuple(row[c] for c in self.df.columns)], self.df.schema))

    def _object(self, value: object, columns: list[str], what: str) -> dict[str, object]:
        if isinstance(value, Mapping):
            self.ordered(value, columns)
            return dict(value)
        if len(columns) != 1:
            raise ValueError(f"a plain {what} needs exactly one {what} column, not {columns}")
        return {columns[0]: value}

    def key_of(self, key: object) -> dict[str, object]:
        return self._object(key, self.keys, "key")

    @staticmethod
    def ordered(row: Mapping[str, object], columns: list[str]) -> list[object]:
        """The row's values in the order of the columns, which it must have, and no others."""
        if {*row} != {*columns}:
            raise ValueError(f"the columns must be {columns}, not {sorted(row)}")
        return [row[c] for c in columns]

    def separate(self, combined: Mapping[str, object]) -> tuple[dict[str, object], dict[str, object]]:
        """A whole row as its key and its value."""
        return {k: combined[k] for k in self.keys}, {v: combined[v] for v in self.values}

    def separated(self) -> tuple[DataFrame, DataFrame]:
        return self.df.select(*self.keys), self.df.select(*self.values)

    def get(self, key: object) -> DataFrame:
        """The value columns of a key's row, with its key columns."""
        return self.df.filter(self._all(self.key_of(key)))

    def get_value(self, key: object) -> object:
        """The one value of a key, or None; for tables of one key and one value column."""
        if len(self.keys) != 1 or len(self.values) != 1:
            raise ValueError("plain values need exactly one key and one value column")
        row = self.get(key).first()
        return None if row is None else row[self.values[0]]

    def get_combined(self, keys: DataFrame) -> DataFrame:
        """Whole rows of many keys at once; keys without a row have none."""
        return self.df.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def search(self, where: Mapping[str, object]) -> DataFrame:
        unknown = [c for c in where if c not in self.df.columns]
        if unknown or not any(c in self.searchable for c in where):
            raise ValueError("search needs a searchable column")
        return self.df.filter(self._all(where))

    def delete(self, key: object) -> KVTable:
        return self._with(self.df.filter(~F.coalesce(self._all(self.key_of(key)), F.lit(False))))

    def delete_all(self) -> KVTable:
        return self._with(self.df.limit(0))

    def get_all(self) -> DataFrame:
        return self.df

    def size(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("size"))

    def _all(self, where: Mapping[str, object]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v).cast(self.df.schema[c].dataType)) for c, v in where.items()])


class ModelCatalog:
    """models(name, ...) and task_models(task, model); changes give a new catalog."""

    def __init__(self, models: DataFrame, task_models: DataFrame):
        self.models, self.task_models = models, task_models

    def add_models(self, rows: DataFrame) -> ModelCatalog:
        return ModelCatalog(KVTable(self.models, ["name"]).put(rows).get_all(), self.task_models)

    def connect(self, rows: DataFrame) -> ModelCatalog:
        """Connect tasks to models (task, model); a pair that is there already stays one."""
        keys = ["task", "model"]
        return ModelCatalog(self.models, self.task_models.select(*keys).unionByName(rows.select(*keys)).distinct())

    def models_by_task(self, task: object) -> DataFrame:
        names = self.task_models.filter(F.col("task") == task).select(F.col("model").alias("name")).distinct()
        return names.join(self.models, "name")

    def tasks_by_model(self, model: object) -> DataFrame:
        return self.task_models.filter(F.col("model") == model).select("task").distinct()

    def tasks(self) -> DataFrame:
        return self.task_models.select("task").distinct()

    def all_models(self) -> DataFrame:
        return self.models

    def by_name(self, name: object) -> DataFrame:
        return self.models.filter(F.col("name") == name)

    def size(self) -> DataFrame:
        return self.models.agg(F.count("*").alias("size"))

    def existing(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.join(self.models.select(F.col("name").alias(column)), column, "left_semi")

    def dangling(self) -> DataFrame:
        return self.task_models.join(self.models.select(F.col("name").alias("model")), "model", "left_anti")

    def ports(self, ports: Mapping[str, object]) -> DataFrame:
        """Every model with one column a port: its name where it is connected to the port's task, else null."""
        hit = [F.max(F.when(F.col("task") == task, F.col("model"))).alias(port) for port, task in ports.items()]
        of = self.task_models.groupBy(F.col("model").alias("name")).agg(*hit)
        return self.models.join(of, "name", "left")


_CATALOG: list[ModelCatalog | None] = [None]


def set_catalog(catalog: ModelCatalog) -> None:
    _CATALOG[0] = catalog


def get_catalog(spark: SparkSession | None = None) -> ModelCatalog:
    """The catalog in use; an empty one where none was set."""
    if _CATALOG[0] is None:
        spark = spark or SparkSession.getActiveSession()
        _CATALOG[0] = ModelCatalog(spark.createDataFrame([], "name string, provider string"), spark.createDataFrame([], "task string, model string"))
    return _CATALOG[0]


def seeds(spark: SparkSession) -> ModelCatalog:
    """A small catalog for the offline provider, with every model task connected."""
    models = [("offline-embed-64", "offline", 64, True), ("offline-text", "offline", None, False)]
    tasks = [("TextEmbeddingTask", "offline-embed-64")] + [(f"{t}Task", "offline-text") for t in ("TextGeneration", "TextRewriter", "TextSummary", "TextQuestionAnswer", "TextTranslation")]
    return ModelCatalog(spark.createDataFrame(models, "name string, provider string, nativeDimensions int, normalize boolean"), spark.createDataFrame(tasks, "task string, model string"))
