"""Stores that outlive a session, behind the keyed-table interface, and the repositories on top of them."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from weftline.plans.graph import Emitter, TaskGraph
from weftline.sources.kv import KVTable, checked_names, fingerprint, fingerprint_of
from weftline.sources.shared import remove


class ParquetKV:
    """A keyed table as Parquet versions under a path: every change writes the next version, the newest whole one counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], searchable: list[str] | None = None):
        self.spark, self.path, self.keys, self.searchable = spark, path.rstrip("/"), keys, searchable
        self.empty = spark.createDataFrame([], schema)
        self.table()  # checks names

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        whole = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in whole)

    def table(self) -> KVTable:
        held = self._versions()
        df = self.spark.read.schema(self.empty.schema).parquet(f"{self.path}/v{held[-1]}") if held else self.empty
        return KVTable(df, self.keys, self.searchable)

    def _write(self, table: KVTable) -> None:
        held = self._versions()
        table.df.write.parquet(f"{self.path}/v{(held[-1] if held else 0) + 1}")
        for old in held[:-1]:  # readers of the version before go on
            remove(self.spark, f"{self.path}/v{old}")

    def put(self, rows: DataFrame, order: list[str] | None = None) -> None:
        self._write(self.table().put(rows, order))

    def put_one(self, key: object, value: object) -> None:
        self._write(self.table().put_one(key, value))

    def delete(self, key: object) -> None:
        self._write(self.table().delete(key))

    def delete_all(self) -> None:
        self._write(self.table().delete_all())

    def get(self, key: object) -> DataFrame:
        return self.table().get(key)

    def get_value(self, key: object) -> object:
        return self.table().get_value(key)

    def search(self, where: Mapping[str, object]) -> DataFrame:
        return self.table().search(where)

    def get_all(self) -> DataFrame:
        return self.table().get_all()

    def size(self) -> int:
        return self.table().size().first()[0]


class FileKV:
    """One folder of JSON for each key, named by the key's fingerprint, so a point read lists one folder only."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.values = [c for c in self.schema.names if c not in keys]
        checked_names(None, keys, self.values)

    def put(self, rows: DataFrame) -> None:
        rows = KVTable(rows.limit(0).select(*self.schema.names), self.keys).put(rows).df
        hashed = rows.withColumn("key_hash", fingerprint(self.keys))
        hashed.repartition("key_hash").write.partitionBy("key_hash").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(self.path)

    def _hash(self, key: Mapping[str, object]) -> str:
        row = self.spark.createDataFrame([tuple(key[k] for k in self.keys)], StructType([self.schema[k] for k in self.keys]))
        return row.select(fingerprint(self.keys)).first()[0]

    def _rows(self) -> DataFrame:
        """Files that cannot be read as rows are left out."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema).withColumn("key_hash", F.lit(""))
        return self.spark.read.schema(self.schema).option("mode", "DROPMALFORMED").json(self.path)

    def _exists(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def get(self, key: Mapping[str, object]) -> DataFrame:
        return self._rows().filter(F.col("key_hash") == self._hash(key)).select(*self.values)

    def get_all(self) -> DataFrame:
        """The values of all keys."""
        return self._rows().select(*self.values)

    def delete(self, key: Mapping[str, object]) -> None:
        remove(self.spark, f"{self.path}/key_hash={self._hash(key)}")

    def delete_all(self) -> None:
        remove(self.spark, self.path)

    def size(self) -> int:
        return self._rows().count()

    def search(self, where: Mapping[str, object]) -> DataFrame:
        raise NotImplementedError("files are found by key alone")


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """format("weftline_sqlite"): options path, table; keys (comma-separated) for writing; parts for reading.

    The file must be in a place that the driver and all executors share. Reads are split by rowid.
    Writes of one table are upserts, in one transaction for each task.
    """

    @classmethod
    def name(cls) -> str:
        return "weftline_sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary", "BOOLEAN": "boolean"}
        with sqlite3.connect(self.options["path"]) as db:
            rows = db.execute(f"PRAGMA table_info(\"{self.options['table']}\")").fetchall()
        return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in rows)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _SqliteWriter(dict(self.options), schema, overwrite)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(self.options["path"]) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM \"{self.options['table']}\"").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high + 1 - low) // int(self.options.get("parts", "8"))))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        columns = ", ".join(f'"{f.name}"' for f in self.schema)
        truth = [k for k, f in enumerate(self.schema) if f.dataType.simpleString() == "boolean"]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for row in db.execute(f"SELECT {columns} FROM \"{self.options['table']}\" WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(None if v is None else bool(v) if k in truth else v for k, v in enumerate(row))


class _SqliteWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.options, self.schema = options, schema
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB", "boolean": "BOOLEAN"}
        keys = [k for k in options.get("keys", "").split(",") if k]
        checked_names(options["table"], keys, [f.name for f in schema if f.name not in keys])
        columns = ", ".join(f'"{f.name}" {kinds.get(f.dataType.simpleString(), "TEXT")}' for f in schema)
        primary = ", PRIMARY KEY ({})".format(", ".join(f'"{k}"' for k in keys)) if keys else ""
        with sqlite3.connect(options["path"]) as db:
            if overwrite:
                db.execute(f"DROP TABLE IF EXISTS \"{options['table']}\"")
            db.execute(f"CREATE TABLE IF NOT EXISTS \"{options['table']}\" ({columns}{primary})")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        marks = ", ".join("?" for _ in self.schema)
        with sqlite3.connect(self.options["path"], timeout=300) as db:
            db.executemany(f"INSERT OR REPLACE INTO \"{self.options['table']}\" VALUES ({marks})", (tuple(r) for r in rows))
        return WriterCommitMessage()


class SqliteKV:
    """A keyed table in an SQLite file."""

    def __init__(self, spark: SparkSession, path: str, table: str, keys: list[str], searchable: list[str] | None = None):
        spark.dataSource.register(SqliteSource)
        self.spark, self.path, self.name, self.keys, self.searchable = spark, path, table, keys, searchable
        checked_names(table, keys, [])

    def table(self) -> KVTable:
        return KVTable(self.spark.read.format("weftline_sqlite").options(path=self.path, table=self.name).load(), self.keys, self.searchable)

    def put(self, rows: DataFrame) -> None:
        rows = KVTable(rows.limit(0), self.keys).put(rows).df
        rows.write.format("weftline_sqlite").options(path=self.path, table=self.name, keys=",".join(self.keys)).mode("append").save()
        with sqlite3.connect(self.path) as db:
            for c in self.searchable or []:
                db.execute(f'CREATE INDEX IF NOT EXISTS "{self.name}_{c}" ON "{self.name}" ("{c}")')

    def get(self, key: object) -> DataFrame:
        return self.table().get(key)

    def search(self, where: Mapping[str, object]) -> DataFrame:
        return self.table().search(where)

    def get_all(self) -> DataFrame:
        return self.table().get_all()

    def delete(self, key: object) -> None:
        key = self.table().key_of(key)
        with sqlite3.connect(self.path) as db:
            db.execute('DELETE FROM "{}" WHERE {}'.format(self.name, " AND ".join(f'"{k}" IS ?' for k in key)), tuple(key.values()))

    def delete_all(self) -> None:
        with sqlite3.connect(self.path) as db:
            db.execute(f'DELETE FROM "{self.name}"')

    def size(self) -> int:
        return self.table().size().first()[0]


class JdbcKV:
    """A keyed table in a database that a JDBC driver on the class path reaches (PostgreSQL's dialect for writing)."""

    def __init__(self, spark: SparkSession, url: str, table: str, keys: list[str], values: list[str], **options: str):
        checked_names(table, keys, values)
        self.spark, self.url, self.name, self.keys, self.values, self.options = spark, url, table, keys, values, options

    def get_all(self) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=self.name, **self.options).load()

    def get(self, key: Mapping[str, object]) -> DataFrame:
        """The filter is pushed down to the database."""
        KVTable.ordered(key, self.keys)
        return self.get_all().filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in key.items()]))

    def stage(self, rows: DataFrame) -> str:
        """Append rows to a staging table; returns the statement that merges it, to be run in the database."""
        rows.write.format("jdbc").options(url=self.url, dbtable=f"{self.name}_staged", **self.options).mode("overwrite").save()
        return self.merge_statement()

    def merge_statement(self) -> str:
        quoted = lambda names: ", ".join(f'"{n}"' for n in names)
        every = quoted([*self.keys, *self.values])
        change = "UPDATE SET " + ", ".join(f'"{v}" = excluded."{v}"' for v in self.values) if self.values else "NOTHING"
        return f'INSERT INTO "{self.name}" ({every}) SELECT {every} FROM "{self.name}_staged" ON CONFLICT ({quoted(self.keys)}) DO {change}'


class TaskOutputRepository(Emitter):
    """Outputs of tasks by the fingerprint of their inputs and their type, as JSON, in a store of (key, taskType, value)."""

    SCHEMA = "key string, taskType string, value string"

    def __init__(self, store: ParquetKV):
        self.store = store

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> TaskOutputRepository:
        return cls(ParquetKV(spark, path, cls.SCHEMA, ["key", "taskType"]))

    def save(self, task_type: str, inputs: Mapping[str, object], output: Mapping[str, object]) -> None:
        self.store.put_one({"key": fingerprint_of(inputs), "taskType": task_type}, {"value": json.dumps(output)})
        self.emit("changed", task_type)

    def get(self, task_type: str, inputs: Mapping[str, object]) -> dict[str, object] | None:
        row = self.store.get({"key": fingerprint_of(inputs), "taskType": task_type}).first()
        return None if row is None else json.loads(row.value)

    def probe(self, rows: DataFrame, inputs: list[str], task_type: str) -> DataFrame:
        """rows with `fingerprint` and the stored `value` of their inputs, null where there is none: one join for all rows."""
        return probe(rows, inputs, self.store.get_all().filter(F.col("taskType") == task_type).select(F.col("key").alias("fingerprint"), "value"))

    def clear(self) -> None:
        self.store.delete_all()
        self.emit("reset")

    def size(self) -> int:
        return self.store.size()


def probe(rows: DataFrame, inputs: list[str], held: DataFrame) -> DataFrame:
    """rows with the fingerprint of their inputs and what held (fingerprint, ...) has for it, or nulls."""
    return rows.withColumn("fingerprint", fingerprint(inputs)).join(held, "fingerprint", "left")


class TaskGraphRepository(Emitter):
    """Graphs by key, as JSON."""

    def __init__(self, store: ParquetKV):
        self.store = store

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> TaskGraphRepository:
        return cls(ParquetKV(spark, path, "key string, value string", ["key"]))

    def save(self, key: str, graph: TaskGraph) -> None:
        self.store.put_one(key, json.dumps(graph.to_json()))
        self.emit("changed", key)

    def get(self, key: str) -> TaskGraph | None:
        text = self.store.get_value(key)
        return None if text is None else TaskGraph.from_json(json.loads(text))

    def clear(self) -> None:
        self.store.delete_all()
        self.emit("reset")

    def size(self) -> int:
        return self.store.size()
