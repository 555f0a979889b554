"""Helpers shared by the corpus operators: shared-folder tables and skew-safe joins."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows; so fewer than HOT_SHARE keys are.
HOT_SHARE = 2000
#: Rows of one Arrow batch handed to Python; whole documents, so batches stay a few MB.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new one on a local master (tests), else an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of save() that no later step reads."""
    for df in tables:
        path = getattr(df, "_weftline_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def keyed(docs: DataFrame, id_col: str = "doc_id", key: str = "_row") -> DataFrame:
    """docs with a bigint column that tells every row from all others.

    That is the id itself where no id is null or repeated (a count of ids decides, texts do not
    move). Else rows are numbered, and the numbered table is written, so that the numbers are the
    same whenever it is read.
    """
    ids = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    if not ids.filter("n > 1 or id is null").limit(1).count():
        return docs.withColumn(key, F.col(id_col).cast("long"))
    return save(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


def prepare(spark: SparkSession) -> None:
    """Before Python runs on executors: send them this package once, and bound the Arrow batches they get."""
    sc = spark.sparkContext
    if getattr(sc, "_weftline_sent", None) is None:
        top = Path(__file__).resolve().parents[1]
        sc._weftline_sent = shutil.make_archive(str(Path(tempfile.mkdtemp()) / top.name), "zip", top.parent, top.name)
        sc.addPyFile(sc._weftline_sent)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows to groups (one row per key) without sending a hot key to one task.

    groups has the keys, the number of rows of each in `weight`, and values. Keys with more than
    total/HOT_SHARE rows number fewer than HOT_SHARE, so their groups are broadcast; their rows
    are dealt out by `spread` instead of the key. All other keys are joined by a shuffle.
    """
    values = [c for c in groups.columns if c not in keys]
    hot = groups.filter(F.col(weight) * HOT_SHARE > total)
    cold = groups.filter(F.col(weight) * HOT_SHARE <= total)
    h = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(*values).alias("_hot"))
    c = cold.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_c_salt"))
    out = rows.join(F.broadcast(h), [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], "left")
    # odd salts never meet the cold side's 0
    out = out.withColumn("_salt", F.when(F.col("_hot").isNotNull(), spread.bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    out = out.join(c, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("_salt") == F.col("_c_salt")], "left")
    picked = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[picked[v].alias(v) for v in values])


def computed_once(name: str, expr: Column) -> Column:
    """A column that the optimizer does not copy into later filters and lambdas, where it would be worked out again for each element."""
    return F.explode(F.array(expr)).alias(name)
