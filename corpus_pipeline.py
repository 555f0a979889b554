"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage takes null, empty and very long texts, null and repeated ids, columns of any other names
(but `_row`), which all but the last return, and an empty table, which gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import toxicity as tox
from weftline.llm.common import keyed, read, save
from weftline.llm.decontaminate import decontaminate
from weftline.llm.exact_dedup import exact_dedup
from weftline.llm.labelled import training_labels
from weftline.llm.near_dedup import near_duplicates
from weftline.llm.piece_lattice import encode

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _kept(rows: DataFrame, columns: list[str], verdict: DataFrame) -> DataFrame:
    """The columns of the rows whose key `_row` is in verdict (_key): one verdict a row, also where doc_ids are null or repeated."""
    return rows.join(verdict, rows["_row"] == verdict["_key"], "left_semi").select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. The model learns from this stage's documents.

    Null and empty texts get the base score alone and stay where that is under the threshold; rows that
    repeat an id or text are scored each for itself.
    """
    model = tox.train(docs, training_labels(read(spark, sf_dir, "labels"), "toxic", 4, 2))
    rows = keyed(docs)
    found = tox.score(rows, model, id_col="_row").filter(F.col("score") < tox.THRESHOLD)
    return _kept(rows, docs.columns, found.select(F.col("doc_id").alias("_key")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty), the row with the largest doc_id; of rows that repeat that id too, any one."""
    rows = keyed(docs)
    found = exact_dedup(rows, row_col="_row").filter("kept")
    return _kept(rows, docs.columns, found.select(F.col("row").alias("_key")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the smallest doc_id, null below all; of rows that repeat that id, any one."""
    rows = keyed(docs)
    found = near_duplicates(rows, row_col="_row").filter("kept")
    return _kept(rows, docs.columns, found.select(F.col("row").alias("_key")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; a null or empty text has no words and stays."""
    rows = keyed(docs)
    found = decontaminate(rows, read(spark, sf_dir, "benchmark"), id_col="_row").filter(~F.col("contaminated"))
    return _kept(rows, docs.columns, found.select(F.col("doc_id").alias("_key")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its sampled piece ids, which decode to the text exactly; a null or empty text has none. One row per row."""
    return encode(docs, PIECE_MODEL).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "text_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs


#: Multiple-instance learning, order MinHash and lattice sampling are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
