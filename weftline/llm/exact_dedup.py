"""Exact deduplication by content-defined chunk recipes (DataFrame operations only).

Each text is cut where its content says so: a chunk ends at a line or sentence end once it
is CHUNK_MIN characters long, and at CHUNK_MAX at the latest. Distinct chunks are found once,
with map-side combining, and identified by two 64-bit hashes; an identifier counts as verified
when no two distinct chunks share it. If any do, all identifiers are made anew with another
seed. Texts are equal exactly when their ordered lists of verified identifiers are, so only
those lists are grouped and joined; a document's text moves as chunks, once.

Cases: null text counts as empty, and all empty texts are equal; texts of any length are cut and
compared whole; a null doc_id sorts below all others; rows that repeat a doc_id and text are the
same document and get the same verdict, unless row_col tells them apart: then one row stays of each
group; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import attach, save

CHUNK_MIN, CHUNK_MAX = 512, 4096
#: Java regular expression of one chunk; chunks follow each other without gaps.
CHUNK = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX - 1}}}?[\n.!?]|.{{1,{CHUNK_MAX}}}"
ID = "struct<a:bigint,b:bigint>"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), chunk).alias("a"), F.xxhash64(F.lit(2 * seed + 1), chunk).alias("b"))


def verified_seed(texts: DataFrame, text: str, first: int = 0) -> int:
    """The first seed under which every identifier stands for one chunk text only."""
    seed = first
    while True:
        each = texts.select(F.explode(chunks(F.col(text))).alias("chunk"))
        distinct = each.groupBy(identifier(F.col("chunk"), seed).alias("id"), "chunk").agg(F.lit(1).alias("one"))
        shared = distinct.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        if not shared:
            return seed
        seed += 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256, recipe.

    row_col names a column that tells rows apart, if there is one: ties go to its largest value, and it is returned as `row`.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    tie = ["row"] if row_col else []
    seed = verified_seed(src, "text")
    recipe = F.transform(chunks(F.col("text")), lambda c: identifier(c, seed))
    rows = save(src.select("doc_id", *tie, recipe.alias("recipe"), F.sha2("text", 256).alias("text_sha256")), "recipes")
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", *tie)).alias("keep"), F.count("*").alias("group_size"))
    out = attach(rows, groups, ["recipe"], "group_size", rows.count(), F.xxhash64("doc_id", *tie))
    out = out.withColumn("kept", F.struct("doc_id", *tie).eqNullSafe(F.col("keep")))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256", "recipe", *tie)
