"""Line deduplication: first occurrences streamed from range-partitioned line hashes (DataFrame operations only).

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
min_length code points that occur in at least min_docs documents lose all their lines but
those in the document with the largest id. Key hashes are range-partitioned and sorted by
document and position, so one pass over a partition meets each key's first (kept) document
first. Keys that hold more than 1/HOT_SHARE of all lines are counted apart, with map-side
combining, and their few verdicts are broadcast. The result per document is a sparse bitmap
of 64-line words: only words with dropped lines are stored; text does not travel.

Keys are compared by two 64-bit hashes (128 bits). Cases: null or empty text is one empty
line; null ids count as one document, below all others; rows that repeat an id and a text get
the same bitmap; rows that repeat an id with another text are parts of one document; texts of any
length are split whole; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.llm.common import HOT_SHARE, partitions, save

UPPER, LOWER, SPACE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r"
NO_ID = -(2**63)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_d"), F.xxhash64(text).alias("_t"), text.alias("text"))


def drop_bitmaps(docs: DataFrame, min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """(_d, _t, dropped: array<struct<word, bits>>) of the documents of _numbered() that lose lines."""
    spark = docs.sparkSession
    each = docs.select("_d", "_t", F.posexplode(lines(F.col("text"))).alias("pos", "line")).select("_d", "_t", "pos", key(F.col("line")).alias("k"))
    each = each.filter(F.length("k") >= min_length).select("_d", "_t", "pos", F.xxhash64("k").alias("a"), F.xxhash64(F.lit(1), F.col("k")).alias("b"))
    each = save(each, "lines")
    total = each.count()

    heavy = each.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") * HOT_SHARE > total).select("a", "b")
    heavy = save(heavy, "hot-lines")  # fewer than HOT_SHARE rows
    of_hot = each.join(F.broadcast(heavy), ["a", "b"], "left_semi")
    told = of_hot.groupBy("a", "b").agg(F.count_distinct("_d").alias("n"), F.max("_d").alias("keep"))
    hot = of_hot.join(F.broadcast(told), ["a", "b"]).filter((F.col("n") >= min_docs) & (F.col("_d") < F.col("keep"))).select("_d", "_t", "pos")

    cold = each.join(F.broadcast(heavy), ["a", "b"], "left_anti")
    cold = cold.repartitionByRange(partitions(spark), "a", "b").sortWithinPartitions("a", "b", F.desc("_d"), "_t", "pos")
    by_key = W.partitionBy("a", "b")
    cold = cold.select("_d", "_t", "pos", "a", "b", F.dense_rank().over(by_key.orderBy(F.desc("_d"))).alias("nth"))
    cold = cold.withColumn("n", F.max("nth").over(by_key)).filter((F.col("nth") > 1) & (F.col("n") >= min_docs)).select("_d", "_t", "pos")

    words = hot.unionByName(cold).groupBy("_d", "_t", F.floor(F.col("pos") / 64).cast("int").alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("_d", "_t").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, dropped (sparse bitmap, null if all lines stay)."""
    rows = _numbered(docs, id_col, text_col)
    out = rows.select("doc_id", "_d", "_t", n_lines(F.col("text")).alias("n_lines")).join(drop_bitmaps(rows, min_length, min_docs), ["_d", "_t"], "left")
    return out.select("doc_id", "n_lines", n_dropped(F.col("dropped")).alias("n_dropped"), "dropped")


def n_dropped(dropped: Column) -> Column:
    return F.coalesce(F.aggregate(dropped, F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w["bits"])), F.lit(0).cast("long"))


def n_lines(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")


def apply_bitmap(rows: DataFrame) -> DataFrame:
    """rows with columns text and dropped: text without the lines that the bitmap drops."""
    gone = F.flatten(F.transform("dropped", lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.call_function("getbit", w["bits"], i) == 1, w["word"] * 64 + i)), lambda p: p.isNotNull())))
    # split once a row: a column that is used twice is not inlined into the lambda below
    rows = rows.withColumn("_lines", F.when(F.col("dropped").isNotNull(), lines(F.col("text"))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return rows.withColumn("text", F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)).drop("_lines")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row."""
    rows = _numbered(docs, id_col, text_col)
    out = rows.join(drop_bitmaps(rows, min_length, min_docs), ["_d", "_t"], "left").withColumn("n_lines", n_lines(F.col("text")))
    return apply_bitmap(out).select("doc_id", "n_lines", n_dropped(F.col("dropped")).alias("n_dropped"), "text")
