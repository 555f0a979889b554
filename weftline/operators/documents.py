"""Documents to ordered fragments: markdown structure, paragraphs, flat texts; and the building of documents.

A document is one row, so its lines are folded where they are: no line is shuffled, rows that repeat
an id stay apart, and a document of any length is one pass over its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What begins a header, the parts of a header, an image in a line, the parts of an image, and what counts as white space at an end.
STARTS_HEADER = re.compile(r"^#{1,6}\s")
HEADER = re.compile(r"^(#{1,6})\s+(.*)$")
IMAGE = re.compile(r"(!\[.*?\]\(.*?\))")
IMAGE_PARTS = re.compile(r"^!\[(.*)\]\((.*)\)$")
WHITE = " \t\n\x0b\x0c\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
KINDS = ("header", "text", "table", "image")
FRAGMENT = "ord int, piece int, section int, depth int, path array<int>, kind string, content string, alt string, src string"


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("ord", "line"))


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The non-empty lines of each text, numbered from 0."""
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: x != "")
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("ord", "content"))


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sentences of each text, numbered from 0: runs up to . ! or ? and white space, or a line end. An extension."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?<=[.!?])\s+|\n"), F.trim), lambda x: x != "")
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("ord", "content"))


def fold(text: str | None, title: str | None = None, compat: bool = False) -> list[dict[str, Any]]:
    """The fragments of one markdown text, in order.

    A section begins at a header and is numbered from 1; a level-1 header opens it under the document,
    any other under the section before. Table lines and the lines with a pipe behind them are one
    table; with compat every table line opens a table of what follows it, and the title comes first
    as a text. Neighbouring plain lines are one trimmed text.
    """
    out: list[dict[str, Any]] = []
    rows = (text or "").split("\n")
    path: list[int] = []
    section, held, held_at = 0, [], 0

    def emit(at: int, kind: str, content: str | None, alt: str | None = None, src: str | None = None) -> None:
        piece = out[-1]["piece"] + 1 if out and out[-1]["ord"] == at else 0
        out.append({"ord": at, "piece": piece, "section": section, "depth": len(path), "path": list(path), "kind": kind, "content": content, "alt": alt, "src": src})

    def flush() -> None:
        plain = "\n".join(held).strip(WHITE)
        if plain:
            emit(held_at, "text", plain)
        held.clear()

    if title:
        emit(-1, "text" if compat else "title", title)
    at = 0
    while at < len(rows):
        line = rows[at]
        trimmed = line.strip(WHITE)
        if STARTS_HEADER.match(line):
            flush()
            parts = HEADER.match(line)
            section += 1
            path = [section] if not parts or len(parts[1]) == 1 else [*path, section]
            emit(at, "header", parts[2] if parts else "")
        elif trimmed.startswith("|") and "|" in trimmed[1:]:
            flush()
            end = at + 1
            while end < len(rows) and "|" in rows[end] and (compat or not STARTS_HEADER.match(rows[end])):
                end += 1
            emit(at, "table", "\n".join(rows[at:end]))
            at = at if compat else end - 1
        elif "![" in line and "](" in line:
            flush()
            for part in IMAGE.split(line):
                image = IMAGE_PARTS.match(part)
                if image:
                    emit(at, "image", part.strip(WHITE), image[1], image[2])
                elif part.strip(WHITE):
                    emit(at, "text", part.strip(WHITE))
        else:
            if not held:
                held_at = at
            held.append(line)
        at += 1
    flush()
    return out


def _folded(df: DataFrame, id_col: str, text_col: str, title_col: str | None, compat: bool) -> DataFrame:
    """(doc_id, fragments: array) of every row."""
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("piece", pa.int32()), ("section", pa.int32()), ("depth", pa.int32()), ("path", pa.list_(pa.int32())), ("kind", pa.string()), ("content", pa.string()), ("alt", pa.string()), ("src", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, titles = (batch.column(c).to_pylist() for c in ("text", "title"))
            found = [fold(x, y, compat) for x, y in zip(texts, titles)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "fragments"])

    title = F.col(title_col) if title_col else F.lit(None)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), title.cast("string").alias("title"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fragments array<struct<{', '.join(x.replace(' ', ':', 1) for x in FRAGMENT.split(', '))}>>")


def markdown_fragments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, compat: bool = False) -> DataFrame:
    """One row a fragment: doc_id and FRAGMENT, ordered in a document by (ord, piece)."""
    return _folded(df, id_col, text_col, title_col, compat).select("doc_id", F.inline("fragments"))


def plain_fragments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain text: one fragment a document, the whole of it."""
    return df.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("ord"), F.lit("text").alias("kind"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))


def split_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, compat: bool = False) -> DataFrame:
    """The splitter: one row a document, its fragments in order as texts; images as their {alt, src}."""
    said = lambda f: F.when(f["kind"] == "image", F.to_json(F.struct(f["alt"].alias("alt"), f["src"].alias("src")))).otherwise(f["content"])
    return _folded(df, id_col, text_col, title_col, compat).select("doc_id", F.transform("fragments", said).alias("texts"))


def flat_texts(fragments: DataFrame) -> DataFrame:
    """The splitter over fragments that are rows already: regrouped by document, ordered by (ord, piece)."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "piece", "content")))
    return fragments.groupBy("doc_id").agg(F.transform(rows, lambda r: r["content"]).alias("texts"))


def paragraph_variant(fragments: DataFrame) -> DataFrame:
    """Top-level texts cut at line ends, empty lines dropped; all other fragments as they are."""
    top = (F.col("kind") == "text") & (F.col("depth") == 0)
    parts = F.when(top, F.filter(F.split("content", "\n", -1), lambda x: x != "")).otherwise(F.array("content"))
    return fragments.withColumn("part", parts).select(*[c for c in fragments.columns if c != "content"], F.posexplode("part").alias("line", "content"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): whole text or markdown files as documents, by their path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


class Document:
    """A document that is built by hand: fragments are added one after another, sections nest."""

    def __init__(self, title: str = "", **metadata: Any):
        self.metadata = {"title": title, **metadata}
        self.fragments: list[dict[str, Any]] = []
        self._path: list[int] = []
        self._sections = [0]

    def _add(self, kind: str, content: str | None, alt: str | None = None, src: str | None = None) -> None:
        self.fragments.append({"ord": len(self.fragments), "piece": 0, "section": self._path[-1] if self._path else 0, "depth": len(self._path), "path": list(self._path), "kind": kind, "content": content, "alt": alt, "src": src})

    def add_text(self, text: str) -> Document:
        self._add("text", text)
        return self

    def add_image(self, alt: str, src: str) -> Document:
        self._add("image", f"![{alt}]({src})", alt, src)
        return self

    def add_table(self, text: str) -> Document:
        self._add("table", text)
        return self

    def add_section(self, title: str = "") -> Document:
        """A view of this document inside a new section."""
        inner = Document.__new__(Document)
        inner.metadata, inner.fragments, inner._sections = {"title": title}, self.fragments, self._sections
        self._sections[0] += 1
        inner._path = [*self._path, self._sections[0]]
        if title:
            inner._add("header", title)
        return inner

    def add_content(self, content: Any) -> Document:
        if isinstance(content, str):
            return self.add_text(content)
        if isinstance(content, dict) and content.get("kind") in KINDS:
            self._add(content["kind"], content.get("content"), content.get("alt"), content.get("src"))
            return self
        raise ValueError(f"this is no content of a document: {content!r}")

    def to_df(self, spark: SparkSession, doc_id: Any = 0) -> DataFrame:
        return spark.createDataFrame([tuple(f.values()) for f in self.fragments], FRAGMENT).withColumn("doc_id", F.lit(doc_id))


class MasterDocument:
    """An original table of documents, the master made from it, and variants by name, with merged metadata."""

    def __init__(self, original: DataFrame, master: DataFrame, **metadata: Any):
        self.original, self.master, self.metadata, self.variants = original, master, dict(metadata), {}

    def add_variant(self, name: str, variant: DataFrame, **metadata: Any) -> MasterDocument:
        self.variants[name] = variant
        self.metadata |= metadata
        return self

    def variant(self, name: str) -> DataFrame:
        if name not in self.variants:
            raise KeyError(f"no variant {name}")
        return self.variants[name]

    @classmethod
    def of_markdown(cls, docs: DataFrame, **metadata: Any) -> MasterDocument:
        master = markdown_fragments(docs)
        return cls(docs, master, **metadata).add_variant("paragraphs", paragraph_variant(master)).add_variant("flat", split_texts(docs))
