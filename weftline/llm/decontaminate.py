"""Benchmark decontamination through a distributed positional inverted index of the training corpus.

The index holds the postings of every term of the corpus, whatever is asked later. It is cut into
segments of about SEGMENT_WORDS words of neighbouring documents: a row holds a segment's postings of
one term (documents and positions), rows of a segment are in the order of the terms' hashes, so that
a few terms read few row groups, and one row of each segment lists its documents. A phrase (13
consecutive words of an item, or all words of a shorter one) is looked up from its rarest term in the
whole corpus: the positions of that term, shifted by its offset in the phrase, are intersected with
the shifted positions of the next rarest terms until none or all are done. Only postings of terms of
the items travel, to the task of their segment. Terms are compared as texts, not by hashes alone.

The benchmark is the stated query set, looked up in blocks of BLOCK_WORDS words over one index;
results of blocks meet by a key of the rows.

Words are runs of digits, ASCII letters (A-Z lower-cased) and all characters beyond ASCII.
Cases: null or empty texts have no words, hits or items; texts of any length are indexed whole, one
that is longer than a segment alone; items without words have no phrases, and a null id is the empty
one; items that repeat an id are one item; rows that repeat a doc_id, or have none, are looked up
each for itself; empty tables give no rows or no hits; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.llm.common import save, prepare

WINDOW = 13
BLOCK_WORDS = 1_000_000
SEGMENT_WORDS = 600_000
#: n postings of a term: the documents' places in the segment (u16) and the positions (u32); or, with an empty term, the segment's documents.
INDEX = "segment bigint, hash bigint, term string, n int, docs binary, positions binary, doc_ids array<bigint>, n_words array<int>"
DOCUMENTS = 1 << 16
#: Index rows handed over at once.
ROWS = 20_000
HITS = "row bigint, doc_id bigint, n_words bigint, n_hit bigint, items array<string>, begins array<int>, ends array<int>"


def item_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hashes of the items' words, each item's first (with an end), and the words."""
    h, counts, found = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    for _, _, data, off in tokens.text_slices(pa.array(texts, pa.large_string())):
        each, at, first = tokens.words(data, off)
        low = tokens.WORD[data].tobytes()
        h.append(each)
        counts.append(np.diff(first))
        found += [low[i : i + n].decode() for i, n in zip(at.tolist(), tokens.word_sizes(data, off).tolist())]
    return np.concatenate(h), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), found


class Phrases:
    """The phrases of a block of items over the vocabulary of its words, in the order of their hashes."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        h, first, found = item_words(texts)
        self.vocabulary, at, terms = np.unique(h.view(np.int64), return_index=True, return_inverse=True)
        self.words = [found[i] for i in at.tolist()]
        if any(self.words[k] != w for k, w in zip(terms.tolist(), found)):
            raise ValueError("two words of the items have one hash")
        self.names = ids
        rows = [(i, s, min(window, first[i + 1] - first[i])) for i in range(len(ids)) if first[i + 1] > first[i] for s in range(first[i], max(first[i] + 1, first[i + 1] - window + 1))]
        self.item, start, self.length = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), ())))
        grid = start[:, None] + np.arange(window)
        self.terms = np.where(np.arange(window) < self.length[:, None], terms[np.minimum(grid, max(len(terms) - 1, 0))] if len(terms) else 0, -1)

    def order_by(self, frequency: np.ndarray) -> Phrases:
        """Offsets of each phrase from its rarest to its commonest term, and the phrases that each rarest term leads."""
        weight = np.where(self.terms >= 0, frequency[np.maximum(self.terms, 0)], np.iinfo(np.int64).max) if len(self.terms) else self.terms
        self.order = np.argsort(weight, axis=1, kind="stable")
        lead = np.take_along_axis(self.terms, self.order[:, :1], 1)[:, 0] if len(self.terms) else np.zeros(0, np.int64)
        self.by_lead = np.argsort(lead, kind="stable")
        self.lead_from = np.searchsorted(lead[self.by_lead], np.arange(len(self.vocabulary) + 1))
        return self


class Segment:
    """Documents whose words are gathered until there are enough for a segment."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n_words: list[np.ndarray] = []
        self.size, self.docs = 0, 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        h, at, first = tokens.words(data, offsets)
        count = np.diff(first)
        doc = np.repeat(np.arange(len(count)), count)
        self.parts.append((h, doc + self.docs, np.arange(len(h)) - first[doc], tokens.WORD[data], at, tokens.word_sizes(data, offsets)))
        self.ids.append(ids)
        self.n_words.append(count)
        self.size, self.docs = self.size + len(h), self.docs + len(count)

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        """The segment as index rows: its documents, then its terms by their hashes."""
        h, doc, pos, at, size = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1, 2, 4, 5))
        lead = np.cumsum([0] + [len(p[3]) for p in self.parts])
        low = np.concatenate([p[3] for p in self.parts])
        at = at + np.repeat(lead[:-1], [len(p[0]) for p in self.parts])
        by = np.argsort(h, kind="stable")  # by document and position within a term
        h, doc, pos, at, size = h[by], doc[by], pos[by], at[by], size[by]
        new = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)) != 0) if len(h) else np.zeros(0, np.int64)
        of = np.repeat(new, np.diff(new, append=len(h)))
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        spelt = low[np.repeat(at, size) + inside]
        if not np.array_equal(size, size[of]) or not np.array_equal(spelt, low[np.repeat(at[of], size) + inside]):
            # words of one hash: a term's words come together, by the words themselves
            words = [low[a : a + n].tobytes() for a, n in zip(at.tolist(), size.tolist())]
            by = np.array(sorted(range(len(words)), key=lambda k: (h[k], words[k])), np.int64)
            h, doc, pos, at, size = h[by], doc[by], pos[by], at[by], size[by]
            new = np.array([k for k in range(len(by)) if not k or words[by[k]] != words[by[k - 1]]], np.int64)
        none = lambda kind: pa.nulls(1, kind)
        names = [c.split()[0] for c in INDEX.split(", ")]
        ids, n_words = pa.concat_arrays(self.ids), pa.array(np.concatenate(self.n_words).astype(np.int32))
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([0]), pa.array([""]), pa.array([0], pa.int32()), none(pa.binary()), none(pa.binary()), whole(ids), whole(n_words)], names=names)
        docs, positions = doc.astype("<u2"), pos.astype("<u4")
        cut = np.append(new, len(h))
        for lo in range(0, len(new), ROWS):
            mine = cut[lo : lo + ROWS + 1]
            n = len(mine) - 1
            a, b = int(mine[0]), int(mine[-1])
            letters = size[mine[:-1]]
            begin = np.concatenate([[0], np.cumsum(letters)]).astype(np.int32)
            text = low[np.repeat(at[mine[:-1]] - begin[:-1], letters) + np.arange(begin[-1])]
            flat = lambda kind, values, unit: kind.from_buffers(kind_of[kind], n, [None, pa.py_buffer(((mine - a) * unit).astype(np.int32)), pa.py_buffer(values[a:b].tobytes())])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, segment)), pa.array(h[mine[:-1]].view(np.int64)), pa.StringArray.from_buffers(n, pa.py_buffer(begin), pa.py_buffer(text.tobytes())), pa.array(np.diff(mine).astype(np.int32)),
                flat(pa.BinaryArray, docs, 2), flat(pa.BinaryArray, positions, 4), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())),
            ], names=names)


kind_of = {pa.BinaryArray: pa.binary()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of docs."""
    prepare(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment, at = Segment(), TaskContext.get().partitionId() << 20
        for batch in batches:
            for lo, hi, data, off in tokens.text_slices(batch.column("text")):
                if segment.docs + hi - lo > DOCUMENTS:
                    yield from segment.rows(at)
                    segment, at = Segment(), at + 1
                segment.add(batch.column("doc_id").slice(lo, hi - lo), data, off)
                if segment.size >= SEGMENT_WORDS:
                    yield from segment.rows(at)
                    segment, at = Segment(), at + 1
        if segment.docs:
            yield from segment.rows(at)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return save(src.mapInArrow(index, INDEX), "postings")


def postings(index: DataFrame, phrases: Phrases) -> DataFrame:
    """The rows of the phrases' terms (at most BLOCK_WORDS, or one item's: the bound of the broadcast), and each segment's documents."""
    rows = pa.table({"hash": np.append(phrases.vocabulary, 0), "term": [*phrases.words, ""]})
    wanted = index.sparkSession.createDataFrame(rows)
    return index.join(F.broadcast(wanted), ["hash", "term"], "left_semi")


def frequencies(index: DataFrame, phrases: Phrases) -> np.ndarray:
    """Occurrences of each of the phrases' terms in the whole corpus."""
    rows = postings(index, phrases).filter("term <> ''").groupBy("hash").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(max(len(phrases.vocabulary), 1), np.int64)
    out[np.searchsorted(phrases.vocabulary, rows.column("hash").to_numpy())] = rows.column("n").to_numpy()
    return out


class Postings:
    """The postings of a segment as one sorted list of (document, term, position)."""

    def __init__(self, table: pa.Table, phrases: Phrases):
        named = np.array(table.column("term").to_pylist(), object) != ""
        self.segment = int(table.column("segment")[0].as_py())
        at = int(np.flatnonzero(~named)[0])
        self.doc_ids = table.column("doc_ids")[at].values
        self.n_words = table.column("n_words")[at].values.to_numpy().astype(np.int64)
        self.n_terms = max(len(phrases.vocabulary), 1)
        terms = table.filter(pa.array(named))
        flat = lambda c, kind: np.frombuffer(b"".join(terms.column(c).to_pylist()), kind).astype(np.int64)
        doc, pos = flat("docs", "<u2"), flat("positions", "<u4")
        term = np.repeat(np.searchsorted(phrases.vocabulary, terms.column("hash").to_numpy()), terms.column("n").to_numpy())
        self.reach = int(self.n_words.max(initial=0)) + 1
        keys = (doc * self.n_terms + term) * self.reach + pos
        by = np.argsort(keys, kind="stable")
        self.doc, self.term, self.pos, self.keys = doc[by], term[by], pos[by], keys[by]

    def nearest(self, doc: np.ndarray, term: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The term's first position in the document at or after pos; -1 if there is none."""
        base = (doc * self.n_terms + term) * self.reach
        i = np.searchsorted(self.keys, base + np.clip(pos, 0, self.reach - 1))
        found = self.keys[np.minimum(i, len(self.keys) - 1)] - base
        return np.where((i < len(self.keys)) & (found < self.reach) & (pos < self.reach), found, -1)

    def leads(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(posting, phrase) of every occurrence of every phrase's rarest term."""
        n = phrases.lead_from[self.term + 1] - phrases.lead_from[self.term]
        at = np.repeat(np.arange(len(self.term)), n)
        skip = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, phrases.by_lead[phrases.lead_from[self.term[at]] + skip]

    def phrase_matches(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, phrase, first position) of all exact matches."""
        at, p = self.leads(phrases)
        doc, start = self.doc[at], self.pos[at] - phrases.order[p, 0]
        ok = (start >= 0) & (start + phrases.length[p] <= self.n_words[doc])
        doc, p, start = doc[ok], p[ok], start[ok]
        for k in range(1, phrases.terms.shape[1]):
            offset = phrases.order[p, k]
            term = phrases.terms[p, offset]
            want = start + offset
            ok = (k >= phrases.length[p]) | (self.nearest(doc, np.maximum(term, 0), want) == want)
            doc, p, start = doc[ok], p[ok], start[ok]
        return doc, p, start

    def proximity_matches(self, phrases: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, phrase, position of its rarest term) where all terms, in any order, lie within length + slop words of it."""
        at, p = self.leads(phrases)
        doc, mid = self.doc[at], self.pos[at]
        for k in range(1, phrases.terms.shape[1]):
            term = phrases.terms[p, phrases.order[p, k]]
            reach = phrases.length[p] + slop
            found = self.nearest(doc, np.maximum(term, 0), np.maximum(mid - reach, 0))
            ok = (k >= phrases.length[p]) | ((found >= 0) & (found <= mid + reach))
            doc, p, mid = doc[ok], p[ok], mid[ok]
        return doc, p, mid


def lookup(index: DataFrame, phrases: Phrases, slop: int | None = None) -> DataFrame:
    """Per document: n_words, words hit, items matched and the merged ranges of hit words; with slop, proximity matches."""

    def search(table: pa.Table) -> pa.Table:
        post = Postings(table, phrases)
        n = len(post.n_words)
        base = np.concatenate([[0], np.cumsum(post.n_words)])
        if not len(post.keys) or not len(phrases.terms):
            doc, p, start, size = (np.zeros(0, np.int64),) * 4
        elif slop is None:
            doc, p, start = post.phrase_matches(phrases)
            size = phrases.length[p]
        else:
            doc, p, start = post.proximity_matches(phrases, slop)
            size = np.ones(len(p), np.int64)
        edge = np.zeros(base[-1] + 1, np.int64)
        np.add.at(edge, base[doc] + start, 1)
        np.add.at(edge, base[doc] + start + size, -1)
        hit = np.cumsum(edge)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        inner = base[:-1][base[:-1] < base[-1]]
        rise, fall = hit.copy(), hit.copy()
        rise[1:] &= ~hit[:-1]
        rise[inner] = hit[inner]
        fall[:-1] &= ~hit[1:]
        last = inner[inner > 0] - 1
        fall[last] = hit[last]
        begins, ends = np.flatnonzero(rise), np.flatnonzero(fall)
        at = np.searchsorted(base, begins, "right") - 1
        items: list[set[str]] = [set() for _ in range(n)]
        for d, i in {*zip(doc.tolist(), phrases.item[p].tolist())}:
            items[d].add(phrases.names[i])
        cut = np.searchsorted(at, np.arange(n + 1))
        return pa.Table.from_arrays([
            pa.array(post.segment * DOCUMENTS + np.arange(n)), post.doc_ids, pa.array(post.n_words), pa.array(total[base[1:]] - total[base[:-1]], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            tokens.lists((begins - base[at]).astype(np.int32), cut, pa.int32()), tokens.lists((ends + 1 - base[at]).astype(np.int32), cut, pa.int32()),
        ], names=["row", "doc_id", "n_words", "n_hit", "items", "begins", "ends"])

    return postings(index, phrases).groupBy("segment").applyInArrow(search, HITS)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[str], list[str | None]]]:
    """Ids and texts of the items, at most about BLOCK_WORDS words or one item at once; one empty block if there are none."""
    ids: list[str] = []
    texts: list[str | None] = []
    size, n = 0, 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        ids.append("" if item is None else item)
        texts.append(text)
        size += len(text or "") // 2 + 1  # words at most
        if size >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, size, n = [], [], 0, n + 1
    if ids or not n:
        yield ids, texts


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items, ranges of hit words, contaminated (a hit, and hits of at least 1/20 of the words)."""
    index = build_index(docs, id_col, text_col)
    whole: DataFrame | None = None
    hits: list[DataFrame] = []
    for ids, texts in blocks(benchmark, item_col, item_text):
        if whole is not None:  # one block's phrases in memory at a time, and only rows with hits are stored
            hits.append(save(whole.filter("n_hit > 0"), "hits"))
        phrases = Phrases(ids, texts, window)
        whole = lookup(index, phrases.order_by(frequencies(index, phrases)))
    if not hits:
        found = whole
    else:
        hits.append(save(whole.filter("n_hit > 0"), "hits"))
        each = index.filter("term = ''").select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("at", "d"))
        each = each.select((F.col("segment") * DOCUMENTS + F.col("at")).alias("row"), F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
        found = each.join(_merged(hits), "row", "left")
        found = found.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        for c, kind in (("items", "array<string>"), ("begins", "array<int>"), ("ends", "array<int>")):
            found = found.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return found.drop("row").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, item) of the documents where all words of a window of an item, in any order, lie near its rarest one: within its length and slop words."""
    index = build_index(docs, id_col, text_col)
    found = []
    for ids, texts in blocks(benchmark, item_col, item_text):
        phrases = Phrases(ids, texts, window)
        near = lookup(index, phrases.order_by(frequencies(index, phrases)), slop)
        found.append(save(near.select("row", "doc_id", F.explode("items").alias("item")), "near"))
    return reduce(DataFrame.unionByName, found).distinct().drop("row")


def _merged(hits: list[DataFrame]) -> DataFrame:
    """Results of blocks of items as one per row: ranges united, hit words counted anew."""
    both = reduce(DataFrame.unionByName, hits).groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))).alias("runs"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = [], []
            for runs in batch.column("runs").to_pylist():
                b, e = [], []
                for run in runs:
                    if e and run["begins"] <= e[-1]:
                        e[-1] = max(e[-1], run["ends"])
                    else:
                        b.append(run["begins"])
                        e.append(run["ends"])
                begins.append(b)
                ends.append(e)
            n_hit = [sum(e) - sum(b) for b, e in zip(begins, ends)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_hit, pa.int64()), batch.column("items"), pa.array(begins, kind), pa.array(ends, kind)], names=["row", "n_hit", "items", "begins", "ends"])

    return both.mapInArrow(unite, "row bigint, n_hit bigint, items array<string>, begins array<int>, ends array<int>")
