"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

The lattice of a text has an edge for every vocabulary piece that occurs in its bytes (the
model's space mark stands for a space) and byte pieces for characters that are no piece. An
edge's weight is rank ** -theta of its piece. Forward filtering sums the weights of all paths
to each byte; backward sampling then draws a whole segmentation from the end, with random
numbers made from the row key, the place and the step: the same row gives the same pieces on
any cluster. Pieces are spelt in bytes, so decoding gives back every text exactly, also one
that holds the space mark itself, and no prefix is added.

Pieces never cross the border before a space, so texts are cut there and each distinct part of
a slice is filtered once. Cases: null and empty texts have no pieces; a null key counts as 0;
rows that repeat a key and text get the same pieces; texts of any length are encoded whole, in time
linear in their bytes (a text without spaces is one part, sampled piece by piece); pieces of equal
weight are drawn alike; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.llm.common import prepare

MARK = "▁"
BYTE_RANK = 1e5
_MODELS: dict[tuple[str, float], PieceModel] = {}


class PieceModel:
    """Pieces as bytes, their weights, and a trie as a dense table."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.spell: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        usable = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.spell[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.spell[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.spell[i] = piece.replace(MARK, " ").encode()
                usable.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        #: whether parts that begin at a space are independent
        self.by_space = all(b" " not in self.spell[i].lstrip(b" ") for i in usable)
        rank = np.array([max(1.0, -sp.get_score(i)) + 1 for i in range(n)])
        self.logp = -theta * np.log(rank)
        self.logp[self.byte_id] = -theta * np.log(BYTE_RANK)
        used = np.unique(np.frombuffer(b"".join(self.spell[i] for i in usable), np.uint8))
        self.column = np.full(256, len(used), np.int32)
        self.column[used] = np.arange(len(used))
        rows: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i in usable:
            at = 0
            for b in self.spell[i]:
                nxt = rows[at].get(b)
                if nxt is None:
                    nxt = rows[at][b] = len(rows)
                    rows.append({})
                at = nxt
            ends.setdefault(at, i)
        inner = [k for k, r in enumerate(rows) if r]
        row_of = {k: j for j, k in enumerate(inner)}
        names = {k: j for j, k in enumerate([*inner, *(k for k, r in enumerate(rows) if not r)])}
        self.n_inner = len(inner)
        self.table = np.full((len(inner), len(used) + 1), -1, np.int32)
        for k in inner:
            for b, child in rows[k].items():
                self.table[row_of[k], self.column[b]] = names[child]
        self.end = np.full(len(rows), -1, np.int32)
        for k, i in ends.items():
            self.end[names[k]] = i
        spelt = np.array([len(s) for s in self.spell])
        self.spell_from = np.concatenate([[0], np.cumsum(spelt)])
        self.spell_bytes = np.frombuffer(b"".join(self.spell), np.uint8)

    def edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all edges; stop: for each byte, where its part ends."""
        begin = (data & 0xC0) != 0x80
        at = np.flatnonzero(begin)
        node = np.zeros(len(at), np.int64)
        spelt = np.zeros(len(data) + 1, bool)  # characters that are pieces
        width = np.diff(at, append=len(data))
        found = []
        length = 0
        where, size = at, width
        while len(where):
            alive = (where + length < stop[where]) & (node < self.n_inner)
            where, node, size = where[alive], node[alive], size[alive]
            node = self.table[node, self.column[data[where + length]]].astype(np.int64)
            alive = node >= 0
            where, node, size = where[alive], node[alive], size[alive]
            length += 1
            piece = self.end[node]
            hit = piece >= 0
            found.append((where[hit], np.full(hit.sum(), length), piece[hit].astype(np.int64)))
            spelt[where[hit & (size == length)]] = True
        owner = at[np.cumsum(begin) - 1] if len(at) else np.zeros(0, np.int64)
        raw = np.flatnonzero(~spelt[owner])
        found.append((raw, np.ones(len(raw), np.int64), self.byte_id[data[raw]]))
        start, size, piece = (np.concatenate(x) for x in zip(*found))
        return start, start + size, piece

    def decode(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.spell_from[ids + 1] - self.spell_from[ids]
        begin = np.cumsum(sizes) - sizes
        return self.spell_bytes[np.repeat(self.spell_from[ids] - begin, sizes) + np.arange(sizes.sum())]


def model(path: str, theta: float) -> PieceModel:
    """The worker's copy of a model."""
    if (path, theta) not in _MODELS:
        _MODELS[path, theta] = PieceModel(path, theta)
    return _MODELS[path, theta]


def sample(m: PieceModel, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of the documents in data, flat, and where each document's begin."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    new = np.zeros(len(data), bool)
    if m.by_space:
        space, line = data == 32, data == 10
        new[1:] = (space[1:] & ~space[:-1]) | (line[1:] != line[:-1])
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    part = np.flatnonzero(new)
    size = np.diff(part, append=len(data))
    doc = np.searchsorted(offsets, part, "right") - 1
    if distinct:
        h, _ = tokens.run_hashes(data, np.ones(len(data), bool), new)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
    else:
        first = which = np.arange(len(part))
    # the distinct parts, one after another
    length = size[first]
    top = np.cumsum(length)
    text = data[np.repeat(part[first] - (top - length), length) + np.arange(top[-1])]
    stop = np.repeat(top, length)
    start, end, piece = m.edges(text, stop)
    # forward filtering; nodes are bytes plus one end a part, so part k's byte i is node i + k
    k = np.repeat(np.arange(len(first)), length)
    a, b = start + k[start], end + k[start]
    depth = end - (top - length)[k[start]]
    by = np.lexsort((b, depth))
    a, b, piece, depth = a[by], b[by], piece[by], depth[by]
    group = np.flatnonzero(np.diff(b, prepend=-1))
    logp = m.logp[piece]
    alpha = np.zeros(top[-1] + len(first))
    cut = np.searchsorted(depth, np.arange(1, depth.max() + 2))
    g_cut = np.searchsorted(group, cut)
    weight = np.empty(len(a))
    for lo, hi, g_lo, g_hi in zip(cut[:-1], cut[1:], g_cut[:-1], g_cut[1:]):
        if lo < hi:
            w = alpha[a[lo:hi]] + logp[lo:hi]
            g = group[g_lo:g_hi] - lo
            counts = np.diff(g, append=hi - lo)
            high = np.maximum.reduceat(w, g)
            e = np.exp(w - np.repeat(high, counts))
            total = np.add.reduceat(e, g)
            alpha[b[lo:hi][g]] = high + np.log(total)
            weight[lo:hi] = e / np.repeat(total, counts)
    run = np.cumsum(weight)
    before = run[group] - weight[group]
    counts = np.diff(group, append=len(a))
    run -= np.repeat(before, counts)
    run[group + counts - 1] = 2.0  # the last edge takes what is left
    edge_from = np.zeros(len(alpha), np.int64)
    edge_from[b[group]] = group
    # backward sampling of all parts at once
    base = top - length + np.arange(len(first))  # first node of each distinct part
    state = (top + np.arange(len(first)))[which]
    goal = base[which]
    with np.errstate(over="ignore"):
        seed = tokens.mix(tokens.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(1))[doc] + (part - offsets[doc]).astype(np.uint64))
    live = np.arange(len(part))
    steps, used = [], np.zeros(len(part), np.int64)
    step = 0
    while len(live):
        with np.errstate(over="ignore"):
            u = (tokens.mix(seed[live] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(step + 1)) >> np.uint64(11)) * 2.0**-53
        e = edge_from[state[live]]
        todo = np.flatnonzero(u >= run[e])
        while len(todo):
            e[todo] += 1
            todo = todo[u[todo] >= run[e[todo]]]
        steps.append((live, piece[e]))
        state[live] = a[e]
        used[live] += 1
        live = live[state[live] > goal[live]]
        step += 1
    last = np.cumsum(used)
    ids = np.empty(last[-1], np.int64)
    for s, (who, got) in enumerate(steps):
        ids[last[who] - 1 - s] = got
    per_doc = np.bincount(doc, used, n).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(per_doc)])
    if distinct and not np.array_equal(m.decode(ids), data):  # two parts with one hash
        return sample(m, data, offsets, keys, False)
    return ids, begin


def encode(docs: DataFrame, model_path: str, theta: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (sampled pieces), text_sha256. model_path must be readable on the executors."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path, theta)
        for batch in batches:
            keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in tokens.text_slices(batch.column("text")):
                ids, begin = sample(m, data, off, keys[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), tokens.lists(ids.astype(np.int32), begin, pa.int32()), batch.column("text_sha256").slice(lo, hi - lo)], names=["doc_id", "ids", "text_sha256"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("text_sha256"))
    return src.mapInArrow(run, "doc_id bigint, ids array<int>, text_sha256 string")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """All columns of rows (id, ids, ...), with the text that the ids spell in place of the ids."""
    others = [c for c in rows.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path, 1.0)
        for batch in batches:
            ids = batch.column(ids_col)
            for lo in range(0, batch.num_rows, 64):
                part = ids.slice(lo, 64).fill_null([])
                off = part.offsets.to_numpy()
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.concatenate([[0], np.cumsum(m.spell_from[flat + 1] - m.spell_from[flat])])
                at = sizes[off - off[0]]
                text = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(m.decode(flat).tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, 64) for c in others] + [text], names=[*others, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != ids_col)
    return rows.mapInArrow(run, f"{kinds}, text string")


def round_trip(docs: DataFrame, model_path: str, theta: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, lossless: every text encoded, decoded and compared."""
    rows = encode(docs, model_path, theta, id_col, text_col)
    n, crc = F.size("ids").cast("long"), F.crc32(F.array_join("ids", ",").cast("binary"))
    back = decode(rows.select("doc_id", "text_sha256", n.alias("n_pieces"), crc.alias("ids_crc32"), "ids"), model_path)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), (F.sha2("text", 256) == F.col("text_sha256")).alias("lossless"))
