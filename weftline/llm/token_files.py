"""Token-id files: documents tokenized in id order, ids coded by context mixing in checksummed blocks.

Layout. A table in the shared folder holds one row a frame, written by Spark's committer: the
shard (a range of doc_id), the frame's place in it, the ids of the shard before it, the documents
of the frame with their id counts, and a payload:

    "WTB2" | alphabet bytes: u32 | blocks: u32 | ids: u32 | of each block: ids u32, code words u32, crc32 of its ids u32
    | alphabet: zlib of u32 ids, counts, successors (symbols, 0 for none) and their grades | code words: u32, block after block

Model. The frame's alphabet gives the state that every block starts from: how often each id occurs
(order 0), and the id that most often follows it, with a grade (order 1). Each block of BLOCK ids
then adapts on its own, so any block can be read with the alphabet alone. A table per block holds
what followed the last two ids (order 2), with a trust that grows with every confirmation. The
order-2 guess if it is trusted, else the order-1 guess, predicts the next id; whether it is right
is one binary decision, whose probability mixes three orders in the logistic domain: terms by the
guess's grade or trust, by the last id and by the last two, each learned in the block. An id that
was not predicted is coded by its order-0 share. Both go through one range coder (64 bits of state,
32-bit words, no carries). All blocks of a frame are coded in step as lanes of one numpy program;
the model works in integers only.

Cases: null text counts as empty, an empty document is its end id alone; null doc_ids sort
first; rows that repeat a doc_id keep their own ids, in an order by text; texts of any length are
encoded whole; an empty table gives no frames and no rows; other columns are ignored, whatever
their names. Damaged blocks raise an error on reading. Ids may be any below 2 ** 26.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.llm.common import partitions, prepare, save

END_ID = 0
BLOCK = 2048
LANES = 4096
FRAME_IDS = BLOCK * LANES
MAGIC = 0x32425457
MOST_ID = 1 << 26
FRAME = "shard int, frame int, before bigint, doc_ids array<bigint>, counts array<int>, n_ids bigint, payload binary"
#: Sizes of a lane's tables, in bits: terms by the last id, terms and guesses by the last two.
LAST_1, LAST_2 = 8, 11
#: Learning rates of the terms by kind of guess, last id, last two ids: shifts of the error.
RATES = (4, 2, 1)
#: Shares of a successor that make its grade (kinds 1 to 4), and the first hit rates of kinds: none, the grades, and order 2 at trust 0 to 3 (kinds 8 to 11).
GRADES = (0.05, 0.3, 0.6, 0.9)
FIRST_RATES = {1: 0.15, 2: 0.45, 3: 0.75, 4: 0.95, 9: 0.6, 10: 0.75, 11: 0.88}
#: Places of the sum of terms: 4096 a unit of log-odds, even odds in the middle; its 12-bit probability, 0 if there is no guess. Integers, the same everywhere.
FINE, EVEN = 4, 2048
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-(np.arange(4096) - EVEN) / 256.0))), 1, 4095).astype(np.int32)
SQUASH[0] = 0
_WORD, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


class Alphabet:
    """What the blocks of a frame start from. Symbols are places among the frame's sorted ids, from 1."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, successor: np.ndarray, grade: np.ndarray):
        self.ids, self.counts, self.successor, self.grade = ids, counts, successor, grade
        d = len(ids)
        self.bits = max(16, min(d.bit_length() + 3, max(20, d.bit_length())))
        #: what is left of a range for ids that were not guessed must hold all shares
        self.squash = np.minimum(SQUASH, 4096 - (1 << max(0, self.bits - 20)))
        whole = 1 << self.bits
        share = np.maximum(1, counts.astype(np.int64) * (whole - d) // max(1, int(counts.sum())))
        if d:
            share[np.argmax(share)] += whole - int(share.sum())  # never below 1: floors and d ones are at most the whole
        self.share, self.start = (np.concatenate([[0], x]).astype(np.uint64) for x in (share, np.cumsum(share) - share))
        self.symbol = np.repeat(np.arange(1, d + 1, dtype=np.int32), share)
        #: by symbol: a hash, and the guess that follows it, as the lanes' tables hold guesses
        self.hash = tokens.mix(np.arange(d + 1, dtype=np.uint64)).view(np.int64) & ((1 << 40) - 1)
        self.guess = np.concatenate([[0], np.where(successor > 0, successor.astype(np.int64) << 4 | grade, 0)]).astype(np.int32)

    @staticmethod
    def of(ids: np.ndarray) -> tuple[Alphabet, np.ndarray]:
        """The alphabet of a frame's ids, and the ids as symbols."""
        most = int(ids.max(initial=0)) + 1
        if most <= 1 << 22:
            counts = np.bincount(ids, minlength=most)
            used = np.flatnonzero(counts)
            place = np.zeros(most, np.int32)
            place[used] = np.arange(len(used))
            symbols, counts = place[ids], counts[used]
        else:
            used, symbols, counts = np.unique(ids, return_inverse=True, return_counts=True)
        d = len(used)
        successor, grade = np.zeros(d, np.int32), np.zeros(d, np.uint8)
        if len(symbols) > 1:
            pair = symbols[:-1].astype(np.int64) * d + symbols[1:]
            pair.sort()
            at = np.flatnonzero(np.diff(pair, prepend=-1))
            often, pair = np.diff(at, append=len(pair)), pair[at]
            first, second = np.divmod(pair, d)
            lead = np.flatnonzero(np.diff(first, prepend=-1))
            best = np.maximum.reduceat(often * d + second, lead)
            first, share = first[lead], best // d / counts[first[lead]]
            good = share >= GRADES[0]
            successor[first[good]] = best[good] % d + 1
            grade[first[good]] = np.searchsorted(GRADES, share[good], "right")
        return Alphabet(used.astype(np.int64), counts, successor, grade), symbols.astype(np.int32) + 1

    def pack(self) -> bytes:
        return zlib.compress(b"".join(x.astype("<u4").tobytes() for x in (np.diff(self.ids, prepend=0), self.counts, self.successor)) + self.grade.tobytes())

    @staticmethod
    def unpack(data: bytes) -> Alphabet:
        raw = zlib.decompress(data)
        d = len(raw) // 13
        ids, counts, successor = (np.frombuffer(raw, "<u4", d, 4 * d * k).astype(np.int64) for k in range(3))
        return Alphabet(np.cumsum(ids), counts, successor.astype(np.int32), np.frombuffer(raw, np.uint8, d, 12 * d))


class Lanes:
    """The adaptive model and the range of n blocks in step."""

    def __init__(self, n: int, alphabet: Alphabet):
        self.a = alphabet
        lane = np.arange(n)
        self.by_kind, self.by_1, self.by_2 = (lane << bits for bits in (4, LAST_1, LAST_2))
        self.guess = np.zeros(n << LAST_2, np.int32)  # symbol << 4 | 8 | trust
        first = np.full(16, -(1 << 24), np.int32)
        for kind, rate in FIRST_RATES.items():
            first[kind] = round((EVEN + 256 * np.log(rate / (1 - rate))) * (1 << FINE))
        self.terms = [np.tile(first, n), np.zeros(n << LAST_1, np.int32), np.zeros(n << LAST_2, np.int32)]
        self.last = np.zeros(n, np.int64)
        self.hash, self.hash_2 = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of the last symbol, and of the one before, shifted
        self.low = np.zeros(n, np.uint64)
        self.range = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbol that is guessed to be next (0 for none), and the part of the range that stands for it."""
        at = ((self.hash + self.hash_2) & ((1 << LAST_2) - 1)) + self.by_2
        self.seen = self.guess.take(at, mode="clip")
        pick = np.where((self.seen & 3) > 0, self.seen, self.a.guess.take(self.last, mode="clip"))
        self.cells = self.by_kind + (pick & 15), self.by_1 + (self.hash & ((1 << LAST_1) - 1)), at
        self.values = [t.take(c, mode="clip") for t, c in zip(self.terms, self.cells)]
        total = self.values[0] + self.values[1]
        total += self.values[2]
        total >>= FINE
        self.p = self.a.squash.take(total, mode="clip")
        return pick >> 4, (self.range >> np.uint64(12)) * self.p.view(np.uint32)

    def learn(self, symbol: np.ndarray, hit: np.ndarray) -> None:
        err = (hit.astype(np.int32) << 12) - self.p
        for term, cell, value, rate in zip(self.terms, self.cells, self.values, RATES):
            value += err >> rate
            term[cell] = value
        held = (symbol << 4) | 8
        seen = self.seen
        # a trusted guess survives one miss; any other is replaced
        self.guess[self.cells[2]] = np.where((seen ^ held) < 4, np.minimum(seen + 1, held + 3), np.where((seen & 2) > 0, seen - 2, held))
        self.last = symbol
        self.hash_2 = self.hash >> 13
        self.hash = self.a.hash.take(symbol, mode="clip")

    def renew(self, at: np.ndarray) -> np.ndarray:
        """Shift a word out of the lanes at, whose range is less than a word; the word."""
        low, size = self.low[at], self.range[at]
        split = ((low ^ (low + size - np.uint64(1))) >> _WORD) > 0  # the part straddles a word: give up its upper end
        size = np.where(split, (np.uint64(0) - low) & _LOW, size)
        self.low[at] = low << _WORD
        self.range[at] = size << _WORD
        return (low >> _WORD).astype(np.uint32)


def _code(blocks: np.ndarray, sizes: np.ndarray, a: Alphabet) -> list[np.ndarray]:
    """The code words of each block (a row of symbols; rows of one size but for the last)."""
    n = len(blocks)
    m = Lanes(n, a)
    columns = np.ascontiguousarray(blocks.T)
    if len(sizes) and sizes[-1] < sizes[0]:  # the last lane ends before the others: any symbol will do after that
        columns[sizes[-1] :, -1] = 1
    lane_out, word_out = [], []
    bits = np.uint64(a.bits)
    with np.errstate(over="ignore"):
        for symbol in columns:
            guess, part = m.predict()
            hit = (symbol == guess) & (m.p > 0)  # a guess of no probability is none
            each = (m.range - part) >> bits
            m.low += np.where(hit, np.uint64(0), part + each * a.start.take(symbol, mode="clip"))
            m.range = np.where(hit, part, each * a.share.take(symbol, mode="clip"))
            ready = np.flatnonzero(m.range <= _LOW)
            if len(ready):
                lane_out.append(ready)
                word_out.append(m.renew(ready))
            m.learn(symbol, hit)
    lanes = np.concatenate([*lane_out, np.zeros(0, np.int64)])
    words = np.concatenate([*word_out, np.zeros(0, np.uint32)])
    by = np.argsort(lanes, kind="stable")
    words, cut = words[by], np.searchsorted(lanes[by], np.arange(n + 1))
    tail = np.stack([m.low >> _WORD, m.low & _LOW], 1).astype(np.uint32)
    return [np.concatenate([words[cut[i] : cut[i + 1]], tail[i]]) for i in range(n)]


def _decode(sizes: np.ndarray, codes: list[np.ndarray], a: Alphabet) -> np.ndarray:
    """The symbols of each block, one row a block."""
    n, steps = len(codes), int(sizes.max(initial=0))
    out = np.zeros((steps, n), np.int32)
    m = Lanes(n, a)
    at = np.cumsum([0] + [len(c) + 2 for c in codes])[:-1]
    data = np.concatenate([x for c in codes for x in (c, np.zeros(2, np.uint32))]).astype(np.uint64)
    left = (data[at] << _WORD) | data[at + 1]  # the code less low
    at = at + 2
    bits = np.uint64(a.bits)
    with np.errstate(over="ignore", divide="ignore"):
        for t in range(steps):
            guess, part = m.predict()
            hit = left < part
            each = (m.range - part) >> bits
            slot = (left - part) // each  # damaged blocks may lead anywhere: places are clipped
            symbol = np.where(hit, guess, a.symbol.take(slot.view(np.int64), mode="clip"))
            start = np.where(hit, np.uint64(0), part + each * a.start.take(symbol, mode="clip"))
            m.low += start
            left -= start
            m.range = np.where(hit, part, each * a.share.take(symbol, mode="clip"))
            ready = np.flatnonzero(m.range <= _LOW)
            if len(ready):
                m.renew(ready)
                left[ready] = (left[ready] << _WORD) | data.take(at[ready], mode="clip")
                at[ready] += 1
            out[t] = symbol
            m.learn(symbol, hit)
    return out.T


def pack(ids: np.ndarray) -> bytes:
    """A payload of ids, each 0 to MOST_ID - 1."""
    if len(ids) and (ids.min() < 0 or ids.max() >= MOST_ID):
        raise ValueError(f"ids must be 0 to {MOST_ID - 1}")
    a, symbols = Alphabet.of(ids)
    n = -(-len(ids) // BLOCK)
    sizes = np.minimum(BLOCK, len(ids) - np.arange(n) * BLOCK)
    grid = np.zeros(n * BLOCK, np.int32)
    grid[: len(ids)] = symbols
    grid = grid.reshape(n, BLOCK)
    codes = [c for i in range(0, n, LANES) for c in _code(grid[i : i + LANES, : sizes[i]], sizes[i : i + LANES], a)]
    flat = ids.astype("<u4")
    head = np.array([[k, len(c), zlib.crc32(flat[i * BLOCK : i * BLOCK + k].tobytes())] for i, (k, c) in enumerate(zip(sizes.tolist(), codes))], "<u4").reshape(-1, 3)
    alphabet = a.pack()
    return np.array([MAGIC, len(alphabet), n, len(ids)], "<u4").tobytes() + head.tobytes() + alphabet + b"".join(c.astype("<u4").tobytes() for c in codes)


def unpack(payload: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a payload, or of one of its blocks."""
    magic, size, n, total = np.frombuffer(payload[:16], "<u4").tolist()
    if magic != MAGIC:
        raise ValueError("not a token payload")
    head = np.frombuffer(payload[16 : 16 + 12 * n], "<u4").reshape(n, 3).astype(np.int64)
    at = 16 + 12 * n + size
    try:
        a = Alphabet.unpack(payload[at - size : at])
    except zlib.error as e:
        raise ValueError("the alphabet is damaged") from e
    begin = at + 4 * np.concatenate([[0], np.cumsum(head[:, 1])]).astype(np.int64)
    out = []
    which = range(n) if only is None else [only]
    for lo in range(0, len(which), LANES):
        part = which[lo : lo + LANES]
        codes = [np.frombuffer(payload[begin[i] : begin[i + 1]], "<u4") for i in part]
        for i, symbols in zip(part, _decode(head[part, 0], codes, a)):
            ids = a.ids.take(symbols[: head[i, 0]] - 1, mode="clip")
            if zlib.crc32(ids.astype("<u4").tobytes()) != head[i, 2]:
                raise ValueError(f"block {i} is damaged")
            out.append(ids)
    ids = np.concatenate([*out, np.zeros(0, np.int64)])
    if only is None and len(ids) != total:
        raise ValueError("ids are missing")
    return ids


def _classes() -> np.ndarray:
    """Of every code point: 0 letter, 1 number, 2 space, 3 other, 4 not known to be the same in all Unicode versions."""
    out = np.full(sys.maxunicode + 1, 4, np.uint8)
    old = unicodedata.ucd_3_2_0
    kinds = {"L": 0, "N": 1, "Z": 2, "M": 3, "P": 3, "S": 3, "C": 3}
    for i in range(len(out)):
        kind = unicodedata.category(chr(i))
        if kind == old.category(chr(i)) and kind not in ("Cn", "Cs", "Zl", "Zp"):
            out[i] = kinds[kind[0]]
    out[9:14] = 2
    out[0x1C:0x20], out[0x85] = 4, 4
    return out


class Tokenizer:
    """The tokenizers library, with a store of pre-tokens that it has encoded before.

    Files whose pre-tokenizer is the usual byte-level one cut texts by a fixed rule, and pieces are
    encoded independently: then pieces are found for many texts at once, and only new ones go to
    the library. Texts that hold special tokens or characters that Unicode versions class
    differently, and all texts of other files, go to the library whole.
    """

    KEEP, SHIFT = 1_000_000, 43
    SLOTS = 1 << (64 - SHIFT)
    #: The characters that byte-level models spell bytes with: printable ones stand for themselves, the others, in order, from 256 on.
    BYTES = np.arange(256, dtype="<u2")
    BYTES[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = np.arange(256, 256 + 68)
    _CLASS: np.ndarray | None = None

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        made = json.loads(self.library.to_str())
        cut = made.get("pre_tokenizer") or {}
        self.cuts = made.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and made["model"].get("type") == "BPE" and not made["model"].get("dropout")
        if self.cuts and Tokenizer._CLASS is None:
            Tokenizer._CLASS = _classes()
        self.clear()

    def clear(self) -> None:
        self.key, self.at = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
        self.n = 0
        self.ids, self.chars = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint32)
        self.ids_from, self.chars_from = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @staticmethod
    def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        """array, grown if need be, with the values at a place."""
        if at + len(values) > len(array):
            array = np.concatenate([array, np.zeros(max(len(array), at + len(values) - len(array)), array.dtype)])
        array[at : at + len(values)] = values
        return array

    def _add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        n = self.n
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        chars_end = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        raw = np.frombuffer("".join(pieces).encode(), np.uint8)
        raw_end = np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))[chars_end - 1].tolist()
        spelt = self.BYTES[raw].tobytes().decode("utf-16-le")
        merge = self.library.model.tokenize
        found: list[int] = []
        ids_end = np.zeros(len(pieces), np.int64)
        for k, (a, b) in enumerate(zip([0, *raw_end], raw_end)):
            found += [t.id for t in merge(spelt[a:b])]
            ids_end[k] = len(found)
        ids = np.array(found, np.int32)
        for what, start, values, ends in (("ids", "ids_from", ids, ids_end), ("chars", "chars_from", chars, chars_end)):
            begin = getattr(self, start)
            at = int(begin[n])
            setattr(self, what, self._put(getattr(self, what), at, values))
            setattr(self, start, self._put(begin, n + 1, at + ends))
        slot, todo = (hashes >> np.uint64(self.SHIFT)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = todo[self.at[slot[todo]] < 0]
            self.at[slot[free]] = n + free  # of several for one slot, the last has it
            won = free[self.at[slot[free]] == n + free]
            self.key[slot[won]] = hashes[won]
            todo = todo[self.at[slot[todo]] != n + todo]
            slot[todo] = (slot[todo] + 1) % self.SLOTS
        self.n += len(pieces)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in the store, or -1."""
        slot = (h >> np.uint64(self.SHIFT)).astype(np.int64)
        found = self.at.take(slot, mode="clip")
        wrong = np.flatnonzero((found >= 0) & (self.key.take(slot, mode="clip") != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % self.SLOTS
            found[wrong] = self.at[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.key[slot[wrong]] != h[wrong])]
        return found

    def _starts(self, cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts that begin at `first` begin."""
        n = len(cp)
        text = np.zeros(n + 1, bool)
        text[first] = True
        text[n] = True
        run = text.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        start = run.copy()
        # the last of a run of spaces leaves the run if something follows, and a plain one joins that
        last = np.flatnonzero((kind == 2) & run[1:] & ~text[1:])
        start[last] = True
        start[last[cp[last] == 0x20] + 1] = False
        # an apostrophe that is a run of its own takes s, t, m, d, re, ve, ll with it
        mark = np.flatnonzero((cp == 0x27) & start[:n] & run[1:] & ~text[1:])
        if len(mark):
            one = cp[mark + 1]
            two = np.where(text[mark + 2], 0, cp[np.minimum(mark + 2, n - 1)])
            for at, size in ((mark[np.isin(one, [0x73, 0x74, 0x6D, 0x64])], 1), (mark[((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)], 2)):
                start[at + 1] = False
                start[at + size + 1] = True
        return np.flatnonzero(start[:n])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (with an end)."""
        slow = np.ones(len(texts), bool)
        if self.cuts:
            whole = "".join(texts)
            size = np.array([len(t) for t in texts], np.int64)
            cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            kind = self._CLASS.take(cp, mode="clip")
            slow = np.zeros(len(texts), bool)
            unknown = np.flatnonzero(kind == 4)
            if len(unknown):
                slow[np.searchsorted(np.cumsum(size), unknown, "right")] = True
            if any(s in whole for s in self.specials):
                slow |= [any(s in t for s in self.specials) for t in texts]
        if slow.any():
            each: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
            fast = np.flatnonzero(~slow)
            if len(fast):
                ids, begin = self.encode_batch([texts[i] for i in fast])
                for k, i in enumerate(fast.tolist()):
                    each[i] = ids[begin[k] : begin[k + 1]]
            for i in np.flatnonzero(slow).tolist():
                each[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
            return np.concatenate(each), np.cumsum([0] + [len(x) for x in each])
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        first = np.cumsum(size) - size
        start = self._starts(cp, kind, first[size > 0])
        length = np.diff(start, append=len(cp))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))
            within = np.arange(len(cp)) - np.repeat(start, length)
            h = tokens.mix(np.add.reduceat((cp + np.uint64(1)) * power.take(within, mode="clip"), start))
        which = self._find(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            some, at = np.unique(h[new], return_index=True)
            if self.n + len(some) > self.KEEP:
                self.clear()
                some, at = np.unique(h, return_index=True)
                new = np.arange(len(h))
            at = new[at]
            self._add(some, [whole[a : a + b] for a, b in zip(start[at].tolist(), length[at].tolist())])
            which = self._find(h)
        # the store's pieces are the texts' pieces, not just of one hash
        held = self.chars_from[which]
        same = np.array_equal(self.chars_from[which + 1] - held, length) and np.array_equal(self.chars.take(np.repeat(held, length) + within, mode="clip"), cp)
        if not same:
            ids = [np.array(e.ids, np.int32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate(ids), np.cumsum([0] + [len(x) for x in ids])
        count = self.ids_from[which + 1] - self.ids_from[which]
        end = np.cumsum(count)
        ids = self.ids.take(np.repeat(self.ids_from[which] - (end - count), count) + np.arange(end[-1]), mode="clip")
        return ids, np.concatenate([[0], end])[np.searchsorted(start, np.append(first, len(cp)))]


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer_of(path: str) -> Tokenizer:
    """The worker's copy, which keeps what it has learnt from one task to the next."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """The stored frames of docs in ascending id order."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = tokenizer_of(tokenizer_path)
        shard, frame, before = TaskContext.get().partitionId(), 0, 0
        docs_in: list[int | None] = []
        counts_in: list[np.ndarray] = []
        ids_in: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            counts = np.concatenate(counts_in).astype(np.int32)
            values = [shard, frame, before, docs_in, counts, held, pack(np.concatenate(ids_in))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
            names = ["shard", "frame", "before", "doc_ids", "counts", "n_ids", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for lo, hi, _, _ in tokens.text_slices(batch.column("text")):
                ids, begin = tokenizer.encode_batch(batch.column("text").slice(lo, hi - lo).to_pylist())
                docs_in += batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                counts_in.append(np.diff(begin) + 1)
                ids_in.append(np.insert(ids, begin[1:], end_id))
                held += len(ids_in[-1])
                if held >= FRAME_IDS:
                    yield flush()
                    docs_in, counts_in, ids_in, before, held, frame = [], [], [], before + held, 0, frame + 1
        if docs_in:
            yield flush()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return save(src.mapInArrow(run, FRAME), "tokens")


def read_tokens(frames: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless left out, ids of every document, decoded from the stored frames."""
    prepare(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(batch.column("payload")[i].as_py())
                counts = batch.column("counts")[i].values.to_numpy().astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(counts)])
                doc_ids = batch.column("doc_ids")[i].values
                raw = memoryview(ids.astype("<u4").tobytes())
                for lo in range(0, len(counts), 256):
                    hi = min(len(counts), lo + 256)
                    cut = begin[lo : hi + 1]
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:])]
                    columns = {"doc_id": doc_ids.slice(lo, hi - lo), "start": pa.array(batch.column("start")[i].as_py() + cut[:-1]), "n_tokens": pa.array(counts[lo:hi]), "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        columns["ids"] = tokens.lists(ids[cut[0] : cut[-1]].astype(np.int32), cut - cut[0], pa.int32())
                    yield pa.RecordBatch.from_pydict(columns)

    # one row a shard, as many as partitions: sums of the shards before each
    sums = sorted((r[0], r[1]) for r in frames.groupBy("shard").agg(F.sum("n_ids")).collect())
    at, rows = 0, []
    for shard, n in sums:
        rows.append((shard, at))
        at += n
    starts = frames.sparkSession.createDataFrame(rows, "shard int, earlier long")
    src = frames.join(F.broadcast(starts), "shard").select((F.col("earlier") + F.col("before")).alias("start"), "doc_ids", "counts", "payload")
    return src.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
