"""Near-duplicate classes by order MinHash over five-word k-mers, verified by banded alignment.

A document is its sequence of words (see tokens). Documents with the same words form one exact
group, represented by one row; documents without words are grouped by their whole text.
Of each representative, every sketch takes the K_MIN smallest hashes of its occurrence-labelled
k-mers and keeps them in text order, so that equal sketches speak for equal k-mers in the same
order. Two documents are linked if the best order-keeping alignment of their k-mers, LCS, has
LCS / (n + m - LCS) >= threshold. That needs every matched pair to lie within a band of
(n + m) (1 - threshold) / (1 + threshold) positions, which bounds the alignment without loss.

Documents that share a sketch form a bucket; a bucket is never expanded into all pairs. First its
members are compared with HEADS of them (the same ones in all buckets of a group of copies), and
linked ones become classes. Then the members outside a bucket's largest class are compared with
all others of other classes, in chunks of at most CHUNK members a side: sketches alone decide
which pairs are worth aligning, and such pairs are gathered by blocks of at most BLOCK documents,
and BLOCK_KMERS k-mers, so that the k-mers of a document are sent once for each pair of blocks,
not for each pair of documents. In a pair of blocks products of k-mer incidences refute most
pairs; the rest is aligned unless linked already. Pairs that share fewer than LEAST_SHARED of all sketches are not
aligned: a pair at similarity 0.8 shares each sketch with probability 0.51 (0.8 to the third), so
at least two of SKETCHES with probability 1 - 1.3e-5. In chunks, pairs whose BINS (the least hash of
each of 256 classes of k-mers, by one byte) agree in DEVIATIONS standard deviations less than
similarity 0.8 would have them are not aligned either: at 0.8 that befalls about one pair in a
million. That is all that can be missed.

Cases: null text counts as empty, and empty texts are one group; texts of any length are read
whole; ties between equal texts go to the smallest id, then to any one row; a null id sorts below
all others, and rows that repeat an id, or have none, are nodes of their own: each gets the class
of its text; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from bisect import bisect_left
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.llm.common import HOT_SHARE, attach, discard, keyed, prepare, save

K, K_MIN, SKETCHES, THRESHOLD = 5, 3, 20, 0.8
#: Sketches that a pair must share to be aligned.
LEAST_SHARED = 2
#: Classes of k-mers whose least hashes are compared before k-mers are sent; how far under the expected agreement refutes.
BINS, DEVIATIONS = 256, 5.0
#: Members of a bucket that all others are compared with first.
HEADS = 2
#: Members of one chunk of a bucket, documents of one block, columns of one product.
CHUNK, BLOCK, COLUMNS = 1024, 1024, 4096
#: k-mers of one block, about; documents of one product.
BLOCK_KMERS, PRODUCT = 1 << 19, 256
NO_ID = -(2**63)
SKETCH = "id bigint, doc bigint, a bigint, b bigint, n int, sketches array<bigint>, bins binary"
_SEEDS = tokens.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def labelled(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """k-mer hashes told apart by how often the k-mer has occurred in its document before."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    by = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1])
    if new.all():
        return h
    at = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(at, np.diff(at, append=len(h)))
    out = h.copy()
    with np.errstate(over="ignore"):
        again = nth > 0
        out[by[again]] = tokens.mix(h[by[again]] + nth[again].astype(np.uint64))
    return out


def sketch(kmers: np.ndarray) -> np.ndarray:
    """The order MinHash sketches of one document."""
    m = min(K_MIN, len(kmers))
    with np.errstate(over="ignore"):
        rolled = kmers[None, :] ^ _SEEDS[:, None]
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(32)
        rolled *= np.uint64(0x94D049BB133111EB)
        least = np.argpartition(rolled, m - 1, axis=1)[:, :m] if m < len(kmers) else np.tile(np.arange(m), (SKETCHES, 1))
        least.sort(axis=1)
        out = _SEEDS.copy()
        for j in range(m):
            out = tokens.mix(out * np.uint64(0x9E3779B97F4A7C15) + kmers[least[:, j]])
    return out


def binned(kmers: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each document, BINS bytes: 0 for a class without k-mers, else 1 to 255 by its least hash."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    mixed = tokens.mix(kmers ^ np.uint64(0x2545F4914F6CDD1D))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full((len(begin) - 1) * BINS, none)
    np.minimum.at(least, doc * BINS + (mixed % np.uint64(BINS)).astype(np.int64), mixed // np.uint64(BINS))
    return np.where(least == none, 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(-1, BINS)


def may_reach(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether the bins x and y of each pair agree as often as similarity least may leave them."""
    some = ((x | y) > 0).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1)
    return same >= least * some - DEVIATIONS * np.sqrt(least * (1 - least) * some)


def sketched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tokens.text_slices(batch.column("text")):
                h, _, first = tokens.words(data, off)
                kmers, begin = tokens.shingles(h, first, K)
                kmers = labelled(kmers, begin)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                key = np.zeros((2, hi - lo), np.uint64)
                with np.errstate(over="ignore"):
                    place = tokens.mix((np.arange(len(h)) - first[doc]).astype(np.uint64))
                    for i, salt in enumerate((np.uint64(0x51), np.uint64(0xA3))):
                        np.add.at(key[i], doc, tokens.mix(h * (place | np.uint64(1)) + salt))
                for d in np.flatnonzero(np.diff(first) == 0):  # no words: the text itself
                    raw = data[off[d] : off[d + 1]].astype(np.uint64)
                    with np.errstate(over="ignore"):
                        spot = np.arange(len(raw), dtype=np.uint64)
                        key[:, d] = [tokens.mix(raw * (tokens.mix(spot + s) | np.uint64(1)) + s).sum(dtype=np.uint64) + np.uint64(1) for s in (np.uint64(7), np.uint64(11))]
                each = [sketch(kmers[begin[d] : begin[d + 1]]) for d in range(hi - lo) if begin[d + 1] > begin[d]]
                flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
                n = np.diff(begin)
                bins = [row.tobytes() for row in binned(kmers, begin)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(lo, hi - lo), batch.column("doc").slice(lo, hi - lo), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), pa.array(n.astype(np.int32)),
                    tokens.lists(flat.view(np.int64), np.concatenate([[0], np.cumsum((n > 0) * SKETCHES)]), pa.int64()),
                    pa.array(bins, pa.binary()),
                ], names=["id", "doc", "a", "b", "n", "sketches", "bins"])

    return docs.mapInArrow(run, SKETCH)


def similarity(x: np.ndarray, y: np.ndarray, least: float) -> float:
    """LCS / (n + m - LCS) of two labelled k-mer lists by an alignment inside the band; 0 where it is under least."""
    total = len(x) + len(y)
    need = least * total / (1 + least) - 1e-9
    if min(len(x), len(y)) < need:
        return 0.0
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= total * (1 - least) / (1 + least) + 1
    i, j = i[near], j[near]
    if len(i) < need:
        return 0.0
    line = j[np.argsort(i)]
    if len(line) > 1 and not (np.diff(line) > 0).all():
        tails: list[int] = []
        for v in line.tolist():
            at = bisect_left(tails, v)
            if at == len(tails):
                tails.append(v)
            else:
                tails[at] = v
        lcs = len(tails)
    else:
        lcs = len(line)
    return lcs / (total - lcs) if lcs >= need else 0.0


def paired(pairs: DataFrame, values: DataFrame, total: int) -> DataFrame:
    """pairs (rep, id) with the values (id, v) of both as x and y; the rows of a frequent rep are dealt out."""
    often = pairs.groupBy("rep").agg(F.count("*").alias("c")).filter(F.col("c") * HOT_SHARE > total)
    often = often.select(F.col("rep"), F.ceil(F.col("c") * HOT_SHARE / F.lit(max(total, 1))).cast("int").alias("parts"))  # fewer than HOT_SHARE rows, parts sum to 2 HOT_SHARE at most
    left = pairs.join(F.broadcast(often), "rep", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    reps = values.join(F.broadcast(often), F.col("id") == F.col("rep"), "left").select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part"), F.col("v").alias("x"))
    # a document has a few pairs for each of its buckets, so ids are never hot
    return left.join(values.withColumnRenamed("v", "y"), "id").join(reps, ["rep", "part"]).select("rep", "id", "x", "y")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in links (rep, id): the smallest id of its connected component."""
    edges = save(links.select(F.col("rep").alias("u"), F.col("id").alias("v")).union(links.select("id", "rep")).distinct(), "edges")
    labels = save(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("label")), "labels")
    while True:
        at = labels.select(F.col("id").alias("v"), F.col("label").alias("l"))
        best = edges.join(at, "v").groupBy(F.col("u").alias("id")).agg(F.min("l").alias("m"))
        step = labels.join(best, "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = step.select(F.col("id").alias("label"), F.col("label").alias("top"))  # labels are ids of the component
        after = save(step.join(up, "label").select("id", "was", F.least("label", "top").alias("label")), "labels")
        changed = after.filter("was <> label").limit(1).count()
        discard(labels)
        labels = after
        if not changed:
            discard(edges)
            return after.select("id", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id of its class), class_size, kept (true for one row of a class, with that id).

    row_col names a bigint column that tells rows apart, if there is one; it is returned as `row`.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *([F.col(row_col).alias("id")] if row_col else []))
    src = src if row_col else keyed(src, "doc", "id")
    src = src.select("id", F.coalesce("doc", F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = save(sketched(src), "sketches")
    total = rows.count()
    first = F.min(F.struct("doc", "id"))
    groups = rows.groupBy("a", "b").agg(first.alias("top"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("sketches").alias("sketches"), F.first("bins").alias("bins"))
    groups = save(groups.select("a", "b", F.col("top.id").alias("rep"), F.col("top.doc").alias("doc"), "copies", "n", "sketches", "bins"), "groups")

    each = groups.select(F.col("rep").alias("id"), "n", F.posexplode("sketches").alias("j", "s")).select("id", "n", "j", F.xxhash64("j", "s").alias("bucket"))
    star, each, kmers = _stars(each, groups, src, threshold)
    labels = components(star)
    weights = labels.groupBy("label").agg(F.count("*").alias("weight"))
    labels = save(attach(labels, weights, ["label"], "weight", total, F.xxhash64("id")), "labelled")
    links = star.unionByName(_others(each, labels, groups, kmers, threshold))
    discard(kmers)
    labels = components(links)
    classes = groups.select("a", "b", "rep", "doc", "copies").join(labels, F.col("rep") == F.col("id"), "left").select("a", "b", "rep", "doc", "copies", F.coalesce("label", "rep").alias("class"))
    classes = save(classes, "classes")
    sizes = classes.groupBy("class").agg(F.sum("copies").alias("class_size"), F.min(F.struct("doc", "rep")).alias("head"))
    classes = attach(classes, sizes.withColumn("w", F.col("class_size")), ["class"], "w", total, F.xxhash64("a", "b")).select("a", "b", "copies", "class_size", "head")
    sized = save(classes, "classes-sized")
    out = attach(rows.select("id", "doc", "a", "b"), sized, ["a", "b"], "copies", total, F.xxhash64("id"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("doc").alias("doc_id"), back("head.doc").alias("class_id"), "class_size", (F.col("id") == F.col("head.rep")).alias("kept"), *([F.col("id").alias("row")] if row_col else []))


def _stars(each: DataFrame, groups: DataFrame, src: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (rep, id) between the members (id, n, j, bucket) of buckets and the buckets' heads; the members but the heads; all k-mers needed."""
    # the same order in every bucket, so that buckets of one group of copies choose the same heads
    picked = [F.min_by(F.struct("id", "n"), F.xxhash64("id", F.lit(k)) if k else F.col("id")) for k in range(HEADS)]
    # most buckets have one member: sizes go first, as small rows, and only what is left is looked at closer
    sizes = save(each.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    rows = sizes.agg(F.sum("size")).first()[0] or 0
    each = save(attach(each, sizes, ["bucket"], "size", rows, F.xxhash64("id")).filter(F.col("size").isNotNull()).drop("size"), "shared")
    heads = each.groupBy("bucket").agg(F.array_distinct(F.array(*picked)).alias("heads"), F.count("*").alias("size"), F.sum("n").alias("mass"))
    members = save(attach(each, heads, ["bucket"], "size", rows, F.xxhash64("id")).filter(F.col("heads").isNotNull()), "members")
    tried = members.select("id", "n", F.explode("heads").alias("h")).filter(F.col("h.id") != F.col("id"))
    fits = F.least("n", "h.n") >= threshold * F.greatest("n", "h.n")  # else the threshold is out of reach
    pairs = tried.filter(fits).select(F.least("h.id", "id").alias("rep"), F.greatest("h.id", "id").alias("id")).distinct()
    tried = save(pairs, "tried")
    homes = _homes(members)
    values = groups.select(F.col("rep").alias("id"), "sketches").join(homes, "id").select("id", F.struct("sketches", "block").alias("v"))
    shared = F.aggregate(F.zip_with("x.sketches", "y.sketches", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)
    pairs = paired(tried, values, tried.count()).filter(shared >= LEAST_SHARED)
    pairs = pairs.groupBy(F.least("x.block", "y.block").alias("first"), F.greatest("x.block", "y.block").alias("second")).agg(F.collect_list(F.struct("rep", "id")).alias("p"))
    pairs = save(pairs.select("first", "second", F.col("p.rep").alias("xs"), F.col("p.id").alias("ys")), "pairs")
    docs = pairs.select(F.col("first").alias("one"), F.col("second").alias("two"), F.explode(F.array_union("xs", "ys")).alias("id"))
    # the picks may fall on one member; two members or more besides the heads have pairs to compare
    rest = members.filter((F.col("size") > F.size("heads") + 1) & ~F.array_contains("heads.id", F.col("id"))).select("id", "n", "j", "bucket")
    # whatever is aligned later is among the rest, so texts are read and moved once
    kmers = _kmers(src, docs.select("id").union(rest.select("id")).distinct())
    found = _aligned(pairs, docs, kmers, threshold)
    discard(sizes, each, tried, pairs)
    return found, rest, kmers


def _homes(rows: DataFrame) -> DataFrame:
    """(id, block) of the ids of rows (id, bucket, size, mass): a share of the largest bucket that each is in."""
    home = rows.groupBy("id").agg(F.max_by(F.struct("bucket", "size", "mass"), F.struct("size", "bucket")).alias("home"))
    parts = F.ceil(F.greatest(F.col("home.size") / BLOCK, F.col("home.mass") / BLOCK_KMERS))
    block = F.xxhash64("home.bucket", F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.lit(1), parts)))
    return save(home.select("id", block.alias("block")), "homes")


def _others(each: DataFrame, labels: DataFrame, groups: DataFrame, kmers: DataFrame, threshold: float) -> DataFrame:
    """Links (rep, id) between members of buckets that labels (id, label, weight) hold in different classes."""
    rows = each.join(labels, "id", "left").select("id", "n", "j", "bucket", F.coalesce("label", "id").alias("label"), F.coalesce("weight", F.lit(1)).alias("weight"))
    open_ = F.min("label") != F.max("label")
    major = save(rows.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("mass"), F.max_by("label", F.struct("weight", "label")).alias("major"), open_.alias("open")).filter("open").drop("open"), "major")
    total = major.agg(F.sum("size")).first()[0] or 0
    rows = save(attach(rows, major, ["bucket"], "size", total, F.xxhash64("id")).filter("major is not null").select("id", "n", "j", "bucket", "label", "size", "mass", (F.col("label") == F.col("major")).alias("is_major")), "open")
    parts = rows.groupBy("bucket").agg(F.count("*").alias("size2"), F.ceil(F.count_if(~F.col("is_major")) / CHUNK).cast("int").alias("c1"), F.ceil(F.count_if("is_major") / CHUNK).cast("int").alias("c2"))

    homes = _homes(rows)
    info = homes.join(groups.select(F.col("rep").alias("id"), "sketches", "bins"), "id")

    # chunks of the members outside the largest class (0 to c1) meet each other and all of its chunks (c1 to c1 + c2)
    rows = attach(rows, parts, ["bucket"], "size2", total, F.xxhash64("id"))
    chunk = F.when(F.col("is_major"), F.col("c1") + F.pmod(F.xxhash64("id"), F.col("c2"))).otherwise(F.pmod(F.xxhash64("id"), F.col("c1"))).cast("int")
    rows = rows.withColumn("chunk", chunk)
    meets = F.when(F.col("is_major"), F.sequence(F.lit(0), F.col("c1") - 1)).otherwise(F.sequence(F.lit(0), F.col("c1") + F.col("c2") - 1))
    # sketches meet a document's buckets (at most SKETCHES) as one row, and are copied after that
    places = rows.select("id", "n", "label", F.struct("bucket", "j", "chunk", meets.alias("meets")).alias("m"))
    places = places.groupBy("id", "n", "label").agg(F.collect_list("m").alias("ms"))
    grid = places.join(info, "id").select("id", "n", "label", "block", "sketches", "bins", F.explode("ms").alias("m"))
    grid = grid.select("*", F.explode("m.meets").alias("other"))
    grid = grid.select("m.bucket", F.least("m.chunk", "other").alias("p"), F.greatest("m.chunk", "other").alias("q"), "m.chunk", "id", "n", "m.j", "label", "block", "sketches", "bins")

    def candidates(table: pa.Table) -> pa.Table:
        ids, n, label, block, chunk = (table.column(c).to_numpy() for c in ("id", "n", "label", "block", "chunk"))
        sketches = table.column("sketches").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(ids), -1)
        j = int(table.column("j")[0].as_py())
        p, q = int(table.column("p")[0].as_py()), int(table.column("q")[0].as_py())
        left, right = np.flatnonzero(chunk == p), np.flatnonzero(chunk == q)
        out: list[np.ndarray] = []
        step = max(1, (1 << 20) // max(1, len(right)))
        for lo in range(0, len(left), step):
            x = left[lo : lo + step]
            ok = label[x][:, None] != label[right][None, :]
            if p == q:
                ok &= ids[x][:, None] < ids[right][None, :]
            ok &= np.minimum(n[x][:, None], n[right][None, :]) >= threshold * np.maximum(n[x][:, None], n[right][None, :])
            u, v = np.nonzero(ok)
            u, v = x[u], right[v]
            for at in range(0, len(u), 1 << 16):
                a, b = u[at : at + (1 << 16)], v[at : at + (1 << 16)]
                same = sketches[a] == sketches[b]
                # a pair is taken in the bucket of its first shared sketch
                take = (same.sum(axis=1) >= LEAST_SHARED) & (same.argmax(axis=1) == j)
                a, b = a[take], b[take]
                take = may_reach(bins[a], bins[b], threshold)
                out.append(np.stack([a[take], b[take]]))
        u, v = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
        first, second = np.minimum(block[u], block[v]), np.maximum(block[u], block[v])
        by = np.lexsort((second, first))
        u, v, first, second = u[by], v[by], first[by], second[by]
        new = np.ones(len(u), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        cut = np.append(np.flatnonzero(new), len(u))
        return pa.table({"first": first[cut[:-1]], "second": second[cut[:-1]], "xs": tokens.lists(ids[u], cut, pa.int64()), "ys": tokens.lists(ids[v], cut, pa.int64())})

    kind = "first bigint, second bigint, xs array<bigint>, ys array<bigint>"
    pairs = grid.groupBy("bucket", "p", "q").applyInArrow(candidates, kind)
    # at most BLOCK x BLOCK pairs in a row: each pair is taken once
    pairs = pairs.groupBy("first", "second").agg(F.collect_list(F.struct("xs", "ys")).alias("p"))
    pairs = save(pairs.select("first", "second", F.flatten("p.xs").alias("xs"), F.flatten("p.ys").alias("ys")), "candidates")
    docs = pairs.select(F.col("first").alias("one"), F.col("second").alias("two"), F.explode(F.array_union("xs", "ys")).alias("id"))
    found = _aligned(pairs, docs, kmers, threshold)
    discard(major, homes, pairs)
    return found


def _aligned(pairs: DataFrame, docs: DataFrame, kmers: DataFrame, threshold: float) -> DataFrame:
    """Links (rep, id) among pairs (first, second, xs, ys) of blocks' documents (one, two, id): as many as connect what is similar."""

    def align(pairs: pa.Table, docs: pa.Table) -> pa.Table:
        ids = docs.column("id").to_numpy()
        column = docs.column("v").combine_chunks()
        at, flat = column.offsets.to_numpy(), column.values.to_numpy()
        order = np.argsort(ids)
        xs, ys = (order[np.searchsorted(ids, pairs.column(c).combine_chunks().flatten().to_numpy(), sorter=order)] for c in ("xs", "ys"))
        size = np.diff(at)
        common = np.zeros(len(xs), np.float32)
        square = (xs // PRODUCT) * len(ids) + ys // PRODUCT
        by = np.argsort(square, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(square[by])) + 1) if len(by) else []:
            (u, i), (v, j) = (np.unique(k[part], return_inverse=True) for k in (xs, ys))
            common[part] = shared_kmers(*([flat[at[k] : at[k + 1]] for k in side] for side in (u, v)))[i, j]
        total = size[xs] + size[ys]
        near = np.flatnonzero(common >= threshold * total / (1 + threshold) - 1e-6)
        near = near[np.argsort(-common[near] / total[near], kind="stable")]
        top = list(range(len(ids)))

        def find(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        links = []
        for k in near.tolist():
            x, y = int(xs[k]), int(ys[k])
            # what is linked in this pair of blocks already has no more to tell
            if find(x) != find(y) and similarity(flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]], threshold) >= threshold:
                top[find(x)] = find(y)
                links.append((x, y))
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"rep": ids[found[:, 0]], "id": ids[found[:, 1]]})

    sent = docs.join(kmers, "id").select("one", "two", "id", "v")
    return save(pairs.groupBy("first", "second").cogroup(sent.groupBy("one", "two")).applyInArrow(align, "rep bigint, id bigint"), "links")


def shared_kmers(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many k-mers each of the left lists shares with each right one: products of incidence matrices, some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    code = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1]
    cut = sum(len(x) for x in left)
    row = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    column = [code[:cut], code[cut:]]
    width = int(code.max(initial=-1)) + 1
    both = np.ones(width, bool)
    for c in column:
        both &= np.bincount(c, minlength=width) > 0
    place = np.cumsum(both) - 1
    for k in (0, 1):
        inside = both[column[k]]
        column[k], row[k] = place[column[k][inside]], row[k][inside]
        by = np.argsort(column[k], kind="stable")
        column[k], row[k] = column[k][by], row[k][by]
    width = int(both.sum())
    for lo in range(0, width, COLUMNS):
        parts = []
        for side, c, r in zip((left, right), column, row):
            a, b = np.searchsorted(c, [lo, lo + COLUMNS])
            part = np.zeros((len(side), min(COLUMNS, width - lo)), np.float32)
            part[r[a:b], c[a:b] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _kmers(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, v): the labelled k-mers of the wanted ids, which are rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tokens.text_slices(batch.column("text")):
                h, _, first = tokens.words(data, off)
                kmers, begin = tokens.shingles(h, first, K)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), tokens.lists(labelled(kmers, begin).view(np.int64), begin, pa.int64())], names=["id", "v"])

    rows = src.join(wanted, "id", "left_semi").mapInArrow(run, "id bigint, v array<bigint>")
    return save(rows, "kmers")
