import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from weftline.llm import decontaminate as dec  # noqa: E402
from weftline.llm import html_text, license_scan, near_dedup, piece_lattice, quality, token_files, tokens, toxicity  # noqa: E402
from weftline.llm.exact_dedup import exact_dedup  # noqa: E402
from weftline.llm.line_dedup import deduplicated, line_dedup  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "the quick brown fox jumps over the lazy dog again and again until night falls on the old mill by the river "
SCHEMA = "doc_id bigint, text string, keep_id string, id string"  # with columns whose names clash
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


CASES = [(1, None), (2, ""), (3, "a\nb"), (4, "a\nb"), (4, "a\nb"), (None, "c"), (5, "c"), (6, LONG * 400), (7, LONG * 400), (8, "é漢🙂▁ <|endoftext|> it's\r\n\t")]


def test_exact_dedup(spark):
    rows = exact_dedup(frame(spark, CASES)).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        same = [i for i, t in CASES if hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256]
        keep = max(i for i in same if i is not None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), r.doc_id == keep)
    assert exact_dedup(frame(spark, []).limit(0)).count() == 0


def test_line_dedup(spark):
    lines = ["A shared line that is long enough", "  a SHARED line that is long enough ", "short", "another line only in two places"]
    docs = [(1, "\n".join([lines[0], lines[2], lines[0]])), (2, "\n".join([lines[1], lines[3]])), (3, "\n".join([lines[0], lines[3], lines[1], ""])), (4, None), (5, lines[2]), (None, "x")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in deduplicated(frame(spark, docs)).collect()}
    assert got == {1: (3, 2, "short"), 2: (2, 1, lines[3]), 3: (4, 0, docs[2][1]), 4: (1, 0, ""), 5: (1, 0, "short"), None: (1, 0, "x")}
    many = [(i, "\n".join(f"line number {k} of the common block" for k in range(200))) for i in range(4)]
    got = {r.doc_id: r for r in line_dedup(frame(spark, many)).collect()}
    assert [got[i].n_dropped for i in range(4)] == [200, 200, 200, 0] and got[3].dropped is None and len(got[0].dropped) == 4


def test_words_match_the_rule():
    import pyarrow as pa

    texts = ["It's 3 Éa-b", "", "x", LONG, "ÀB_c 漢字"]
    for _, _, data, off in tokens.text_slices(pa.array(texts)):
        h, at, first = tokens.words(data, off)
        assert [int(n) for n in np.diff(first)] == [len(words(t)) for t in texts]
        ids = {}
        for w, x in zip([w for t in texts for w in words(t)], h.tolist()):
            assert ids.setdefault(w, x) == x
        assert len(set(ids.values())) == len(ids)


def brute_contamination(docs, items):
    phrases = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            phrases.setdefault(tuple(w[s : s + 13]), set()).add(i)
    out = {}
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for p, ids in phrases.items():
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    found |= ids
        out[i] = (len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "of"] * 10
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(n)) for i, n in enumerate([40, 20, 13, 5, 1, 0])] + [(9, None), (2, LONG)]
    docs = [(i, text(200)) for i in range(20)] + [(100 + i, text(50) + " " + t + " " + text(60)) for i, t in items if t] + [(200, None), (201, ""), (202, items[0][1][:60]), (203, LONG * 5)]
    spark_items = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in dec.decontaminate(frame(spark, docs), spark_items).collect()}
    assert got == brute_contamination(docs, items)


def test_decontamination_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(rng.choice([f"w{i}" for i in range(40)], n))
    items = [(i, text(n)) for i, n in enumerate([30, 20, 13, 5, 25, 30])] + [(9, None), (2, text(20)), (3, text(30))]
    dirty = [text(20) + " " + t + " " + items[i - 1][1] + " " + text(20) for i, t in items if t and i]
    docs = [(7, t) for t in dirty] + [(None, t) for t in dirty] + [(7, text(len(words(t)))) for t in dirty] + [(None, None), (None, ""), (8, ""), (8, "")]
    columns = ("doc_id", "n_words", "n_hit", "items", "begins", "ends", "contaminated")
    found = []
    for size in (dec.BLOCK_WORDS, 40, 1):
        monkeypatch.setattr(dec, "BLOCK_WORDS", size)
        rows = dec.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
        found.append(sorted((repr([r[c] for c in columns]) for r in rows)))
        want = [brute_contamination([d], items)[d[0]] for d in docs]
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows) == sorted((str(d[0]), *w) for d, w in zip(docs, want))
    assert found[0] == found[1] == found[2]


def test_proximity(spark):
    docs = frame(spark, [(1, "gamma x alpha y beta"), (2, "alpha beta"), (3, "alpha " + "z " * 40 + "beta gamma"), (None, "beta alpha gamma")])
    got = dec.proximity(docs, spark.createDataFrame([(7, "alpha beta gamma")], "item_id bigint, text string"), 5)
    assert {(r.doc_id, r["item"]) for r in got.collect()} == {(1, "7"), (None, "7")}


def test_index_holds_the_postings_of_every_term(spark, monkeypatch):
    texts = ["b a b", "", None, "Ünï b", "a " * 50]
    index = dec.build_index(frame(spark, [(i, t) for i, t in enumerate(texts)]).coalesce(1))
    got = {r.term: (r.n, np.frombuffer(r.docs, "<u2").tolist(), np.frombuffer(r.positions, "<u4").tolist()) for r in index.filter("term <> ''").collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 51, "b": 3, "Ünï": 1}
    assert got["b"] == (3, [0, 0, 3], [0, 2, 1]) and got["Ünï"] == (1, [3], [0])
    row = index.filter("term = ''").first()
    assert row.doc_ids == [0, 1, 2, 3, 4] and row.n_words == [3, 0, 0, 2, 50]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    real = tokens.words

    def clash(data, offsets):
        h, at, first = real(data, offsets)
        return h % np.uint64(3), at, first

    monkeypatch.setattr(tokens, "words", clash)
    segment = dec.Segment()
    text = "one two three four two one five"
    _, _, data, off = next(tokens.text_slices(pa.array([text])))
    segment.add(pa.array([9]), data, off)
    rows = pa.Table.from_batches(segment.rows(5)).to_pylist()[1:]
    assert {r["term"]: np.frombuffer(r["positions"], "<u4").tolist() for r in rows} == {"one": [0, 5], "two": [1, 4], "three": [2], "four": [3], "five": [6]}
    with pytest.raises(ValueError):
        dec.Phrases(["i"], [text])


def brute_lcs_links(texts):
    """The smallest index of each text's class."""
    grams = []
    for t in texts:
        w = words(t)
        grams.append([tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else [])

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(up, 2):
        n, m = len(grams[a]), len(grams[b])
        fits = n and m and min(n, m) >= 0.8 * max(n, m) and len({*grams[a]} & {*grams[b]}) >= 0.5 * max(len({*grams[a]}), len({*grams[b]}))
        common = lcs(grams[a], grams[b]) if fits else 0
        if texts[a] == texts[b] or (common and common / (n + m - common) >= 0.8):
            up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in up]


def brute_classes(docs):
    top = brute_lcs_links([t or "" for _, t in docs])
    return {i: docs[top[k]][0] for k, (i, _) in enumerate(docs)}


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(400)]
    docs = []
    for base in range(6):
        w = rng.choice(vocabulary, 150).tolist()
        for copy in range(5):
            v = list(w)
            for _ in range([0, 0, 1, 2, 12][copy]):
                v[rng.integers(len(v))] = "changed"
            docs.append((base * 10 + copy, " ".join(v)))
    docs += [(90, None), (91, ""), (92, "one two"), (93, "One, two!"), (94, "!!!"), (95, "???"), (96, LONG * 60), (97, LONG * 60 + "end")]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute_classes([(i, t) for i, t in docs])


def test_toxicity_learns_and_locates(spark):
    rng = np.random.default_rng(5)
    clean = [f"good{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(300):
        parts = [" ".join(rng.choice(clean, 8)) for _ in range(4)]
        if i % 3 == 0:
            parts[rng.integers(4)] += " vilelike" + "abc"[i % 2]
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(i % 3 == 0)))
    train = spark.createDataFrame(labels[:220], "doc_id bigint, y int")
    model = toxicity.train(frame(spark, rows), train)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows + [(900, None), (901, "")]), model).collect()}
    assert sum((got[i].score >= 0.3) == bool(y) for i, y in labels[220:]) >= 75
    assert all("vilelike" in s for i, _ in labels[220:] for s in got[i].sentences)
    assert 0 <= got[900].score < 0.3 and got[900].score == got[901].score
    only = toxicity.train(frame(spark, rows), train.filter("y = 0"))
    assert toxicity.score(frame(spark, rows[:3]), only).first().score < 0.01


@pytest.mark.parametrize("size", [4, 500])
def test_toxicity_of_long_texts(spark, size):
    rng = np.random.default_rng(7)
    text = lambda n: [" ".join(rng.choice([f"good{i}" for i in range(60)], 8)) for _ in range(n)]
    rows = []
    for i in range(120):
        parts = text(size)
        if i % 3 == 0:
            parts[rng.integers(size)] += " vilelike" + "abc"[i % 2]
        rows.append((i, ". ".join(parts) + "."))
    assert all(len(t) > 20_000 for _, t in rows) == (size == 500)
    model = toxicity.train(frame(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, y int"))
    long = ". ".join(text(20_000))
    got = {r.doc_id: r for r in toxicity.score(frame(spark, [(1, long), (2, long + " vilelikea"), (3, "")]), model).collect()}
    assert got[1].score < 0.1 and got[3].score < 0.1 and got[1].sentences == []
    assert got[2].score >= 0.3 and len(got[2].sentences) == 1 and "vilelikea" in got[2].sentences[0]


def test_quality_learns(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"t{i}" for i in range(80)]
    rows = [(i, (" | " if i % 4 == 0 else " ").join(rng.choice(vocabulary, 30))) for i in range(240)] + [(900, None)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(160)], "doc_id bigint, y int")
    model = quality.train(frame(spark, rows), labels)
    got = {r.doc_id: r.score for r in quality.score(frame(spark, rows), model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 != 0) for i in range(160, 240)) and 0 <= got[900] <= 1


def test_dual_descent_separates():
    x = [(np.array([i % 2]), np.array([1.0])) for i in range(20)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(20)])
    w = quality.dual_descent(x, y, np.full(20, 10.0), 2)
    assert all(np.sign(w[f[0]] + w[2]) == s for (f, _), s in zip(x, y))


def test_license_scan(spark):
    docs = [(1, "Intro words here. " + license_scan.TEMPLATES["mit"].upper() + " tail"), (2, "x\nReleased under the MIT License.\ny"), (3, "released under the mit"), (4, None), (5, ""), (6, LONG), (7, "many filler words " * 30 + license_scan.TEMPLATES["apache-2.0"].replace("governing", "ruling"))]
    got = {(r.doc_id, r.license) for r in license_scan.license_scan(frame(spark, docs)).collect()}
    assert got == {(1, "mit"), (2, "mit-line"), (7, "apache-2.0"), (7, "apache-2.0-line")}  # the notice holds the line
    with pytest.raises(ValueError):
        license_scan.license_scan(frame(spark, docs), {"tiny": "too short"})


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = token_files.read_tokens(token_files.write_tokens(frame(spark, CASES), BPE)).collect()
    assert len(got) == len(CASES)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and len(r.ids) == r.n_tokens
        at += r.n_tokens
        texts = [x or "" for i, x in CASES if i == r.doc_id]
        ids = t.encode(texts[0], add_special_tokens=False).ids + [0]
        assert list(r.ids) == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_token_blocks_are_checked():
    rng = np.random.default_rng(0)
    for ids in (np.concatenate([rng.integers(0, 65536, 3000), np.tile(rng.integers(0, 50, 40), 60)]), rng.integers(0, token_files.MOST_ID, 5000), np.zeros(9000, np.int64), np.array([7])):
        payload = token_files.pack(ids)
        assert np.array_equal(token_files.unpack(payload), ids)
        for k in range(-(-len(ids) // token_files.BLOCK)):  # a block needs no other
            assert np.array_equal(token_files.unpack(payload, k), ids[k * token_files.BLOCK : (k + 1) * token_files.BLOCK])
    assert len(token_files.unpack(token_files.pack(np.zeros(0, np.int64)))) == 0
    payload = token_files.pack(np.arange(9000) % 977)
    for place in (-300, 40, 20):
        broken = bytearray(payload)
        broken[place] ^= 0xFF
        with pytest.raises(ValueError):
            token_files.unpack(bytes(broken))
    with pytest.raises(ValueError):
        token_files.pack(np.array([token_files.MOST_ID]))


@pytest.mark.parametrize("rate", [1e-12, 1e-4, 1 - 1e-4])
def test_token_blocks_with_guesses_of_extreme_probability(monkeypatch, rate):
    monkeypatch.setattr(token_files, "FIRST_RATES", {k: rate for k in token_files.FIRST_RATES})
    rng = np.random.default_rng(1)
    for ids in (np.tile(rng.integers(0, 9, 50), 300), rng.integers(0, 3, 20_000), rng.integers(0, 200_000, 300_000)):
        assert np.array_equal(token_files.unpack(token_files.pack(ids)), ids)


def test_token_coder_beats_general_compression():
    import pyarrow.parquet as pq

    tokenizer = token_files.Tokenizer(BPE)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    ids, _ = tokenizer.encode_batch(texts)
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    size = len(token_files.pack(ids)) / len(ids)
    assert size < len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)
    assert size < -(share * np.log2(share)).sum() / 8


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizer_equals_the_library(name):
    t = token_files.Tokenizer(public_tokenizers.path(name))
    rng = np.random.default_rng(4)
    parts = ["  ", " ", "\n", "\t", "'", "'s", "'re", "'ll", "'ve", "'d", "'x", "a", "Zb", "é", "漢", "12", "٣", "!", "...", "\xa0", "🙂", "\u200b", "\u0301", "\x85", "\x1c", "\u2028", "<|endoftext|>", "_", "\r\n", "\u3000"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)] + ["", LONG * 3000, "x" * 100_000]
    ids, begin = t.encode_batch(texts)
    for i, text in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == t.library.encode(text, add_special_tokens=False).ids


def test_piece_lattice_is_lossless_and_follows_the_weights(spark):
    rows = piece_lattice.round_trip(frame(spark, CASES), PIECES).collect()
    assert len(rows) == len(CASES) and all(r.lossless for r in rows)
    again = {(r.doc_id, r.ids_crc32) for r in piece_lattice.round_trip(frame(spark, CASES).repartition(3), PIECES).collect()}
    assert again == {(r.doc_id, r.ids_crc32) for r in rows}
    m = piece_lattice.model(PIECES, 1.0)
    word = np.frombuffer(b" there", np.uint8)
    paths = {}
    def walk(at, p, done):
        if at == len(word):
            paths[tuple(done)] = p
        for i, s in enumerate(m.spell):
            if s and m.byte_id[s[0]] != i and word[at:].tobytes().startswith(s):
                walk(at + len(s), p * np.exp(m.logp[i]), [*done, i])
    walk(0, 1.0, [])
    n = 20000
    ids, begin = piece_lattice.sample(m, np.tile(word, n), np.arange(n + 1) * len(word), np.arange(n))
    seen = {}
    for k in range(n):
        key = tuple(ids[begin[k] : begin[k + 1]].tolist())
        seen[key] = seen.get(key, 0) + 1
    total = sum(paths.values())
    assert set(seen) <= set(paths)
    for key, p in paths.items():
        q = p / total
        assert abs(seen.get(key, 0) - n * q) <= 5 * np.sqrt(n * q * (1 - q)) + 3


def test_main_text(spark):
    page = "<html><head><title>t</title><script>x='<p>no</p>'</script></head><body><nav><ul><li><a href=1>Menu</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>Head &amp; more</h1><p>First  one.<p>Second\n<b>bold</b> line.</article><div class='comments'><p>Nice post, thanks a lot.</p></div><footer>&copy; me</footer>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<article><p>cut <b>off <a hre")], "page_id bigint, url string, html string")
    got = {r.page_id: (r.url, r.text) for r in html_text.main_text(pages).collect()}
    assert got[1] == ("u", "Head & more\nFirst one.\nSecond bold line.") and got[2] == (None, "") and got[3][1] == "" and got[4][1] == "cut off"


def test_main_text_on_generated_pages():
    trees, rng = html_text.trained(), np.random.default_rng(99)
    right = wanted = given = 0
    for _ in range(100):
        page, kept = html_text.synthetic_page(rng)
        got = html_text.extract([page], trees)[0]
        right += len({*got} & {*kept})
        wanted, given = wanted + len({*kept}), given + len({*got})
    assert right / wanted > 0.95 and right / given > 0.95


@pytest.mark.parametrize("unseen, least", [(("section",), 0.84), (("bare",), 0.9), (("id main", "class entry", "div"), 0.94), (("article", "main", "main article", "header inside"), 0.95)])
def test_main_text_of_unseen_layouts(unseen, least):
    seen = tuple(x for x in html_text.LAYOUTS if x not in unseen)
    trees, rng = html_text.trained(layouts=seen), np.random.default_rng(98)
    right = wanted = given = 0
    for _ in range(120):
        page, kept = html_text.synthetic_page(rng, unseen)
        got = html_text.extract([page], trees)[0]
        right, wanted, given = right + len({*got} & {*kept}), wanted + len({*kept}), given + len({*got})
    assert right / wanted > least and right / given > 0.94


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", "<section>{}</section>", '<div id="main">{}</div>', '<div class="entry">{}</div>', '<div class="xyz">{}</div>', "<article>{}</article>"])
def test_main_text_of_long_plain_articles(wrap):
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6)) + "</ul>"
    for n in (3, 11, 101, 1001):
        blocks = [f"Paragraph {i} of the story, with several words, commas, and a full stop at its end." for i in range(n)]
        page = f"<html><head><title>t</title><body>{menu}{wrap.format(''.join(f'<p>{b}</p>' for b in blocks))}<footer>&copy; x</footer></body></html>"  # a head without an end
        assert html_text.extract([page], html_text.trained())[0] == blocks


def test_bins_refute_only_what_is_far():
    rng = np.random.default_rng(5)
    for n in (1, 7, 60, 400, 5000):
        base = rng.integers(1, 2**63, n).astype(np.uint64)
        near, far = base.copy(), base.copy()
        near[: n // 10] = rng.integers(1, 2**63, n // 10).astype(np.uint64)  # Jaccard 0.82
        far[n // 3 :] = rng.integers(1, 2**63, n - n // 3).astype(np.uint64)  # Jaccard 0.2
        bins = near_dedup.binned(np.concatenate([base, near, far, base]), np.array([0, n, 2 * n, 3 * n, 4 * n, 4 * n]))
        assert (bins[4] == 0).all() and (bins[0] == bins[3]).all()
        assert near_dedup.may_reach(bins[[0, 0]], bins[[1, 3]], 0.8).all()
        assert n < 60 or not near_dedup.may_reach(bins[:1], bins[2:3], 0.8).any()


def test_buckets_of_three_are_compared_whole(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    def kmers(text):
        _, _, data, off = next(tokens.text_slices(pa.array([text])))
        h, _, first = tokens.words(data, off)
        return near_dedup.labelled(*tokens.shingles(h, first, near_dedup.K))

    rng = np.random.default_rng(11)
    triples = []
    for k in range(2000):  # a and b at 0.81, h at 0.79 of both
        h = [f"g{k}v{x}" for x in range(220)]
        a, b = list(h), list(h)
        for x in rng.choice(10, 3, False) * 10 + 6:
            a[x] = b[x] = f"g{k}c{x}"
        for x in (130, 150):
            a[x], b[x + 40] = f"g{k}a{x}", f"g{k}b{x}"
        texts = [" ".join(w) for w in (h, a, b)]
        grams = [kmers(t) for t in texts]
        of_h, of_a, of_b = (near_dedup.sketch(g) for g in grams)
        if (of_a == of_b).sum() >= near_dedup.LEAST_SHARED and (of_h == of_a)[of_a == of_b].all():
            near = [near_dedup.similarity(grams[x], grams[y], 0.0) for x, y in ((1, 2), (0, 1), (0, 2))]
            assert near[0] >= 0.8 > max(near[1:])
            triples.append(texts)
    assert len(triples) >= 3  # a and b are together only in buckets of three
    order = [r.x for r in spark.range(3000).orderBy("id").select(F.xxhash64("id", F.lit(1)).alias("x")).collect()]
    starts = [i for i in range(0, 3000, 3) if order[i] == min(order[i : i + 3])]  # both picks fall on h
    docs = [(i + j, t) for i, texts in zip(starts, triples) for j, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert got == {i: i if i % 3 == 0 else i // 3 * 3 + 1 for i, _ in docs}
