"""The pipeline and its stages against plain Python, with null and repeated ids, null and empty texts, and repeated rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import pyarrow as pa  # noqa: E402

from tests.llm.test_corpus import brute_contamination, brute_lcs_links, words  # noqa: E402
from weftline.llm import near_dedup, piece_lattice, tokens, toxicity  # noqa: E402
from weftline.llm.exact_dedup import exact_dedup  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, id string"
ITEMS = [(1, "what is the tall tower that stands beside the slow green river of the north called today"), (2, "short item here"), (3, None), (4, "")]


def corpus():
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    rows, labels = [], []
    for i in range(150):
        bad = i % 3 == 0
        rows.append((i, text(40) + ". " + text(10) + (" vilelike" if bad else "") + ". " + text(30)))
        labels.append((i, int(bad), int(bad)))
    base = text(200)
    near = base.split()
    near[20] = "changed"
    rows += [(200, base), (201, base), (None, base), (201, base), (202, " ".join(near)), (203, base.upper())]
    a, b = text(120), text(120)
    near_a, near_b = a.split(), b.split()
    near_a[5], near_b[5] = "one", "two"
    rows += [(None, a), (None, b), (301, " ".join(near_a)), (302, " ".join(near_b))]  # two null ids, each near one other row
    rows += [(400, text(30) + " " + ITEMS[0][1]), (400, text(60)), (None, ITEMS[0][1]), (None, text(50)), (401, text(3000) + " " + ITEMS[0][1])]
    rows += [(500, None), (501, ""), (None, None), (500, None), (502, "!?"), (503, text(9000))]
    return rows, labels


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), None, "x") for i, t in rows], SCHEMA)


def plain_score(model, text):
    _, _, data, off = next(tokens.text_slices(pa.array([text or ""])))
    feature, sentence, doc, _ = toxicity.sentences(data, off)
    return float(model.documents(model.hazards(feature, sentence, len(doc)), doc, 1)[0])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def low(i):
    return -1 if i is None else i


def plain_exact(rows):
    best = {}
    for i, t in rows:
        k = t or ""
        if k not in best or low(i) > low(best[k][0]):
            best[k] = (i, t)
    return list(best.values())


def near_classes(rows):
    texts = [t or "" for _, t in rows]
    top = brute_lcs_links(texts)
    out = {}
    for k, (i, _) in enumerate(rows):
        out.setdefault(top[k], []).append((low(i), k))
    return out


def test_stages_and_run(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, corpus_pipeline.training_labels(spark.read.parquet(f"{folder}/labels.parquet"), "toxic", 4, 2))
    want = [(i, t) for i, t in rows if plain_score(model, t) < toxicity.THRESHOLD]
    assert 0 < len(rows) - len(want) < 80
    got = corpus_pipeline.toxicity(spark, docs, folder)
    assert got.columns == docs.columns and pairs(got) == Counter(want)

    # a row with null text and one with empty text are equal: either may stand for both
    norm = lambda c: Counter({(i, t or ""): n for (i, t), n in c.items()})
    docs, want = frame(spark, want), plain_exact(want)
    got = corpus_pipeline.exact(spark, docs, folder)
    assert got.columns == docs.columns and norm(pairs(got)) == norm(Counter(want))

    docs, classes = frame(spark, want), near_classes(want)
    got = corpus_pipeline.near(spark, docs, folder)
    kept = [want[min(members)[1]] for members in classes.values()]
    assert got.columns == docs.columns and pairs(got) == Counter(kept)

    docs = frame(spark, kept)
    found = [brute_contamination([r], ITEMS)[r[0]][3] for r in kept]
    want = [r for r, bad in zip(kept, found) if not bad]
    assert 0 < len(want) < len(kept)
    got = corpus_pipeline.decontamination(spark, docs, folder)
    assert got.columns == docs.columns and pairs(got) == Counter(want)

    out = corpus_pipeline.sentencepiece(spark, frame(spark, want), folder)
    back = piece_lattice.decode(out.select("doc_id", "ids"), corpus_pipeline.PIECE_MODEL)
    assert pairs(back) == Counter((i, t or "") for i, t in want)

    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in whole) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in want)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rows = [r for r in corpus()[0] if r[0] is None or r[0] >= 200]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    classes = near_classes(rows)
    ids = [[rows[k][0] for _, k in members] for members in classes.values()]
    want = Counter((i, min(m, key=low), len(m)) for m in ids for i in m)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(classes)


def test_exact_dedup_keeps_one_row_where_rows_have_keys(spark):
    rows = [r for r in corpus()[0] if r[0] is None or r[0] >= 200]
    df = frame(spark, rows).rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(SCHEMA + ", key bigint")
    got = exact_dedup(df, row_col="key").collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len({t or "" for _, t in rows})


def test_empty_tables(spark, tables):
    folder, _ = tables
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), folder).collect() == []


def test_words_of_the_helpers():
    assert words(ITEMS[1][1]) == ["short", "item", "here"]
