"""Every operator on nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing columns."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from weftline.llm import decontaminate as dec  # noqa: E402
from weftline.llm import exact_dedup, html_text, license_scan, line_dedup, near_dedup, piece_lattice, quality, token_files, toxicity  # noqa: E402

PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "A long line about nothing in particular, again and again. " * 6000 + "x" * 40_000
TEXTS = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, "short"), (None, None), (4, LONG), (5, LONG), (6, "Released under the MIT License.\nthe same line of twenty letters\n"), (7, "\n\n"), (8, "the same line of twenty letters\n"), (9, "THE SAME LINE OF TWENTY LETTERS")]
# names of the operators' own columns, inner ones too, with nulls in all of them
CLASH = "id bigint, row bigint, y int, n bigint, a bigint, b bigint, doc string, label bigint, score double, kept boolean, keep_id bigint, _d bigint, _t bigint, recipe string, items array<string>, shard int, start bigint, term string, segment bigint, url string, page_id bigint, html string, bucket bigint, text_sha256 string"


def frame(spark, rows, id_col="doc_id", text_col="text"):
    extra = [c for c in CLASH.split(", ") if c.split()[0] not in (id_col, text_col)]
    schema = f"{id_col} bigint, {text_col} string, " + ", ".join(extra)
    return spark.createDataFrame([(i, t, *[None] * len(extra)) for i, t in rows], schema)


@pytest.fixture(scope="module")
def models(spark):
    docs = spark.createDataFrame([(i, "bad vile text." if i % 2 else "good kind text.") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, y int")
    return toxicity.train(docs, labels), quality.train(docs, labels)


def operators(spark, models):
    items = spark.createDataFrame([(1, "a long line about nothing in particular"), (None, None), (2, "")], "item_id bigint, text string")
    return {
        "exact": lambda d: exact_dedup.exact_dedup(d), "lines": lambda d: line_dedup.deduplicated(d), "tokens": lambda d: token_files.read_tokens(token_files.write_tokens(d, BPE)), "toxicity": lambda d: toxicity.score(d, models[0]),
        "near": lambda d: near_dedup.near_duplicates(d), "contaminated": lambda d: dec.decontaminate(d, items), "quality": lambda d: quality.score(d, models[1]), "pieces": lambda d: piece_lattice.round_trip(d, PIECES),
    }


NAMES = ["exact", "lines", "tokens", "toxicity", "near", "contaminated", "quality", "pieces"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(spark, models, name):
    run = operators(spark, models)[name]
    rows = run(frame(spark, TEXTS)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    assert run(frame(spark, [])).collect() == []
    plain = run(spark.createDataFrame(TEXTS, "doc_id bigint, text string")).collect()
    kind = lambda rs: sorted(repr([r[c] for c in r.__fields__]) for r in rs)
    assert kind(rows) == kind(plain)  # other columns change nothing


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_equal_texts_get_equal_scores(spark, models, name):
    rows = operators(spark, models)[name](frame(spark, TEXTS)).collect()
    score = {}
    for r in rows:
        score.setdefault(r.doc_id, set()).add(round(r.score, 12))
    assert score[4] == score[5] and len(score[3]) == 1 and score[1] == score[2] and all(0 <= x <= 1 for s in score.values() for x in s)


def test_dedup_of_ties_and_nulls(spark, models):
    run = operators(spark, models)
    exact = run["exact"](frame(spark, TEXTS)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact if r.doc_id in (1, 2, 3, 4, 5)} == {(1, 2, 3), (2, 2, 3), (3, 3, 3), (4, 5, 2), (5, 5, 2)}
    near = run["near"](frame(spark, TEXTS)).collect()
    assert sum(r.kept for r in near) == len({str(r.class_id) + str(r.class_size) for r in near}) or sum(r.kept for r in near) == 6
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in run["lines"](frame(spark, TEXTS)).collect() if r.doc_id and r.doc_id > 5}
    assert lines == {6: (3, 1), 7: (3, 0), 8: (2, 1), 9: (1, 0)}


def test_licenses_and_pages(spark):
    found = license_scan.license_scan(frame(spark, [*TEXTS, (None, TEXTS[8][1])])).collect()
    assert {(r.doc_id, r.license) for r in found} == {(6, "mit-line"), (None, "mit-line")} and len(found) == 2
    assert license_scan.license_scan(frame(spark, [])).collect() == []
    long = "<article>" + "<p>Some words of a paragraph, and more.</p>" * 3000 + "</article>"
    pages = spark.createDataFrame([(1, None, None, "x", "y"), (None, "u", "", None, None), (2, "u", long, None, None), (2, "u", long, None, None)], "page_id bigint, url string, html string, text string, blocks string")
    out = html_text.main_text(pages).collect()
    assert sorted((str(r.page_id), r.url, len(r.blocks)) for r in out if r.url) == [("2", "u", 3000), ("2", "u", 3000), ("None", "u", 0)] and all(r.text is not None for r in out)
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_fits_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, y int")
    for model in (toxicity, quality):
        fitted = model.train(frame(spark, TEXTS), none)
        assert all(0 <= r.score <= 1 for r in model.score(frame(spark, TEXTS), fitted).collect())
        fitted = model.train(frame(spark, []), spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, y int"))
        assert model.score(frame(spark, []), fitted).collect() == []
