"""Rows that a corpus has somewhere: nulls, empty and very long texts, repeats, empty tables and names that clash."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from casewright.llm import ann_additive, language_gru, line_dedup, quality_knn, simhash, suffix_dedup, url_filter, url_labels  # noqa: E402

#: Names that operators have used, or use, for columns of their own.
NAMES = ("_bytes", "_none", "_row", "row", "own", "none", "bytes", "lang_pred", "_lang_pred", "score", "spans", "gone", "t1", "t2", "_spans", "kept", "fp", "a b")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
SHARED = "the same passage of more than four hundred bytes " * 10


def row(i, t, lang="en"):
    return (i, t, lang, "s", len(t or ""), *(f"{n}{i}" for n in NAMES))


ROWS = [
    row(1, "one two three four five six\n" + SHARED), row(2, None), row(3, ""), row(4, "... 12 ½"), row(5, "word " * 60_000), row(6, SHARED + "\nan end of its own"),
    row(7, "one two three four five six\nseven"), row(None, "null id, a text"), row(8, "café naïve über"), row(8, "café naïve über"), row(9, "x" * 3000), row(10, "plain text here", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_stages_take_odd_rows(spark, docs):
    """Every stage keeps the columns, whatever their names, and the rows that its docstring says stay."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    extra = lambda df: {(r.doc_id, *(r[n] for n in NAMES)) for r in df.collect()}
    out = stages["language"](spark, docs, "")
    assert out.columns == docs.columns and extra(out) <= extra(docs)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((r[0] for r in ROWS if r[0] not in (2, 3, 4)), key=str)
    for name in ("lines", "near_duplicates", "substrings"):
        made = stages[name](spark, docs, "")
        assert made.columns == docs.columns and extra(made) <= extra(docs)
        texts = {r.doc_id: (r.text, r.n_chars) for r in made.collect()}
        assert all(n == len(t) for t, n in texts.values() if t is not None)
        if name == "lines":
            assert texts[7][0] == "seven" and texts[2][0] is None and texts[3][0] == "" and made.count() == len(ROWS)
        elif name == "near_duplicates":
            assert 2 in texts and 3 not in texts  # both have no word
        else:
            assert texts[6][0].endswith("an end of its own") and len(texts[6][0]) < 30 and made.count() == len(ROWS)
    assert stages["packing"](spark, docs, "").select("doc_id").distinct().count() == len({r[0] for r in ROWS})
    for stage in stages.values():
        assert stage(spark, docs.limit(0), "").count() == 0


def test_keep_columns_of_any_name(docs):
    for made in (line_dedup.line_dedup(docs, keep_columns=True), suffix_dedup.suffix_dedup(docs, keep_columns=True)):
        assert made.columns == docs.columns and {(r.doc_id, r["_bytes"], r["a b"]) for r in made.collect()} == {(r[0], r[5], r[-1]) for r in ROWS}


def test_language_letters(docs):
    """A letter is what Unicode calls one; digits and fractions are none."""
    rows = docs.sparkSession.createDataFrame([(1, "½ ² 12 ①"), (2, "12 a"), (3, "漢"), (4, None), (5, "́")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_gru.identify(rows, language_gru.fit([b"aa bb", b"cc dd"], ["x", "y"], steps=2)).collect()}
    assert {i for i, k in got.items() if k == "und"} == {1, 4, 5}


def test_language_reads_samples_whole(spark):
    """A language that shows only past the first pages of its texts is learned from them, and a rare one as well as a common one."""
    rows = [(i, "... 0 1 2 " * 600 + ("zwei über schnee " if i % 10 == 0 else "lorem dolor amet ") * 900, "de" if i % 10 == 0 else "la") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_gru.identify(docs, language_gru.train(docs)).where("held_out").collect()
    assert sum(r.lang_pred == ("de" if r.doc_id % 10 == 0 else "la") for r in got) >= 0.97 * len(got)


def test_quality_vote_by_hand(spark):
    """The blocked products give the vote that a loop over all labelled vectors gives."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA", "42", "..."], 30)) for _ in range(60)]
    x = np.stack([quality_knn.terms(t.encode()) for t in texts])
    y = np.array([int("GAMMA" in t.split()[:15]) for t in texts], np.float32)
    model = quality_knn.Model(x[:40], y[:40])
    for row_, got in zip(x[40:], model.score(x[40:])):
        v = (row_ - model.mean) @ model.axes
        v = v / max(1e-9, math.sqrt(float((v * v).sum())))
        near = sorted(((float(v @ w), float(k)) for w, k in zip(model.vectors.T, y[:40])), reverse=True)[: quality_knn.NEIGHBOURS]
        weights = [max(s, 0.0) ** quality_knn.SHARPNESS + 1e-9 for s, _ in near]
        assert got == pytest.approx(sum(w * k for w, (_, k) in zip(weights, near)) / sum(weights), abs=1e-3)


def test_quality_terms_in_steps(monkeypatch):
    """A text cut in steps has the terms of the whole."""
    t = bytes(np.random.default_rng(1).choice(list(b"abc XYZ.,\n"), 5000).tolist())
    whole = quality_knn.terms(t)
    monkeypatch.setattr(quality_knn, "_STEP", 700)
    assert np.allclose(quality_knn.terms(t), whole, atol=1e-6)


def test_quality_repeats_and_clashes(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in (1, 6, 7, 8, 8, 9, 10)], "doc_id long, quality int, terms string")
    got = quality_knn.score(docs, quality_knn.train(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://casino.example.net/win", "r"), (2, None, "r"), (3, "http://x.com/de/a", "r")], "page_id long, url string, host string")
    none = url_labels.labelled(spark).limit(0)
    got = {r.page_id: (r.verdict, r.score) for r in url_filter.url_filter(pages, none, list(url_labels.RULES)).collect()}
    assert got == {1: ("allow", 0.0), 2: ("allow", 0.0), 3: ("block", 0.0)}
    one = spark.createDataFrame([("http://a.example.net/b", 1), ("http://c.example.net/d", 1), (None, 0)], "url string, label int")
    assert {r.verdict for r in url_filter.url_filter(pages, one, []).collect()} == {"block"}


def test_url_score_by_hand(spark):
    """The score is the logistic of weights times square roots of counts of cells."""
    weights, intercept = url_filter.train(url_labels.labelled(spark))
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(("http://spam.example.com/click/click", "https://docs.example.org/en/x", ""))], "page_id long, url string")
    host, path = url_filter.split_url(F.col("url"))
    got = urls.select(url_filter.features(host, path).alias("cells"), url_filter.score(url_filter.features(host, path), weights, intercept).alias("s")).collect()
    for r in got:
        z = intercept + sum(weights[c] * math.sqrt(r.cells.count(c)) for c in set(r.cells))
        assert r.s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_neighbours_in_double_precision(spark):
    """Distances are those of the column as it is: finer than single precision, and beyond it."""
    rows = [(100, [0.0, 1.0], "q"), (1, [0.076543211, 1.0], "q"), (2, [1e100, 1.0], "q"), (3, [0.1, 1.0], "q"), (3, [0.2, 1.0], "q"), (4, [math.inf, 1.0], "q")]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>, query_id string")
    got = ann_additive.search(table, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 3), (3, 3), (4, 2)] and got[0].score == 0.076543211 and got[3].score == pytest.approx(1e100)
    assert ann_additive.search(table.limit(0), F.lit(True)).schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:double>"
    assert ann_additive.search(table, F.lit(True)).where("query_id = 3").select("rank").distinct().count() == 3


@pytest.mark.parametrize("count", [10, 100])
def test_simhash_chooses_a_grid_by_size(spark, monkeypatch, count):
    """Either side of a change of grid the links are the same."""
    monkeypatch.setattr(simhash, "AXES", ((50, 6), (None, 8)))
    points = spark.createDataFrame([((i // 2 << 40) + (i % 2) * 15, 1) for i in range(count)], "fp long, n long")
    parts = {r.fp: r.component for r in simhash.link(points).collect()}
    assert all(parts[(i << 40) + 15] == parts[i << 40] for i in range(count // 2))
