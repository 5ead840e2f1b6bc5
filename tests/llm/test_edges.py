"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import embeddings, html_text, languages, lexicon, minhash, ordinal, packing, quality_rules, substrings, token_blocks

LONG = " ".join(f"word{i % 5000}x{i // 5000}" for i in range(20_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (6, LONG), (7, LONG + " end"), (None, "alone here"), (9, "Hé <|endoftext|> ñ²  x y"), (10, "12 34 --")]
CLASH = "kept boolean, score double, n_words long, class_id long, start long, hits int, counts int, shared int, digest string, __id long, keep string"


@pytest.fixture(scope="module")
def nasty(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")}
    return df.withColumns(extra)


@pytest.fixture(scope="module")
def empty(nasty):
    return nasty.where("false")


OPERATORS = {
    "ordinal": lambda d: ordinal.rate(d, ordinal.fit(d, d.select("doc_id", F.lit(1).alias("rating")), 2)),
    "languages": lambda d: languages.identify(d, languages.fit(d)),
    "tokens": token_blocks.token_store,
    "rules": quality_rules.quality_rules,
    "lexicon": lexicon.encode_texts,
    "packing": packing.pack,
    "substrings": substrings.repeated_words,
    "minhash": minhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(nasty, name):
    got = OPERATORS[name](nasty).collect()
    rows = [r for r in got if "piece" not in r.__fields__ or r.piece == 0]
    assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(repr(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_nasty_and_empty(spark, nasty, empty, name, stage):
    assert stage(spark, empty, "").count() == 0
    out = stage(spark, nasty, "")
    out.collect()
    if name != "packing":
        assert out.columns == nasty.columns


def test_values_on_nasty(nasty):
    lang = {r.doc_id: r for r in languages.identify(nasty, languages.fit(nasty)).collect()}
    assert [lang[i].lang_pred for i in (1, 2, 3, 10)] == ["und"] * 4 and lang[1].score == 0.0
    cut = {r.doc_id: r for r in substrings.repeated_words(nasty).collect()}
    assert cut[6].n_removed == 0 and cut[7].n_removed == 20_000 and cut[1].n_words == 0
    assert cut[7].kept_sha256 == hashlib.sha256(b"end").hexdigest() and cut[5].n_removed == 0
    classes = {r.doc_id: r for r in minhash.near_duplicates(nasty).collect()}
    assert classes[5].class_id == 4 and classes[7].class_id == 6 and classes[2].kept and classes[None].class_id is None and classes[None].kept
    words = {r.doc_id: r for r in quality_rules.quality_rules(nasty).collect()}
    assert words[1].n_words == words[3].n_words == 0 and words[3].base_failed and words[6].n_words == 20_000


def test_near_dedup_keeps_one_of_each_and_all_that_have_no_text(nasty):
    assert sorted(repr(r.doc_id) for r in minhash.one_of_each(nasty).select("doc_id").collect()) == sorted(map(repr, [1, 2, 3, 4, 6, None, 9, 10]))


def test_rows_that_share_a_doc_id_but_not_their_text(spark):
    """Each row is shortened by what smaller doc_ids hold, not by its twin; near-dedup takes them as one document."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(120)) for w in "abc")
    rows = [(1, a), (2, b + " " + a), (2, a), (2, b), (3, b + " x " + c), (3, c), (4, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.repeated_words(df).collect())
    assert cut == [(1, 120, 0), (2, 120, 0), (2, 120, 120), (2, 240, 120), (3, 120, 0), (3, 241, 120), (4, 120, 120)]
    out = sorted((r.doc_id, r.text) for r in substrings.without_repeats(df).collect())
    assert out == sorted([(1, a), (2, b), (2, ""), (2, b), (3, "x " + c), (3, c), (4, "")])
    classes = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect())
    assert classes == [(1, 1), (2, 1), (2, 1), (2, 1), (3, 3), (3, 3), (4, 3)]


def test_one_very_long_document(spark):
    """A text of 400,000 words and another that holds 30,000 of them."""
    whole = [f"w{(i * i) % 99_991}" for i in range(400_000)]
    df = spark.createDataFrame([(1, " ".join(whole)), (2, "start " + " ".join(whole[100_000:130_000]) + " end")], "doc_id long, text string")
    cut = {r.doc_id: r for r in substrings.repeated_words(df).collect()}
    assert cut[1].n_removed == 0 and cut[2].n_removed == 30_000 and cut[2].kept_sha256 == hashlib.sha256(b"start end").hexdigest()
    assert {r.class_id for r in minhash.near_duplicates(df).collect()} == {1, 2}


def test_clashing_columns_of_the_same_type(spark):
    vs = spark.createDataFrame([(1, [1.0, 0.0], 5, 6), (2, [1.0, 0.001], 7, 8)], "vec_id long, embedding array<double>, uid long, n long")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(vs).collect()) == [(1, 1, 1), (2, 1, 1)]
    ps = spark.createDataFrame([(1, "u", "<article><p>x</p></article>", "other", 9)], "page_id long, url string, html string, text string, n_chars long")
    assert [(r.text, r.n_chars) for r in html_text.extract(ps).collect()] == [("x", 1)]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vs = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (10, []), (11, [1e200, 1e190])]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>").withColumn("kept", F.lit(1)).withColumn("keys", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[11] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, None))
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_pages(spark):
    ps = [(1, "u", None), (2, None, ""), (None, "u", "<p>plain"), (4, "u", "<article><p>a &lt;b&gt;<script>x</p>"), (5, "u", "<!-- open <p>x"), (5, "u", "<article>" + "<p>t</p>" * 9000), (6, "u", "<a href='x><p>y")]
    df = spark.createDataFrame(ps, "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()]
    assert [x[1] for x in got[:2]] == ["", ""] and got[3][1] == "a <b>" and got[5][2] == 9000 * 3 - 2 and len(got) == 7
    assert html_text.extract(df.where("false")).count() == 0
