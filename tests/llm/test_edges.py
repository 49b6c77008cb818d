"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from hubflow.llm import embeddings, exact, extraction, licences, mixing, packing, simhash, tokens, toxicity
from hubflow.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000 + "x" * 50_000
ROWS = [
    (1, "a b c d e f g", "en", "s1", 13),
    (1, "a b c d e f g", "en", "s1", 13),  # a repeated row
    (2, "a b  c d\ne f g", "en", "s1", 14),
    (3, None, None, None, None),
    (4, "", "en", "s2", 0),
    (5, " \t\n", "en", "s2", 3),
    (None, "no id at all", "en", None, 5),
    (None, None, None, None, None),
    (6, LONG, "en", "s1", len(LONG)),
    (7, "MIT License\nmit license apache license é", "fr", "s3", 30),
]
#: Names that operators use inside.
CLASHES = ["h", "fp", "key", "size", "members", "md5", "recipe", "norm", "root", "component_id", "keep_id", "n_tokens", "pre", "places", "digits", "rest", "target", "whole"]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, ("idiot moron " if i % 4 == 0 else "kind words ") + f"and word{i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


OPERATORS = {
    "mixing": lambda d, m: mixing.mix(d),
    "tokens": lambda d, m: tokens.token_counts(d, tokenizer_path("piece_bpe_32k.model")),
    "simhash": lambda d, m: simhash.near_duplicates(d),
    "licences": lambda d, m: licences.scan_licences(d),
    "toxicity": lambda d, m: toxicity.grade(d, m),
    "exact": lambda d, m: exact.exact_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, model, name):
    out = OPERATORS[name](documents(spark), model).collect()
    assert len(out) == len(ROWS)
    assert sorted((r.doc_id for r in out), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert OPERATORS[name](documents(spark, []), model).count() == 0


def test_defined_results(spark, model):
    by = lambda df: {(r.doc_id, i): r for i, r in enumerate(df.where("doc_id IN (1, 2, 3, 4, 5, 6, 7)").orderBy("doc_id").collect())}
    ex = {r.doc_id: r for r in exact.exact_groups(documents(spark)).where("doc_id IS NOT NULL").collect()}
    assert (ex[1].keep_id, ex[1].group_size, ex[2].keep_id, ex[2].kept) == (2, 3, 2, True)  # the longest original stays
    twice = exact.exact_groups(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.group_size, r.kept) for r in twice) == [(0, 2, False), (0, 2, True), (1, 2, False), (1, 2, True)]
    assert ex[3].keep_id == 5 and ex[4].group_size == 4 and ex[5].kept
    n = {r.doc_id: r.n_tokens for r in tokens.token_counts(documents(spark), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert n[3] == n[4] == 0
    li = {r.doc_id: r for r in licences.scan_licences(documents(spark)).collect()}
    assert (li[7].n_base, li[7].first_word, li[7].last_word, li[7].base_labels) == (3, 0, 4, "apache,mit")
    assert (li[3].n_words, li[3].first_word, li[3].labels, li[3].score) == (0, None, "", 0.0)
    mixed = by(mixing.mix(documents(spark)))
    assert all(r.taken <= 3 * r["size"] for r in mixed.values())
    sh = {r.doc_id: r for r in simhash.near_duplicates(documents(spark)).where("doc_id IS NOT NULL").collect()}
    assert sh[3].fp == sh[4].fp == sh[5].fp == 0 and sh[5].component_id == 3 and sh[2].component_id == 1


def test_clashing_names_pass_through(spark, model):
    """Operators that hand rows on return the caller's columns as they were, whatever they are called."""
    names = [*CLASHES, "_id", "_none", "_sha", "_points", "id", "none", "sha", "points", "row", "t1", "t2", "node", "best", "copies", "tree"]
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g  h"), (None, None), (3, "x y")], "doc_id long, text string").withColumns({c: F.concat(F.lit(f"{c} "), F.length("text")) for c in names})
    for kept, ids in ((exact.keep_one(docs), [None, 2, 3]), (simhash.keep_unlike(docs), [1, None, 3]), (toxicity.keep_clean(docs, model), [1, 1, 2, None, 3])):
        out = kept.collect()
        assert kept.columns == docs.columns and sorted((r.doc_id for r in out), key=str) == sorted(ids, key=str)
        assert all(r[c] == (None if r.text is None else f"{c} {len(r.text)}") for r in out for c in names)
    mixed = mixing.mix(docs.drop("copies", "size", "members", "target", "target"), F.lit("s"), keep=["_id", "rest", "digits", "md5", "root"])
    assert all(r[c] == (None if r.size == 0 else f"{c} {len('a b c d e f g h') + (r.doc_id == 2) if r.doc_id != 3 else 3}") for r in mixed.collect() for c in ("_id", "root"))


def test_packing_edges(spark):
    out = packing.pack(documents(spark), tokenizer_path("byte_bpe_50k.json"), window=64).collect()
    assert sum(r.length for r in out if r.doc_id == 3) == 1  # the end id alone
    assert sum(r.length for r in out if r.doc_id == 1) == 2 * [r.doc_tokens for r in out if r.doc_id == 1][0]
    assert packing.pack(documents(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, [0.0] * 4), (5, []), (6, [1.0, None, 2.0, 3.0]), (7, [float("nan"), 1.0, 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0, 1.0]), (9, [2 * x for x in v]), (None, v), (10, [4.0, -3.0, 2.0, -1.0]), (11, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "node", "size", "filter", "parts", "h", "label")})
    out = embeddings.near_vectors(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None}
    assert got[1] == (4, 1, True) and got[2] == (4, 1, False) and got[9] == (4, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 10, 11))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://a.example/x", "<article><p>Text</article>"), (1, "http://a.example/x", "<article><p>Text</article>"), (2, None, None), (None, "::bad", "plain &amp; simple"), (3, "http://a.example/y", ""), (4, "http://a.example/z", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "lines", "kinds", "group", "groups", "n")})
    out = {(r.page_id, i): r for i, r in enumerate(extraction.extract(df).collect())}
    assert len(out) == len(rows)
    text = {r.page_id: r.text for r in out.values()}
    assert text[1] == "Text" and text[2] == text[3] == "" and text[None] == "plain & simple" and text[4] == ("long " * 50_000).strip()
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert extraction.extract(df.limit(0)).count() == 0
