"""Prefix trie, language identification and ranked search: brute force, held-out accuracy, SQL and odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubflow.llm import langid, lexical, queries, trie
from hubflow.llm.queries import tokenizer_path
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.01"
PIECES = tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op11_trie", "op13_search"])
def test_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


# operator 11


def turn_hash(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute_nodes(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), turn_hash(role, text), len(text)))
    own = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    cut = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    made = {c: own.get(c - int(math.fmod(c, 100)), [])[: cut[c]] + own[c][cut[c] :] for c in own}
    members = defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * p[-1][1] if p else 0
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def nodes(df, **how):
    return sorted(tuple(-1 if x is None else x for x in r) for r in trie.prefix_trie(trie.rebuilt(trie.sequences(df)), **how).collect())


@pytest.fixture(scope="module")
def talks():
    """Long and short talks that share much, copies over many shards, missing turns, roles and texts, repeated turns."""
    r = random.Random(1)
    rows = []
    for c in range(300):
        for t in range(r.choice([1, 2, 3, 8, 16, 17, 20, 32, 33, 50])):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["u", "a", None]), r.choice(["x", "yy", None, "é"]) if r.random() < 0.3 else "same"))
    rows += [(c, t, "u", "copy") for c in range(1000, 1300) for t in range(3)] + rows[:5]
    return [*rows, (None, 1, "u", "none"), (7050, 0, "u", "short"), (-3, 0, "u", "minus"), (-105, 0, "u", "minus"), (-100, 0, "u", "base")]


@pytest.mark.parametrize(("shards", "width"), [(1, 1), (1, 16), (3, 4), (7, 16), (40, 16), (40, 3)])
def test_trie_over_shards(spark, talks, shards, width):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("seq", "key", "h", "base", "depth", "turns")})
    assert nodes(df, shards=shards, width=width) == brute_nodes(talks)


def test_turnless_and_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert nodes(empty) == []
    # the base has fewer turns than are taken, so a conversation of fewer turns than that ends up with the base's
    rows = [(1, 0, "u", "only"), (2, 0, "u", "a"), (2, 1, "a", "b"), (205, 0, None, None)]
    assert nodes(spark.createDataFrame(rows, empty.schema)) == brute_nodes(rows)
    seqs = spark.createDataFrame([(1, b""), (2, b"")], "conv_id long, seq binary")
    assert [tuple(r) for r in trie.prefix_trie(seqs).collect()] == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,2").hexdigest())]


# operator 12


def test_all_segmentations():
    pieces, r = langid.Pieces(PIECES), np.random.default_rng(0)
    p = r.random((len(pieces.texts), 2))
    p /= p.sum(axis=0)
    place = {t: i for i, t in enumerate(pieces.texts)}

    def brute(word, k):
        s = langid.START + word

        @lru_cache(None)
        def rest(i):
            if i == len(s):
                return 1.0
            out = 0.0 if s[i] in place else langid.UNKNOWN * rest(i + 1)
            return out + sum(p[place[s[i:j]], k] * rest(j) for j in range(i + 1, len(s) + 1) if s[i:j] in place)

        return math.log(rest(0))

    words = ["a", "the", "étonnant", "straße", "хорошо", "日本", "x" * 30, "a" * 64, "ŋŋ", "𝔘𝔫𝔦"]
    got = langid.word_scores(pieces, words, pieces.scaled(p))
    assert all(abs(got[i, k] - brute(w, k)) < 1e-9 for i, w in enumerate(words) for k in (0, 1))
    # expected counts: of all pieces, those that cover the word's characters
    e = langid.expected_counts(pieces, ["ab"], np.array([3.0]), pieces.scaled(p)[:, [0]])
    total = math.exp(brute("ab", 0))
    for piece in ("▁ab", "▁a", "b", "▁", "ab", "a"):
        parts = [x for x in (["▁ab"], ["▁a", "b"], ["▁", "ab"], ["▁", "a", "b"]) if piece in x and all(y in place for y in x)]
        want = 3 * sum(math.prod(p[place[y], 0] for y in x) for x in parts) / total
        assert piece not in place or abs(e[place[piece]] - want) < 1e-9
    assert abs((e * pieces.lengths[: len(e)]).sum() - 9) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(docs, langid.fit(docs, PIECES)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right"), F.min("score"), F.max("score")).first()
    assert got["n"] > 200
    assert got["right"] >= 0.98 * got["n"]
    assert 0 <= got[2] <= got[3] <= 1


def test_held_out_documents_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs, PIECES, per_language=20), langid.fit(other, PIECES, per_language=20)
    assert a.languages == b.languages
    assert np.allclose(a.probabilities, b.probabilities)


def test_language_edges(spark):
    rows = [(i, ("the house and the garden " if i % 2 else "das haus und der garten ") * 3, "en" if i % 2 else "de") for i in range(60)]
    odd = [(None, "the garden", "en"), (1000, None, "de"), (1001, "", "de"), (1002, "12 !? 34", None), (1003, "the " * 50_000 + "x" * 3_000, None), (1003, "das haus", None), (1004, "日本語" * 100, None), (1005, "́", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("words", "letters", "score", "id", "language", "word")})
    model = langid.fit(docs, PIECES)
    got = defaultdict(list)
    for r in langid.predict(docs, model).collect():
        got[r.doc_id].append((r.lang_pred, r.held_out))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert sum(map(len, got.values())) == len(rows) + len(odd)
    assert got[None] == [("en", False)]
    assert [got[i][0][0] for i in (1000, 1001, 1002, 1005)] == ["und"] * 4
    assert sorted(x[0] for x in got[1003]) == ["de", "en"]
    assert all(got[i][0][0] == lang for i, _, lang in rows)
    nothing = langid.fit(docs.where("false"), PIECES)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


# operator 13


def test_search_in_small_parts(spark, monkeypatch):
    """Many parts, blocks of items and thresholds give the same rows as one search."""
    for name, value in (("POSTINGS", 500), ("DOCS", 20), ("CELLS", 300), ("SEEDS", 1)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert_same(lexical.rank(docs, items, terms=200), connect(SF), queries.OP13_SQL)


def test_search_edges(spark):
    rows = [(1, "Red apple, red pear"), (2, "red apple red pear"), (None, "red apple red pear"), (2, "red apple red pear"), (3, None), (4, ""), (5, "... !"), (6, "blue " * 30_000 + "apple"), (7, "éclair ÉCLAIR"), (8, "plum")]
    rows += [(20 + i, "other things") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "m", "part", "terms", "words", "item", "term")})
    items = spark.createDataFrame([(1, "RED apple"), (None, "plum"), (3, None), (4, "!!"), (5, "nothing known"), (6, "éclair"), (6, "plum plum")], "item_id long, text string")
    got = defaultdict(list)
    for r in lexical.rank(docs, items).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    assert [x[:2] for x in got[1]] == [(1, 1), (2, 2), (3, 2), (4, None), (5, 6)]  # equal scores by id, null last
    assert len({x[2] for x in got[1][:4]}) == 1
    assert [x[1] for x in got[None]] == [8]
    assert sorted(x[1] for x in got[6]) == [7, 8]  # É is not lower-cased
    assert set(got) == {1, None, 6}
    n_docs, n_terms = len(rows) - 3, 16 + 30_001 + 2 + 1 + 60
    plum = lexical.weight(n_docs, 1) * (1_000_000_000 // (1000 + 12 * (75 + 25 * n_docs // n_terms)))
    assert got[None][0][2] == plum
    assert {x[2] for x in got[6] if x[1] == 8} == {2 * plum}
    assert lexical.rank(docs.where("false"), items).count() == 0
    assert lexical.rank(docs, items.where("false")).count() == 0


# components


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_thinned_edges(spark, most):
    """Forests connect what the edges connect, and are smaller."""
    from hubflow.llm.components import connected_components, thinned

    r = random.Random(3)
    edges = [(g * 100 + r.randrange(40), g * 100 + r.randrange(40)) for g in range(4) for _ in range(300)]
    df = spark.createDataFrame(edges, "a long, b long")
    less = thinned(df, most)
    assert less.count() <= (len(edges) if most == 5 else 4 * 39)
    see = lambda e: sorted(tuple(x) for x in connected_components(e).collect())
    assert see(less) == see(df)
    assert thinned(df.where("false")).count() == 0
