"""Each operator against SQL, a brute-force version, an exact round trip or held-out labels."""

import html as stdhtml
import itertools
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hubflow.llm import chat, components, embeddings, exact, extraction, licences, mixing, packing, queries, simhash, tokens, toxicity
from hubflow.llm.common import WORD
from hubflow.llm.queries import tokenizer_path
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "\n", "a", "  two  spaces ", "tab\there", "▁mark ▁▁ marks", "<s> </s> <unk> <0x0A>", "a<|endoftext|>b", "日本語 テキスト 🙂🙂", "x" * 5000, "é́ combining", "\x00\x01null", "it's we'll I'd", "12345 ½ ²", " nbsp em", "﻿bom", "\r\n crlf \r", "a\u0085b", "end \n\n\n  "]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts_of(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    return rows + [(10**6 + i, t) for i, t in enumerate(ODD)]


def words(text):
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


# ---- 1


def test_mixing_overlap(spark):
    docs = spark.createDataFrame([(i, "w " * 10, [s for s, on in zip("abc", (i % 2, i % 3 == 0, i % 5 == 0), strict=True) if on] or ["c"]) for i in range(600)], "doc_id long, text string, source array<string>")
    out = mixing.mix(docs, weights={"a": 1, "b": 1, "c": 4}).collect()
    assert abs(sum(r.taken for r in out) - 6000) <= 60 and all(0 <= r.copies <= 3 for r in out)
    assert [r.taken for r in sorted(out, key=lambda r: r.doc_id)] == [r.taken for r in sorted(mixing.mix(docs, weights={"a": 1, "b": 1, "c": 4}).collect(), key=lambda r: r.doc_id)]


def test_mixing_overlap_at_any_partitioning(spark):
    """Many flows cost the least; which one is taken doesn't depend on partitions or on the order of rows."""
    rng = random.Random(8)
    rows = [(i, "x " * rng.choice([1, 2, 5]), rng.sample("abcdefgh", rng.choice([1, 2, 2, 3]))) for i in range(600)]
    layout, found = "doc_id long, text string, source array<string>", []
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        found.append({r.doc_id: (r.copies, r.taken) for r in mixing.mix(spark.createDataFrame(rows, layout).repartition(parts)).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 600


def test_mixing_odd_memberships(spark):
    docs = spark.createDataFrame([(1, "a b", ["x"]), (2, "a b", None), (3, "a b", []), (4, "a", ["x", None])], "doc_id long, text string, source array<string>")
    got = {r.doc_id: (r.members, r.copies) for r in mixing.mix(docs).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2][0] == [None] and got[3] == ([], 0)


def test_water_filling():
    assert mixing.water_fill([10, 10], [1, 3], 3) == [5, 15]
    assert mixing.water_fill([1, 99], [1, 1], 3) == [3, 97]
    assert mixing.water_fill([0, 5], [2, 1], 3) == [0, 5]
    assert mixing.water_fill([], [], 3) == []


def test_flow_is_cheapest():
    rng = random.Random(1)
    for _ in range(30):
        cap = [rng.randint(1, 3) for _ in range(2)]
        members = [[0], [0, 1]] if rng.random() < 0.5 else [[0, 1], [0, 1]]
        quota = [rng.randint(0, 4), rng.randint(0, 4)]
        flow = mixing.min_cost_flow(cap, members, quota, 2)
        cost = lambda p, t: sum(1 if k < cap[p] else 2 for k in range(t))
        best = None
        for x in itertools.product(*[range(2 * cap[p] + 1) for p in range(2) for _ in members[p]]):
            it = iter(x)
            g = [{s: next(it) for s in members[p]} for p in range(2)]
            use = [sum(y.values()) for y in g]
            got = [sum(y.get(s, 0) for y in g) for s in range(2)]
            if all(u <= 2 * c for u, c in zip(use, cap, strict=True)) and all(a <= b for a, b in zip(got, quota, strict=True)):
                key = (-sum(got), sum(cost(p, use[p]) for p in range(2)))
                best = key if best is None or key < best else best
        use = [sum(y.values()) for y in flow]
        assert (-sum(use), sum(cost(p, use[p]) for p in range(2))) == best


def test_flow_of_many_patterns():
    rng = random.Random(3)
    cap, quota = [rng.randint(0, 1000) for _ in range(3000)], [rng.randint(0, 2000) for _ in range(800)]
    members = [sorted({rng.randrange(800) for _ in range(rng.randint(1, 4))}) for _ in cap]
    flow = mixing.min_cost_flow(cap, members, quota, 3)
    got = [0] * 800
    for g, c in zip(flow, cap, strict=True):
        assert sum(g.values()) <= 3 * c
        for s, x in g.items():
            got[s] += x
    assert all(a <= b for a, b in zip(got, quota, strict=True)) and sum(got) > 0.9 * min(sum(quota), 3 * sum(cap))


@pytest.mark.parametrize("listed", [1, 7])
def test_shares_beyond_the_driver(spark, monkeypatch, listed):
    """Shares worked out by Spark equal those of the driver."""
    monkeypatch.setattr(mixing, "STEPS", 4)
    rng = random.Random(8)
    for sizes in ([rng.randint(0, 10_000) for _ in range(60)], [5] * 30, [0, 0, 1], [10**9] + [1] * 20):
        own = spark.createDataFrame([(None if i == 3 else f"s{i:03d}", float(x)) for i, x in enumerate(sizes)], "source string, own double")
        for weights in (None, {None: 2.0} | {f"s{i:03d}": 1.0 + i % 5 for i in range(60)}):
            want = {r.source: r.target for r in mixing.shares(own, weights, 3).collect()}
            got = {r.source: r.target for r in mixing.shares(own, weights, 3, listed).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * (1 + want[k]) for k in want)


def test_many_sources(spark):
    """More sources than are listed, some of them shared: every source comes near its target."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 5).alias("text"), F.when(F.col("id") % 10 == 0, F.array(F.concat(F.lit("h"), F.col("id") % 300), F.concat(F.lit("h"), F.col("id") % 300 + 1))).otherwise(F.array(F.concat(F.lit("h"), F.col("id") % 300))).alias("source"))
    key = lambda df: sorted((r.doc_id, r.copies, round(r.target, 6)) for r in df.collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs, listed=20))
    out = mixing.mix(docs, listed=20).collect()
    assert abs(sum(r.taken for r in out) - 15_000) < 1000 and all(r.taken <= 15 for r in out)


# ---- 2


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = texts_of(spark) + [(2 * 10**6, None)]
    want = {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows}
    for remember in (10**6, 50):
        got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("piece_bpe_32k.model"), remember=remember).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


# ---- 3


def fingerprint(text, size=3):
    w = words(text)
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash(spark):
    rows = texts_of(spark)
    want = {i: fingerprint(t) for i, t in rows}
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("hex", simhash.hex16("fp")).collect()
    assert {r.doc_id: r.hex for r in got} == {i: f"{f:016x}" for i, f in want.items()}
    ids = sorted(want)
    linked = [(a, b) for a, b in itertools.combinations(ids, 2) if (want[a] ^ want[b]).bit_count() <= 3]
    assert {r.doc_id: r.component_id for r in got} == brute_components(ids, linked)


def test_covering_masks_cover():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(3)]
    assert len(masks) == 15 and {m.bit_count() for m in masks} == {32}
    for bits in itertools.combinations(range(64), 3):
        d = sum(1 << b for b in bits)
        assert any(not d & m for m in masks)


@pytest.mark.parametrize("block", [4096, 8])
def test_large_buckets(spark, block):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) & (1 << 64) - 1 for b in base for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, block)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = brute_components(signed, pairs)
    assert {v: got.get(v, v) for v in signed} == want
    assert links.count() < 15 * 2 * len(signed) * max(1, len(signed) // block + 1)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


# ---- 4


def check_packing(out, texts, window):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts}
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = ids[i][r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[i]), zlib.crc32(part.tobytes())) and len(part) == r.length > 0
            at += r.length
        assert at == len(ids[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and (at == window or at & (at - 1) == 0) and {r.padded_to for r in pieces} == {at}


@pytest.mark.parametrize("most_open", [4096, 5])
def test_packing(spark, most_open):
    rows = texts_of(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_packing(packing.pack(df, tokenizer_path("byte_bpe_50k.json"), most_open=most_open).collect(), rows, 2048)


def test_packer_follows_sum_of_squares():
    rng, window = random.Random(2), 12
    p = packing.Packer(window)
    levels = [0] * (window + 1)
    for i in range(300):
        size = rng.randint(1, window - 1)
        best = None
        for h in range(window - size + 1):
            if h == 0 or levels[h]:
                after = levels.copy()
                after[h] -= h > 0
                after[h + size] += h + size < window
                score = (sum(x * x for x in after), -h)
                best = min(best, (score, after)) if best else (score, after)
        levels = best[1]
        p.add(i, np.ones(size, "<u4"))
        assert p.counts.tolist() == levels


def test_ids_on_every_code_point():
    from tokenizers import Tokenizer

    tok, read = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), packing.IdReader(tokenizer_path("byte_bpe_50k.json"))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}a 1{c}1 {c}{c} .{c}" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for k in range(0, len(texts), 500):
        for text, e in zip(texts[k : k + 500], tok.encode_batch(texts[k : k + 500], add_special_tokens=False), strict=True):
            assert read(text).tolist() == e.ids


# ---- 5


def brute_licences(text):
    w = re.findall(licences.WORD, text.translate({c: c + 32 for c in range(65, 91)}))
    places = sorted((i, label) for phrase, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    more, most = set(), 0.0
    for label, body in licences.TEMPLATES:
        t = re.findall(licences.WORD, body.lower())
        pairs, length = set(zip(t, t[1:])), int(len(t) / licences.CONTAINMENT + 1e-9)
        marks = pairs & {tuple(x.split()) for x in licences.mark_pairs(label, licences.MARKS)}
        blocks = (pairs & set(zip(w[i : i + length], w[i + 1 : i + length])) for i in range(len(w)))
        shared = max((len(b) for b in blocks if marks <= b), default=0)
        if shared >= licences.CONTAINMENT * len(pairs) - 1e-9:
            more.add(label)
            most = max(most, shared / len(pairs))
    base = sorted({x for _, x in places})
    return (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted({*base, *more})), 1.0 if places else most)


def test_licences(spark):
    rng = random.Random(4)
    rows = [(i, t[:6000]) for i, t in texts_of(spark)[::3]]
    for i, (_, body) in enumerate(licences.TEMPLATES):
        w = body.split()
        for k in range(8):  # words left out or put in between, near both sides of the threshold
            part = [x for x in w if rng.random() > 0.03 * k] if k % 2 else [y for x in w for y in ([x, "noise"] if rng.random() < 0.03 * k else [x])]
            rows.append((2 * 10**6 + 10 * i + k, " ".join(part) + ("\nnoise MIT  license, mit license mit license" if k == 1 else " noise")))
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: brute_licences(t) for i, t in rows}
    assert 0 < sum(r.score > 0 and r.n_base == 0 for r in got) < len(rows)


def test_wrapped_licences(spark):
    """Wrapped and commented texts give their label and 1.0; words strewn over a long line, or in another order, give none."""
    rows, want = [], {}
    for i, (label, body) in enumerate(licences.TEMPLATES):
        for k, (width, mark) in enumerate([(30, ""), (40, "# "), (72, " * ")]):
            rows.append((10 * i + k, "\n".join(["x y z", *[mark + x for x in textwrap.wrap("Here some words come before. " + body + ". And some come after it.", width)]])))
            want[10 * i + k] = label
        strewn = " ".join(w + " lorem" * 30 for w in body.split())
        rows += [(10 * i + 3, strewn), (10 * i + 4, strewn.replace(" lorem", "\n" + "lorem")), (10 * i + 5, " ".join(body.split()[::-1]))]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label in want.items())
    assert all(got[i].labels == "" and got[i].score == 0.0 for i in got.keys() - want.keys())
    assert licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), templates=()).where("score > 0 AND n_base = 0").count() == 0


def test_relatives_are_told_apart(spark):
    """Each notice or sentence has exactly its own labels, though most of its words are those of its relatives."""
    notice = """This program is free software{}; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by
    the Free Software Foundation; either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it
    will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
    {}General Public License for more details."""
    work, by = "This work is licensed under the GNU {}General Public License, version {}", "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    cases = [
        (notice.format("", "", "2", ""), "gpl,gpl-notice"), (notice.format("", "", "3", ""), "gpl,gpl-notice"),
        (notice.format("", "Lesser ", "3", "Lesser "), "gpl,lgpl-notice"), (notice.replace("program", "library").format("", "Lesser ", "2.1", "Lesser "), "gpl,lgpl-notice"),
        (notice.format("", "Affero ", "3", "Affero "), "agpl-notice,gpl"),
        (work.format("", "2"), "gpl,gpl-2.0"), (work.format("", "3"), "gpl,gpl-3.0"), (work.format("Lesser ", "3"), "gpl,lgpl-3.0"), (work.format("Lesser ", "2.1"), "gpl,lgpl-2.1"), (work.format("Affero ", "3"), "agpl-3.0,gpl"),
        (by.format(""), "cc-by"), (by.format("-NonCommercial"), "cc-by-nc"), (by.format("-ShareAlike"), "cc-by-sa"), (by.format("-NoDerivatives"), "cc-by-nd"),
        (by.format("-NonCommercial-ShareAlike"), "cc-by-nc-sa"), (by.format("-NonCommercial-NoDerivatives"), "cc-by-nc-nd"),
        *((f"Licensed under CC {x.upper()} 4.0", f"cc-{x}") for x in ("by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd")),
        ("It is licensed under the terms of the BSD 3-Clause license", "bsd-3-clause"), ("the BSD 2-Clause License", "bsd-2-clause"), ("under the Mozilla Public License, v. 2.0", "mpl-2.0"),
        *((f"// SPDX-License-Identifier: {x}", f"spdx-{x.lower()}") for x in licences.SPDX), ("SPDX-License-Identifier: GPL-9.0-only", ""), ("Licensed under the Acme License, Version 2.0", ""),
    ]
    rows = [(i, f"Some words before. {t}. And some after.") for i, (t, _) in enumerate(cases)]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {cases[i][0]: r.labels for i, r in got.items()} == dict(cases)
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: brute_licences(t) for i, t in rows}


def test_texts_that_only_look_like_licences(spark):
    texts = ["The film was released under the new law, with a driving license", "Licensed under the Open Data License, Version 2.0", "Mozilla Public License Version 2.0", "the terms of the public are subject to this source of code, a form of license", ""]
    got = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all((r.labels, r.score) == ("", 0.0) for r in got)


# ---- 6


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    assert len(model.features) <= toxicity.MAX_FEATURES and np.all(np.diff(model.theta) > 0)
    rows = toxicity.grade(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    # some labels of this table are wrong: toxic, without any of the words that mark the others
    caught = [r.toxic for r in rows if r.y == 1]
    wrong = [r.toxic for r in rows if r.y == 0]
    assert sum(caught) / len(caught) > 0.92 and sum(wrong) / len(wrong) < 0.005
    assert np.mean([r.expected_severity for r in rows if r.y == 1]) > 1 > 0.1 > np.mean([r.expected_severity for r in rows if r.y == 0])
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == toxicity.grade(docs, model).where("NOT toxic").count()


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (3000, 3)).astype(np.float32)
    z = x @ np.array([1.0, -0.5, 0.0]) + rng.logistic(size=3000)
    y = np.searchsorted([0.0, 1.5, 3.0], z)
    w, theta = toxicity.fit_ordinal(x, y, 4, ridge=0.0, rounds=1500)
    assert np.allclose(w, [1.0, -0.5, 0.0], atol=0.2) and np.allclose(theta, [0.0, 1.5, 3.0], atol=0.3)


def test_likelihood_and_gradient():
    """The loss against its definition and the gradient against differences; the fit against its neighbourhood."""
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((200, 5)), rng.integers(0, 4, 200)
    p = np.concatenate([rng.standard_normal(5), [-0.5], rng.standard_normal(2)])

    def plain(p):
        theta = [-math.inf, p[5], p[5] + math.exp(p[6]), p[5] + math.exp(p[6]) + math.exp(p[7]), math.inf]
        upto = lambda t, s: 0.0 if t == -math.inf else 1.0 if t == math.inf else 1 / (1 + math.exp(s - t))
        total = sum(-math.log(upto(theta[k + 1], r @ p[:5]) - upto(theta[k], r @ p[:5])) for r, k in zip(x, y, strict=True))
        return total / len(y) + 0.01 / 2 * p[:5] @ p[:5]

    value, gradient = toxicity.loss(p, x, y, 0.01)
    steps = 1e-6 * np.eye(8)
    assert abs(value - plain(p)) < 1e-9 and np.allclose(gradient, [(plain(p + h) - plain(p - h)) / 2e-6 for h in steps], atol=1e-6)
    w, theta = toxicity.fit_ordinal(x, y, 4, ridge=0.01, rounds=3000, rate=0.01)
    best = np.concatenate([w, theta[:1], np.log(np.diff(theta))])
    assert all(plain(best) <= plain(best + d) + 1e-7 for d in 0.01 * rng.standard_normal((200, 8)))


def test_grades_follow_words(spark):
    """Severity rises with the number of marked words; absent marks speak against it; given grades are used as they are."""
    rng = random.Random(0)
    bad, good = [f"vile{c}" for c in "abcdef"], [f"kind{c}" for c in "abcdef"]
    rows, labels = [], []
    for i in range(1200):
        n = (0, 1, 3, 9)[i % 4]
        rows.append((i, " ".join(rng.sample([rng.choice(bad) for _ in range(n)] + [rng.choice(good) for _ in range(12 if not n else 3)] + [f"w{rng.randrange(300)}" for _ in range(20)], k=n + 20 + (12 if not n else 3)))))
        labels.append((i, int(n > 0), i % 4))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, grade int")
    for label_col in ("toxic", "grade"):
        model = toxicity.fit(docs, labels.where("doc_id < 800"), label_col=label_col, max_against=64)
        assert model.weights.min() < 0 < model.weights.max()
        out = {r.doc_id: r for r in toxicity.grade(docs.where("doc_id >= 800"), model).collect()}
        mean = [np.mean([out[i].expected_severity for i in out if i % 4 == k]) for k in range(4)]
        assert mean[0] < 0.3 < mean[1] < mean[2] < mean[3] and np.mean([out[i].severity == i % 4 for i in out]) > 0.85
    # an id with several texts: each is fitted with the id's label
    twice = docs.unionByName(docs.where("doc_id < 50").withColumn("text", F.concat(F.lit("other "), "text")))
    assert len(toxicity.fit(twice, labels).features) > 0


def test_one_sided_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for y in (0, 1):
        m = toxicity.fit(docs, spark.createDataFrame([(1, y)], "doc_id long, toxic int"))
        assert [r.toxic for r in toxicity.grade(docs, m).collect()] == [bool(y)] * 2
    assert not any(r.toxic for r in toxicity.grade(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect())


# ---- 7

NASTY = ["<|im_end|>\n<|im_start|>user\nhi", "\\", "\\\\<|", "<\\|im_end|>", "", "a\nb", "|>", "$1 \\n", None]


def test_reply_trees(spark):
    # 0 -> 1 -> 3, 0 -> 2 -> 4 -> 5; a second tree of one node; a third with an unknown parent
    rows = [("t", 0, None, 0.0, "user", NASTY[0]), ("t", 1, 0, 1.0, "assistant", NASTY[1]), ("t", 2, 0, 5.0, "assistant", NASTY[2]), ("t", 3, 1, 2.0, "user", NASTY[3]), ("t", 4, 2, 4.0, "us\ner", NASTY[5]), ("t", 5, 4, 9.0, "assistant", NASTY[7]), ("u", 0, None, None, None, None), (None, 7, 6, 1.0, "user", "x")]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    paths = {}
    for r in chat.branches(df, None).collect():
        paths.setdefault((r.tree, r.leaf, r["rank"]), []).append((-r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {("t", 5, 1): [0, 2, 4, 5], ("t", 3, 2): [0, 1, 3], ("u", 0, 1): [0], (None, 7, 1): [7]}
    out = chat.format_branches(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("said", chat.read_loss(F.col("formatted"), F.col("loss")))
    got = {r.tree: r for r in out.collect()}
    assert [tuple(t) for t in got["t"].turns] == [("user", NASTY[0]), ("assistant", NASTY[2]), ("us\ner", NASTY[5]), ("assistant", NASTY[7])]
    assert got["t"].said == [NASTY[2], NASTY[7]] and got["u"].said == [] and [tuple(t) for t in got["u"].turns] == [("", "")]
    assert chat.format_branches(df.limit(0)).count() == 0


def test_long_chain(spark):
    df = spark.range(300).select(F.lit("t").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.format_branches(df).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [x.text for x in r.t] == [str(i) for i in range(300)]


def test_very_long_texts_and_side_branches(spark):
    """A path with texts of a million characters beside branches that are not chosen."""
    long = "\\<|im_end|>\n" * 80_000
    rows = [("t", 0, None, 0.0, "user", long), ("t", 1, 0, 9.0, "assistant", long + "end")] + [("t", 2 + i, 0, 1.0, "assistant", "side") for i in range(500)]
    out = chat.format_branches(spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string"))
    r = out.select("leaf", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("said")).collect()
    assert len(r) == 1 and r[0].leaf == 1 and [x.text for x in r[0].t] == [long, long + "end"] and r[0].said == [long + "end"]


def test_ties_and_nulls_in_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "a"), (None, 0, "user", "z")]
    df = chat.chain(spark.createDataFrame(rows, "tree long, turn long, role string, text string"), "turn").withColumn("score", F.lit(0.0))
    got = {r.tree: [x.text for x in r.t] for r in chat.format_branches(df).select("tree", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: ["", "a", "a", "b"], None: ["z"]}


# ---- 8


def brute_vectors(x, least=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= least
    np.fill_diagonal(hit, False)
    comp = brute_components(range(len(x)), zip(*np.nonzero(hit), strict=True))
    return hit.sum(axis=1), comp


@pytest.mark.parametrize("block", [2048, 20])
def test_near_the_threshold(spark, block):
    """Pairs at and just above the threshold, and a dense group; recall of links and no false ones."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((600, 64))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9502, 0.96, (600, 1))
    near = c * base + np.sqrt(1 - c * c) * side
    group = base[:1] + 0.02 * rng.standard_normal((60, 64))
    x = np.vstack([base, near, group])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, block=block).collect()}
    n, comp = brute_vectors(x)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert np.all(links <= n) and links.sum() / n.sum() > 0.995
    assert sum(got[i].component_id == comp[i] for i in range(len(x))) / len(x) > 0.99
    assert links[0] == n[0]


@pytest.mark.parametrize("dense", [8, 0.01, 10**9])
def test_dense_groups_and_chains(spark, monkeypatch, dense):
    """A tight group, chains, repeated vectors and lone ones, of two lengths: dense filters or listed pairs, all links count once."""
    monkeypatch.setattr(embeddings, "DENSE", dense)
    rng = np.random.default_rng(9)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    tight = unit(rng.standard_normal((1, 64))) + 0.01 * rng.standard_normal((150, 64))
    a, b = unit(rng.standard_normal((2, 64)))
    b = unit((b - (a @ b) * a)[None])[0]
    chain = np.array([np.cos(t) * a + np.sin(t) * b for t in np.arange(40) * 0.3])  # neighbours at cosine 0.955, others below
    x = np.vstack([tight, chain, tight[:5], unit(rng.standard_normal((200, 64)))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1e200] * 3), (1001, [1e200, 1.01e200, 1e200]), (1002, [1e-200, -1e-200, 0.0]), (1003, [1e-200, 0.0, 1e-200])]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    n, comp = brute_vectors(x)
    assert [got[i].n_links for i in range(len(x))] == n.tolist() and all(got[i].component_id == comp[i] for i in range(len(x)))
    assert [got[k].n_links for k in (1000, 1001, 1002, 1003)] == [1, 1, 0, 0] and got[1001].component_id == 1000


@pytest.mark.parametrize("n", [10**4, 10**6, 3 * 10**7, 10**8])
def test_recall_holds_at_any_size(n):
    """Decoding alone: pairs at cosine 0.951 share a filter, and the filters a vector passes stay about as many."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((400, 64))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    near = 0.951 * base + np.sqrt(1 - 0.951**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    words, share = embeddings.code_size(n)
    books, height = embeddings.codebooks(64, words), embeddings.cap_height(64, share)
    p, q = embeddings.decode(base, books, height), embeddings.decode(near, books, height)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(p, q, strict=True)]) >= 0.99
    assert abs(np.mean([len(a) for a in p]) / 32 - 1) < 0.2
    bits = [embeddings.signs(v).view(np.uint64) for v in (base, near)]
    assert np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1).max() <= embeddings.most_differing(0.95)


def test_recall_of_large_tables(spark):
    """Pairs near the threshold are found with the narrow caps of 10 million vectors; each vector passes filters."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((500, 64))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9502, 0.952, (500, 1))
    x = np.vstack([base, c * base + np.sqrt(1 - c * c) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = embeddings.near_vectors(df, cap=embeddings.CAP * len(x) / 1e7).collect()
    assert sum(r.n_links for r in out) >= 0.99 * brute_vectors(x)[0].sum()
    words, share = embeddings.code_size(10**7)
    passed = embeddings.decode(base, embeddings.codebooks(64, words), embeddings.cap_height(64, share))
    assert min(len(p) for p in passed) >= embeddings.CODES * embeddings.FEWEST and 24 < np.mean([len(p) for p in passed]) < 36


# ---- 9


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_pages_of_the_corpus(spark):
    def plain(h):
        parts = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*?)</article>", h)[1])
        parts = [" ".join(stdhtml.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts]
        return "\n".join(p for p in parts if p)

    want = {r.page_id: plain(r.html) for r in table(spark, "pages").collect()}
    assert {r.page_id: r.text for r in extraction.extract(table(spark, "pages")).collect()} == want


@pytest.mark.parametrize(
    "body, text",
    [
        ("<header><h1>Site</h1></header><main><h1>Title</h1><p>One&nbsp;&amp; two<br>three<aside>x</aside><p>Four<form><input>send</form></main><footer>f</footer>", "Title\nOne & two three\nFour"),
        ("<article><header><h1>Title</h1></header><p>Body</p><div class='share-bar'>tweet</div><section id=comments><article><p>me too</p></article></section></article>", "Title\nBody"),
        ("<div class='cookie-notice'><p>We use</p></div><div role=navigation>a</div><article><p>x &lt;b&gt; &#233;<!-- no --> y</p><ul><li>i<li>j</ul></article>", "x <b> é y\ni\nj"),
        ("<article><p>a<b>b</b>c <span class=ad>buy <span>now</span> ok</span>d</p></article><p>out", "abc\nd"),
        ("<div hidden>h</div><div style='display:none'>h</div><article><pre>a\n  b</pre><table><tr><td>1<td>2</table>", "a b\n1\n2"),
        ("<article><p>5 < 6 and a > b</p><p title='x>y'>q</p>", "5 < 6 and a > b\nq"),
        ("", ""),
        ("<main class='content with-sidebar'><p>A</p><div class='sidebar'>b</div></main>", "A"),
        ("<article class='post comments-open'><p>A</p><div class='comments-area'>b</div></article>", "A"),
        ("<div class='page has-sidebar'><article><p>A</p><svg/><p>B</p><svg><text>c</text></svg><p>C</article></div>", "A\nB\nC"),
        ("<article><p class=it's>A</p><p title=\"x>'y\">B</p><p class='ad'>c</p><p data-x = 'ad' hidden>d</p></article>", "A\nB"),
        ("<div class='sidebar-layout'><main><p>A</p></main><p>b</p></div>", "A"),
        ("<article><p>A<object><p>B</article><article class='comment'><p>c</p></article>", "A\nB"),
        ("<article><p>1 <2 & 3</p><p>B</p></article><a href='x", "1 <2 & 3\nB"),
        ("<form id=aspnetForm><nav>m</nav><article><p>A</p></article><input></form>", "A"),
        ("<div id='content-sidebar-wrap'><article><p>A</p></article><aside>b</aside></div>", "A"),
        ("<div class='widget-area'><div><article><p>A</p></article></div></div>", "A"),
        ("<article><p>A</p></article><div class='widget-area'><article><p>a longer story of others</p></article></div>", "A"),
        ("<p>The page has its text here</p><div class='promo'><article><p>buy</p></article></div>", "The page has its text here"),
        ("<article><section class='related-work'><p>A</p></section><div class='social-history'>B</div><p class='notice-of-claim'>C</p><ul class='menu-items'><li>D</ul><h2 class='banner-title'>E</h2></article>", "A\nB\nC\nD\nE"),
        ("<article><p>A</p><div class='ad-slot-2'>b</div><ul class='related-posts'><li>c</ul><div id='ad_300x250'>d</div><div class='reader-comments'><p>e</p></div></article>", "A"),
        ("<article><p>A story</p><article class='comment-item'><p>a comment that is longer than it</p></article></article>", "A story"),
        ("<article><p>A story</p></article><article class='reply-box'><p>a reply that is longer than it</p></article>", "A story"),
        ("<article><p>A longer story</p></article><article class='teaser'><p>another story, far longer than that</p></article>", "A longer story"),
        ("<article><p>A longer story</p><div class='c'><article><p>me too</p></article></div></article><article><p>other</p></article>", "A longer story"),
        ("<main><h1>T</h1><article><p>A story</p></article><article><p>me too</p></article></main>", "T\nA story"),
        ("<article class='page'><h1>T</h1><article><p>A story</p></article></article>", "T\nA story"),
        ("<section class='comments'><article><p>first</p></article></section><p>Text</p>", "Text"),
    ],
)
def test_structure(body, text):
    assert extraction.main_text(*extraction.lines_of(page(body)), None) == text


def test_classes_of_the_page_itself():
    assert extraction.lines_of('<html class="no-js"><body class="single has-sidebar footer"><article><p>A</p></article></body></html>') == (["A"], [extraction.ARTICLE])


def test_hostile_pages_take_linear_time():
    began = time.perf_counter()
    for page_ in ("<a " * 350_000, "<a b=\"" * 150_000, "<a b='x" * 150_000, "<div>" * 200_000 + "</p>" * 50_000, "<svg>" * 200_000, "<!--" * 250_000, "< " * 300_000, "<p>x" * 200_000 + "</div>" * 50_000, "<select " * 120_000):
        extraction.lines_of(page_)
    assert time.perf_counter() - began < 9
    equal, began = ["x"] * 100_000, time.perf_counter()
    assert len(extraction.common_lines(equal, equal)) == 100_000
    assert len(extraction.common_lines(["own", *equal[:50_000], "mine"], ["other", *equal, "end"])) == 50_000
    assert time.perf_counter() - began < 20


def test_differencing(spark):
    """Pages without an article element: shared lines go, on a small host and on one that is dealt into groups."""
    rows = [(i, f"http://{h}.example/en/{i}", page(f"<div>Menu</div><div>Story {i}</div><div>More {i}</div><div>Imprint</div>")) for i, h in enumerate(["a"] * 5 + ["b"] * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extraction.extract(df, paired=10).collect()} == {i: f"Story {i}\nMore {i}" for i in range(45)}


def test_large_host(spark):
    """Sections of a large host with menus of their own, pages told apart by path or by query: ranges change nothing."""
    rows = []
    for s in range(30):
        for k in range(12):
            menu = "".join(f"<p>Section {s} item {m}</p>" for m in range(4))
            tail = f"p{k:02d}" if s % 2 else f"index?page={k:02d}"
            rows.append((100 * s + k, f"http://big.example/section{s:02d}/{tail}", page(f"{menu}<p>Own text {s} {k}</p>")))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for paired in (7, 200, 1000):
        got = {r.page_id: r.text for r in extraction.extract(df, paired=paired).collect()}
        assert got == {100 * s + k: f"Own text {s} {k}" for s in range(30) for k in range(12)}


def test_runs_of_equal_pages(spark):
    """Copies with adjacent addresses are compared with the nearest other page, wherever ranges end."""
    body = lambda own: page(f"<p>Menu</p><p>{own}</p><p>Notice</p>")
    rows = [(k, f"http://a.example/p{k:02d}", body("copy" if 2 <= k <= 12 else f"own {k}")) for k in range(16)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for paired in (3, 200):
        got = {r.page_id: r.text for r in extraction.extract(df, paired=paired).collect()}
        assert got == {k: "copy" if 2 <= k <= 12 else f"own {k}" for k in range(16)}


def test_ranges_against_brute_force(spark):
    rng, rows = random.Random(2), []
    for i in range(150):  # few different pages, so runs cross ranges
        lines = [f"line {x}" for x in rng.choice([(1, 2), (1, 3), (2, 3, 4), (1,)])] + ([f"own {i}"] if rng.random() < 0.15 else [])
        rows.append((i, f"http://{rng.choice('aab')}.example/{rng.choice('xyz')}{rng.randrange(6)}{rng.choice(['', '?q=1', '?q=2'])}", page("".join(f"<p>{x}</p>" for x in lines)), lines))
    split = lambda r: (r[1].split("/")[2], *(r[1].split("/")[3] + "?").split("?")[:2])
    order, want = sorted(rows, key=lambda r: (*split(r), r[0])), {}
    for n, r in enumerate(order):
        sides = [next((o for o in side if o[3] != r[3] and split(o)[0] == split(r)[0]), None) for side in (order[:n][::-1], order[n + 1 :])]
        around = [o for o in sides if o]
        partner = max(around, key=lambda o: extraction._prefix(o[1], r[1]))[3] if around else None
        want[r[0]] = extraction.main_text(r[3], [extraction.OUTSIDE] * len(r[3]), partner)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    for paired in (4, 20, 200):
        assert {r.page_id: r.text for r in extraction.extract(df, paired=paired).collect()} == want


@pytest.mark.parametrize("few", [True, False])
def test_longest_common_lines(monkeypatch, few):
    rng = random.Random(0)
    if not few:  # as on pages with many equal lines
        monkeypatch.setattr(extraction, "FEW", 0)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = sorted(extraction.common_lines(a, b))
        assert len(found) == best[-1][-1]
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in found)


# ---- 10


@pytest.mark.parametrize("weak", [F.xxhash64, lambda c: (F.length(c) % 3).cast("long")])
def test_exact(spark, weak):
    """Right even when most chunks share an identifier."""
    rows = texts_of(spark)
    rows += [(3 * 10**6 + i, t.replace(" ", "\n  ")) for i, (_, t) in enumerate(rows[:50])]
    got = {r.doc_id: r for r in exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), chunk_size=(40, 200), hash_fn=weak).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t) for i, t in rows}
    best, size = {}, {}
    for i, t in rows:
        k = norm[i]
        best[k] = min(best.get(k, (1, 0)), (-len(t), i))
        size[k] = size.get(k, 0) + 1
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {i: (best[norm[i]][1], size[norm[i]], best[norm[i]][1] == i) for i, _ in rows}


@pytest.mark.parametrize("first, last", [(0x61, 0x7A), (0x430, 0x44F), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x627, 0x64A)])
def test_shifted_texts_share_chunks(spark, first, last):
    """Content decides where chunks end in every script: a text with something in front shares most chunks."""
    rng = random.Random(first)
    text = "".join(chr(rng.randint(first, last)) for _ in range(60_000))
    df = spark.createDataFrame([(text,), ("in front" + text,)], "norm string").select(exact.chunks(F.col("norm")).alias("c"))
    a, b = ({*r.c} for r in df.collect())
    assert len(a) > 40 and len(a & b) >= 0.75 * len(a)


@pytest.mark.parametrize("few", [10_000, 0])
def test_some_clashes(spark, monkeypatch, few):
    """Only chunks of one length clash, as a rare collision would; compared in place and by a shuffle."""
    monkeypatch.setattr(exact, "FEW_CLASHES", few)
    rows = [(i, c * 40 + ("tail" if i % 2 else "")) for i, c in enumerate("abcdefghij")] + [(20, "a " * 40), (21, "b" * 40)]
    weak = lambda c: F.when(F.length(c) == 40, F.lit(1).cast("long")).otherwise(F.xxhash64(c))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), chunk_size=(40, 200), hash_fn=weak).collect()}
    assert got == {i: (i, 1) for i in range(1, 10)} | {0: (20, 2), 20: (20, 2), 21: (21, 1)}


def test_chunks_join_to_the_text(spark):
    rows = texts_of(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("norm", exact.normalised())
    for least, most in ((512, 4096), (8, 32)):
        bad = df.withColumn("c", exact.chunks(F.col("norm"), least, most)).where((F.array_join("c", "") != F.col("norm")) | F.exists("c", lambda x: F.length(x) > most))
        assert bad.count() == 0

