"""Each stage against a brute-force version on the stage's own input."""

import itertools
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from hubflow.llm import mixing, simhash, toxicity
from tests.llm.test_edges import ROWS, SCHEMA
from tests.llm.test_operators import brute_components, check_packing, fingerprint, words

SF = "/root/testdata/sf0.01"
KEY = lambda r: (r.doc_id is None, r.doc_id or 0)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, frames = tmp_path_factory.mktemp("pipeline"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{folder}/{k}")
        frames.append(spark.read.parquet(f"{folder}/{k}"))
    return frames


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(f.columns == cp.COLUMNS for f in stages[:-1])


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(stages[1]) == ids(toxicity.grade(stages[0], model).where("NOT toxic"))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(ids(stages[0])) - set(ids(stages[1]))
    assert sum(labels.get(i) == 1 for i in gone) >= 0.9 * sum(labels.values()) and not any(labels.get(i) == 0 for i in gone)


def test_one_of_equal_texts_stays(stages):
    best = {}
    for r in stages[1].collect():
        k = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[k] = min(best.get(k, (1, 0)), (-len(r.text), r.doc_id))
    assert ids(stages[2]) == sorted(i for _, i in best.values())


def near_copies(rows, similarity=0.8, shingle=5):
    """All pairs with that Jaccard similarity of their shingles, over an inverted index of all shingles."""
    sets, where, shared = {}, {}, Counter()
    for i, t in rows:
        w = words(t or "")
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)}
        for x in sets[i]:
            where.setdefault(x, []).append(i)
    for found in where.values():
        shared.update(itertools.combinations(found, 2))
    return [(a, b) for (a, b), n in shared.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9]


def test_one_of_near_copies_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    comp = brute_components(sorted(i for i, _ in rows), near_copies(rows))
    assert len(set(comp.values())) < len(rows) and ids(stages[3]) == sorted(set(comp.values()))


@pytest.fixture(scope="module")
def edited():
    """Groups of edited copies, large ones too, a chain of copies that ends far from its start, and unrelated texts."""
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for size, words, edits in ((2, 60, 2), (3, 100, 2), (40, 300, 6), (250, 200, 4)):
        base = text(words)
        for _ in range(size):
            w = base.copy()
            for _ in range(rng.randint(1, edits)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
    w = text(400)
    for k in range(30):
        w[k * 12 : k * 12 + 6] = text(6)
        rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(text(rng.randint(0, 80)))) for i in range(120)]
    rng.shuffle(rows)
    prints = {i: (fingerprint(t), fingerprint(t, 5)) for i, t in rows}
    near = near_copies(rows)
    links = [(a, b) for a, b in near if (prints[a][0] ^ prints[b][0]).bit_count() <= 11 and (prints[a][1] ^ prints[b][1]).bit_count() <= simhash.ALSO]
    assert len(links) >= 0.98 * len(near)
    return rows, set(brute_components(sorted(prints), links).values()), set(brute_components(sorted(prints), near).values())


@pytest.mark.parametrize("partitions, block, group", [(1, 4096, 512), (4, 16, 512), (7, 4096, 10), (4, 16, 10)])
def test_groups_of_near_copies(spark, edited, partitions, block, group):
    """What stays are the components of all links, whatever the parts and the partitions."""
    rows, by_links, by_copies = edited
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        kept = {r.doc_id for r in simhash.keep_unlike(df, block=block, group=group).select("doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert kept == by_links == by_copies


def test_rows_without_and_with_repeated_ids(spark):
    """An id alone is no key: texts of one id and rows without an id are judged by what they say."""
    long = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcd"]
    rows = [(5, long[0]), (1, long[0] + " more"), (5, long[1]), (None, long[2]), (None, long[2] + " more"), (None, long[3]), (7, long[3]), (8, None), (9, ""), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, df, SF).collect()), key=str)
    assert (1, long[0] + " more") in kept and (5, long[1]) in kept and (7, long[3]) in kept and (8, None) in kept
    assert len(kept) == 5 and sum(i is None for i, _ in kept) == 1


def test_wide_radius_masks_cover():
    for radius, parts in ((11, 2), (9, 2), (7, 4), (5, 3)):
        masks, rng = [m & (1 << 64) - 1 for m in simhash.split_masks(radius, parts)], random.Random(radius)
        assert min(m.bit_count() for m in masks) >= 64 // parts // 2 - 3
        for _ in range(3000):
            d = sum(1 << b for b in rng.sample(range(64 // parts * parts), radius))
            assert any(not d & m for m in masks)


def test_mix_takes_effect(stages):
    want = Counter({r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()})
    assert Counter(ids(stages[4])) == +want
    assert len({tuple(r) for r in stages[4].collect()}) == len(set(ids(stages[4])))


def test_copies_are_packed(stages):
    rows = [(r.doc_id, r.text) for r in stages[4].collect()]
    out = stages[5].collect()
    assert Counter(r.doc_id for r in out if r.start == 0) == Counter(i for i, _ in rows)
    first, seen = [], set()
    for r in out:  # one copy of each document is read back in full
        if r.doc_id not in seen and r.length == r.doc_tokens:
            seen.add(r.doc_id)
            first.append(r)
    assert len(first) > 0 and sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)


def test_run(spark, stages):
    out = cp.run(spark, SF)
    firsts = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    assert out.columns == stages[5].columns and cp.ORACLE_SQL is None
    assert firsts(out) == firsts(stages[5]) and sum(firsts(out).values()) == stages[4].count()


def test_packing_of_single_copies(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    check_packing(cp.pack_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect(), rows, 2048)


def test_odd_rows(spark):
    """Nulls, empties and repeated rows pass every stage; an empty table gives an empty table."""
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in cp.STAGES:
            assert stage(spark, docs, SF).count() >= (1 if rows else 0)
        if not rows:
            assert cp.STAGES[1][1](spark, docs, SF).count() == 0
    kept = cp.exact_dedup(spark, spark.createDataFrame(ROWS, SCHEMA), SF).collect()
    assert Counter(r.doc_id for r in kept)[2] == 1 and not any(r.doc_id == 1 for r in kept)
