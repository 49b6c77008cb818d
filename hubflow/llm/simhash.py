"""SimHash near-dedup by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubflow.llm.common import WHITE, ascii_lower, cut, split_words, whole
from hubflow.llm.components import connected_components, local_forest, thinned

BITS = 64
#: Largest part of a bucket that one task compares with another part; larger buckets are split into such parts.
BLOCK = 4096
#: Most differing bits of the fingerprints of longer shingles. Of unrelated pairs that pass the first fingerprint, one in
#: 3,000 passes this one, too, so candidates of a large corpus don't all hang together.
ALSO = 18
#: Documents, and shingles, of a part whose candidates are verified in one task with those of another part.
GROUP, SHINGLES = 512, 1 << 20
#: One of so many nodes tells which buckets are large.
ONE_OF = 32
#: Most rows that are broadcast.
SMALL = 100_000


def covering_masks(radius: int, first: int = 0, width: int = BITS) -> list[int]:
    """The 2^(radius+1)-1 masks of a covering code (Pagh, 2016) over ``width`` bits from ``first``, as signed longs.

    Bit i gets a vector phi(i) of radius+1 bits. The mask of a vector v != 0 holds the bits with <v, phi(i)> odd. The
    vectors of at most ``radius`` differing bits span less than the whole space, so some v is orthogonal to them all,
    and under its mask the two fingerprints agree: every pair within the radius shares a key in some table.
    """
    side = radius + 1
    # with fewer bits than vectors those with the highest bit set, so that no mask is short
    phi = [i % (1 << side) if width >= 1 << side else (1 << side) - width + i for i in range(width)]
    masks = [sum(1 << (first + i) for i in range(width) if (v & phi[i]).bit_count() % 2) for v in range(1, 1 << side)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def split_masks(radius: int, parts: int) -> list[int]:
    """Covering masks for a wide radius: of ``parts`` parts of the bits one differs in at most radius / parts of them.

    Each part has the masks of that smaller radius, so every pair within the radius shares a key in some table. There
    are far fewer tables than the 2^(radius+1)-1 over all bits, with keys of about BITS / parts / 2 bits.
    """
    width = BITS // parts
    return [m for k in range(parts) for m in covering_masks(radius // parts, k * width, width)]


def shingle_hashes(words: str, size: int = 3) -> Column:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included; one hash of fewer words, none of no words.

    ``words`` is the name of an array column: an expression would be evaluated again for each use.
    """
    n = F.size(words)
    ahead = F.arrays_zip(*[F.slice(words, F.lit(k + 1), n - (size - 1)).alias(f"w{k}") for k in range(size)])
    many = F.transform(ahead, lambda s: F.xxhash64(F.concat_ws(" ", *[s[f"w{k}"] for k in range(size)])))
    return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


@F.pandas_udf(T.LongType())
def majority_bits(hashes: pd.Series) -> pd.Series:
    """Sets each bit that is 1 in over half of the hashes; 0 for none."""

    def one(h: np.ndarray) -> int:
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(h), 65536):
            ones += np.unpackbits(np.asarray(h[at : at + 65536], ">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(h)).view(">i8")[0])

    return pd.Series([one(h) for h in hashes], dtype="int64")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (long) of every row; built from whole texts, row by row, without a shuffle."""
    low = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).select("doc_id", ascii_lower(F.col("text")).alias("low"))
    hashed = low.select("doc_id", split_words(F.col("low"), WHITE).alias("words")).select("doc_id", shingle_hashes("words", shingle).alias("hashes"))
    return hashed.select("doc_id", majority_bits("hashes").alias("fp"))


def spanning_forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a forest that connects just what links of at most ``radius`` bits connect."""
    left, found = np.unique(values).view(np.uint64), []
    while len(left):
        queue, left = [left[-1]], left[:-1]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                new, left = left[near], left[~near]
                queue.extend(new)
                found.extend((int(x.view(np.int64)), int(y)) for y in new.view(np.int64))
    return found


def near_links(prints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between different fingerprints that connect whatever pairs within the radius connect.

    ``prints`` has a column fp of distinct longs. Buckets of two are compared in place. A larger bucket is dealt into
    parts of about ``block`` fingerprints, and each two parts meet in a task that returns a spanning forest instead of
    all pairs, so no bucket is dropped, capped or gathered whole.
    """
    keys = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks(radius))])).alias("k")).select("k.t", "k.key", "fp")
    buckets = keys.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    buckets = cut(buckets)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = buckets.where((F.col("n") == 2) & close).select("a", "b")
    parts = F.ceil(F.col("n") / block).cast("int")
    members = keys.join(buckets.where("n > 2").select("t", "key", parts.alias("parts")), ["t", "key"])
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("mine")))
    met = members.withColumn("mine", mine).withColumn("other", F.explode(others)).groupBy("t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for v in batch["fps"] for x in spanning_forest(np.asarray(v, np.int64), radius)], columns=["a", "b"], dtype="int64")

    return pairs.unionByName(met.select("fps").mapInPandas(forests, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id, the smallest doc_id reachable by links.

    Fingerprints link at ``radius`` or fewer differing bits. Copies of a fingerprint are one node. Null and empty
    texts have fingerprint 0 and link like any other; null ids take part but never name a component unless all of its
    ids are null; repeated rows stay; other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(nodes.select("fp"), radius, block)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # written first: Spark splits a hot fingerprint in the join only where both sides come straight from a shuffle or a scan
    known = cut(named.select("fp", "root").join(names, "root").select("fp", "component_id"))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def candidate_links(nodes: DataFrame, radius: int, also: int, *, parts: int = 2, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that connect what the candidates among ``nodes`` (``node, fp, other``) connect.

    Candidates are the pairs whose ``fp`` differ in at most ``radius`` bits and whose ``other`` fingerprints in at most
    ``also``. Tables are those of ``split_masks`` over ``fp``; a pair counts in the first table in which it meets. A task
    returns a spanning forest of the candidates at hand instead of all. A sample tells which buckets are large: these are
    dealt into parts of about ``block``, and each two parts meet in a task. So no bucket is dropped, capped or gathered whole.
    """
    masks, width = split_masks(radius, parts), BITS // parts
    tables = F.array(*[F.struct(F.lit(t << width).alias("table"), F.lit(m).alias("mask"), F.lit(t * parts // len(masks) * width).alias("shift")) for t, m in enumerate(masks)])

    def keyed(some: DataFrame) -> DataFrame:
        return some.select("node", "fp", "other", F.explode(tables).alias("x")).select(F.expr("shiftrightunsigned(fp & x.mask, x.shift) + x.table").alias("bucket"), "node", "fp", "other")

    sample = keyed(nodes.where(F.pmod(F.xxhash64("node"), F.lit(ONE_OF)) == 0)).groupBy("bucket").agg((F.count("*") * ONE_OF).alias("n"))
    large = cut(sample.where(F.col("n") > block).select("bucket", F.ceil(2 * F.col("n") / block).cast("int").alias("parts")))
    if large.isEmpty():
        met = keyed(nodes).select("bucket", F.lit(0).alias("deal"), "node", "fp", "other", F.lit(0).alias("mine"))
    else:
        split = keyed(nodes).join(F.broadcast(large) if large.count() <= SMALL else large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        split = split.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = split.select("bucket", (F.least("mine", "with") * F.col("parts") + F.greatest("mine", "with")).alias("deal"), "node", "fp", "other", "mine")
    met = met.repartition("bucket", "deal").sortWithinPartitions("bucket", "deal")
    unsigned = np.array(masks, np.int64).view(np.uint64)
    names = ["bucket", "deal", "node", "fp", "other", "mine"]

    def compare(bucket: np.ndarray, deal: np.ndarray, node: np.ndarray, fp: np.ndarray, other: np.ndarray, mine: np.ndarray) -> pa.RecordBatch:
        fp, other, first, second = fp.view(np.uint64), other.view(np.uint64), [], []
        group = np.cumsum(np.concatenate([[0], (np.diff(bucket) != 0) | (np.diff(deal) != 0)]))[: len(bucket)]
        same, shift = np.arange(len(group)), 0
        while len(same):  # rows with a row of the same group so many places on
            shift += 1
            same = same[same + shift < len(group)]
            same = same[group[same] == group[same + shift]]
            hit = same[np.bitwise_count(fp[same] ^ fp[same + shift]) <= radius]
            hit = hit[np.bitwise_count(other[hit] ^ other[hit + shift]) <= also]
            first.append(hit)
            second.append(hit + shift)
        i, j = np.concatenate([np.zeros(0, np.int64), *first]), np.concatenate([np.zeros(0, np.int64), *second])
        lowest = np.unique(group, return_index=True)[1]
        crossed = np.add.reduceat((mine != mine[lowest][group]).astype(np.int64), lowest) > 0 if len(lowest) else np.zeros(0, bool)
        keep = (mine[i] != mine[j]) | ~crossed[group[i]]
        i, j = i[keep], j[keep]
        for t, m in enumerate(unsigned):  # leaves out pairs that an earlier table has
            new = (t >= bucket[i] >> width) | ((fp[i] ^ fp[j]) & m != 0)
            i, j = i[new], j[new]
        known, ends = np.unique(np.concatenate([node[i], node[j]]), return_inverse=True)
        links = np.array(local_forest(len(known), ends[: len(i)], ends[len(i) :]), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(known[links[:, 0]], pa.int64()), pa.array(known[links[:, 1]], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held and len(new[0]):
                whole_ = [np.concatenate([h[k] for h in held] + [new[k]]) for k in range(len(names))]
                last = np.flatnonzero((np.diff(whole_[0]) != 0) | (np.diff(whole_[1]) != 0))
                if len(last) and len(whole_[0]) >= 50_000:
                    yield compare(*[x[: last[-1] + 1] for x in whole_])
                    new = [x[last[-1] + 1 :] for x in whole_]
                    held = []
            held.append(new)
        if held:
            yield compare(*[np.concatenate([h[k] for h in held]) for k in range(len(names))])

    return met.select(*names).mapInArrow(run, "a long, b long")


def keep_unlike(docs: DataFrame, *, radius: int = 11, also: int = ALSO, similarity: float = 0.8, shingle: int = 5, print_shingle: int = 3, parts: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of near copies.

    Near copies share at least ``similarity`` of their ``shingle``-word shingles (Jaccard, exact, over whole texts).
    Candidates are the pairs whose SimHash fingerprints of ``print_shingle``-word shingles differ in at most ``radius``
    bits and those of ``shingle``-word shingles in at most ``also``; covering masks over the former find all of them.
    Links are the candidates that are near copies, and a group is what links connect. All candidates within what
    candidates connect are looked at, in parts of about ``group`` documents, each two parts in one task, but for pairs
    that links of the task connect already: only forests of links are written. So the groups depend on the texts alone,
    not on ``block``, ``group`` or partitions.

    The document with the smallest id of a group stays, nulls last; equal ids go by content. Rows with the same words are
    one document, null and empty texts too; of repeated rows one stays. Other columns pass through, whatever their names;
    an empty table gives no rows.
    """
    base = _hashed(docs, id_col, text_col).select("none", "id", "t1", "t2", ascii_lower(F.col("text")).alias("low"))
    cut_up = base.select("none", "id", "t1", "t2", split_words(F.col("low"), WHITE).alias("words"))
    hashed = cut_up.select("none", "id", "t1", "t2", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"), shingle_hashes("words", print_shingle).alias("hashes"), shingle_hashes("words", shingle).alias("others"))
    prints = cut(hashed.select("none", "id", "t1", "t2", "h1", "h2", majority_bits("hashes").alias("fp"), majority_bits("others").alias("other")))
    best = F.min(F.struct("none", "id", "t1", "t2")).alias("best")
    nodes = cut(prints.groupBy("h1", "h2").agg(F.min("fp").alias("fp"), F.min("other").alias("other"), best).select("fp", "other", "best", F.monotonically_increasing_id().alias("node")))
    hang = cut(connected_components(thinned(candidate_links(nodes.select("node", "fp", "other"), radius, also, parts=parts, block=block))))
    links = _near_copies(docs, nodes, hang, radius, also, group, similarity, shingle, text_col)
    ranked = cut(connected_components(thinned(links)).join(nodes.select("node", "best"), "node"))
    first = ranked.groupBy("root").agg(F.min(F.struct("best", "node")).alias("first"))
    lost = cut(ranked.join(first, "root").where("node <> first.node").select("node"))
    key = ["none", "id", "t1", "t2"]
    kept = nodes.join(lost, "node", "left_anti").select("best.*")
    times = prints.groupBy(*key).agg(F.count("*").alias("times"))
    gone = cut(times.join(kept, key, "left_anti").select(*key))
    rows = _hashed(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stay = rows.join(F.broadcast(gone), key, "left_anti") if gone.count() <= SMALL else rows.join(gone, key, "left_anti")
    twice = cut(times.where("times > 1").join(kept, key, "left_semi"))
    if not twice.isEmpty():  # of repeated rows one stays
        again = stay.join(twice.select(*key), key, "left_semi").dropDuplicates(key)
        stay = stay.join(twice.select(*key), key, "left_anti").unionByName(again)
    return stay.select("row.*")


def _hashed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The id (0 and ``none`` for null), the text and 128 bits of its hash; two texts of one id are told apart by them."""
    rows = docs.select(*more, F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), whole(text_col).alias("text"))
    return rows.select(*(["row"] if more else []), "none", "id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def _shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """``node, set``: the distinct shingles of the wanted nodes' whole texts, hashed."""
    wanted = cut(wanted.select("node").distinct().join(nodes.select("node", "best.t1", "best.t2"), "node"))
    texts = docs.select(whole(text_col).alias("text")).select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= SMALL else wanted, ["t1", "t2"]).select("node", ascii_lower(F.col("text")).alias("low"))
    hashes = texts.select("node", split_words(F.col("low"), WHITE).alias("words")).select("node", shingle_hashes("words", shingle).alias("hashes"))
    return cut(hashes.select("node", F.array_distinct("hashes").alias("set")).dropDuplicates(["node"]))


def linked(fp: np.ndarray, other: np.ndarray, mine: np.ndarray, sets: list[np.ndarray], crossed: bool, radius: int, also: int, similarity: float) -> list[tuple[int, int]]:
    """Places of a forest of links: candidates whose sorted sets are alike. ``crossed``: only pairs of different parts."""
    size = np.array([len(x) for x in sets])
    up, found = list(range(len(sets))), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x in range(len(sets) - 1):
        rest = slice(x + 1, None)
        apart = np.bitwise_count(fp[rest] ^ fp[x])
        near = (apart <= radius) & (np.bitwise_count(other[rest] ^ other[x]) <= also) & (np.minimum(size[rest], size[x]) >= similarity * np.maximum(size[rest], size[x]) - 1e-9)
        if crossed:
            near &= mine[rest] != mine[x]
        which = np.flatnonzero(near)
        for y in (x + 1 + which[np.argsort(apart[which], kind="stable")]).tolist():
            a, b = root(x), root(y)
            if a != b:
                short, long = (sets[x], sets[y]) if size[x] <= size[y] else (sets[y], sets[x])
                at = np.minimum(long.searchsorted(short), len(long) - 1)
                shared = int((long[at] == short).sum()) if len(long) else 0
                if shared >= similarity * (size[x] + size[y] - shared) - 1e-9:
                    up[max(a, b)] = min(a, b)
                    found.append((x, y))
    return found


def _near_copies(docs: DataFrame, nodes: DataFrame, hang: DataFrame, radius: int, also: int, group: int, similarity: float, shingle: int, text_col: str) -> DataFrame:
    """Links that connect what all near copies connect among the candidates that hang together (``node, root``)."""
    sets = _shingle_sets(docs, nodes, hang, shingle, text_col)
    sized = hang.join(sets.select("node", F.size("set").alias("n")), "node")
    parts = sized.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("parts"))
    dealt = hang.join(parts, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("root", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "node", "mine")
    rows = dealt.join(nodes.select("node", "fp", "other"), "node").join(sets, "node").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    key = ("root", "i", "j")

    def verify(rows: pa.Table) -> pa.RecordBatch:
        node, fp, other, mine = (rows.column(c).to_numpy() for c in ("node", "fp", "other", "mine"))
        each = rows.column("set").combine_chunks()
        ends, flat = each.offsets.to_numpy(), each.values.to_numpy(zero_copy_only=False)
        found = linked(fp.view(np.uint64), other.view(np.uint64), mine, [np.sort(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], rows.column("i")[0] != rows.column("j")[0], radius, also, similarity)
        return pa.RecordBatch.from_arrays([pa.array([int(node[e[k]]) for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in columns])) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and any(held[0].column(k)[0].as_py() != c[a] for k, c in zip(key, columns, strict=True)):
                        yield verify(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield verify(pa.Table.from_batches(held))

    return cut(rows.select(*key, "node", "mine", "fp", "other", "set").mapInArrow(run, "a long, b long"))


def hex16(fp: str | Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
