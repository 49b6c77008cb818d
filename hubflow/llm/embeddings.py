"""Embedding near-dedup by spherical-cap filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import cut
from hubflow.llm.components import connected_components, local_forest

#: Independent product codes.
CODES = 4
#: Filters that a vector passes on average, over all codes; more give a higher recall.
FILTERS = 24
#: Filters of a code that every vector passes; one that reaches fewer caps gets its best ones.
FEWEST = 5
#: Shorter vectors are decoded with zeros added, as few dimensions don't give both blocks of a code room.
LEAST_DIM = 32
#: Vectors that pass a filter on average; fewer give more, narrower caps.
CAP = 128
#: Largest part of a filter's vectors that one task compares with another part.
BLOCK = 2048
#: Most filters with more vectors than that which are broadcast; more of them are joined by a shuffle.
SMALL = 100_000
#: Sign bits that stand for a vector in its filters.
SIGNS = 128
#: Candidates a vector of a filter beyond which the filter's pairs are counted in place instead of listed.
DENSE = 8
#: One of so many vectors is decoded first, to see which filters are large.
ONE_OF = 32


def code_size(n: int, cap: float = CAP, filters: int = FILTERS, codes: int = CODES) -> tuple[int, float]:
    """Codewords a block, and the share of all directions that a cap holds, for n vectors: n x share = ``cap``."""
    share = min(0.02, cap / max(n, 1))
    return max(2, math.ceil(math.sqrt(filters / codes / share))), share


def cap_height(dim: int, share: float) -> float:
    """The product with a cap's direction that a ``share`` of the sphere in ``dim`` dimensions reaches.

    A direction is a unit vector, and the random rotation makes any vector's product with it follow the law of the
    sphere, whose density is (1 - t^2)^((dim - 3)/2). Its tail is lighter than that of the normal law.
    """
    t = np.linspace(0, 1, 100_001)
    density = (1 - t * t) ** ((dim - 3) / 2)
    above = np.cumsum(((density[1:] + density[:-1]) / 2)[::-1])[::-1]
    return float(np.interp(-share, -above / (2 * above[0]), t[:-1]))


def codebooks(dim: int, words: int, codes: int = CODES, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per code a random rotation and two blocks of random unit codewords; a direction is a pair of them."""
    out = []
    for k in range(codes):
        rng = np.random.default_rng(seed + k)
        q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        half = dim // 2
        a, b = rng.standard_normal((words, half)), rng.standard_normal((words, dim - half))
        out.append((q, a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)))
    return out


def decode(unit: np.ndarray, books: list[tuple[np.ndarray, np.ndarray, np.ndarray]], height: float, fewest: int = FEWEST) -> list[np.ndarray]:
    """Per unit vector the sorted numbers of all directions whose product with it reaches the cap, ``fewest`` a code at least.

    A direction (a, b)/sqrt 2 has the product (<x1, a> + <x2, b>)/sqrt 2. Of each block only the products that can
    reach the threshold with the other block's best one are looked at; those of b are sorted, and for each a only the
    prefix that reaches it is listed. Where a code gives fewer, the threshold of this vector is lowered to its
    ``fewest``-th best direction, which is among the pairs of as many best a and b.
    """
    dim = len(books[0][0])
    unit = np.pad(unit, ((0, 0), (0, dim - unit.shape[1])))
    rows, numbers = [], []
    for k, (q, a, b) in enumerate(books):
        x = unit @ q
        left, right = x[:, : a.shape[1]] @ a.T, x[:, a.shape[1] :] @ b.T
        best = min(fewest, len(a))
        pairs = np.partition(left, -best, axis=1)[:, -best:, None] + np.partition(right, -best, axis=1)[:, None, -best:]
        number = min(fewest, best * best)
        least = np.minimum(height * math.sqrt(2), np.partition(pairs.reshape(len(x), -1), -number, axis=1)[:, -number] - 1e-12)
        width = int((right >= (least - left.max(axis=1))[:, None]).sum(axis=1).max(initial=1))
        order = np.argpartition(-right, width - 1, axis=1)[:, :width]
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(right, order, axis=1), axis=1), axis=1)
        top = np.take_along_axis(right, order, axis=1)
        row, first = np.nonzero(left >= (least - top[:, 0])[:, None])
        take = (top[row] >= (least[row] - left[row, first])[:, None]).sum(axis=1)
        at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        row, first = np.repeat(row, take), np.repeat(first, take)
        rows.append(row)
        numbers.append((k * len(a) + first) * len(b) + order[row, at])
    row, number = np.concatenate(rows), np.concatenate(numbers).astype(np.int32)
    number = number[np.lexsort((number, row))]
    return np.split(number, np.cumsum(np.bincount(row, minlength=len(unit)))[:-1]) if len(unit) else []


def _by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and the matrix of the vectors of each length."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, start = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        which = np.flatnonzero(lengths == dim)
        for at in range(0, len(which), 1024):
            some = which[at : at + 1024]
            yield some, flat[start[some][:, None] + np.arange(dim)]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def signs(unit: np.ndarray, seed: int = 11) -> np.ndarray:
    """Per vector ``SIGNS`` bits, as longs: on which side of random hyperplanes it lies."""
    planes = np.random.default_rng(seed).standard_normal((SIGNS, unit.shape[1]))
    return np.packbits(unit @ planes.T > 0, axis=1).view(">i8").astype(np.int64)


def most_differing(least: float) -> int:
    """Differing sign bits that a pair with cosine ``least`` has at most: 6.5 standard deviations above the mean.

    A bit differs with probability angle / pi, so a pair is missed in fewer than one case in a billion.
    """
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(SIGNS * p + 6.5 * math.sqrt(SIGNS * p * (1 - p)))


def _candidates(bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j whose sign bits differ in at most ``most`` places."""
    first, second = [], []
    bits = np.ascontiguousarray(bits).view(np.uint64)
    for at in range(0, len(bits), 256):
        part = bits[at : at + 256]
        apart = sum(np.bitwise_count(part[:, None, k] ^ bits[None, at:, k]) for k in range(bits.shape[1]))
        i, j = np.nonzero(apart <= most)
        keep = i < j
        first.append(i[keep] + at)
        second.append(j[keep] + at)
    return np.concatenate(first), np.concatenate(second)


def _linked(unit: np.ndarray, passed: list[np.ndarray], this: int, least: float, mine: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j with cosine >= ``least`` whose smallest common filter is ``this``; if ``split``, only pairs across parts."""
    first, second = [], []
    for at in range(0, len(unit), 512):
        i, j = np.nonzero(unit[at : at + 512] @ unit.T >= least)
        keep = i + at < j
        first.append(i[keep] + at)
        second.append(j[keep])
    i, j = np.concatenate(first), np.concatenate(second)
    if split:
        keep = mine[i] != mine[j]
        i, j = i[keep], j[keep]
    if not len(i):
        return i, j
    # filters below this one that two of the linked vectors share would have found the pair already
    rows = np.unique(np.concatenate([i, j]))
    earlier = [passed[r][passed[r] < this] for r in rows]
    flat = np.concatenate(earlier)
    values, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    of = np.repeat(np.arange(len(rows)), [len(e) for e in earlier])
    common = times[where] > 1
    width = int(number[-1]) + 1 if len(values) else 0
    a, b = np.searchsorted(rows, i), np.searchsorted(rows, j)
    seen = np.zeros(len(i), bool)
    for low in range(0, width, 1024):  # a bounded slice of the membership matrix at a time
        inside = common & (number[where] >= low) & (number[where] < low + 1024)
        m = np.zeros((len(rows), min(1024, width - low)), np.float32)
        m[of[inside], number[where][inside] - low] = 1
        if len(i) > len(rows) * 8:
            seen |= (m @ m.T)[a, b] > 0
        else:
            for s in range(0, len(i), 4096):
                seen[s : s + 4096] |= (m[a[s : s + 4096]] * m[b[s : s + 4096]]).any(axis=1)
    return i[~seen], j[~seen]


def usable(vector: Column) -> Column:
    """True for vectors that can link: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, *, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", filters: int = FILTERS, cap: float = CAP, codes: int = CODES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept (vec_id = component_id).

    1. Equal vectors become one class with the smallest id and the number of its rows.
    2. Each class's unit vector is list-decoded by random product codes to the filters (spherical caps) that it
       passes. The caps get narrower as the classes grow in number, so a filter holds about ``cap`` vectors and a
       vector passes about ``filters`` filters on average at any size, and ``FEWEST`` a code at least.
    3. Classes meet in filters with ``SIGNS`` sign bits instead of their vectors. Pairs whose bits differ too much for
       ``least`` (see ``most_differing``) are left out; the vectors of the others are fetched once a pair and their
       cosines checked in double precision.
    4. A filter with more than ``block`` vectors, or with more candidates than ``DENSE`` a vector, is dense: there no
       pairs are listed. Its vectors are dealt into parts of about ``block``; each two parts meet in one task, which
       returns counts of links and a spanning forest. A pair counts in its smallest common dense filter if it has one,
       else once as a pair, so counts are exact. A sample tells which filters are large; it decides how the work is
       dealt and nothing else.
    5. Components are found on the links and forests.

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing. Vectors of different
    lengths don't link. Null ids take part and never name a component unless all its ids are null; rows that repeat an
    id are vectors of their own. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = rows.where(usable(F.col("v")))
    classes = cut(good.groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size")).select(F.xxhash64("v").alias("h"), "v", "least_id", "size", F.monotonically_increasing_id().alias("node")))
    n = classes.count()
    words, share = code_size(n, cap, filters, codes)
    apart = most_differing(least)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, tuple[list, float]] = {}
        for batch in batches:
            for some, matrix in _by_length(batch.column("v")):
                dim, unit = matrix.shape[1], _unit(matrix)
                d = max(dim, LEAST_DIM)
                if d not in books:
                    books[d] = codebooks(d, words, codes), cap_height(d, share)
                numbers = pa.array([(dim << 40) + f.astype(np.int64) for f in decode(unit, *books[d])], pa.list_(pa.int64()))
                bits = signs(unit)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(some)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), numbers], ["node", "s1", "s2", "filters"])

    def in_filters(some: DataFrame) -> DataFrame:
        return some.select("node", "v").mapInArrow(passed, "node long, s1 long, s2 long, filters array<long>").select("node", "s1", "s2", F.explode("filters").alias("filter"))

    sample = in_filters(classes.where(F.pmod(F.xxhash64("node"), F.lit(ONE_OF)) == 0)).groupBy("filter").agg((F.count("*") * ONE_OF).alias("n"))
    large = cut(sample.where(F.col("n") > block // 2).select("filter", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    large_side = F.broadcast(large) if large.count() <= SMALL else large

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by filter: (filter, a, b) for candidates; (filter, a, null) for a dense filter's vectors that have one."""
        kept = [np.zeros(0, np.int64)] * 4
        names = ["filter", "node", "s1", "s2"]

        def done(f: np.ndarray, node: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            out = []
            for part in np.split(np.arange(len(f)), np.flatnonzero(np.diff(f)) + 1):
                if len(part) > 1:
                    i, j = _candidates(bits[part], apart)
                    if len(i) > DENSE * len(part):
                        one = node[part[np.unique(np.concatenate([i, j]))]]
                        out.append((f[part[0]], one, np.full(len(one), -1)))
                    elif len(i):
                        a, b = node[part[i]], node[part[j]]
                        out.append((f[part[0]], np.minimum(a, b), np.maximum(a, b)))
            a, b = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in out]]) for k in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)), pa.array(a), pa.array(b, mask=b < 0)], ["filter", "a", "b"])

        for batch in batches:
            new = [np.concatenate([k, batch.column(c).to_numpy(zero_copy_only=False)]) for k, c in zip(kept, names, strict=True)]
            last = np.searchsorted(new[0], new[0][-1]) if len(new[0]) else 0
            kept = [x[last:] for x in new]
            yield done(new[0][:last], new[1][:last], np.stack([x[:last] for x in new[2:]], axis=1))
        yield done(kept[0], kept[1], np.stack(kept[2:], axis=1))

    keyed = in_filters(classes).join(large_side, "filter", "left")
    met = keyed.where("parts IS NULL").select("filter", "node", "s1", "s2").repartition("filter").sortWithinPartitions("filter")
    found = cut(met.mapInArrow(compare, "filter long, a long, b long"))
    dense_nodes = found.where("b IS NULL").select("filter", F.col("a").alias("node"), F.lit(1).alias("parts"))
    if not large.isEmpty():
        dense_nodes = dense_nodes.unionByName(keyed.where("parts IS NOT NULL").select("filter", "node", "parts"))
    dense = cut(dense_nodes)
    lists = dense.groupBy("node").agg(F.array_sort(F.collect_list("filter")).alias("dense"))

    def verify(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, size = part["node"].to_numpy(), part["size"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        unit = _unit(np.array(part["v"].tolist(), np.float64))
        a, b = _linked(unit, part["dense"].tolist(), key[0], least, part["mine"].to_numpy(), key[1] != key[2])
        links = np.bincount(a, size[b], len(ids)) + np.bincount(b, size[a], len(ids))
        hit = np.flatnonzero(links)
        edges = local_forest(len(ids), a, b)
        nodes = [*ids[hit].tolist(), *[int(ids[x]) for x, _ in edges]]
        others = pd.array([*[None] * len(hit), *[int(ids[y]) for _, y in edges]], "Int64")
        return pd.DataFrame({"a": nodes, "b": others, "n": [*links[hit].astype(int).tolist(), *[0] * len(edges)]})

    known = classes.select("node", "size", "v")
    parts = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dense.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(parts))
    dealt = dealt.select("filter", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "mine").join(known, "node").join(lists, "node")
    in_dense = dealt.groupBy("filter", "i", "j").applyInPandas(verify, "a long, b long, n long")

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (some, x), (_, y) in zip(_by_length(batch.column("v")), _by_length(batch.column("w")), strict=True):
                hit = pa.array(some[np.einsum("ij,ij->i", _unit(x), _unit(y)) >= least])
                yield pa.RecordBatch.from_arrays([batch.column(c).take(hit) for c in ("a", "b", "size_a", "size_b")], ["a", "b", "size_a", "size_b"])

    pairs = found.where("b IS NOT NULL").select("a", "b").distinct()
    if not dense.isEmpty():  # pairs that share a dense filter are counted there
        la, lb = (lists.select(F.col("node").alias(c), F.col("dense").alias(f"dense_{c}")) for c in "ab")
        pairs = pairs.join(la, "a", "left").join(lb, "b", "left").where(~F.coalesce(F.arrays_overlap("dense_a", "dense_b"), F.lit(False)))
    ends = pairs.select("a", "b").join(known.select(F.col("node").alias("a"), F.col("size").alias("size_a"), "v"), "a").join(known.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("v").alias("w")), "b")
    linked = cut(ends.select("a", "b", "size_a", "size_b", "v", "w").mapInArrow(cosines, "a long, b long, size_a long, size_b long"))
    groups = cut(in_dense) if not dense.isEmpty() else None
    ends_of = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("size_b").alias("n")), F.struct(F.col("b").alias("node"), F.col("size_a").alias("n"))))
    counts, edges = linked.select(ends_of.alias("x")).select("x.*"), linked.select("a", "b")
    if groups is not None:
        counts = counts.unionByName(groups.where("b IS NULL").select(F.col("a").alias("node"), "n"))
        edges = edges.unionByName(groups.where("b IS NOT NULL").select("a", "b"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("links"))
    roots = connected_components(edges)
    named = classes.select("node", "h", "v", "least_id", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = named.join(names, "root").join(counts, "node", "left").select("h", F.col("v").alias("v2"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    keyed_rows = rows.withColumn("h", F.when(usable(F.col("v")), F.xxhash64("v")))
    r, k = keyed_rows.alias("r"), known.alias("k")
    out = r.join(k, F.expr("r.h = k.h AND r.v = k.v2"), "left").select("r.vec_id", F.coalesce("k.n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("k.component_id", "r.vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
