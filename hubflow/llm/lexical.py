"""Ranked lexical search over a length-stratified index."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hubflow.llm.common import ascii_lower, cut, split_words, whole

#: Runs of what is not in a term: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Length normalisation: b = 25 %, k1 = 1.2.
BASE, LENGTH = 75, 25
#: Most different terms that one pass over the documents looks for; more items are searched in blocks.
TERMS = 200_000
#: Postings and documents of a stratum's part on average at most.
POSTINGS, DOCS = 1 << 19, 1 << 13
#: Cells of scores that are held at a time.
CELLS = 1 << 21
#: The parts of each item's highest bounds that are searched first, by which the others are then left out.
SEEDS = 2
#: Stands for a null id, which comes after all others.
NO_ID = (1 << 63) - 1
#: Most strata that are broadcast.
SMALL = 100_000

INDEX = "m long, part long, docs array<long>, terms array<int>, tfs array<int>, ends array<int>, places array<int>"


def terms_of(text: str | Column = "text") -> Column:
    """The terms of a whole text in order, A-Z lower-cased. ``text`` should be a column of its own."""
    return split_words(ascii_lower(F.col(text) if isinstance(text, str) else text), BETWEEN)


@dataclass
class Index:
    #: One row per part of a stratum (see ``build_index``).
    rows: DataFrame
    terms: list[str]
    weights: np.ndarray


def _count(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs``: a document's number of terms, and which of the wanted ones it has how often."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), whole(text_col).alias("text")).select("doc_id", terms_of("text").alias("words"))
    wanted = pa.array(terms, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            here = code >= 0
            key, tf = np.unique(np.repeat(np.arange(len(n)), n)[here] * (len(terms) + 1) + code[here], return_counts=True)
            doc, term = key // (len(terms) + 1), key % (len(terms) + 1)
            offsets = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
            each = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *each], ["doc_id", "n", "terms", "tfs"])

    return texts.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _stratum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns rows that are sorted by stratum and part into postings by term and tf, one row per part."""
    held: list[pa.RecordBatch] = []

    def made(rows: pa.Table) -> pa.RecordBatch:
        docs, lists = rows.column("doc_id").combine_chunks(), rows.column("terms").combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        term, tf = lists.flatten().to_numpy(zero_copy_only=False), rows.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        place = np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.lexsort((place, tf, term))
        term, tf, place = term[order], tf[order], place[order]
        last = np.flatnonzero(np.append((np.diff(term) != 0) | (np.diff(tf) != 0), True))
        lists = [pa.array([x], pa.list_(t)) for x, t in ((docs, pa.int64()), (term[last], pa.int32()), (tf[last], pa.int32()), (last + 1, pa.int32()), (place, pa.int32()))]
        return pa.RecordBatch.from_arrays([rows.column("m").combine_chunks()[:1], rows.column("part").combine_chunks()[:1], *lists], [f.split()[0] for f in INDEX.split(", ")])

    for batch in batches:
        m, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "part"))
        cuts = [0, *(np.flatnonzero((np.diff(m) != 0) | (np.diff(part) != 0)) + 1), len(m)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and b > a and (held[0].column("m")[0].as_py(), held[0].column("part")[0].as_py()) != (m[a], part[a]):
                yield made(pa.Table.from_batches(held))
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield made(pa.Table.from_batches(held))


def build_index(docs: DataFrame, terms: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents for the given terms, in alphabetical order and without repeats.

    A document's normaliser m grows with its length over the mean. Documents of equal m are a stratum, dealt into parts
    of about ``POSTINGS`` postings. A part's row has its documents, and for each term and tf (the runs, by rising tf)
    the documents' places: ``ends`` is where a run ends in ``places``. Within a stratum a posting's impact depends on tf
    alone. Documents without any of the terms are counted, and have no postings.
    """
    counted = cut(_count(docs, terms, id_col, text_col))
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    # one row a wanted term
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    weights = np.array([weight(n_docs, x) if x else 0 for x in df.tolist()], np.int64)
    found = counted.where(F.size("terms") > 0).withColumn("m", F.lit(BASE) + F.expr(f"({LENGTH} * n * {n_docs}L) div {max(n_terms, 1)}L"))
    strata = cut(found.groupBy("m").agg(F.greatest(F.ceil(F.sum(F.size("terms")) / POSTINGS), F.ceil(F.count("*") / DOCS)).alias("parts")))
    dealt = found.join(F.broadcast(strata) if strata.count() <= SMALL else strata, "m").withColumn("part", F.pmod(F.xxhash64("doc_id", "tfs"), "parts"))
    rows = dealt.select("m", "part", "doc_id", "terms", "tfs").repartition("m", "part").sortWithinPartitions("m", "part")
    return Index(cut(rows.mapInArrow(_stratum_rows, INDEX), instead_of=counted), terms, weights)


class _Part:
    """A row of the index, with the impact of each run."""

    def __init__(self, row: dict) -> None:
        self.docs, self.terms, self.tfs, self.ends, self.places = (np.asarray(row[c]) for c in ("docs", "terms", "tfs", "ends", "places"))
        self.key = (row["m"], row["part"])
        tf, at = np.unique(self.tfs, return_inverse=True)
        self.impacts = impact(tf.astype(np.int64), row["m"])[at]
        last = np.append(np.diff(self.terms) != 0, True)
        self.known, self.highest = self.terms[last], self.impacts[last]

    def bounds(self, terms: np.ndarray, gains: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
        """For each item the score that no document of this part exceeds."""
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        here = self.known[at] == terms
        out = np.zeros(n, np.int64)
        np.add.at(out, items[here], gains[here] * self.highest[at[here]])
        return out

    def scores(self, by_term: dict[int, tuple[np.ndarray, np.ndarray]], wanted: np.ndarray) -> np.ndarray:
        """Scores of all documents for the wanted items."""
        row = np.full(int(wanted.max()) + 1, -1)
        row[wanted] = np.arange(len(wanted))
        out = np.zeros((len(wanted), len(self.docs)), np.int64)
        start = np.concatenate([[0], self.ends[:-1]])
        runs = np.concatenate([[0], np.flatnonzero(np.diff(self.terms)) + 1, [len(self.terms)]])
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            items, gains = by_term[int(self.terms[a])]
            mine = items[items < len(row)]
            keep = row[mine] >= 0
            rows, gain = row[mine[keep]], gains[: len(mine)][keep]
            if len(rows):
                gained = np.repeat(self.impacts[a:b], self.ends[a:b] - start[a:b])
                out[rows[:, None], self.places[start[a] : self.ends[b - 1]]] += gain[:, None] * gained
        return out


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, -scores))[:k]
    return scores[order], docs[order]


def search(index: Index, items: pd.DataFrame, k: int = 20) -> DataFrame:
    """``item, doc_id, score`` of each item's ``k`` best documents with a score above 0.

    ``items``: item (0 to n - 1), term (a place in the index' terms) and times, one row per item and different term. The
    parts with an item's highest bounds are searched first, and the k-th score found is its threshold. Then tasks visit
    their parts by falling bounds and leave out those below the item's threshold, which rises on the way.
    """
    spark = index.rows.sparkSession
    items = items.sort_values(["term", "item"])
    terms, of, gains = items["term"].to_numpy(), items["item"].to_numpy(), items["times"].to_numpy() * index.weights[items["term"].to_numpy()]
    n = int(of.max()) + 1 if len(of) else 0
    if not n:
        return spark.createDataFrame([], "item long, doc_id long, score long")
    split = np.flatnonzero(np.diff(terms)) + 1
    by_term = {int(t[0]): (i, g) for t, i, g in zip(*(np.split(x, split) for x in (terms, of, gains)), strict=True)}

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(n)]
        for batch in batches:
            for row in batch.to_pylist():
                part = _Part(row)
                for i, b in enumerate(part.bounds(terms, gains, of, n).tolist()):
                    if b > 0:
                        best[i] = sorted([*best[i], (-b, *part.key)])[:SEEDS]
        out = [(i, -b, m, part) for i in range(n) for b, m, part in best[i]]
        yield from pa.Table.from_pandas(pd.DataFrame(out, columns=["item", "bound", "m", "part"], dtype="int64"), preserve_index=False).to_batches()

    def visit(rows: DataFrame, least: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            best, floor = defaultdict(lambda: nothing), least.copy()
            for batch in batches:
                parts = [_Part(row) for row in batch.to_pylist()]
                bound = [p.bounds(terms, gains, of, n) for p in parts]
                for at in sorted(range(len(parts)), key=lambda i: -int(bound[i].max())):
                    live = np.flatnonzero(bound[at] >= floor)
                    for a in range(0, len(live), max(1, CELLS // len(parts[at].docs))):
                        some = live[a : a + max(1, CELLS // len(parts[at].docs))]
                        for i, scores in zip(some.tolist(), parts[at].scores(by_term, some), strict=True):
                            hit = np.flatnonzero(scores >= floor[i])
                            if len(hit):
                                best[i] = _best(np.concatenate([best[i][0], scores[hit]]), np.concatenate([best[i][1], parts[at].docs[hit]]), k)
                                if len(best[i][0]) == k:
                                    floor[i] = max(floor[i], best[i][0][-1])
            columns = [np.repeat(np.array(list(best), np.int64), [len(best[i][0]) for i in best]), *(np.concatenate([nothing[0], *(best[i][x] for i in best)]) for x in (1, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

        found = rows.mapInArrow(run, "item long, doc_id long, score long")
        w = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    w = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "part")
    first = index.rows.mapInArrow(bounds, "item long, bound long, m long, part long").withColumn("place", F.row_number().over(w)).where(F.col("place") <= SEEDS)
    # at most SEEDS parts an item, and k rows an item
    seeds = index.rows.join(F.broadcast(first.select("m", "part").distinct()), ["m", "part"], "left_semi")
    least = np.ones(n, np.int64)
    for r in visit(seeds, least).where(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    return visit(index.rows, least).select("item", "doc_id", "score", "rank")


def rank(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", terms: int = TERMS) -> DataFrame:
    """Per row of ``items`` its ``k`` best documents: item_id, rank (int, from 1), doc_id, score.

    The score sums, over the item's terms with repeats, the term's weight floor(1000 ln((2N+2)/(2df+1))) times
    10^9 tf div (1000 tf + 12 m), where m = 75 + 25 n N div L (documents with a term N, all their terms L, the
    document's own n). Only scores above 0 count; equal scores go by doc_id, nulls last. Items are a stated query set:
    they are dealt into blocks of about ``terms`` terms, and each block is one search over all documents.

    Null and empty texts have no terms: such documents aren't counted in N, and such items find nothing. A null doc_id
    or item_id stays null; repeated rows of either table are documents and items of their own. Other columns are
    ignored. A table without documents or items gives no rows.
    """
    of = items.select(F.col(item_col).alias("item_id"), whole(item_text_col).alias("text")).select("item_id", terms_of("text").alias("words"))
    asked = cut(of.select(F.monotonically_increasing_id().alias("row"), "item_id", "words"))
    blocks = max(1, -(-(asked.agg(F.sum(F.size(F.array_distinct("words")))).first()[0] or 0) // terms))
    out = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).collect()
        times = [Counter(r["words"]) for r in mine]
        known = sorted(set().union(*times))
        place = {t: i for i, t in enumerate(known)}
        pairs = pd.DataFrame([(i, place[t], n) for i, c in enumerate(times) for t, n in c.items()], columns=["item", "term", "times"], dtype="int64")
        found = search(build_index(docs, known, id_col=id_col, text_col=text_col), pairs, k) if known else None
        if found is not None:
            ids = items.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], f"item long, item_id {items.schema[item_col].dataType.simpleString()}")
            named = found.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
            out = named if out is None else out.unionByName(named)
    if out is None:
        return asked.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out
