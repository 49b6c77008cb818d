"""Prefix trie of conversations from padded matrices of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hubflow.llm.common import cut, whole

#: Bytes of a turn in a sequence: 16 of the SHA-256 of role and text, 4 of the text's length. Equal bytes, equal turns.
TURN = 20
#: Columns of a padded matrix; longer conversations go on in further matrices, which hold them alone.
WIDTH = 16
#: Turns that a shard holds on average at most.
SHARD_TURNS = 1 << 20
#: Bytes of joined ids in one row, where a node's ids come from several shards.
PIECE = 1 << 16
#: Most shared nodes that are broadcast.
SMALL = 100_000

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What shards return: inner nodes (kind 0), their part of shared nodes (1), ids that end in these (2), first and last row (3).
PARTS = f"kind int, shard long, piece long, key binary, parent_key binary, {NODES}, ends string, first binary, last binary"


def turn_bytes(role: str | Column, text: str | Column) -> Column:
    """The ``TURN`` bytes of a turn; a null role or text counts as empty."""
    r, t = whole(role), whole(text)
    digest = F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(t)), 8, "0")))


def sequences(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, seq``: the bytes of each conversation's turns, by turn, null first; equal turns go by their bytes.

    Texts stay where they are: only ``TURN`` bytes a turn are shuffled. Rows without conv_id belong to no conversation.
    """
    c, t = F.col(id_col).cast("long"), F.col(turn_col).cast("long")
    rows = turns.where(F.col(id_col).isNotNull()).select(c.alias("conv_id"), F.struct(t.isNotNull(), F.coalesce(t, F.lit(0)), turn_bytes(role_col, text_col).alias("b")).alias("turn"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return lists.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["b"])), "")).alias("seq"))


def rebuilt(seqs: DataFrame, every: int = 100, first: int = 6) -> DataFrame:
    """Each conversation c with its first h turns those of conversation c - c % ``every``, where h = crc32(c) % ``first``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % first * TURN
    heads = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(seq, 1, {first * TURN})").alias("head"))
    both = seqs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h.cast("int")}).join(heads, "base", "left")
    return both.select("conv_id", F.expr("concat(coalesce(substring(head, 1, h), X''), substring(seq, h + 1))").alias("seq"))


def sort_turns(ids: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by their ids (> 0), and how many leading ids each shares with the row before; -1 for the first.

    Rows are padded with 0 to matrices of ``width`` columns and sorted with lexsort. Where a row first differs from the
    row before, the OR-accumulated masks of changed columns begin. Rows that are longer go on in the next matrix.
    """
    n = len(lens)
    order, group, shared = np.arange(n), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    alive, at = np.arange(n), 0
    while len(alive):
        rows = order[alive]
        columns = np.arange(at, at + min(width, max(int(lens[rows].max()) - at, 1)))
        there = columns < lens[rows][:, None]
        m = np.zeros(there.shape, ids.dtype)
        m[there] = ids[(starts[rows][:, None] + columns)[there]]
        by = np.lexsort((lens[rows] > columns[-1] + 1, *m.T[::-1], group[alive]))
        m, order[alive] = m[by], rows[by]
        changed = np.ones(m.shape, bool)
        follows = np.flatnonzero((np.diff(alive) == 1) & (group[alive[1:]] == group[alive[:-1]])) + 1
        changed[follows] = m[follows] != m[follows - 1]
        masks = np.logical_or.accumulate(changed, axis=1)
        # all rows that were alike so far differ here or later; those apart since an earlier matrix are known
        open_ = alive[(alive > 0) & (group[alive] == group[alive - 1])]
        alike = np.zeros(n, np.int64)
        alike[alive] = (~masks).sum(axis=1)
        shared[open_] = np.minimum(at + alike[open_], np.minimum(lens[order[open_]], lens[order[open_ - 1]]))
        group[alive] = np.maximum.accumulate(np.where(masks[:, -1], alive, 0))
        at = int(columns[-1]) + 1
        alive = alive[lens[order[alive]] > at]
    return order, shared


def _keys(seq: bytes) -> list[bytes]:
    """128 bits for every prefix of a sequence, the empty one first."""
    out = [b"root"]
    for at in range(0, len(seq), TURN):
        out.append(hashlib.blake2b(out[-1] + seq[at : at + TURN], digest_size=16).digest())
    return out


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shard_nodes(shard: int, conv: np.ndarray, seqs: pa.Array, width: int = WIDTH) -> Iterator[pd.DataFrame]:
    """The nodes of a shard's conversations (see ``PARTS``).

    Nodes of the first and the last row may have members in other shards. All figures are sums over a node's rows of
    what a row adds over the row before: a row starts the nodes below what it shares with that one, ends a leaf if the
    next row doesn't go on from it, and saves the texts that it shares. So shards' parts add up (see ``prefix_trie``).
    """
    by_id = np.argsort(conv, kind="stable")
    conv, seqs = conv[by_id], seqs.take(pa.array(by_id))
    lens = np.array([len(x) // TURN for x in seqs.to_pylist()], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    flat = np.frombuffer(b"".join(seqs.to_pylist()), np.uint8).reshape(-1, TURN)
    high, low, points = (np.ascontiguousarray(flat[:, a:b]).view(t).ravel() for a, b, t in ((0, 8, ">u8"), (8, 16, ">u8"), (16, 20, ">u4")))
    ranked = np.lexsort((low, high))
    step = np.ones(len(ranked), np.int64)
    step[1:] = (high[ranked[1:]] != high[ranked[:-1]]) | (low[ranked[1:]] != low[ranked[:-1]])
    ids = np.empty(len(ranked), np.int64)
    ids[ranked] = np.cumsum(step)
    order, shared = sort_turns(ids, starts, lens, width)
    conv, lens, starts = conv[order], lens[order], starts[order]
    until = np.concatenate([[0], np.cumsum(points, dtype=np.int64)])
    n = len(order)
    next_shared = np.append(shared[1:], -1)
    ends_leaf = (next_shared < lens).astype(np.int64)
    first, last = seqs[int(order[0])].as_py(), seqs[int(order[-1])].as_py()
    keys = (_keys(first), _keys(last))
    yield pd.DataFrame({"kind": [3], "first": [first], "last": [last]})
    # below this depth a row is alone; its nodes from there on need no sums, but where other shards may join it
    alone = np.maximum(shared, next_shared) + 1
    alone[[0, -1]] = np.maximum(lens, alone)[[0, -1]]
    places, depth = np.arange(n), 0
    parent, parent_at = np.zeros(n, np.int64), np.full(n, -1, np.int64)  # the parent node's conv_id, or whose key it has
    while len(places := places[np.minimum(lens, alone)[places] >= depth]):
        node = np.flatnonzero(shared[places] < depth)
        sums = lambda x: np.add.reduceat(x.astype(np.int64), node)
        least = np.minimum.reduceat(conv[places], node)
        saves = np.maximum(until[starts[places] + np.maximum(shared[places], 0)] - until[starts[places] + max(depth - 1, 0)], 0) * (shared[places] >= depth)
        here = sums(lens[places] == depth)
        at = np.full(len(node), -1)
        if lens[0] >= depth:
            at[0] = 0
        if lens[-1] >= depth and at[-1] < 0:
            at[-1] = 1
        top = places[node]
        out = pd.DataFrame({
            "kind": (at >= 0).astype(int), "conv_id": least, "depth": depth, "n_convs": np.diff(np.append(node, len(places))),
            "n_children": sums((lens[places] > depth) & (shared[places] <= depth)), "n_leaves": sums(ends_leaf[places]), "saved_tokens": sums(saves),
        })
        out["parent_key"] = [keys[k][depth - 1] if k >= 0 else None for k in (parent_at[top] if depth else np.full(len(node), -1))]
        out["parent_conv_id"] = pd.array(np.where(parent_at[top] >= 0, 0, parent[top]), "Int64")
        out.loc[(parent_at[top] >= 0) | (depth == 0), "parent_conv_id"] = pd.NA
        out["key"] = [keys[k][depth] if k >= 0 else None for k in at]
        texts = np.full(len(node), _sha(""), object)
        for i in np.flatnonzero((here > 0) & (at < 0)):
            texts[i] = _sha(_joined(conv[places[node[i] : node[i] + here[i]]]))
        out["ends_sha256"] = texts
        yield out
        for i in np.flatnonzero((here > 0) & (at >= 0)):
            mine = conv[places[node[i] : node[i] + here[i]]]
            for piece, k in enumerate(range(0, len(mine), PIECE // 8)):
                yield pd.DataFrame({"kind": [2], "piece": [piece], "key": [keys[at[i]][depth]], "ends": [_joined(mine[k : k + PIECE // 8])]})
        of = np.repeat(np.arange(len(node)), out["n_convs"])
        parent[places], parent_at[places] = least[of], at[of]
        depth += 1
    tails = np.flatnonzero(lens > alone)
    for k in range(0, len(tails), 1 << 14):
        rows = tails[k : k + (1 << 14)]
        times = lens[rows] - alone[rows]
        row = np.repeat(rows, times)
        deep = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + alone[row] + 1
        texts = np.full(len(row), _sha(""), object)
        texts[np.cumsum(times) - 1] = [_sha(str(c)) for c in conv[rows].tolist()]
        yield pd.DataFrame({"kind": 0, "conv_id": conv[row], "depth": deep, "parent_conv_id": conv[row], "n_convs": 1, "n_children": (deep < lens[row]).astype(int), "n_leaves": 1, "saved_tokens": 0, "ends_sha256": texts})


def _corrections(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a shard counted of its first row as if no row came before it."""
    for batch in pairs:
        for before, first in zip(batch["before"], batch["first"], strict=True):
            a, b = (np.frombuffer(bytes(x), np.uint8).reshape(-1, TURN) for x in (before, first))
            m = min(len(a), len(b))
            shared = int(np.append((a[:m] == b[:m]).all(axis=1), False).argmin())
            until = np.concatenate([[0], np.cumsum(np.ascontiguousarray(b[:, 16:]).view(">u4").ravel(), dtype=np.int64)])
            depth = np.arange(shared + 1)
            yield pd.DataFrame({"key": _keys(b[:shared].tobytes()), "n_children": -(depth < shared).astype(int), "n_leaves": -int(shared == len(a)), "saved_tokens": until[shared] - until[np.maximum(depth - 1, 0)]})


def _hash_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's pieces, which follow one another."""
    key, digest = None, None
    for batch in batches:
        for k, text in zip(batch["key"], batch["ends"], strict=True):
            k = bytes(k)
            if k == key:
                digest.update(b",")
            else:
                if key is not None:
                    yield pd.DataFrame({"key": [key], "ends_sha256": [digest.hexdigest()]})
                key, digest = k, hashlib.sha256()
            digest.update(text.encode())
    if key is not None:
        yield pd.DataFrame({"key": [key], "ends_sha256": [digest.hexdigest()]})


def prefix_trie(seqs: DataFrame, *, shards: int | None = None, width: int = WIDTH) -> DataFrame:
    """The nodes of the trie of ``seqs`` (``conv_id, seq``, see ``sequences``), one row per distinct prefix.

    Returns conv_id (smallest member), depth, parent_conv_id (the parent's smallest member, null for the root), n_convs,
    n_children, n_leaves (childless nodes below, itself included), saved_tokens (over the node and all below: members but
    one, times the code points of the last text) and ends_sha256 (of the ids, ascending and comma-joined, of members that
    end here). Conversations without turns are members of the root; an empty table gives no node.

    Rows are dealt to ``shards`` by ranges of (sequence, id), so that copies of one conversation can lie in several. A
    shard sorts its padded matrices and sums every depth. Nodes that reach over a shard's border are those of its first
    and last row: about twice a conversation's length for each shard. Their parts are summed by a hash of the path, less
    what each shard's first row shares with the shard before. The ids that end in such a node are hashed as a stream, in
    order, by one task: SHA-256 allows no other way. A conversation is one row of ``TURN`` bytes a turn, so the longest
    must fit into a task.
    """
    spark = seqs.sparkSession
    rows = cut(seqs)
    if shards is None:
        turns = rows.agg(F.sum(F.length("seq"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // (TURN * SHARD_TURNS)))
    names = [f.split()[0] for f in PARTS.split(", ")]
    whole_numbers = {f.split()[0] for f in PARTS.split(", ") if f.split()[1] == "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        shard = TaskContext.get().partitionId()
        seq = pa.chunked_array([b.column("seq").cast(pa.large_binary()) for b in got]).combine_chunks()
        for out in shard_nodes(shard, np.concatenate([b.column("conv_id").to_numpy(zero_copy_only=False) for b in got]), seq, width):
            out["shard"] = shard
            yield from pa.Table.from_pandas(out.reindex(columns=names).astype({c: "Int64" for c in whole_numbers}), schema=arrow, preserve_index=False).to_batches()

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    arrow = pa.schema([(f.split()[0], types[f.split()[1]]) for f in PARTS.split(", ")])
    parts = cut(rows.repartitionByRange(shards, "seq", "conv_id").mapInArrow(run, PARTS), instead_of=rows)
    edges = parts.where("kind = 3").select("shard", "first", "last")
    # one row a shard
    pairs = edges.withColumn("before", F.lag("last").over(Window.orderBy("shard"))).where("before IS NOT NULL").select("before", "first")
    fixes = pairs.mapInPandas(_corrections, "key binary, n_children long, n_leaves long, saved_tokens long")
    mine = parts.where("kind = 1").select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
    added = mine.unionByName(fixes, allowMissingColumns=True).groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    )
    ended = parts.where("kind = 2").select("key", "shard", "piece", "ends").repartition("key").sortWithinPartitions("key", "shard", "piece").select("key", "ends")
    hashed = ended.mapInPandas(_hash_pieces, "key binary, ends_sha256 string")
    over = cut(added.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))))
    of = over.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of"))
    of = F.broadcast(of) if over.count() <= SMALL else of
    columns = [f.split()[0] for f in NODES.split(", ")]
    known = over.select("parent_key", *[c for c in columns if c != "parent_conv_id"]).join(of, "parent_key", "left").withColumnRenamed("of", "parent_conv_id").select(*columns)
    inner = parts.where("kind = 0").join(of, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("of", "parent_conv_id")).select(*columns)
    return inner.unionByName(known)
