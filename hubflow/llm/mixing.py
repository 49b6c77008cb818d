"""Mixing sources to target weights by min-cost flow."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hubflow.llm.common import WORD, cut, whole
from hubflow.llm.components import connected_components

#: Most sources whose shares the driver works out, and most patterns that are broadcast; Spark does what is beyond.
LISTED = 100_000
#: Steps in which Spark narrows the level down to so many sources.
STEPS = 1000


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares the total of ``sizes`` by weight; no share exceeds ``most`` times its size, and what is above is shared again."""
    total, shares = float(sum(sizes)), [0.0] * len(sizes)
    caps = [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    left, weight = total, float(sum(weights))
    for k, i in enumerate(order):
        level = left / weight
        if caps[i] > level * weights[i]:
            for j in order[k:]:
                shares[j] = level * weights[j]
            break
        shares[i] = caps[i]
        left, weight = left - caps[i], weight - weights[i]
    return shares


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Tokens that each pattern gives to each of its sources, meeting quotas at the least cost.

    The k-th use of a pattern's documents costs k a token, so the cost is convex and repetition is spread before it
    deepens. Only the edges into patterns cost anything, so a shortest path costs k just when its first edge opens tier
    k: flows of least cost are a greatest flow through the first tier, extended through the second, and so on. Each is
    found with blocking flows along the edges of a breadth-first layering (Dinic).
    """
    P, S = len(capacity), len(quota)
    sink = P + S
    to: list[int] = []
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(P + S + 1)]

    def edge(a: int, b: int, most: int) -> int:
        for x, y, r in ((a, b, most), (b, a, 0)):
            at[x].append(len(to))
            to.append(y)
            room.append(r)
        return len(to) - 2

    gives = [{s: edge(p, P + s, capacity[p] * repeats) for s in members[p]} for p in range(P)]
    for s in range(S):
        edge(P + s, sink, quota[s])
    left = [0] * P
    for _ in range(repeats):
        left = [x + c for x, c in zip(left, capacity, strict=True)]
        while True:
            layer = {p: 0 for p in range(P) if left[p]}
            queue = deque(layer)
            while queue and sink not in layer:
                a = queue.popleft()
                for e in at[a]:
                    if room[e] and to[e] not in layer:
                        layer[to[e]] = layer[a] + 1
                        queue.append(to[e])
            if sink not in layer:
                break
            used = [0] * len(at)  # edges of each node that lead nowhere in this layering
            for p in range(P):
                path: list[int] = []
                a = p
                while left[p] and layer.get(p) == 0:
                    if a == sink:
                        push = min(left[p], *(room[e] for e in path))
                        for e in path:
                            room[e] -= push
                            room[e ^ 1] += push
                        left[p] -= push
                        full = next((k for k, e in enumerate(path) if not room[e]), 0)
                        a = to[path[full] ^ 1]
                        del path[full:]
                        continue
                    while used[a] < len(at[a]) and not (room[at[a][used[a]]] and layer.get(to[at[a][used[a]]], -1) == layer[a] + 1):
                        used[a] += 1
                    if used[a] < len(at[a]):
                        path.append(at[a][used[a]])
                        a = to[path[-1]]
                    elif path:
                        a = to[path.pop() ^ 1]
                        used[a] += 1
                    else:
                        break
    return [{s: room[e + 1] for s, e in g.items()} for g in gives]


def default_weights(names: Sequence[str | None]) -> list[float]:
    """1, 2, 3, repeating, over sources by code point, null last."""
    return [float(i % 3 + 1) for i in range(len(names))]


def shares(own: DataFrame, weights: Mapping[str | None, float] | None, repeats: int, listed: int = LISTED) -> DataFrame:
    """``source, target`` from ``source, own``: ``water_fill`` over any number of sources."""
    spark, n = own.sparkSession, own.count()
    if n <= listed:
        rows = sorted(((r["source"], r["own"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or ""))
        names = [r[0] for r in rows]
        w = default_weights(names) if weights is None else [float(weights[x]) for x in names]
        return spark.createDataFrame(list(zip(names, water_fill([r[1] for r in rows], w, repeats), strict=True)), "source string, target double")
    if weights is None:  # the rank of a source: its place in its sorted range after the ranges before
        placed = cut(own.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source").withColumn("n", F.monotonically_increasing_id()))
        part = F.shiftright("n", 33)
        ahead, before = [], 0
        for r in sorted(placed.groupBy(part.alias("p")).count().collect()):
            ahead.append((r["p"], before))
            before += r["count"]
        ahead = F.broadcast(spark.createDataFrame(ahead, "p long, before long"))
        rank = F.col("before") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
        weighed = placed.withColumn("p", part).join(ahead, "p").select("source", "own", (rank % 3 + 1).cast("double").alias("weight"))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        weighed = own.join(given, own["source"].eqNullSafe(given["name"])).select("source", "own", "weight")
    weighed = cut(weighed.withColumn("cap", F.col("own") * repeats).withColumn("full", F.col("cap") / F.col("weight")))
    total, low, high = weighed.agg(F.sum("own"), F.lit(0.0), F.max("full")).first()
    below = lambda x: weighed.where(F.col("full") <= x).agg(F.coalesce(F.sum("cap"), F.lit(0.0))).first()[0]
    above = lambda x: weighed.where(F.col("full") > x).agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    for _ in range(6):
        inside = weighed.where((F.col("full") > low) & (F.col("full") <= high))
        if high <= low or inside.select("full").distinct().limit(listed + 1).count() <= listed:
            break
        step = (high - low) / STEPS
        sums = {r["k"]: r for r in inside.groupBy(F.least(F.ceil((F.col("full") - low) / step), F.lit(STEPS)).alias("k")).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).collect()}
        cap, weight = below(low), above(high) + sum(r["weight"] for r in sums.values())
        for k in range(1, STEPS + 1):  # the first step at whose end the shares reach the total
            cap, weight = cap + (sums[k]["cap"] if k in sums else 0), weight - (sums[k]["weight"] if k in sums else 0)
            if cap + (low + k * step) * weight >= total:
                low, high = low + (k - 1) * step, low + k * step
                break
    left, weight = total - below(low), above(low)
    for r in sorted(weighed.where((F.col("full") > low) & (F.col("full") <= high)).groupBy("full").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).collect()):
        if r["full"] > left / weight:
            break
        left, weight = left - r["cap"], weight - r["weight"]
    level = left / weight if weight > 0 else high
    return weighed.select("source", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def _flows(group: pd.DataFrame, repeats: int) -> pd.DataFrame:
    """The flow of one component: patterns that share sources with each other and with no other pattern.

    Flows of least cost need not be unique, so patterns are given in the order of their members, whatever the partitions.
    """
    rows = group.iloc[sorted(range(len(group)), key=lambda i: [(x is None, x or "") for x in group["members"].iloc[i]])]
    quotas = {s: t for names, targets in zip(rows["members"], rows["targets"], strict=True) for s, t in zip(names, targets, strict=True)}
    names = sorted(quotas, key=lambda x: (x is None, x or ""))
    index = {x: i for i, x in enumerate(names)}
    flow = min_cost_flow([int(x) for x in rows["pattern_size"]], [[index[x] for x in m] for m in rows["members"]], [round(quotas[x]) for x in names], repeats)
    return pd.DataFrame({"key": rows["key"], "take": [sum(g.values()) for g in flow]})


def plan(patterns: DataFrame, weights: Mapping[str | None, float] | None, repeats: int, listed: int = LISTED) -> DataFrame:
    """From ``members array<string>, pattern_size``: per pattern its target and the tokens that it gives (take).

    A pattern of one source that shares it with no other pattern gives its source's quota. The others are dealt into
    components of patterns that share sources; each component's flow is planned by a task of its own.
    """
    keyed = cut(patterns.withColumn("key", F.monotonically_increasing_id()))
    of = keyed.select("key", F.explode("members").alias("source"), (F.col("pattern_size") / F.size("members")).alias("part"))
    goal = cut(shares(cut(of.groupBy("source").agg(F.sum("part").alias("own"))), weights, repeats, listed))
    o, g = of.alias("o"), (F.broadcast(goal) if goal.count() <= listed else goal).alias("g")
    each = o.join(g, F.expr("o.source <=> g.source")).select("o.key", "o.source", "g.target")
    target = each.groupBy("key").agg(F.sum("target").alias("target"))
    shared = keyed.where(F.size("members") > 1)
    if shared.isEmpty():
        return keyed.join(target, "key", "left").select("members", "pattern_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce(F.bround("target"), F.lit(0.0)).cast("long").alias("take"))
    # patterns are linked with the first pattern of each of their sources
    first = each.groupBy("source").agg(F.min("key").alias("first"))
    e, f = each.alias("e"), first.alias("f")
    edges = e.join(f, F.expr("e.source <=> f.source")).select(F.col("e.key").alias("a"), F.col("f.first").alias("b"))
    roots = connected_components(edges).select(F.col("node").alias("key"), "root")
    lists = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("x")).select("key", F.col("x.source").alias("members"), F.col("x.target").alias("targets"))
    known = lists.join(keyed.select("key", "pattern_size"), "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))

    def flows(group: pd.DataFrame) -> pd.DataFrame:
        return _flows(group, repeats)

    lone = known.where(F.size("members") == 1).join(roots, "key", "left_anti").select("key", F.bround(F.col("targets")[0]).cast("long").alias("take"))
    planned = known.join(lone.select("key"), "key", "left_anti").select("root", "key", "members", "targets", "pattern_size").groupBy("root").applyInPandas(flows, "key long, take long")
    takes = cut(lone.unionByName(planned))
    return keyed.join(target, "key", "left").join(takes, "key", "left").select("members", "pattern_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("take", F.lit(0)).cast("long").alias("take"))


def mix(docs: DataFrame, sources: Column | str = "source", size: Column | None = None, *, weights: Mapping[str | None, float] | None = None, repeats: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), listed: int = LISTED) -> DataFrame:
    """Adds to every document what a mix of 100 % of all sizes takes of it.

    ``sources``: a string column, or an array column of the sources that a document belongs to. Returns doc_id, members,
    size, pattern_size, target, copies, taken (copies x size), and the columns named in ``keep``.

    1. Sizes are summed by membership pattern (partial sums, one row a pattern and task).
    2. The total is shared by weight, and tokens are routed to quotas by min-cost flow with convex costs of repetition
       (see ``plan``). Up to ``listed`` sources the driver works the shares out and plans are broadcast; beyond, Spark
       does both, with the same results.
    3. A pattern that gives k times its size and r tokens more takes all its documents k times, and those first in the
       order of md5(seed:doc_id) once more, as long as half of a document lies within r. The border is found from
       sums over the first three and the next three digits of the md5; only the documents that share all six digits
       with the border are sorted. A source of any size is thus cut exactly without meeting in one task.

    Nulls: a null text has size 0, a null source is a source of its own, sorted last, and so is a null array; a document
    of no source (an empty array) is never taken; a null id is ordered as ''. Ties
    of md5 go by id, then size. Repeated rows count each. Reruns give the same rows.
    """
    col = F.col(sources) if isinstance(sources, str) else sources
    of = F.coalesce(col, F.array(F.lit(None).cast("string"))) if isinstance(docs.select(col).schema[0].dataType, T.ArrayType) else F.array(col)
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    given = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("given")] if keep else []  # so that no name clashes
    base = docs.select(*given, F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(of)).alias("members"), (n_words(text_col) if size is None else F.coalesce(size.cast("long"), F.lit(0))).alias("size"), rank.alias("md5"))
    slim = cut(base.drop("given"))
    planned = cut(plan(slim.groupBy("members").agg(F.sum("size").alias("pattern_size")), weights, repeats, listed))
    few = planned.count() <= listed
    small = lambda df: F.broadcast(df) if few else df  # noqa: E731  at most a row or two a pattern
    p = planned.withColumn("whole", F.when(F.col("pattern_size") > 0, F.floor(F.col("take") / F.col("pattern_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("take") - F.col("whole") * F.col("pattern_size"))

    def border(rows: DataFrame, digits: Column) -> DataFrame:
        """Of the groups by ``digits`` the one where the running sum passes the rest, and the rest within it."""
        sums = rows.groupBy("members", "rest", digits.alias("digits")).agg(F.sum("size").alias("sum"))
        until = F.sum("sum").over(Window.partitionBy("members").orderBy("digits"))
        passed = sums.withColumn("until", until).where(F.col("until") > F.col("rest"))
        return passed.groupBy("members").agg(F.min_by(F.struct("digits", (F.col("rest") - F.col("until") + F.col("sum")).alias("rest")), "digits").alias("x")).select("members", "x.*")

    one, two = F.substring("md5", 1, 3), F.substring("md5", 4, 3)
    b1 = border(slim.join(small(p.select("members", "rest")), "members"), one).select("members", F.col("digits").alias("one"), "rest")
    inside = slim.withColumn("one", one).join(small(b1), ["members", "one"])
    b2 = border(inside, two).select("members", F.col("digits").alias("two"), F.col("rest").alias("rest2"))
    last = inside.drop("rest").withColumn("two", two).join(small(b2), ["members", "two"])
    order = Window.partitionBy("members").orderBy("md5", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = last.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    in_ = sorted_.where(2 * F.col("before") + F.col("size") <= 2 * F.col("rest2"))
    ends = in_.groupBy("members").agg(F.max(F.struct("md5", F.col("doc_id").alias("id"), "size")).alias("last"))
    cuts = p.join(b1.drop("rest"), "members", "left").join(b2.drop("rest2"), "members", "left").join(ends, "members", "left").select("members", "pattern_size", "target", "whole", "rest", "one", "two", "last")
    first6 = F.substring("md5", 1, 6)
    edge6 = F.concat("one", "two")
    more = (
        F.when(F.col("rest") <= 0, False)
        .when(F.col("one").isNull(), True)  # the rest is the whole pattern
        .when(first6 != edge6, first6 < edge6)
        .otherwise(F.coalesce(F.struct("md5", F.col("doc_id").alias("id"), "size") <= F.col("last"), F.lit(False)))
    )
    copies = F.col("whole") + more.cast("long")
    out = (base if keep else slim).join(small(cuts), "members")
    return out.select(*(["given.*"] if keep else []), "doc_id", "members", "size", "pattern_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
