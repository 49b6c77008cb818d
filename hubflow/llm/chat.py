"""Reply trees as chat-formatted conversations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hubflow.llm.common import cut

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Backslashes become two, and every ``<|`` becomes ``<\\|``: no escaped text holds a control string."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def keyed(rows: DataFrame) -> DataFrame:
    """Adds tree_key and tree_none, which name a tree as ``tree`` does but are never null: plain equality joins on them."""
    if "tree_key" in rows.columns:
        return rows
    return rows.withColumns({"tree_key": F.coalesce(F.col("tree").cast("string"), F.lit("")), "tree_none": F.col("tree").isNull()})


def chain(rows: DataFrame, order: str) -> DataFrame:
    """Rows by turn as trees: adds node (place in the conversation, from 0) and parent (the place before; null at first).

    The place of a row is the number of rows of its tree before it, by turn, then by role and text (nulls first).
    """
    before = Window.partitionBy("tree_key", "tree_none").orderBy(*[F.col(c).asc_nulls_first() for c in (order, "role", "text") if c in rows.columns])
    return keyed(rows).withColumn("node", F.row_number().over(before).cast("long") - 1).withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1))


def branches(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees as rows: tree, leaf, rank, up (distance from the leaf), node.

    ``nodes``: tree, node, parent (null or unknown: a root), score. Iterative self-joins: after round k every node knows
    its ancestor 2^k above, and every leaf its first 2^(k+1) path nodes, so a path of d nodes takes log2(d) rounds and
    only nodes of paths are ever made. A branch's score is its mean node score; ties go to the smaller leaf. ``best``
    keeps that many branches a tree, None all.
    """
    n = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    a, b = n.alias("a"), n.select("tree", F.col("node").alias("parent")).distinct().alias("b")
    linked = a.join(b, F.expr("a.tree <=> b.tree AND a.parent = b.parent"), "left").select("a.tree", "a.node", F.col("b.parent").alias("above"))
    linked = cut(linked)
    jump = linked.where("above IS NOT NULL")
    a, b = linked.alias("a"), jump.select("tree", "above").distinct().alias("b")
    leaves = a.join(b, F.expr("a.tree <=> b.tree AND a.node = b.above"), "left_anti").select("a.tree", F.col("a.node").alias("leaf"))
    paths = cut(leaves.select("tree", "leaf", F.lit(0).cast("long").alias("up"), F.col("leaf").alias("node")))
    step = 1
    while not jump.isEmpty():
        p, j = paths.alias("p"), jump.alias("j")
        longer = p.join(j, F.expr("p.tree <=> j.tree AND p.node = j.node")).select("p.tree", "p.leaf", (F.col("p.up") + step).alias("up"), F.col("j.above").alias("node"))
        paths = cut(paths.unionByName(longer), instead_of=paths)
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut(a.join(b, F.expr("a.tree <=> b.tree AND a.above = b.node")).select("a.tree", "a.node", "b.above"), instead_of=jump)
        step *= 2
    q, s = paths.alias("q"), n.alias("s")
    scored = q.join(s, F.expr("q.tree <=> s.tree AND q.node = s.node")).groupBy("q.tree", "q.leaf").agg(F.avg("s.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen = scored.withColumn("rank", rank)
    chosen = chosen if best is None else chosen.where(F.col("rank") <= best)
    q, c = paths.alias("q"), chosen.alias("c")
    return q.join(c, F.expr("q.tree <=> c.tree AND q.leaf = c.leaf")).select("q.tree", "q.leaf", "c.rank", "q.up", "q.node")


def format_branches(nodes: DataFrame, best: int | None = 1, skeleton: DataFrame | None = None) -> DataFrame:
    """Each chosen path as one conversation: tree, leaf, rank, formatted, loss (array of start, length in code points).

    ``nodes``: tree, node, parent, score, role, text; node is unique within its tree. ``skeleton``: the same without
    role and text, where these rows can be made for less. A turn is written as
    ``<|im_start|>role LF text<|im_end|> LF`` with role and text escaped reversibly; the loss mask holds the texts of
    assistant turns. Null roles and texts are empty ones; a null tree is a tree of its own; an empty table gives no rows.

    Paths are found without texts. Then the texts of each tree's chosen nodes meet once, by tree, and all that follows
    (picking the turns of each path, their places by a running sum, the text) stays where they met.
    """
    tree = ["tree_key", "tree_none"]
    slim = cut(keyed((nodes if skeleton is None else skeleton).select("tree", "node", "parent", "score")))
    paths = cut(keyed(branches(slim, best)))
    on_paths = cut(paths.select(*tree, "node").distinct())
    at = F.row_number().over(Window.partitionBy(*tree).orderBy("node")) - 1
    steps = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "i"))).alias("steps")
    chosen = paths.join(on_paths.withColumn("i", at), [*tree, "node"]).groupBy(*tree, "leaf", "rank").agg(steps)
    full = keyed(nodes)
    if on_paths.count() < slim.count():
        full = full.join(on_paths, [*tree, "node"], "left_semi")
    said = F.struct("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    texts = full.groupBy(*tree).agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list(said)).alias("said"))
    turns = texts.join(chosen, tree).select(*tree, "tree", "leaf", "rank", F.explode(F.transform("steps", lambda x: F.struct(x["at"].alias("at"), F.get("said", x["i"]).alias("t")))).alias("x"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("x.t.role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    turns = turns.select(*tree, "tree", "leaf", "rank", "x.at", head.alias("head"), escape(F.col("x.t.text")).alias("body"), (F.col("x.t.role") == "assistant").alias("loss"))
    before = Window.partitionBy(*tree, "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("head") + F.length("body") + F.lit(len(END) + 1)).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("span", F.when(F.col("loss"), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    turn = F.struct("at", F.concat("head", "body", F.lit(f"{END}\n")).alias("text"))
    whole = turns.groupBy(*tree, "leaf", "rank").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list(turn)).alias("turns"), F.array_sort(F.collect_list("span")).alias("loss"))
    return whole.select("tree", "leaf", "rank", F.array_join("turns.text", "").alias("formatted"), "loss")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    turns = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), F.lit(1))
    parts = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"  # the role ends at the first line feed without a backslash
    return F.transform(turns, lambda t: F.struct(*[unescape(F.regexp_extract(t, parts, k)).alias(name) for k, name in ((1, "role"), (2, "text"))]))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))))
