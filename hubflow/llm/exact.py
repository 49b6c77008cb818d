"""Exact dedup by content-defined chunk recipes. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import cut, no_white, whole

#: Fewest and most code points of a chunk.
CHUNK = (512, 4096)
#: Most clashing identifiers that recipes are compared with in place; more of them are joined by a shuffle.
FEW_CLASHES = 10_000


def _chunk_pattern(least: int, most: int) -> str:
    """A chunk ends after two characters of an eighth of all code points, else after ``most``.

    That eighth holds every eighth code point of the Latin blocks (below U+0250), 4 of each 32 in the alphabets after
    them and 128 of each 1024 from U+3100 on, so texts of any script are cut at content. The rule looks only at the text
    near the cut, so an insertion moves the cuts near it and no others.
    """
    latin = "".join(f"\\x{{{c:x}}}" for c in range(0x20, 0x250) if c % 8 == 5)
    starts = [(c, 4) for c in range(0x254, 0x3100, 32)] + [(c, 128) for c in range(0x3100, 0x30000, 1024)]
    others = "".join(f"\\x{{{c:x}}}-\\x{{{c + n - 1:x}}}" for c, n in starts)
    # the second class is asked only of characters from U+0250 on
    return rf"(?s).{{{least},{most}}}?(?:(?<=[{latin}]{{2}})|(?<=[\x{{250}}-\x{{10ffff}}&&[{others}]]{{2}})|\z)|.{{1,{most}}}"


def normalised(text: str | Column = "text") -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return no_white(whole(text))


def chunks(norm: Column, least: int = CHUNK[0], most: int = CHUNK[1]) -> Column:
    """Ordered content-defined chunks whose concatenation is ``norm``; none for the empty text."""
    return F.regexp_extract_all(norm, F.lit(_chunk_pattern(least, most)), F.lit(0))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_size: tuple[int, int] = CHUNK, hash_fn: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Groups documents whose texts are the same but for white space.

    Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_points (of the original).

    1. Each text becomes a recipe: the ordered identifiers (``hash_fn``) of its chunks.
    2. Identifiers are verified: the distinct chunks of the whole corpus are compared by content. Where two contents
       share an identifier, recipes that use it are told apart by their texts too; no other text moves for that.
    3. Equal recipes are equal texts. Recipes, not texts, are grouped and joined, so a long document moves once at
       most, as chunks that are first reduced to distinct ones within each task.

    Nulls: a null text is an empty one, and all empty texts form a group. A null id never wins over another. Ties on
    length go to the smallest id. Of rows that repeat both id and text one may stay, and each counts in group_size.
    Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("norm", no_white(F.col("text")))
    cut_up = base.withColumn("chunks", chunks(F.col("norm"), *chunk_size))
    recipe = F.transform("chunks", lambda c: hash_fn(c)).alias("recipe")
    columns = ["doc_id", F.length("text").alias("n_points"), F.sha2("norm", 256).alias("text_sha256"), recipe]
    clashes = cut(
        cut_up.select(F.explode("chunks").alias("chunk")).select(hash_fn(F.col("chunk")).alias("h"), "chunk").distinct()
        .groupBy("h").count().where("count > 1").select("h")
    )
    if clashes.isEmpty():
        rows = cut(cut_up.select(*columns, F.lit("").alias("told_apart")))
    else:
        if clashes.count() <= FEW_CLASHES:
            doubt = F.arrays_overlap("recipe", F.array(*[F.lit(r["h"]) for r in clashes.collect()]))
            told = cut_up.select(*columns, F.col("norm")).withColumn("doubt", doubt)
        else:
            used = cut_up.select(recipe).distinct()
            doubtful = used.select("recipe", F.explode("recipe").alias("h")).join(clashes, "h", "left_semi").select("recipe").distinct().withColumn("doubt", F.lit(True))
            told = cut_up.select(*columns, "norm").join(doubtful, "recipe", "left")
        rows = cut(told.withColumn("told_apart", F.when(F.col("doubt"), F.col("norm")).otherwise("")).drop("doubt", "norm"))
    # rows that repeat an id and a text are one row with a number until the end
    each = rows.groupBy("recipe", "told_apart", "doc_id", "n_points", "text_sha256").agg(F.count("*").alias("times"))
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("rev")))
    # written first: Spark splits a hot key of a join only where both sides come straight from a shuffle or a scan
    groups = cut(each.groupBy("recipe", "told_apart").agg(F.sum("times").alias("group_size"), best.alias("best")))
    first = F.col("doc_id").eqNullSafe(F.bitwise_not("best.rev")) & (F.col("n_points") == F.col("best.n_points"))
    named = each.join(groups, ["recipe", "told_apart"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return named.select("doc_id", F.bitwise_not("best.rev").alias("keep_id"), "group_size", (first & (F.col("copy") == 1)).alias("kept"), "text_sha256", F.col("n_points").cast("long").alias("n_points"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts, repeated rows once."""
    # the caller's columns stay in a struct, so no name can clash; plain equality on the same columns in both steps, so
    # that texts are shuffled once
    key = ["id", "none", "sha", "points"]
    of = lambda i: [F.coalesce(i, F.lit(0)).alias("id"), i.isNull().alias("none")]
    text = whole(text_col)
    kept = exact_groups(docs, id_col=id_col, text_col=text_col).where("kept")
    kept = kept.select(*of(F.col("doc_id").cast("long")), F.col("text_sha256").alias("sha"), F.col("n_points").alias("points"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *of(F.col(id_col).cast("long")), F.sha2(no_white(text), 256).alias("sha"), F.length(text).cast("long").alias("points"))
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")
