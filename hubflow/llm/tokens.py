"""Token counts from the pieces of distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import whole

#: U+2581, which stands for a space inside pieces; a text's own ones count as spaces.
MARK = "▁"
#: A pre-token: one line feed, or a run of spaces with what follows up to the next space or line feed. No piece of the
#: vocabulary has a space after another character, or a line feed, so no piece crosses these borders.
PRE_TOKEN = rf"\n|[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+"
#: Most pre-tokens whose counts a task remembers from batch to batch.
REMEMBER = 2_000_000


def pre_tokens(text: str | Column = "text") -> Column:
    """The pre-tokens of a whole text with the leading space that the library adds; none for the empty text."""
    t = whole(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.concat(F.lit(" "), t), F.lit(PRE_TOKEN), F.lit(0)))


def check_vocabulary(model_file: str) -> None:
    """Fails for a model whose pieces can cross the borders of pre-tokens."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if "\n" in piece or MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {i} ({piece!r}) crosses pre-tokens")


def token_counts(docs: DataFrame, model_file: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", remember: int = REMEMBER) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Texts are cut into pre-tokens by Spark. Each Arrow batch of them becomes a dictionary of distinct pre-tokens and
    the codes of every document's pre-tokens. Pieces are counted once per distinct pre-token that the task has not met
    before, joined to the documents' pre-token frequencies by code, and summed: no ids are made, nothing is shuffled,
    and the work of a task follows its input alone. A global dictionary was ruled out: it grows with the corpus, so it
    can't be broadcast, and a shuffle of all (document, pre-token) rows outweighs the texts (see the README).

    Nulls: a null text is empty and has 0 tokens; a null id stays null. Repeated rows are counted each for itself.
    """
    check_vocabulary(model_file)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(whole(text_col)).cast("long").alias("n_bytes"), pre_tokens(text_col).alias("pre"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        known: dict[str, int] = {}
        for batch in batches:
            lists = batch.column("pre")
            distinct = lists.flatten().dictionary_encode()
            words = distinct.dictionary.to_pylist()
            new = [w for w in words if w not in known]
            if len(known) + len(new) > remember:
                known, new = {}, words
            # a line feed in front keeps the library from adding a space to the pre-token itself; it and the space before it are two pieces
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                known.update(zip(part, (len(x) - 2 for x in sp.encode(["\n" + w for w in part], num_threads=1)), strict=True))
            pieces = np.fromiter((known[w] for w in words), np.int64, len(words))
            codes = distinct.indices.to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            document = np.repeat(np.arange(len(lengths)), lengths)
            n = np.bincount(document, weights=pieces[codes], minlength=len(lengths)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
