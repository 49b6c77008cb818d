"""Language identification by unigram models of pieces, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import cut, whole

#: A word: up to 64 letters and marks; a longer run counts as several words.
WORD = r"[\p{L}\p{M}]{1,64}"
#: Stands for the start of a word in the vocabulary's pieces.
START = "▁"
#: About how many documents of each language the models are fitted on, drawn by a hash of the id.
PER_LANGUAGE = 5_000
#: Most languages.
LANGUAGES = 1_000
#: Rounds of expectation and maximisation.
ROUNDS = 3
#: Added to each piece's expected count; the probability of a character that no piece has.
ADDED, UNKNOWN = 0.05, 1e-6
#: Every character's probability is scaled by this, so that products over a word stay in the range of doubles.
SCALE = 16.0
#: Word lengths, the start included, that are computed together; most cells of their piece tables.
LENGTHS, CELLS = (4, 6, 8, 10, 12, 14, 17, 21, 25, 33, 49, 65), 1 << 22
#: What a document without letters gets.
UNDETERMINED = "und"


class Pieces:
    """The pieces of a vocabulary file that consist of letters, found by 64-bit hashes of substrings."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        known = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        self.texts = sorted({p for p in known if p == START or p.removeprefix(START).isalpha()})
        self.longest = max(map(len, self.texts))
        #: Lengths, also of an unknown character and of no piece at all, which follow the pieces.
        self.lengths = np.array([*map(len, self.texts), 1, 0])
        self.unknown, self.none = len(self.texts), len(self.texts) + 1
        hashes = np.array([self._hash(p) for p in self.texts], np.uint64)
        # direct addresses; pieces whose address is taken go to a second table, and both are verified by the hash
        self.hashes, self.first, self.second = np.append(hashes, np.zeros(2, np.uint64)), np.full(1 << 20, self.none, np.int32), np.full(1 << 20, self.none, np.int32)
        self.first[hashes >> np.uint64(44)] = np.arange(len(hashes))
        left = np.flatnonzero(self.first[hashes >> np.uint64(44)] != np.arange(len(hashes)))
        at = hashes[left] & np.uint64((1 << 20) - 1)
        if len(np.unique(hashes)) < len(hashes) or len(np.unique(at)) < len(at):
            raise ValueError("two pieces share an address in both tables")
        self.second[at] = left

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h + ord(c)) * int(self.BASE) % (1 << 64)
        return h

    def tables(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of words, their lengths with the start, and the piece from each character on with each length, in parts."""
        size = np.array([len(w) + 1 for w in words])
        bucket = np.searchsorted(LENGTHS, size)
        for b in np.unique(bucket):
            wide, rows = LENGTHS[b], np.flatnonzero(bucket == b)
            most = min(self.longest, wide)
            for at in range(0, len(rows), max(1, CELLS // (wide * most))):
                part = rows[at : at + max(1, CELLS // (wide * most))]
                text = "".join((START + words[i]).ljust(wide, "\0") for i in part)
                codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).reshape(len(part), wide).astype(np.uint64)
                ids = np.full((len(part), wide, most), self.none, np.int32)
                h = np.zeros_like(codes)
                for k in range(most):
                    h = (h[:, : wide - k] + codes[:, k:]) * self.BASE
                    found = self.first[h >> np.uint64(44)]
                    wrong = self.hashes[found] != h
                    other = self.second[h[wrong] & np.uint64((1 << 20) - 1)]
                    found[wrong] = np.where(self.hashes[other] == h[wrong], other, self.none)
                    ids[:, : wide - k, k] = found
                ids[:, :, 0][ids[:, :, 0] == self.none] = self.unknown
                yield part, size[part], ids

    def scaled(self, probabilities: np.ndarray) -> np.ndarray:
        """Probabilities of all pieces (rows) by language, with those of an unknown character and of no piece."""
        p = np.vstack([probabilities, np.full((1, probabilities.shape[1]), UNKNOWN), np.zeros((1, probabilities.shape[1]))])
        return p * SCALE ** self.lengths[:, None]


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each word, place and language the scaled probability of the characters before it, over all segmentations."""
    n, wide, most = ids.shape
    alpha = np.zeros((wide + 1, n, p.shape[1]))
    alpha[0] = 1
    for i in range(1, wide + 1):
        for k in range(1, min(i, most) + 1):
            alpha[i] += alpha[i - k] * p[ids[:, i - k, k - 1]]
    return alpha


def backward(ids: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The same of the characters from a place to the word's end."""
    n, wide, most = ids.shape
    beta = np.zeros((wide + 1, n, p.shape[1]))
    for i in range(wide, -1, -1):
        beta[i, size == i] = 1
        for k in range(1, min(wide - i, most) + 1):
            beta[i] += beta[i + k] * p[ids[:, i, k - 1]]
    return beta


def word_scores(pieces: Pieces, words: list[str], scaled: np.ndarray) -> np.ndarray:
    """Natural logarithms of the words' probabilities by language."""
    out = np.zeros((len(words), scaled.shape[1]))
    for part, size, ids in pieces.tables(words):
        out[part] = np.log(forward(ids, scaled)[size, np.arange(len(part))]) - size[:, None] * np.log(SCALE)
    return out


def expected_counts(pieces: Pieces, words: list[str], times: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur so many times, over all their segmentations (one language)."""
    out = np.zeros(len(pieces.lengths))
    for part, size, ids in pieces.tables(words):
        alpha, beta = forward(ids, scaled)[:, :, 0], backward(ids, size, scaled)[:, :, 0]
        each = times[part] / alpha[size, np.arange(len(part))]
        for i in range(ids.shape[1]):
            for k in range(1, min(ids.shape[1] - i, ids.shape[2]) + 1):
                np.add.at(out, ids[:, i, k - 1], alpha[i] * scaled[ids[:, i, k - 1], 0] * beta[i + k] * each)
    return out[: len(pieces.texts)]


@dataclass
class Model:
    languages: list[str]
    #: Probabilities of the pieces (rows) by language, and of the languages.
    probabilities: np.ndarray
    prior: np.ndarray
    model_file: str


def words_of(text: str | Column = "text") -> Column:
    """The words of a whole text, in lower case."""
    return F.regexp_extract_all(F.lower(whole(text)), F.lit(WORD), F.lit(0))


def held_out(id_col: str = "doc_id") -> Column:
    """True for a quarter of the ids; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, model_file: str, *, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns piece probabilities for each language from documents that aren't held out and have an id and a language.

    About ``per_language`` documents of each language are read, those with the smallest hashes of their ids. Their words
    are counted by Spark; each round computes the expected pieces of all words over all segmentations where the words
    lie, and only sums by piece and language meet. Without any document the model knows no language.
    """
    pieces = Pieces(model_file)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((len(pieces.texts), 0)), np.zeros(0), model_file)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, per_language / counts[lang])])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40))
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    words = cut(drawn.select(number[F.col("lang")].alias("language"), F.explode(words_of("text")).alias("word")).groupBy("language", "word").agg(F.count("*").alias("times")))
    p = np.full((len(pieces.texts), len(languages)), 1 / len(pieces.texts))
    for _ in range(rounds):
        scaled = pieces.scaled(p)

        def expect(batches: Iterator[pd.DataFrame], scaled: np.ndarray = scaled) -> Iterator[pd.DataFrame]:
            mine, sums = Pieces(model_file), {}
            for batch in batches:
                for k, some in batch.groupby("language"):
                    sums[k] = sums.get(k, 0) + expected_counts(mine, some["word"].tolist(), some["times"].to_numpy(), scaled[:, [k]])
            for k, x in sums.items():
                piece = np.flatnonzero(x)
                yield pd.DataFrame({"language": k, "piece": piece, "times": x[piece]})

        sums = words.mapInPandas(expect, "language int, piece int, times double").groupBy("language", "piece").agg(F.sum("times").alias("times")).toPandas()
        p = np.full(p.shape, ADDED)
        p[sums["piece"], sums["language"]] += sums["times"]
        p /= p.sum(axis=0)
    prior = np.array([counts[x] for x in languages], float)
    return Model(languages, p, prior / prior.sum(), model_file)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score (the language's posterior probability).

    A text's probability under a language is the product of its words' probabilities, and a word's the sum over all its
    segmentations into pieces. Each distinct word of a batch is computed once. Texts without letters, null and empty
    ones are ``und`` with score 0, and so is every text if the model knows no language. Ties go to the language that
    sorts first. A null id stays null and isn't held out; repeated rows stay; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), whole(text_col).rlike(r"\p{L}").alias("letters"), words_of(text_col).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.model_file)
        scaled, prior = pieces.scaled(model.probabilities), np.log(model.prior)
        for batch in batches:
            lists = batch.column("words")
            coded = lists.flatten().dictionary_encode()
            scores = word_scores(pieces, coded.dictionary.to_pylist(), scaled)
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            document, codes = np.repeat(np.arange(len(length)), length), coded.indices.to_numpy(zero_copy_only=False)
            total = np.column_stack([np.bincount(document, weights=scores[codes, k], minlength=len(length)) + prior[k] for k in range(len(prior))]) if len(prior) else np.zeros((len(length), 0))
            known = batch.column("letters").to_numpy(zero_copy_only=False) & (len(prior) > 0)
            best, score = np.zeros(len(length), int), np.zeros(len(length))
            if len(prior):
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
