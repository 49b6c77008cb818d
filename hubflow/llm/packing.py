"""Sum-of-squares online packing of tokenised documents."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import whole

WINDOW = 2048
#: Most partially filled windows that a task keeps, and so the most ids that it holds: OPEN x WINDOW.
OPEN = 4096
#: Follows each document's ids.
END = 1
#: Splits a text before the merges of byte-level BPE; a fixed value of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"


def fast_encoding(tokenizer_file: str):
    """A byte-level BPE file of the tokenizers library as a tiktoken encoding, which gives the same ids at a quarter of the time.

    Both apply merges by rank after the same split; a test compares the ids on every code point.
    """
    import tiktoken

    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from code point 256
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    if any(ranks[bytes(byte[c] for c in "".join(pair if isinstance(pair, list) else pair.split(" ")))] != 256 + i for i, pair in enumerate(spec["model"]["merges"])):
        raise ValueError("ids don't follow the order of merges")
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class IdReader:
    """Ids of whole texts, special strings inside them handled as the library's default does."""

    def __init__(self, tokenizer_file: str):
        self.file, self.fast, self.library = tokenizer_file, fast_encoding(tokenizer_file), None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), "<u4")
        except Exception:  # a run of characters that is too long for the splitter
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.file)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


class Packer:
    """Packs documents in the order of their arrival.

    ``counts[h]`` is the number of windows filled to level h. A document (what is over after its full windows) goes to
    the level, or to a new window, after which the sum of the squares of ``counts`` is least; ties go to the fullest.
    """

    def __init__(self, window: int = WINDOW, most_open: int = OPEN, first_id: int = 0):
        self.window, self.most_open, self.next_id = window, most_open, first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]  # windows by level; a window is a list of pieces
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self._close([(doc_id, at, ids[at : at + self.window], n)])
            at += self.window
        if at < n:
            self._place((doc_id, at, ids[at:], n))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        c, last = self.counts, self.window - size
        cost = np.full(last + 1, np.iinfo(np.int64).max)
        # moving one window from level h to h + size changes the sum of squares by 2 (counts[h + size] - counts[h]) + 2
        # at h = 0 a window is new, at h = last it is full; neither level is counted
        used = np.flatnonzero(c[1 : last + 1]) + 1
        cost[used] = 2 * (c[used + size] - c[used]) + 2
        if last and c[last]:
            cost[last] = 1 - 2 * c[last]
        cost[0] = 2 * c[size] + 1
        h = last - int(np.argmin(cost[::-1]))
        window = self.levels[h].pop() if h else []
        c[h] -= h > 0
        window.append(piece)
        if h + size == self.window:
            self._close(window)
            return
        self.levels[h + size].append(window)
        c[h + size] += 1
        if self.counts.sum() > self.most_open:
            self._settle()

    def _close(self, window: list[tuple]) -> None:
        total, at = sum(len(ids) for _, _, ids, _ in window), 0
        for doc_id, start, ids, n in window:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next_id, at, total if total & (total - 1) == 0 else self.window))
            at += len(ids)
        self.next_id += 1

    def _settle(self) -> list[tuple]:
        """Fills the fullest windows with what the emptiest hold, cutting documents; returns what is left, less than a window."""
        windows = [w for level in reversed(self.levels) for w in level]
        self.levels = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        rest: list[tuple] = []
        while windows or sum(len(p[2]) for p in rest) >= self.window:
            target = windows.pop(0) if windows else []
            room = self.window - sum(len(p[2]) for p in target)
            while room and (rest or windows):
                rest = rest or windows.pop()
                doc_id, start, ids, n = rest.pop()
                target.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    rest.append((doc_id, start + room, ids[room:], n))
                room -= len(target[-1][2])
            if room:
                rest = target
                break
            self._close(target)
        if rest and self.most_open:
            level = sum(len(p[2]) for p in rest)
            self.levels[level].append(rest)
            self.counts[level] += 1
        return rest

    def finish(self) -> None:
        """Cuts what is left into sequences whose lengths are powers of two, which need no padding."""
        pieces = self._settle()
        self.levels, left = [[] for _ in range(self.window + 1)], sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while left:
            room, part = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, ids, n = pieces.pop()
                part.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    pieces.append((doc_id, start + room, ids[room:], n))
                room -= len(part[-1][2])
            self._close(part)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) or [()] * 8
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer_file: str, *, window: int = WINDOW, end: int = END, most_open: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``window`` ids; one row per piece (see ``PIECES``).

    Documents are packed where they are read: each task tokenises its part of the input and packs it at once with its
    own level array, so neither texts nor ids are shuffled, and a task that is repeated makes the same sequences
    (sequence_id holds the task's number). A task keeps at most ``most_open`` partial windows; at that bound and at its
    end the emptiest ones are cut up to fill the others, and the rest of less than a window becomes sequences of
    power-of-two lengths. So no sequence has padding (padded_to is its length).

    Nulls: a null text is empty and has the end id alone; a null doc_id stays null. Repeated rows are packed each for
    itself. An empty input gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, packer, stop = IdReader(tokenizer_file), Packer(window, most_open, TaskContext.get().partitionId() << 40), np.array([end], "<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc_id, np.concatenate([read(text.as_py()), stop]))
                if len(packer.done) >= 10_000:
                    yield packer.take()
            yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, PIECES)
