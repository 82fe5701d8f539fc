"""Bounded-space online packing of tokenised documents into windows of fixed length.

Each partition keeps a fixed number of open windows.  A piece goes to the open
window that it fills best; if it fits none, the fullest window is emitted; at
the end the leftovers are merged.  Nothing is shuffled, and a task holds its
open windows and one Arrow batch only.
"""

from __future__ import annotations

import re
import sys
import types
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches

CAPACITY = 4096
WINDOWS = 64
#: A window is emitted with so many free places at most; a larger gap takes the head of the piece that did not fit.
MAX_GAP = 64
END_ID = 2
#: Words whose ids a worker remembers; the memory is emptied when full.
CACHE_WORDS = 400_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: str.split() also splits at these four controls, the tokenizer does not.
CONTROLS = re.compile("[\x1c-\x1f]")
OTHER_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


class _Numbers(dict):
    """Numbers words as they come and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class WordTokenizer:
    """Ids of texts, word by word with a memory of words.

    Exact for tokenizers that drop white space and case and never join pieces
    over white space or over the line between letters and punctuation: a word of
    plain letters and one last mark is its letters' ids and that mark's id.
    """

    SEPARATOR = "<|endoftext|>"
    MARKS = ",.;:!?"

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.separator = self.own.token_to_id(self.SEPARATOR)
        self.cache_words = cache_words
        self.marks = {m: self.own.encode(m, add_special_tokens=False).ids[0] for m in self.MARKS}
        self.clear()

    def clear(self) -> None:
        self.words, self.stems = _Numbers(), _Numbers()
        self.stem = np.zeros(0, dtype=np.int64)  # of each word, and the id of its mark or -1
        self.mark = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(1, dtype=np.int64)  # stem k has the ids arena[starts[k]:starts[k + 1]]
        self.arena = np.zeros(0, dtype=np.uint32)

    def _learn(self) -> None:
        stem, mark = [], []
        for w in self.words.new:
            m = -1
            if w.isascii():
                w = w.lower()
                if w[-1] in self.marks and w[:-1].isalpha():
                    w, m = w[:-1], self.marks[w[-1]]
            stem.append(self.stems[w])
            mark.append(m)
        self.stem = np.concatenate((self.stem, np.array(stem, dtype=np.int64)))
        self.mark = np.concatenate((self.mark, np.array(mark, dtype=np.int64)))
        new, sizes, ids = self.stems.new, [], []
        self.words.new, self.stems.new = [], []
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            joined = self.SEPARATOR.join("" if "<|" in w else w for w in part)
            got = np.array(self.own.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cut = np.flatnonzero(got == self.separator)
            n = np.diff(np.concatenate(([-1], cut, [len(got)]))) - 1
            got = got[got != self.separator]
            for k in [k for k, w in enumerate(part) if "<|" in w]:  # may be a special token's own string
                odd = np.array(self.own.encode(part[k], add_special_tokens=False).ids, dtype=np.uint32)
                got = np.insert(got, int(n[:k].sum()), odd)
                n[k] = len(odd)
            sizes.append(n)
            ids.append(got)
        if new:
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
            self.arena = np.concatenate([self.arena, *ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them)."""
        if len(self.words) > self.cache_words:
            self.clear()
        words = [OTHER_SPACE.split(t) if CONTROLS.search(t) else t.split() for t in texts]
        words = [[w for w in ws if w] if "" in ws else ws for ws in words]
        sizes = list(map(len, words))
        index = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=sum(sizes))
        if self.words.new:
            self._learn()
        stem, mark = self.stem[index], self.mark[index]
        first, n = self.starts[stem], self.starts[stem + 1] - self.starts[stem]
        whole = n + (mark >= 0)
        ends = np.cumsum(whole)
        total = int(ends[-1]) if len(ends) else 0
        # where a mark stands, the place after the stem's ids is read first and then set
        at = np.repeat(first - (ends - whole), whole) + np.arange(total)
        ids = self.arena[np.minimum(at, max(len(self.arena) - 1, 0))] if total else self.arena[:0]
        ids[ends[mark >= 0] - 1] = mark[mark >= 0]
        per_text = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        return ids, np.concatenate(([0], ends))[per_text]


class Packer:
    """Open windows of one partition.  Pieces are tuples (doc index, start, ids); emit(sequence) gets their lists."""

    def __init__(self, emit: Callable[[list[tuple]], None], capacity: int = CAPACITY, windows: int = WINDOWS, max_gap: int = MAX_GAP) -> None:
        self.emit, self.capacity, self.windows, self.max_gap = emit, capacity, windows, max_gap
        self.order: list[tuple[int, int]] = []  # (free places, window), least first
        self.open: dict[int, list[tuple]] = {}
        self.made = 0

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.emit([(doc, at, ids[at : at + self.capacity])])
            at += self.capacity
        if at < n:
            self._place(doc, at, ids[at:])

    def _place(self, doc, start: int, ids: np.ndarray) -> None:
        while len(ids):
            k = bisect_left(self.order, (len(ids), -1))
            if k < len(self.order):  # the window with the least room that still holds the piece
                free, w = self.order.pop(k)
                self._put(w, free, (doc, start, ids))
                return
            if len(self.open) < self.windows:
                self.made += 1
                self.open[self.made] = []
                self._put(self.made, self.capacity, (doc, start, ids))
                return
            free, w = self.order.pop(0)
            if free > self.max_gap:
                self.open[w].append((doc, start, ids[:free]))
                start, ids = start + free, ids[free:]
            self.emit(self.open.pop(w))

    def _put(self, w: int, free: int, piece: tuple) -> None:
        self.open[w].append(piece)
        free -= len(piece[2])
        if free:
            insort(self.order, (free, w))
        else:
            self.emit(self.open.pop(w))

    def finish(self) -> None:
        """The leftovers, fullest first, are poured into full windows; the rest into windows whose lengths are powers of two."""
        pieces = [p for _, w in self.order for p in self.open[w]]
        left = sum(len(p[2]) for p in pieces)
        self.order, self.open = [], {}
        pieces.reverse()
        while left:
            want = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= want
            sequence = []
            while want:
                doc, start, ids = pieces.pop()
                sequence.append((doc, start, ids[:want]))
                if len(ids) > want:
                    pieces.append((doc, start + want, ids[want:]))
                want -= len(sequence[-1][2])
            self.emit(sequence)


SCHEMA = "id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack_batches(path: str, capacity: int, windows: int, max_gap: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # the worker process serves many tasks: what it knows of words stays
        state = sys.modules.setdefault("jsonmill_worker_state", types.ModuleType("jsonmill_worker_state")).__dict__
        if ("tokenizer", path) not in state:
            state["tokenizer", path] = WordTokenizer(path)
        tok = state["tokenizer", path]
        partition, made, rows, kind = TaskContext.get().partitionId(), 0, [], pa.int64()

        def emit(sequence: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for (doc, total), start, ids in sequence:
                rows.append((doc, start, len(ids), total, (partition << 40) + made, offset, ids.tobytes()))
                offset += len(ids)
            made += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [kind, *[pa.int64()] * 5, pa.binary()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        packer = Packer(emit, capacity, windows, max_gap)
        end = np.array([end_id], dtype=np.uint32)
        for b in batches:
            kind = b.schema.field(0).type
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids, offsets = tok.encode([t or "" for t in part.column(1).to_pylist()])
                for doc, a, z in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.concatenate((ids[a:z], end)).astype("<u4")
                    packer.add((doc, len(own)), own)
                if rows:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    windows: int = WINDOWS,
    max_gap: int = MAX_GAP,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit).

    A document's ids end with end_id.  Null text counts as empty, so it is one
    end id; null and repeated ids are documents of their own; a document longer
    than a window is cut into whole windows and a rest; other input columns are
    ignored; an empty table gives no piece.  tokenizer is a path that every
    executor can read.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(releasing(_pack_batches(tokenizer or tokenizer_path(), capacity, windows, max_gap, end_id)), SCHEMA.format(kind=kind))
    return out.withColumnRenamed("id", id_col)
