"""Language-model scores by logistic context mixing over bits.

Words of a dictionary are coded along a Huffman tree, all others letter by
letter along another, so a text is a series of bits.  Counts in tables of
hashed contexts (the words and letters before, with the place in the tree) give
each bit several predictions.  A mixer adds them up with weights that a gate
selects; the weights are fitted on training rows that the tables had not
counted.  While a text is read its own weights move on from there, and a table
of what the predictions missed so far corrects the next ones.  A word outside
the dictionary costs its spelling and its count among all training words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing, small_batches

#: Words of the dictionary at most (a fixed bound of what is broadcast), and how often each must have been met.
WORDS, LEAST = 1 << 18, 4
#: The counted word of a text's end; no word holds white space.
END = b"\n"
SMOOTH = 0.1

#: Slots of the tables of word and letter contexts at most, as powers of two; fewer tokens get fewer slots.
WORD_SLOTS, LETTER_SLOTS = (22, 22), (20, 20, 20)
#: The word before is a context if it is one of so many most frequent ones; else the last of the FREQUENT ones is.
OWN, FREQUENT = 512, 64
LETTERS = 257
#: How many letters before make a context.
ORDERS = (2, 3, 5)
#: What is added to both counts of a slot.
PRIOR = 0.4
#: Predictions are kept in these units, in a byte with two bits for how often the slot was met.
UNIT = 0.25
CHUNK = 1 << 16

#: One in so many training rows is kept from the tables until the weights are fitted on it.
FIT_SHARE, FIT_ROUNDS = 64, 3
#: A text's own weights move after so many bits, later after each quarter of what was read.
BLOCK = 64
RATE, DECAY, FARTHEST = 0.004, 1000.0, 2.0
#: Bits a text must have had in a bucket of predictions until half of what they missed corrects the next.
BUCKETS, BUCKET_PRIOR = 12, 200.0
#: Texts that are read in step.
TEXTS = 64


# --- codes ------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A Huffman tree; the bits and nodes of symbol s are [start[s], start[s + 1]), the root is node 0."""

    start: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    ones: np.ndarray  # the logistic of the probability of a one at each node by the counts


def huffman(counts: np.ndarray) -> Tree:
    """The tree of two symbols or more."""
    n = len(counts)
    heap = [(int(c), k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, dtype=np.int32), np.zeros(2 * n - 1, dtype=np.uint8)
    ones = np.zeros(n - 1, dtype=np.float32)
    for k in range(n, 2 * n - 1):
        a, x = heapq.heappop(heap)
        b, y = heapq.heappop(heap)
        parent[x] = parent[y] = k
        side[y] = 1
        ones[2 * n - 2 - k] = np.log((b + 0.05) / (a + 0.05))
        heapq.heappush(heap, (a + b, k))
    at, row, steps = np.arange(n), np.arange(n), []
    while len(at):
        up = parent[at]
        steps.append((row, 2 * n - 2 - up, side[at]))
        row, at = row[up < 2 * n - 2], up[up < 2 * n - 2]
    rows, nodes, bits = (np.concatenate([s[k] for s in reversed(steps)]) for k in range(3))
    order = np.argsort(rows, kind="stable")  # from the root down
    return Tree(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))), nodes[order].astype(np.int32), bits[order], ones)


def expand(tree: Tree, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which symbol of the row, node, bit, depth) of every bit."""
    n = tree.start[symbols + 1] - tree.start[symbols]
    which = np.repeat(np.arange(len(symbols), dtype=np.int32), n)
    depth = np.arange(len(which), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
    at = tree.start[symbols][which] + depth
    return which, tree.nodes[at], tree.bits[at], depth


def mixed_up(*parts: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each row."""
    h = np.zeros(len(parts[0]), dtype=np.uint32)
    for p in parts:
        h = (h + p.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


def slot(context: np.ndarray, node: np.ndarray, size: int) -> np.ndarray:
    """Where a context's counts of a node, hashed, are."""
    h = (context ^ node) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))) & np.uint32(size - 1)


@dataclass
class Words:
    """What coding needs: the dictionary, the trees of words and letters, and the slots of their tables."""

    index: bytes  # the dictionary in order, as an Arrow stream
    words: Tree
    letters: Tree
    word_slots: tuple[int, ...]
    letter_slots: tuple[int, ...]

    def plain(self) -> tuple:
        """As nothing but arrays and bytes, which a worker can read without this package on its path."""
        return self.index, *(tuple(vars(t).values()) for t in (self.words, self.letters)), self.word_slots, self.letter_slots

    @classmethod
    def of(cls, plain: tuple) -> Words:
        return cls(plain[0], Tree(*plain[1]), Tree(*plain[2]), *plain[3:])

    def known(self) -> pa.Array:
        with pa.ipc.open_stream(self.index) as r:
            return r.read_all().column(0).combine_chunks()

    @property
    def end(self) -> int:
        return len(self.words.start) - 3

    @property
    def escape(self) -> int:
        return len(self.words.start) - 2

    def kind(self, of_words: bool) -> tuple[Tree, tuple[int, ...]]:
        """The tree and the slots of its tables."""
        return (self.words, self.word_slots) if of_words else (self.letters, self.letter_slots)


def slots_for(n: int, most: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(1 << min(k, max(10, int(n).bit_length() + 3)) for k in most)


def words_of(known: list[bytes], counts: np.ndarray, letters: np.ndarray) -> Words:
    """counts: of the known words, of ends, of all other words; letters: of the bytes and of words' ends in the vocabulary."""
    table, out = pa.table({"w": pa.array(known, pa.large_binary())}), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return Words(out.getvalue().to_pybytes(), huffman(counts), huffman(letters), slots_for(counts.sum(), WORD_SLOTS), slots_for(letters.sum(), LETTER_SLOTS))


@dataclass
class Symbols:
    """A stream of symbols: the text, or word, each is of, and hashes of its contexts."""

    text: np.ndarray
    symbol: np.ndarray
    contexts: list[np.ndarray]


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all of them; only A-Z are lowered, a null text has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    before = np.concatenate(([0], np.cumsum(real)))
    return np.diff(before[offsets - offsets[0]]), words.filter(pa.array(real)).cast(pa.large_binary())


def streams(own: Words, known: pa.Array, sizes: np.ndarray, words: pa.Array) -> tuple[Symbols, pa.Array]:
    """The words of texts (of so many words each) with their ends, and those outside the dictionary; known: the dictionary in order."""
    found = pc.index_in(words, value_set=known)
    rest = words.filter(found.is_null())
    sizes = sizes + 1
    n, text_ends = int(sizes.sum()), np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    is_end = np.zeros(n, dtype=bool)
    is_end[text_ends - 1] = True
    symbols = np.full(n, own.end, dtype=np.int64)
    symbols[~is_end] = found.fill_null(own.escape).to_numpy(zero_copy_only=False)
    place, start = np.arange(n), np.repeat(text_ends - sizes, sizes)
    before = np.where(place > start, np.concatenate(([own.end], symbols))[:n], own.end)
    earlier = np.where(place > start + 1, np.concatenate(([own.end] * 2, symbols))[:n], own.end)
    # the last of the most frequent words before each place, within the text
    seen = np.maximum.accumulate(np.where(before < FREQUENT, place, -1)) if n else place
    recent = np.where(seen >= start, before[np.maximum(seen, 0)], FREQUENT) if n else place
    near = np.where(before < OWN, before, OWN + recent)
    return Symbols(text, symbols, [mixed_up(near), mixed_up(before, earlier)]), rest


def text_parts(s: Symbols, texts: int) -> Iterator[tuple[int, int, Symbols]]:
    """s in parts of TEXTS texts: the first, the one behind the last, and their symbols."""
    for a in range(0, texts, TEXTS):
        z = min(a + TEXTS, texts)
        i, j = np.searchsorted(s.text, [a, z])
        yield a, z, Symbols(s.text[i:j] - np.int32(a), s.symbol[i:j], [c[i:j] for c in s.contexts])


def _bytes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, dtype=np.uint8)


def spelled(words: pa.Array) -> Symbols:
    """The letters and ends of words (large binary)."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False) + 1
    ends = np.cumsum(sizes)
    letters = np.full(int(sizes.sum()), LETTERS - 1, dtype=np.int64)
    inside = np.ones(len(letters), dtype=bool)
    inside[ends - 1] = False
    letters[inside] = _bytes(words)
    at = np.arange(len(letters)) - np.repeat(ends - sizes, sizes)
    ahead = np.concatenate((np.full(ORDERS[-1], LETTERS), letters))
    past = [np.where(at >= k, ahead[ORDERS[-1] - k : len(ahead) - k], LETTERS) for k in range(1, ORDERS[-1] + 1)]
    return Symbols(np.repeat(np.arange(len(words), dtype=np.int32), sizes), letters, [mixed_up(*past[:k]) for k in ORDERS])


# --- tables -----------------------------------------------------------------------------------


#: Distinct words that a counting task holds.
HELD = 500_000


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[pa.Table] = []
    held, merged = 0, 0

    def merge() -> pa.Table:
        return pa.concat_tables(parts).group_by("w").aggregate([("n", "sum")]).select(["w", "n_sum"]).rename_columns(["w", "n"])

    for b in batches:
        found = pc.value_counts(tokens_of(b.column(0))[1])
        parts.append(pa.table({"w": pa.concat_arrays([found.field(0).cast(pa.binary()), pa.array([END], pa.binary())]), "n": pa.concat_arrays([found.field(1), pa.array([b.num_rows], pa.int64())])}))
        held += len(found)
        if held > max(HELD, 2 * merged):
            parts = [merge()]
            held = merged = parts[0].num_rows
            if merged > HELD:
                yield from parts[0].combine_chunks().to_batches()
                parts, held, merged = [], 0, 0
    if parts:
        yield from merge().filter(pc.field("n") > 0).combine_chunks().to_batches()


def _vocabulary(b: pa.RecordBatch) -> pa.Array:
    return b.column(0).filter(pc.not_equal(b.column(0), END)).cast(pa.large_binary())


def _letter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte is in the vocabulary, and the words' ends."""
    total = np.zeros(LETTERS, dtype=np.int64)
    for b in batches:
        words = _vocabulary(b)
        total[:256] += np.bincount(_bytes(words), minlength=256)
        total[256] += len(words)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LETTERS)), pa.array(total)], names=["k", "n"])


def _stream_batches(own: Words, batches: Iterator[pa.RecordBatch], of_words: bool) -> Iterator[Symbols]:
    """The words of texts, or the letters of the vocabulary, each word once, in parts."""
    known = own.known()
    for b in batches:
        if of_words:
            sizes, words = tokens_of(b.column(0))
            for _, _, s in text_parts(streams(own, known, sizes, words)[0], b.num_rows):
                yield s
        else:
            words = _vocabulary(b)
            for a in range(0, len(words), 20_000):
                yield spelled(words.slice(a, 20_000))


def add_counts(own: Words, s: Symbols, of_words: bool, counts: np.ndarray) -> None:
    """Counts the bits of s in the tables, one behind the other: two counts for each slot."""
    tree, sizes = own.kind(of_words)
    which, node, bit, _ = expand(tree, s.symbol)
    hashed, at = node.astype(np.uint32) * np.uint32(0x85EBCA6B), 0
    for c, size in zip(s.contexts, sizes, strict=True):
        np.add.at(counts[at : at + 2 * size], (slot(c.take(which), hashed, size) * np.uint32(2) + bit).astype(np.intp), np.int32(1))
        at += 2 * size


KINDS = "of_words boolean, k long, salt int, width int, size int, counts binary"


def _packed(of_words: bool, k: int, salt: int, part: np.ndarray) -> pa.RecordBatch:
    """A chunk of counts, compressed, in the narrowest type that holds it."""
    top = int(part.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 8
    row = [of_words, k, salt, width, len(part), pa.compress(part.astype(f"<u{width}").tobytes(), "zstd", asbytes=True)]
    kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["of_words", "k", "salt", "width", "size", "counts"])


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[tuple[bool, int, int], np.ndarray]]:
    """(of_words, k, salt) and the counts of each row."""
    for w, k, salt, width, size, x in zip(*(b.column(j).to_pylist() for j in range(6)), strict=True):
        yield (w, k, salt), np.frombuffer(pa.decompress(x, width * size, "zstd", asbytes=True), dtype=f"<u{width}")


def _table_batches(shared, of_words: bool, salts: int):
    """Counts of the words in texts, or of the letters in the words of the vocabulary, each word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Words.of(shared.value)
        counts = np.zeros(2 * sum(own.kind(of_words)[1]), dtype=np.int32)
        for s in _stream_batches(own, batches, of_words):
            add_counts(own, s, of_words, counts)
        salt = TaskContext.get().partitionId() % salts
        for k in range(0, len(counts), CHUNK):
            if counts[k : k + CHUNK].any():
                yield _packed(of_words, k, salt, counts[k : k + CHUNK])

    return run


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by table, k and salt; one sum is held at a time."""
    now, total = None, None
    for b in batches:
        for key, one in _unpacked(b):
            if now is not None and now != key:
                yield _packed(*now, total)
                total = None
            total, now = one.astype(np.int64) if total is None else total + one, key
    if now is not None:
        yield _packed(*now, total)


@dataclass
class Tables:
    """words[k][slot] and letters[k][slot]: a prediction in UNITs, shifted by two bits for how often the slot was met."""

    words: list[np.ndarray]
    letters: list[np.ndarray]


def values(counts: np.ndarray) -> np.ndarray:
    """A table's predictions from its counts of zeros and ones in turn."""
    n0, n1 = counts[0::2].astype(np.float32), counts[1::2].astype(np.float32)
    n, value = n0 + n1, np.round(np.log((n1 + PRIOR) / (n0 + PRIOR)) / UNIT)
    return (np.clip(value, -31, 31).astype(np.int8) << 2) | ((n > 0).astype(np.int8) + (n > 2) + (n > 8))


def _value_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [values(x).tobytes() for _, x in _unpacked(b)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["of_words", "k", "part"])


# --- mixing -----------------------------------------------------------------------------------


def gates(of_words: bool) -> int:
    return 48 if of_words else 16


def inputs(own: Words, tables: Tables, s: Symbols, of_words: bool, which, node, depth) -> tuple[list[np.ndarray], np.ndarray]:
    """The predictions of every bit, the last one constant, and its gate: by how often its longer contexts were met, and the depth of a word's bit."""
    tree, sizes = own.kind(of_words)
    hashed = node.astype(np.uint32) * np.uint32(0x85EBCA6B)
    found = [t.take(slot(c.take(which), hashed, size).astype(np.intp)) for t, c, size in zip(tables.words if of_words else tables.letters, s.contexts, sizes, strict=True)]
    x = [tree.ones.take(node)] if of_words else []
    x += [(v >> 2).astype(np.float32) * np.float32(UNIT) for v in found]
    x.append(np.full(len(node), 0.3, dtype=np.float32))
    gate = (found[-1] & 3) * 4 + (found[-2] & 3)
    if of_words:
        gate = gate * 3 + np.minimum(depth >> 2, 2).astype(np.int8)
    return x, gate.astype(np.intp)


def block_edges(longest: int) -> np.ndarray:
    edges = [BLOCK]
    while edges[-1] < longest:
        edges.append(edges[-1] + max(BLOCK, edges[-1] // 4))
    return np.array(edges)


def text_costs(own: Words, tables: Tables, weights: np.ndarray, s: Symbols, texts: int) -> np.ndarray:
    """The natural logarithm of the probability of each text's words, s, which are in the texts' order.

    The bits of a text are taken in blocks; weights[gate] and the text's own
    difference from them stay as they are within one.
    """
    which, node, bit, depth = expand(own.words, s.symbol)
    if not len(bit):
        return np.zeros(texts)
    rows = s.text.take(which)
    first = np.searchsorted(rows, np.arange(texts))
    at = np.arange(len(bit)) - first.take(rows)
    block = np.searchsorted(block_edges(int(at.max()) + 1), at, side="right").astype(np.int16)
    order = np.argsort(block, kind="stable")
    which, node, bit, depth, rows = which.take(order), node.take(order), bit.take(order).astype(np.float32), depth.take(order), rows.take(order).astype(np.intp)
    x, gate = inputs(own, tables, s, True, which, node, depth)
    w = np.ascontiguousarray(weights.T.astype(np.float32))
    moved = np.zeros((len(x), texts), dtype=np.float32)
    missed, met = np.zeros(texts * BUCKETS, dtype=np.float32), np.full(texts * BUCKETS, BUCKET_PRIOR, dtype=np.float32)
    seen = np.zeros(texts, dtype=np.float32)
    logs = np.empty(len(bit), dtype=np.float32)
    cuts = np.concatenate(([0], np.cumsum(np.bincount(block))))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        r, g, y = rows[a:z], gate[a:z], bit[a:z]
        heads = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1))  # the rows of a block are in order
        own_rows, sizes = r[heads], np.diff(np.append(heads, z - a))
        score = np.zeros(z - a, dtype=np.float32)
        for j in range(len(x)):
            v = w[j].take(g)
            v += np.repeat(moved[j].take(own_rows), sizes)
            v *= x[j][a:z]
            score += v
        np.clip(score, -14, 14, out=score)
        p = np.exp(-score)
        p += 1
        np.reciprocal(p, out=p)
        score += BUCKETS / 2
        np.clip(score, 0, BUCKETS - 1, out=score)
        cell = r * BUCKETS
        cell += score.astype(np.int8)
        gap = y - p
        final = gap - (missed / met).take(cell)
        np.abs(final, out=final)
        np.subtract(1, final, out=logs[a:z])
        rate = RATE / (1 + seen[own_rows] / DECAY)
        for j in range(len(x)):
            np.multiply(gap, x[j][a:z], out=score)
            moved[j][own_rows] = np.clip(moved[j][own_rows] + rate * np.add.reduceat(score, heads), -FARTHEST, FARTHEST)
        seen[own_rows] += sizes
        missed += np.bincount(cell, weights=gap, minlength=len(missed)).astype(np.float32)
        met += np.bincount(cell, minlength=len(met))
    np.clip(logs, 1e-6, 1, out=logs)
    np.log(logs, out=logs)
    return np.bincount(rows, weights=logs, minlength=texts)


def word_costs(own: Words, tables: Tables, weights: np.ndarray, s: Symbols, words: int) -> np.ndarray:
    """The natural logarithm of the probability of each word's letters, s; no word touches another."""
    which, node, bit, depth = expand(own.letters, s.symbol)
    x, gate = inputs(own, tables, s, False, which, node, depth)
    w = np.ascontiguousarray(weights.T.astype(np.float32))
    score = sum((w[j].take(gate) * x[j] for j in range(len(x))), np.zeros(len(bit), dtype=np.float32))
    p = np.clip(1 / (1 + np.exp(-np.clip(score, -14, 14))), 1e-6, 1 - 1e-6)
    return np.bincount(s.text.take(which), weights=np.log(1 - np.abs(bit - p)), minlength=words)


def start_weights(of_words: bool) -> np.ndarray:
    k = len(WORD_SLOTS) + 2 if of_words else len(ORDERS) + 1
    out = np.full((gates(of_words), k), 0.25)
    out[:, -1] = 0
    return out


def newton_sums(own: Words, tables: Tables, weights: np.ndarray, s: Symbols, of_words: bool) -> np.ndarray:
    """Of each gate the gradient and the second derivatives of the log-likelihood, and the log-likelihood itself."""
    which, node, bit, depth = expand(own.kind(of_words)[0], s.symbol)
    x, gate = inputs(own, tables, s, of_words, which, node, depth)
    k = len(x)
    out = np.zeros((gates(of_words), k + k * k + 2))
    order = np.argsort(gate, kind="stable")
    x, y = np.stack([v[order] for v in x], axis=1), bit[order]
    cuts = np.searchsorted(gate[order], np.arange(len(out) + 1))
    for g in range(len(out)):
        a, z = cuts[g], cuts[g + 1]
        if a == z:
            continue
        xs = x[a:z].astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(xs @ weights[g], -14, 14)))
        out[g, :k] = xs.T @ (y[a:z] - p)
        out[g, k:-2] = ((xs * (p * (1 - p))[:, None]).T @ xs).ravel()
        out[g, -2:] = np.log(1 - np.abs(y[a:z] - p)).sum(), z - a
    return out


def newton_step(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    k, out = weights.shape[1], weights.copy()
    start = start_weights(len(weights) == gates(True))
    for g in range(len(out)):
        step = np.linalg.solve(sums[g, k:-2].reshape(k, k) + 20.0 * np.eye(k), sums[g, :k] - 20.0 * (out[g] - start[g]))
        out[g] += step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
    return out


# --- on Spark ---------------------------------------------------------------------------------


@dataclass
class Rest:
    """Of the words outside the dictionary: tokens, their absolute discount, and the weight that spelling gets."""

    tokens: int
    discount: float
    spelling: float


@dataclass
class Model:
    counts: DataFrame  # w, n of all training tokens
    train_tokens: int
    distinct: int
    own: Words
    shared: object  # own, as sent to the executors
    dictionary_counts: np.ndarray
    tables: Tables
    weights: tuple[np.ndarray, np.ndarray]  # of words, of letters
    rest: Rest

    def base(self, c):
        """The smoothed unigram's log10 probability of a token seen c times."""
        return np.log10((c + SMOOTH) / (self.train_tokens + SMOOTH * (self.distinct + 1)))


def _table_parts(shared, texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each task's counts of texts and vocabulary, by chunks of the tables."""
    few = max(2 * texts.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // 4)
    salts = int(few**0.5)
    parts = texts.coalesce(few).mapInArrow(releasing(_table_batches(shared, True, salts)), KINDS)
    return parts.unionByName(vocabulary.coalesce(few).mapInArrow(releasing(_table_batches(shared, False, salts)), KINDS))


def _summed(parts: DataFrame) -> DataFrame:
    """The sum of each chunk, first by salt, then whole."""
    for by in (["of_words", "k", "salt"], ["of_words", "k"]):
        parts = parts.withColumn("salt", F.col("salt") if "salt" in by else F.lit(0)).repartition(*by).sortWithinPartitions("of_words", "k", "salt").mapInArrow(_sum_batches, KINDS)
    return parts


def _tables(own: Words, sums: DataFrame) -> Tables:
    """The predictions, a bounded number of slots, on the driver."""
    flat = {of_words: np.zeros(sum(own.kind(of_words)[1]), dtype=np.int8) for of_words in (True, False)}
    for r in sums.mapInArrow(_value_batches, "of_words boolean, k long, part binary").toLocalIterator():
        part = np.frombuffer(r["part"], dtype=np.int8)
        flat[r["of_words"]][r["k"] // 2 : r["k"] // 2 + len(part)] = part
    return Tables(*(np.split(flat[w], np.cumsum(own.kind(w)[1])[:-1]) for w in (True, False)))


def _fit_batches(shared, more, weights: np.ndarray, of_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = Words.of(shared.value), Tables(*more.value)
        total: np.ndarray | float = 0.0
        for s in _stream_batches(own, batches, of_words):
            total = total + newton_sums(own, tables, weights, s, of_words)
        if not isinstance(total, float):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

    return run


def _fit(rows: DataFrame, shared, more, of_words: bool) -> np.ndarray:
    """Gate weights by Newton steps; Spark adds up the derivatives, a fixed number of sums, over all rows."""
    weights = start_weights(of_words)
    k = weights.shape[1]
    for _ in range(FIT_ROUNDS):
        sums = np.zeros((len(weights), k + k * k + 2))
        for r in rows.mapInArrow(releasing(_fit_batches(shared, more, weights, of_words)), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums.flat[r["k"]] = r["v"]
        weights = newton_step(weights, sums)
    return weights


def train(docs: DataFrame, learned, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS) -> Model:
    """The model of the rows of docs for which the column expression `learned` holds.

    All of them are counted.  To the driver come the dictionary (`words` words
    at most) and the tables (a bounded number of slots), never the vocabulary.
    Null texts count as empty, repeated rows as rows of their own; without any
    row the model knows nothing and spells every word by even odds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.filter(learned).select(F.col(text_col).alias("t"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(FIT_SHARE)).alias("part"))
    counts = materialize(texts.select("t").mapInArrow(releasing(_count_batches), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm-counts")
    no_end = F.col("w") != F.lit(END)
    met = lambda k: F.count(F.when(no_end & (F.col("n") == k), 1))
    size = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), met(1).alias("once"), met(2).alias("twice")).first()
    ends = counts.filter(F.col("w") == F.lit(END)).first()
    top = counts.filter(no_end & (F.col("n") >= LEAST)).orderBy(F.desc("n"), "w").limit(words).toArrow()
    numbers = top.column("n").to_numpy()
    n_end = ends["n"] if ends else 0
    n_rest, v_rest = size["n"] - n_end - int(numbers.sum()), size["v"] - bool(ends) - len(numbers)
    discount = size["once"] / (size["once"] + 2 * size["twice"]) if size["once"] else 0.5
    letters = np.ones(LETTERS, dtype=np.int64)
    for r in counts.mapInArrow(_letter_batches, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        letters[r["k"]] += r["n"]
    own = words_of(top.column("w").to_pylist(), np.concatenate((numbers, [n_end + 1, n_rest + 1])), letters)
    shared = spark.sparkContext.broadcast(own.plain())
    vocabulary = counts.select("w", F.pmod(F.xxhash64("w"), F.lit(FIT_SHARE)).alias("part"))
    kept = materialize(texts.filter("part = 0").select("t"), "lm-fit")
    words_kept = vocabulary.filter("part = 0").select("w")
    sums = materialize(_summed(_table_parts(shared, texts.filter("part <> 0").select("t"), vocabulary.filter("part <> 0").select("w"))), "lm-tables")
    tables = _tables(own, sums)
    more = spark.sparkContext.broadcast((tables.words, tables.letters))
    weights = _fit(kept, shared, more, True), _fit(words_kept, shared, more, False)
    more.unpersist()
    tables = _tables(own, _summed(sums.unionByName(_table_parts(shared, kept, words_kept))))
    return Model(counts, int(size["n"]), int(size["v"]), own, shared, numbers, tables, weights, Rest(n_rest, discount, discount * v_rest + 1))


def log10_probabilities(own: Words, tables: Tables, weights: tuple[np.ndarray, np.ndarray], found: Symbols, rest: pa.Array, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its words, an escape for those outside the dictionary, and of each of these its spelling."""
    by_text = [text_costs(own, tables, weights[0], s, z - a) for a, z, s in text_parts(found, texts)]
    by_word = [word_costs(own, tables, weights[1], spelled(rest.slice(a, 20_000)), len(rest.slice(a, 20_000))) for a in range(0, len(rest), 20_000)]
    return np.concatenate([np.zeros(0), *by_text]) / np.log(10), np.concatenate([np.zeros(0), *by_word]) / np.log(10)


def _score_batches(shared, more):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, (in_words, in_letters, weights, base) = Words.of(shared.value), more.value
        tables = Tables(in_words, in_letters)
        row, known = TaskContext.get().partitionId() << 40, own.known()
        for part in batches:
            n = part.num_rows
            sizes, words = tokens_of(part.column(1))
            found, rest = streams(own, known, sizes, words)
            m = len(rest)
            scores, spelling = log10_probabilities(own, tables, weights, found, rest, n)
            rows, outside = np.arange(row, row + n), found.symbol == own.escape
            plain = np.bincount(found.text, weights=base[found.symbol], minlength=n)
            inner = np.bincount(found.text[~outside], minlength=n) - 1
            n_bytes = sizes + 1 + np.bincount(np.repeat(np.arange(n), sizes), weights=pc.binary_length(words).to_numpy(zero_copy_only=False), minlength=n).astype(np.int64)
            row += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((rows, rows[found.text[outside]]))),
                    # a text's own row gets a key that no word has
                    pa.concat_arrays([pa.array([b"\n%d" % r for r in rows.tolist()], pa.binary()), rest.cast(pa.binary())]),
                    pa.concat_arrays([part.column(0).cast(pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(sizes + 1, pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(inner, pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(plain, pa.float64()), pa.nulls(m, pa.float64())]),
                    pa.array(np.concatenate((scores, spelling))),
                    pa.concat_arrays([pa.array(n_bytes, pa.int64()), pa.nulls(m, pa.int64())]),
                ],
                names=["row", "w", "id", "n_tokens", "inner", "plain", "cost", "n_bytes"],
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte (of words
    with a space or end each) per input row.

    Null text counts as empty: its end is its only token.  Null and repeated ids
    stay rows of their own; other columns are ignored; texts of any length are
    read whole, and a text's score does not depend on the rows beside it; an
    empty table gives none.  Frequent words' counts come with the dictionary,
    all others by a join with the counted words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ends = model.counts.filter(F.col("w") == F.lit(END)).first()
    # of the dictionary's words, the end, and 0 for the words that the join adds
    base = np.concatenate((model.base(model.dictionary_counts.astype(float)), [model.base(float(ends["n"]) if ends else 0.0), 0.0]))
    more = spark.sparkContext.broadcast((model.tables.words, model.tables.letters, model.weights, base))
    sent = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        releasing(_score_batches(model.shared, more)), "row long, w binary, id long, n_tokens long, inner long, plain double, cost double, n_bytes long"
    )
    counts = model.counts.select(F.col("w").alias("known"), F.col("n").alias("c"))
    joined = sent.join(counts, F.col("w") == F.col("known"), "left")
    own, unit = F.col("n_tokens").isNotNull(), float(model.train_tokens + SMOOTH * (model.distinct + 1))
    # a word outside the dictionary: its discounted count, and the share of all discounts that its spelling has
    spelled_share = F.log10(F.lit(model.rest.spelling / (model.rest.tokens + 1))) + F.col("cost")
    counted = F.greatest(F.coalesce("c", F.lit(0)) - F.lit(model.rest.discount), F.lit(0.0)) / F.lit(float(model.rest.tokens + 1))
    word_cost = F.when(counted > 0, F.log10(counted + F.pow(F.lit(10.0), spelled_share))).otherwise(spelled_share)
    out = joined.groupBy("row").agg(
        F.max("id").alias(id_col),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(own, F.col("inner")).otherwise(F.col("c").isNotNull().cast("long"))).alias("n_known"),
        F.sum(F.when(own, F.col("plain")).otherwise(F.log10((F.coalesce("c", F.lit(0)) + SMOOTH) / unit))).alias("base_score"),
        F.sum(F.when(own, F.col("cost")).otherwise(word_cost)).alias("score"),
        F.max("n_bytes").alias("n_bytes"),
    )
    end_known = 1 if ends else 0
    return out.select(id_col, "n_tokens", (F.col("n_known") + end_known).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") * -np.log2(10.0) / F.col("n_bytes")).alias("bits_per_byte"))
