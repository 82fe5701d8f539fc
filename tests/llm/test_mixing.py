import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jsonmill.llm import mixing, queries
from jsonmill.llm.mixing import Symbols, add_counts, block_edges, expand, gates, huffman, log10_probabilities, mixed_up, newton_step, newton_sums, score, slot, spelled, start_weights, streams, text_costs, tokens_of, train, word_costs, words_of


def array(words):
    return pa.array(words, pa.large_binary())


def own_streams(own, texts):
    return streams(own, own.known(), np.array([len(t) for t in texts], dtype=np.int64), array([w for t in texts for w in t]))


def index(own):
    return {w: k for k, w in enumerate(own.known().to_pylist())}


def small_model():
    words = [w.encode() for w in "the cat sat on a mat and the dog did too".split()] * 3 + [b"unusual"]
    counts = Counter(words)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))[:6]
    own = words_of(ranked, np.array([*(counts[w] for w in ranked), 4, 3]), np.bincount(np.frombuffer(b"".join(counts), dtype=np.uint8), minlength=257) + 1)
    in_words, in_letters = (np.zeros(2 * sum(own.kind(of_words)[1]), dtype=np.int32) for of_words in (True, False))
    add_counts(own, own_streams(own, [words])[0], True, in_words)
    add_counts(own, spelled(array(sorted(counts))), False, in_letters)
    tables = mixing.Tables(*(np.split(mixing.values(c), np.cumsum(own.kind(w)[1])[:-1]) for c, w in ((in_words, True), (in_letters, False))))
    return own, tables, (start_weights(True), start_weights(False))


def test_trees():
    whole = huffman(np.array([50, 20, 10, 10, 5, 1, 1]))
    which, node, bit, depth = expand(whole, np.arange(7))
    codes = ["".join(map(str, bit[which == s])) for s in range(7)]
    assert all(not b.startswith(a) for a in codes for b in codes if a is not b)
    assert abs(sum(2.0 ** -len(x) for x in codes) - 1) < 1e-12 and len(codes[0]) == 1
    one = 1 / (1 + np.exp(-whole.ones[node]))
    p = np.exp(np.bincount(which, weights=np.log(np.where(bit == 1, one, 1 - one)), minlength=7))
    assert abs(p.sum() - 1) < 1e-6 and np.allclose(p, np.array([50, 20, 10, 10, 5, 1, 1]) / 97, atol=0.01)
    assert (node[depth == 0] == 0).all()


@pytest.mark.parametrize("of_words", [True, False])
def test_a_symbol_has_probability_one_in_all(of_words):
    own, tables, weights = small_model()
    n = own.escape + 1 if of_words else mixing.LETTERS
    zeros = np.zeros(1, dtype=np.int32)
    for c in (0, 12345):
        contexts = [np.full(1, c, dtype=np.uint32)] * len(own.kind(of_words)[1])
        cost = text_costs if of_words else word_costs
        total = sum(math.exp(cost(own, tables, weights[0 if of_words else 1], Symbols(zeros, np.array([k]), contexts), 1)[0]) for k in range(n))
        assert abs(total - 1) < 1e-3


def both(own, tables, weights, texts):
    found, rest = own_streams(own, texts)
    a, b = log10_probabilities(own, tables, weights, found, rest, len(texts))
    return a + np.bincount(found.text[found.symbol == own.escape], weights=b, minlength=len(texts))


def test_texts_do_not_touch_each_other():
    own, tables, weights = small_model()
    texts = [b"the cat sat".split(), [], b"unheard of words \xc3\xa9".split(), b"the dog did too".split() * 40_000, [b"x" * 20_000], b"dog zebra did".split() * 50_000]
    assert sum(map(len, texts)) > 300_000
    together = both(own, tables, weights, texts)
    alone = np.array([both(own, tables, weights, [t])[0] for t in texts])
    assert np.allclose(together, alone, rtol=1e-5) and (together < 0).all()
    assert both(own, tables, weights, []).shape == (0,)


def bits_of(own, tables, weights, s, of_words):
    """For each bit of s: its text or word, itself, the predictions and the weights, in plain numbers."""
    tree, sizes = own.kind(of_words)
    for i, sym in enumerate(s.symbol.tolist()):
        for depth, at in enumerate(range(int(tree.start[sym]), int(tree.start[sym + 1]))):
            node = int(tree.nodes[at])
            x, often = [float(tree.ones[node])] if of_words else [], []
            for k, c in enumerate(s.contexts):
                h = np.array([node], dtype=np.uint32) * np.uint32(0x85EBCA6B)
                v = int((tables.words if of_words else tables.letters)[k][slot(c[i : i + 1], h, sizes[k])[0]])
                x.append((v >> 2) * mixing.UNIT)
                often.append(v & 3)
            gate = often[-1] * 4 + often[-2]
            yield int(s.text[i]), int(tree.bits[at]), [*x, 0.3], weights[gate * 3 + min(depth // 4, 2) if of_words else gate].tolist()


def slow_word_costs(own, tables, weights, s, words):
    total = [0.0] * words
    for t, y, x, w in bits_of(own, tables, weights, s, False):
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        total[t] += math.log(p if y else 1 - p)
    return total


def slow_text_costs(own, tables, weights, s, texts):
    total, state, edges = [0.0] * texts, {}, block_edges(1 << 22).tolist()
    for t, y, x, w in bits_of(own, tables, weights, s, True):
        now = state.setdefault(t, {"at": 0, "edge": 0, "moved": [0.0] * len(x), "grad": [0.0] * len(x), "missed": Counter(), "met": Counter(), "next": [], "seen": 0})
        if now["at"] == edges[now["edge"]]:  # a block is over
            rate = mixing.RATE / (1 + now["seen"] / mixing.DECAY)
            now["moved"] = [min(max(m + rate * g, -mixing.FARTHEST), mixing.FARTHEST) for m, g in zip(now["moved"], now["grad"])]
            for cell, gap in now["next"]:
                now["missed"][cell] += gap
                now["met"][cell] += 1
            now |= {"seen": now["at"], "grad": [0.0] * len(x), "next": [], "edge": now["edge"] + 1}
        now["at"] += 1
        z = sum((a + m) * b for a, m, b in zip(w, now["moved"], x))
        p = 1 / (1 + math.exp(-z))
        cell = int(min(max(z + mixing.BUCKETS / 2, 0), mixing.BUCKETS - 1))
        final = p + now["missed"][cell] / (now["met"][cell] + mixing.BUCKET_PRIOR)
        total[t] += math.log(final if y else 1 - final)
        now["grad"] = [g + (y - p) * v for g, v in zip(now["grad"], x)]
        now["next"].append((cell, y - p))
    return total


def test_costs_bit_by_bit():
    own, tables, weights = small_model()
    rng = np.random.default_rng(3)
    weights = tuple(w + rng.normal(0, 0.1, w.shape) for w in weights)
    texts = [b"the cat sat on unusual mats and the dog did too".split() * 60, [], b"zebra the zebra".split(), b"did too on a mat".split() * 9]
    found, rest = own_streams(own, texts)
    assert np.allclose(text_costs(own, tables, weights[0], found, len(texts)), slow_text_costs(own, tables, weights[0], found, len(texts)), rtol=1e-4)
    assert np.allclose(word_costs(own, tables, weights[1], spelled(rest), len(rest)), slow_word_costs(own, tables, weights[1], spelled(rest), len(rest)), rtol=1e-4)


def test_contexts_by_hand():
    own, _, _ = small_model()
    found, rest = own_streams(own, [b"the zebra sat".split(), [], b"the".split()])
    known, esc, end, h = index(own), own.escape, own.end, lambda *v: int(mixed_up(*(np.array([x]) for x in v))[0])
    the, sat = known[b"the"], known.get(b"sat", own.escape)
    assert found.symbol.tolist() == [the, esc, sat, end, end, the, end] and found.text.tolist() == [0, 0, 0, 0, 1, 2, 2] and rest.to_pylist()[0] == b"zebra"
    assert found.contexts[0].tolist() == [h(end), h(the), h(esc), h(sat), h(end), h(end), h(the)]
    assert found.contexts[1].tolist() == [h(end, end), h(the, end), h(esc, the), h(sat, esc), h(end, end), h(end, end), h(the, end)]
    letters = spelled(array([b"ab", b"a"]))
    assert letters.symbol.tolist() == [97, 98, 256, 97, 256] and letters.text.tolist() == [0, 0, 0, 1, 1]
    assert letters.contexts[0].tolist() == [h(257, 257), h(97, 257), h(98, 97), h(257, 257), h(97, 257)]


def test_fitting_lowers_the_cost():
    own, tables, weights = small_model()
    s = own_streams(own, [b"the cat sat on a mat and the dog did too".split() * 20])[0]
    w, losses = weights[0], []
    for _ in range(4):
        sums = newton_sums(own, tables, w, s, True)
        losses.append(-sums[:, -2].sum())
        w = newton_step(w, sums)
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0] and w.shape[0] == gates(True)


def base_of(rows):
    tokens = {d: (t or "").encode().lower().split() for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = Counter(w for d, ts in tokens.items() if not held[d] for w in [*ts, None])
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ts) + 1, sum(c[w] > 0 for w in [*ts, None]), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ts, None])) for d, ts in tokens.items()}


def test_table_against_plain_counts(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, got = base_of(rows), queries.op7_mixing(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        h, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)  # both below zero: 5 % better at least


def test_held_out_texts_score_better_than_counts_alone(spark):
    sf = "/root/testdata/sf0.1"
    held = queries.op7_mixing(spark, sf).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert held.s > 0.95 * held.b and held.better > 0.8


def test_scores_by_hand_and_on_any_partitions(spark):
    rows = [(i, " ".join("the cat sat on a mat and the dog did too".split()[k % 11] + ("" if k % 7 else str(i * k)) for k in range(i, i + 40 * (i % 5) + 3))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = train(docs, F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    other = {r.doc_id: r.score for r in score(docs.repartition(7), model).collect()}
    counts = Counter(w for i, t in rows if i % 4 for w in t.lower().encode().split())
    rest = {w: n for w, n in counts.items() if w not in index(model.own)}
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    assert all(n < mixing.LEAST for n in rest.values()) and once
    d = once / (once + 2 * twice)
    for i, t in rows:
        found, spelt = own_streams(model.own, [t.lower().encode().split()])
        total = slow_text_costs(model.own, model.tables, model.weights[0], found, 1)[0] / math.log(10)
        for w, c in zip(spelt.to_pylist(), slow_word_costs(model.own, model.tables, model.weights[1], spelled(spelt), len(spelt))):
            total += math.log10((max(rest.get(w, 0) - d, 0) + (d * len(rest) + 1) * math.exp(c)) / (sum(rest.values()) + 1))
        assert abs(got[i].score - total) < 1e-4 * abs(total) and abs(other[i] - total) < 1e-4 * abs(total)


def test_odd_rows(spark):
    rows = [(1, None, 1.0), (2, "", 2.0), (2, "a b a", 2.0), (None, "a", 1.0), (4, "w" * 5000 + " Z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = train(docs, F.col("doc_id").isNotNull(), words=2)
    got = score(docs, model).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got) == [1, 1, 2, 3, 4]
    assert all(r.score < 0 and r.base_score < 0 and r.train_tokens == 9 for r in got)
    nothing = train(docs.limit(0), F.lit(True))
    assert score(docs.limit(0), nothing).count() == 0
    assert all(r.n_known == 0 and r.score < 0 for r in score(docs, nothing).collect())
    sizes, words = tokens_of(pa.array([None, " a\x0bB \u00c9\u00a0\x1c ", "", "\t\n", "z"]))
    assert sizes.tolist() == [0, 3, 0, 0, 1] and words.to_pylist() == [b"a", b"b", "\u00c9\u00a0\x1c".encode(), b"z"]
    assert tokens_of(pa.array([], pa.string()))[0].tolist() == []
