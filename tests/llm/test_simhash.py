import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from jsonmill.llm import simhash
from jsonmill.llm.simhash import components, fingerprint, keep_one, links, near_duplicates


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams)
        out |= (2 * ones > len(grams)) << bit
    return out


def brute_components(rows):
    at = {i: i for i, _ in rows}

    def root(a):
        while at[a] != a:
            a = at[a]
        return a

    for i, x in rows:
        for j, y in rows:
            if i < j and bin(x ^ y).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return {i: root(i) for i, _ in rows}


def test_fingerprint_by_hand():
    for t in ("", " \n", "One", "one two", "a b c", "Ä b C d e\x0bf", "x " * 300, "a b c a b c d"):
        assert fingerprint(t.encode()) == slow_fingerprint(t)


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(400)
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    want = brute_components(rows)
    got = near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp % 2**64 for r in got} == dict(rows)


@pytest.mark.parametrize("chunk", [2048, 5])
def test_links_connect_clusters_and_hot_buckets(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(15):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    rows = list(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in rows], "id long, fp long")
    found = {r.member: r.component for r in components(links(nodes)).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == brute_components(rows)


def test_every_plan_finds_all_links(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = [(k, x ^ sum(1 << b for b in rng.sample(range(64), k % 5))) for k, x in enumerate(base * 4)]
    nodes = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in rows], "id long, fp long").dropDuplicates(["fp"])
    kept = {r.id for r in nodes.collect()}
    want = brute_components([r for r in rows if r[0] in kept])
    for ts in ([2, 0], [1, 1], [0, 0, 1], [0, 0, 0, 0]):
        cuts = np.array_split(np.arange(64), len(ts))
        monkeypatch.setattr(simhash, "plan_parts", lambda *a, ts=ts, cuts=cuts: [(c.tolist(), t) for c, t in zip(cuts, ts)])
        found = {r.member: r.component for r in components(links(nodes)).collect()}
        assert {i: found.get(i, i) for i in kept} == want


def test_thresholds_sum_up_and_follow_the_cost():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500)
    few, many = simhash.plan_parts(both, 1000), simhash.plan_parts(both * 10**9, 10**12)
    for parts in (few, many):
        assert sum(t for _, t in parts) >= 3 - len(parts) + 1
    assert len(many) < len(few)


def test_nulls_empties_repeats_and_clashing_names(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "", "c"), (5, "some words in a line", None), (6, "some words in a line", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = defaultdict(list)
    for r in near_duplicates(docs).collect():
        got[r.doc_id].append((r.fp, r.component_id))
    assert got[1] == [(0, 1)] and got[2] == [(0, 1), (0, 1)] and got[None] == [(0, None)]
    assert got[5][0][1] == got[6][0][1] == 5
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 5]
    same = spark.createDataFrame([(1, "x y z"), (1, "x y z")], "doc_id long, text string")
    assert keep_one(same).count() == 1
    empty = docs.limit(0)
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0
