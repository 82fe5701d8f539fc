import random
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from jsonmill.llm import queries
from jsonmill.llm.packing import Packer, WordTokenizer, pack, tokenizer_path

OWN = Tokenizer.from_file(tokenizer_path())


def own_ids(text):
    return [*OWN.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, capacity=4096):
    """Each id in exactly one piece, offsets without gaps, little padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, text in texts.items():
        got, want = b"", own_ids(text)
        for r in sorted(docs[d], key=lambda r: r.start):
            assert r.start == len(got) // 4 and r.length == len(r.ids) // 4 and r.doc_tokens == len(want)
            got += bytes(r.ids)
        assert np.frombuffer(got, dtype="<u4").tolist() == want
    padded = total = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= capacity
        total += at
        padded += capacity - at if at & (at - 1) else 0
    return padded / total


def test_word_by_word_equals_whole_text():
    odd = ["", " a b ", "été ́x", "It's DON'T we'll 'sx", "<|endoftext|> a<|startoftext|>b <|x", "中文 字1234 ab12_c", " x　y", "İΣΑΣ ΣΑΣ", "😀a 👍🏽", "a\x1cb\x85c", "a\xa0b\u1680c\u2003d\u2028e\u202ff\u205fg\u200bh", " \x1d "]
    rng = random.Random(1)
    odd += ["".join(rng.choice("aé'1 \n.<|>Σ́中sx") for _ in range(40)) for _ in range(300)]
    tok = WordTokenizer(tokenizer_path(), cache_words=500)
    for at in range(0, len(odd), 7):
        part = odd[at : at + 7]
        ids, offsets = tok.encode(part)
        for k, t in enumerate(part):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == own_ids(t)[:-1], repr(t)


def test_packer_keeps_its_bound_and_every_piece():
    rng = random.Random(2)
    got = []
    p = Packer(got.append, capacity=64, windows=4, max_gap=2)
    docs = {i: np.arange(n, dtype=np.uint32) for i, n in enumerate([rng.randint(1, 200) for _ in range(500)])}
    for i, ids in docs.items():
        p.add(i, ids)
        assert len(p.open) <= 4
    p.finish()
    seen = defaultdict(dict)
    for s in got:
        assert sum(len(x[2]) for x in s) <= 64
        for doc, start, ids in s:
            seen[doc][start] = ids
    assert all(np.array_equal(np.concatenate([seen[i][k] for k in sorted(seen[i])]), ids) for i, ids in docs.items())
    short = [n for s in got if (n := sum(len(x[2]) for x in s)) < 62 and n & (n - 1)]
    assert not short


def test_table_round_trip(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(pack(docs).collect(), texts) < 0.01
    rows = queries.op2_packing(spark, sf).collect()
    import zlib

    one = next(r for r in rows if r.start == 0 and r.length == r.doc_tokens)
    assert one.ids_crc32 == zlib.crc32(np.array(own_ids(texts[one.doc_id]), dtype="<u4").tobytes())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word " * 30_000, "c"), (4, "x", None)], "doc_id long, text string, start string")
    assert check(pack(docs.repartition(3)).collect(), {1: None, 2: "", 3: "word " * 30_000, 4: "x"}) < 0.01
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert sum(r.length for r in pack(twice).collect()) == 6
    assert pack(docs.limit(0)).count() == 0
