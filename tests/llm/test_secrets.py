import random
import re
import time

import numpy as np
import pytest

from jsonmill.llm import queries
from jsonmill.llm.secrets import BASE, RULES, Rule, Scanner, compile_patterns, digest, secret_spans

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")


#: The base rules as the contract words them, with what their matches must have.
WORDED = {"access": ("AKIA[A-Z0-9]+", 20), "hex": ("[0-9a-f]+", 24)}


def brute(text):
    """All spans by Python's own engine."""
    out = []
    for k, rule in enumerate(RULES):
        full, least = WORDED.get(rule.kind, (rule.full, rule.least))
        for m in re.finditer(full, text):
            if rule.kind == "assign":
                if len(ASSIGN.fullmatch(m[0])[2]) < 6:
                    continue
            elif len(m[0]) < least:
                continue
            out.append((m.start(), k, m.end()))
    return [(RULES[k].kind, a, b) for a, k, b in sorted(out)]


PIECES = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abc123", "deadbeef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", ",", "==", "-", "ghp_", "x" * 36, "sk_live_", "a" * 24, "eyJhb.eyJzd.sig", "-----BEGIN RSA PRIVATE KEY-----", "secret", "passwd"]


def random_text(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))


def test_spans_equal_the_regular_expressions(spark):
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(600)] + ["", None, "token = " + "a" * 5, "token = " + "a" * 6, "f" * 23, "f" * 24, "é" * 9 + "a" * 30, "a" * 3000, "token" + " " * 5000 + "=abcdefgh"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_spans(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t or ""), t


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_secrets(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_hex for r in rows) > 0
    for r in rows:
        want = brute(texts[r.doc_id])
        base = [x for x in want if x[0] in BASE]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == digest(base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in base) for k in BASE)


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[0-9]{2,3}x?", "(?i:ab)+c{2}", r"a\.b|a.", "x{2,}y"])
def test_automaton_against_re(pattern):
    d = compile_patterns([pattern], anywhere=False)
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("abcdxyABC.019") for _ in range(rng.randint(0, 7)))
        s = 0
        for b in t.encode():
            s = int(d.table[s, d.classes[b]])
        assert bool(d.accepts[s]) == bool(re.fullmatch(pattern.replace("a.", "a[.]") if pattern.endswith("a.") else pattern, t)), t


def test_minimisation_merges_states():
    d = compile_patterns(["abx|cbx"], anywhere=False)
    assert len(d.table) == 5  # start, after a or c, after b, end, dead
    assert Scanner().first.table.shape[0] < 4000


def test_many_rules_in_one_pass(spark):
    rules = tuple(Rule(f"r{k}", f"k{k:02d}[a-f]+", (f"k{k:02d}",)) for k in range(70))
    text = " ".join(f"xk{k:02d}abcz" for k in range(70)) + "k01k02ab"
    got = secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules=rules).first().spans
    want = sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.full, text))
    assert [(s.start, s.kind, s.end) for s in got] == [(a, f"r{k}", e) for a, k, e in want] and len(want) == 71


def test_long_texts_take_time_in_proportion(spark):
    texts = ["eyJ" * 300_000, "a" * 1_000_000, "ghp_" * 200_000, "token" * 150_000 + "= abcdefgh", "password" + " " * 500_000, "-----BEGIN " * 90_000, "eyJa.eyJb" * 100_000, "AKIA" * 200_000, "é" * 300_000 + "token=abcdefgh"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_spans(docs).collect()}
    assert time.time() - began < 60
    assert all(got[i] == brute(t) for i, t in enumerate(texts) if i in (1, 2, 3, 4, 5, 7, 8))
    assert got[0] == [] and got[1] == [("hex", 0, 1_000_000)] and got[8] == [("assign", 300_000, 300_014)]


def test_beginnings_do_not_cross_texts():
    scanner = Scanner()
    parts = [b"tok", b"en=abcdefgh", b"", b"password=1234567", b"f" * 20, b"f" * 24]
    data, offsets = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([0, *map(len, parts)])
    text, at, rule = scanner.beginnings(data, offsets)
    assert list(zip(text.tolist(), at.tolist(), rule.tolist())) == [(3, 0, 0), *((4, k, 2) for k in range(9)), *((5, k, 2) for k in range(13))]


def test_odd_rows(spark):
    rows = [(None, "token=abcdefgh", "x"), (1, None, "y"), (1, None, "y"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secret_spans(docs).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 0)]
    assert secret_spans(docs.limit(0)).count() == 0
