"""Quality rules, line dedup and decontamination against plain Python."""

import random
import re
from collections import Counter

import pytest

from jsonmill.llm.decontaminate import find_hits, remove_documents
from jsonmill.llm.line_dedup import line_dedup
from jsonmill.llm.quality import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality_against_plain_python(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 500, "é ü\x0bß. ok", "l\nl\n l\nl", "a b c d e f\n" * 2000]
    texts += ["".join(rng.choice(["a", "b ", "c\n", "###", "Ä ", "word. ", "\r\n", "|"]) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    rows = quality(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), texts[r.doc_id]
    assert quality(docs.limit(0)).count() == 0


def test_quality_verdicts(spark):
    prose = "This is a plain sentence of a page that anybody wrote one day.\nIt has another line, which ends well too."
    menu = "Home | News | Sport | Culture | About | Contact\nLogin | Register | Help | Terms | Imprint | Search | More"
    junk = " ".join(f"word{i}### other{i}%%%" for i in range(20)) + "."
    docs = spark.createDataFrame([(1, prose), (2, menu), (3, junk), (4, prose + "\nAll rights reserved.")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality(docs).collect()}
    assert got[1].kept and got[1].clean_text == prose
    assert not got[2].kept and not got[3].kept
    assert got[4].kept and got[4].clean_text == prose


def test_line_dedup(spark):
    rows = [(i, "h" if i < 20 else None, f"Menu of the site\nown line {i}\n\n  Menu of the site ", "z") for i in range(40)]
    rows += [(50, "h", None, None), (51, "other", "Menu of the site", "q"), (50, "h", "", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_lines string")
    got = line_dedup(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.source): r for r in got}
    assert by[3, "h"].text == "own line 3\n" and by[3, "h"].n_lines_dropped == 2
    assert by[30, None].text == "own line 30\n"
    assert by[51, "other"].text == "Menu of the site"
    assert sorted(str(r.text) for r in got if r.doc_id == 50) == ["", "None"]
    assert line_dedup(docs.limit(0)).count() == 0


def brute_hits(texts, items, window=10):
    gap = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: gap.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = low(t)
        z = min(window, len(w))
        for k in range(len(w) - z + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + z]), set()).add(str(i))
    out = {}
    for d, t in texts:
        w, hit, ids = low(t), set(), set()
        for z in {len(x) for x in wins}:
            for k in range(len(w) - z + 1):
                if (x := tuple(w[k : k + z])) in wins:
                    hit |= set(range(k, k + z))
                    ids |= wins[x]
        out[d] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, short):
    rng = random.Random(6)
    vocabulary = ["aa", "bb", "Éé", "cc", "d1", "EE"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.randint(9 if not short else 1, 14))) for i in range(12)] + [(90, None), (91, " -- "), (92, item(10))]
    items.append((93, items[0][1]))
    texts = [(i, item(rng.randint(0, 30)) + ", " + rng.choice(items)[1].__str__() + "! " + item(rng.randint(0, 9))) for i in range(60)] + [(100, None), (101, ""), (102, "x" * 5000)]
    docs = spark.createDataFrame([(*t, "c") for t in texts], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, items)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in find_hits(docs, bench).collect()}
    assert got == want
    spans = {r.doc_id: r.spans for r in find_hits(docs, bench).collect()}
    assert all(sum(s.e - s.s for s in spans[d]) == want[d][1] for d in want)
    clean = remove_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d in want if not want[d][1]}
    assert find_hits(docs.limit(0), bench).count() == 0
    none = find_hits(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and all(r.n_hit == 0 for r in none)


def test_items_without_an_id_hit(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"so {text} eleven twelve"), (2, "b c d"), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text + " eleven"), (7, text), (None, "b c d"), (None, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, list(r["items"]), [tuple(s) for s in r.spans]) for r in find_hits(docs, bench).collect()}
    assert got == {1: (11, 1, ["7"], [(1, 12)]), 2: (3, 0, [], [(0, 3)]), 3: (0, 0, [], [])}
    assert [r.doc_id for r in remove_documents(docs, bench).collect()] == [3]
