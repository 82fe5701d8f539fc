import zlib

import pytest

from jsonmill.llm import queries
from jsonmill.llm.toxicity import EXCEPTIONS, SEEDS, Model, fit, fold, hits, remove_toxic, score


@pytest.mark.parametrize("disguise", ["idiot", "IDIOT", "1d10t", "ídïöt", "іdіоt", "ｉｄｉｏｔ", "idi​ot", "!idiot", "an idiot.", "id!ot", "idiot$$$", "ld1ot"])
def test_folding_meets_disguises(disguise):
    assert hits(Model().matcher(), fold(disguise))[1] == 1


@pytest.mark.parametrize("clean", ["idiotic", "xtrash", "trash can", "the TRASH CANS are", "", "clown fish", "scumble"])
def test_no_hit(clean):
    assert hits(Model().matcher(), fold(clean)) == (0, 0)


def test_matches_equal_a_word_search():
    import re

    text = fold("trash can trash idiot moron, loser; trash bin clown fishy ugly") + " " + fold("x" * 3000 + " scum")
    spared = [m.span() for p in EXCEPTIONS for m in re.finditer(rf"(?<![^\W_]){re.escape(fold(p))}(?![^\W_])", text)]
    found = [m.span() for w in SEEDS for m in re.finditer(rf"(?<![^\W_]){re.escape(fold(w))}(?![^\W_])", text)]
    want = [s for s in found if not any(a <= s[0] and s[1] <= b for a, b in spared)]
    assert hits(Model().matcher(), text)[1] == len(want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op8_toxicity(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in rows.items())
    held = [(r.toxic, rows[r.doc_id].score) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    right = sum((s >= 0.5) == bool(y) for y, s in held) / len(held)
    found = sum(s >= 0.5 for y, s in held if y) / sum(y for y, _ in held)
    assert right > 0.97 and found > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "you idiot", 0.1), (None, "", None), (3, "idiot " * 20_000, 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(docs, none)
    assert model.weights == Model().weights
    got = sorted((r.doc_id or 0, r.score >= 0.5) for r in score(docs, model).collect())
    assert got == [(0, False), (1, False), (1, True), (3, True)]
    left = remove_toxic(docs, none)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1]
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert score(docs.limit(0), fit(docs, odd)).count() == 0
