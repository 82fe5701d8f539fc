"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes homoglyphs, accents and digit substitutions, so that one entry
meets its disguises.  Hits inside an exception phrase do not count.  The
weights of the hits, plain and by length, give the score through a logistic
curve; weights, further entries and the curve are fitted on labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing, small_batches

#: Insults to start from.
SEEDS = """
idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash clown clowns garbage dumb
imbecile retard retarded vermin filth filthy bastard bastards bitch whore slut asshole jerk freak ugly
subhuman degenerate parasite cockroach braindead
""".split()
#: Phrases in which such words are harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "garbage truck", "garbage bag", "garbage collector", "clown fish", "clown school", "ugly duckling")
#: Letters of other scripts, and digits, that stand for Latin letters.  i, l and 1 are one letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i",
}
INSIDE = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")
SIGNS = {"@": "a", "$": "s", "!": "i"}
HIDDEN = "­​‌‍⁠﻿"

#: Rows of labels that a fit reads at most, those with the smallest hash of their id.
FIT_ROWS = 20_000
UNSEEN_WEIGHT = 3.0
#: Stems that labels teach: their letters, the least log-odds, the least share of the best one's information.
STEM_LEAST, STEM_MOST, STEM_LIFT, STEM_SHARE = 4, 10, 2.5, 0.2
_TABLE = str.maketrans(HOMOGLYPHS | dict.fromkeys(HIDDEN, ""))


def fold(text: str) -> str:
    """Lower case without accents, hidden characters, homoglyphs and digits for letters."""
    text = text.lower()
    if "@" in text or "$" in text or "!" in text:
        text = INSIDE.sub(lambda m: SIGNS[m[0]], text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)) if _marked(text) else text
    return text.translate(_TABLE)


def _marked(text: str) -> bool:
    return not unicodedata.is_normalized("NFKD", text)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS, UNSEEN_WEIGHT))
    curve: tuple[float, float, float] = (-3.0, 2.0, 0.5)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self):
        """The automaton; an entry that ends with * is a stem and may go on."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            f = fold(w.rstrip("*"))
            a.add_word(f, (len(f), x, w.endswith("*")))
        for p in self.exceptions:
            a.add_word(fold(p), (len(fold(p)), None, False))
        a.make_automaton()
        return a

    def score(self, total: float, words: int) -> float:
        b, per_text, per_length = self.curve
        z = b + per_text * np.log1p(total) + per_length * np.log1p(100 * total / max(words, 1))
        return float(1 / (1 + np.exp(-z)))


def hits(automaton, folded: str) -> tuple[float, int]:
    """(weight of all hits, their number): whole words or the stems that begin them, none inside an exception phrase."""
    found, spared = [], []
    for last, (n, weight, stem) in automaton.iter(folded):
        a, z = last - n + 1, last + 1
        if (a and folded[a - 1].isalnum()) or (not stem and z < len(folded) and folded[z].isalnum()):
            continue
        if weight is None:
            spared.append((a, z))
        else:
            found.append((a, z, weight))
    good = [x for x in found if not any(a <= x[0] and x[1] <= z for a, z in spared)] if spared else found
    return sum(x[2] for x in good), len(good)


# --- fitting ----------------------------------------------------------------------------------


def _count_batches(model: Model):
    """How many texts of each label hold what: a seed ('w'), a stem in a text without seeds ('s'), or anything ('t', 'p' without seeds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, seeds, counts = model.matcher(), {fold(w) for w in model.weights}, Counter()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                f = fold(t.as_py() or "")
                words = set(re.findall(r"[^\W_]+", f))
                counts["t", "", y] += 1
                counts.update(("w", w, y) for w in words & seeds)
                if not hits(a, f)[1]:
                    counts["p", "", y] += 1
                    counts.update(("s", x, y) for x in {w[:k] for w in words for k in range(STEM_LEAST, min(len(w), STEM_MOST) + 1)})
                if len(counts) > 100_000:
                    yield flush(counts)
        yield flush(counts)

    def flush(counts: Counter) -> pa.RecordBatch:
        kinds, words, toxic = ([k[i] for k in counts] for i in range(3))
        out = pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["kind", "word", "toxic", "n"])
        counts.clear()
        return out

    return run


def information(k1: float, k0: float, n1: float, n0: float) -> float:
    """Mutual information of a label and the presence of an entry."""

    def entropy(*v: float) -> float:
        return -sum(x / sum(v) * np.log(x / sum(v)) for x in v if x > 0)

    n, k = n1 + n0, k1 + k0
    return float(entropy(n1, n0) - k / n * entropy(k1, k0) - (n - k) / n * entropy(n1 - k1, n0 - k0))


def choose_stems(counts: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Stems by falling information, none that begins another or is begun by it, down to a share of the best."""
    ranked = sorted(((information(k1, k0, n1, n0), w, k1, k0) for w, k1, k0 in counts), reverse=True)
    out: dict[str, float] = {}
    for worth, w, k1, k0 in ranked:
        if worth < STEM_SHARE * ranked[0][0]:
            break
        if not any(w.startswith(x) or x.startswith(w) for x in out):
            out[w] = float(np.log((k1 + 0.5) / (n1 + 1)) - np.log((k0 + 0.5) / (n0 + 1)))
    return out


def _feature_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.matcher()
        for b in batches:
            total, words = [], []
            for t in b.column(0).to_pylist():
                f = fold(t or "")
                total.append(float(hits(a, f)[0]))
                words.append(len(f.split()))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(total, pa.float64()), pa.array(words, pa.int64())], names=["toxic", "total", "words"])

    return run


def training_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """id and toxic of at most `rows` labelled rows whose crc32(id as text) mod 5 is not 0."""
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    return own.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = FIT_ROWS,
    seeds: Sequence[str] = tuple(SEEDS),
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """The model from the bounded training sample; without labels of both kinds the seeds with one weight.

    seeds and exceptions are the lexicon to start from, in any languages; the
    built-in ones are English.  Null ids and labels teach nothing; an id with
    several labels is toxic if one of them says so.
    """
    small_batches(docs.sparkSession)
    ids = F.broadcast(training_ids(labels, id_col, label_col, rows))  # `rows` pairs of numbers at most
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))
    sample = materialize(own.join(ids, F.col("doc") == F.col("label_id")).select("t", "toxic"), "toxicity-sample")
    model = Model(dict.fromkeys(seeds, UNSEEN_WEIGHT), exceptions=exceptions)
    sent = sample.mapInArrow(releasing(_count_batches(model)), "kind string, word string, toxic int, n long")
    of = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0))
    counts = materialize(sent.groupBy("kind", "word").agg(of(1).alias("k1"), of(0).alias("k0")), "toxicity-counts")
    texts = {r["kind"]: (r["k1"], r["k0"]) for r in counts.filter("kind IN ('t', 'p')").collect()}
    n1, n0 = texts.get("t", (0, 0))
    if not n1 or not n0:
        return model
    folded = {fold(w): w for w in seeds}
    for r in counts.filter("kind = 'w'").collect():  # at most one row for each seed
        model.weights[folded[r["word"]]] = min(8.0, float(np.log((r["k1"] + 0.5) / (n1 + 1)) - np.log((r["k0"] + 0.5) / (n0 + 1))))
    model.weights = {k: w for k, w in model.weights.items() if w > 0.5}
    r1, r0 = texts.get("p", (0, 0))
    if r1 and r0:
        lift = F.log((F.col("k1") + 0.5) / (r1 + 1)) - F.log((F.col("k0") + 0.5) / (r0 + 1))
        rows = counts.filter(F.col("kind") == "s").filter((F.col("k1") >= max(8, 0.01 * r1)) & (lift >= STEM_LIFT)).collect()  # few: each is in a share of bounded texts
        model.weights |= {f"{w}*": x for w, x in choose_stems([(r["word"], r["k1"], r["k0"]) for r in rows], r1, r0).items()}
    got = sample.mapInArrow(releasing(_feature_batches(model)), "toxic int, total double, words long").toPandas()
    total = got["total"].to_numpy()
    x = np.column_stack([np.ones(len(got)), np.log1p(total), np.log1p(100 * total / np.maximum(got["words"].to_numpy(), 1))])
    y, b = got["toxic"].to_numpy().astype(float), np.zeros(3)
    for _ in range(50):
        p1 = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (p1 * (1 - p1))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p1) - 0.1 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    model.curve = tuple(float(v) for v in b)
    return model


# --- scoring ----------------------------------------------------------------------------------


def _score_batches(model: Model, text: int, keep: list[int]):
    """The columns numbered `keep` with score and n_hits; the one numbered `text` is scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.matcher()
        for b in batches:
            scores, numbers = [], []
            for t in b.column(text):
                f = fold(t.as_py() or "")
                total, n = hits(a, f)
                scores.append(model.score(total, len(f.split()) if n else 1))
                numbers.append(n)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), pa.array(scores, pa.float64()), pa.array(numbers, pa.int64())], names=[*(b.schema.names[k] for k in keep), "score", "n_hits"]
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1) and n_hits per input row.

    Nothing but the text is an input of a score.  Null and empty texts have no
    hit, so they get the score of clean text; null and repeated ids stay rows of
    their own; other columns are ignored; an empty table gives none.
    """
    kind = dict(docs.dtypes)[id_col]
    return (
        docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("id"))
        .mapInArrow(releasing(_score_batches(model, 0, [1])), f"id {kind}, score double, n_hits long")
        .select(F.col("id").alias(id_col), "score", "n_hits")
    )


def remove_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that score 0.5 or more, columns unchanged.

    Null and empty texts and rows without an id stay if clean text does;
    repeated rows are judged each; an empty table stays empty; columns of any
    name pass through.
    """
    model = fit(docs, labels, id_col, text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]
    scored = docs.toDF(*names).mapInArrow(
        releasing(_score_batches(model, docs.columns.index(text_col), list(range(len(names))))), ", ".join(f"{n} {k}" for n, (_, k) in zip(names, docs.dtypes, strict=True)) + ", score double, n_hits long"
    )
    return scored.filter("score < 0.5").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
