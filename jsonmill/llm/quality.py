"""Line-first quality rules, in DataFrame functions only.

Rules for punctuation, navigation and boilerplate are tried on every line; the
lines that fail go, and a document that loses too many of its words is
rejected.  All work is done inside one row: no shuffle, no join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, split_words

#: What counts as a symbol, a separator of menus, the end of a sentence, and boilerplate.
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›·•]"
SENTENCE_END = r"[.!?…:;\"'”’»)\]]([\x20\x09-\x0D]|$)"
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie policy|we use cookies|enable javascript"
    r"|lorem ipsum|click here|subscribe to our newsletter|sign up for|log in to|powered by|read more$)"
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5


def _line_words(line: Column) -> Column:
    return F.size(split_words(line, WS))


def line_fails(line: Column, boilerplate: str = BOILERPLATE) -> Column:
    """Whether a line that has a word breaks a rule.

    Punctuation: more than one symbol or more than one exclamation mark for two
    words, or no word that ends a sentence.  Navigation: three separators or more.
    Boilerplate: a match of the expression, by default phrases of English pages.
    """
    n = _line_words(line)
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    shouts = F.regexp_count(line, F.lit("!"))
    return (
        (symbols * 2 > n)
        | ((n > 1) & (shouts * 2 > n))
        | ~line.rlike(SENTENCE_END)
        | (F.regexp_count(line, F.lit(SEPARATORS)) >= 3)
        | line.rlike(boilerplate)
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost_percent: int = 30, boilerplate: str = BOILERPLATE) -> DataFrame:
    """One row per input row: figures, the verdict and the cleaned text.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_lines_failed, n_words_lost, base_failed, kept
    and clean_text.  A null text counts as empty (no words, so it fails the
    base rules); null ids, repeated ids and equal rows stay separate rows; a
    text of any length is read whole; other input columns are ignored; an empty
    table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # each step names values that the next uses more than once, so that Catalyst computes them once
    s1 = base.select("id", "t", split_words(F.col("t"), WS).alias("w"), F.split("t", "\n").alias("all_lines"))
    five = [F.lit(k) for k in range(REPEAT_WINDOW)]
    s2 = s1.select(
        "id",
        "t",
        "w",
        "all_lines",
        F.size("w").alias("n"),
        F.filter("all_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("all_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x, boilerplate)).alias("fails"),
        F.when(
            F.size("w") > REPEAT_WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("w") - REPEAT_WINDOW),
                lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in five]),
            ),
        ).alias("h"),
    )
    s3 = s2.select(
        "id",
        "t",
        "w",
        "n",
        "lines",
        F.filter("all_lines", lambda x, i: F.get(F.col("fails"), i)).alias("failed"),
        F.filter("all_lines", lambda x, i: ~F.get(F.col("fails"), i)).alias("stay"),
        # equal hashes are a rare hint; only such texts take the exact way
        F.when(
            F.size("h") > F.size(F.array_distinct("h")),
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(1), F.col("n") - (REPEAT_WINDOW - 1)),
                    lambda i: F.struct(F.array_join(F.slice("w", i, REPEAT_WINDOW), " ").alias("w"), i.alias("i")),
                )
            ),
        ).alias("win"),
    )
    near = lambda x, j: F.coalesce(F.get(F.col("win"), j)["w"] == x["w"], F.lit(False))
    s4 = s3.withColumn(
        "at",
        F.sort_array(
            F.transform(F.filter("win", lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["i"])
        ),
    )
    size = F.lit(REPEAT_WINDOW)
    covered = F.aggregate(
        F.transform("at", lambda p, j: F.least(size, F.coalesce(F.get(F.col("at"), j + 1) - p, size))),
        F.lit(0),
        lambda a, x: a + x,
    )
    s5 = s4.select(
        "id",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("failed").cast("long").alias("n_lines_failed"),
        F.size(split_words(F.array_join("failed", "\n"), WS)).cast("long").alias("n_words_lost"),
        F.array_join("stay", "\n").alias("clean_text"),
    )
    bad = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = 100 * F.col("n_words_lost") > max_lost_percent * F.col("n_words")
    return s5.select(
        F.col("id").alias(id_col),
        *[c for c in s5.columns if c not in ("id", "clean_text")],
        bad.alias("base_failed"),
        (~bad & ~lost).alias("kept"),
        "clean_text",
    )
