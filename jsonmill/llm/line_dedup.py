"""Site-relative line dedup: lines that a large share of a site's pages carry are boilerplate and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: A site's boilerplate lines are sent to all executors only if there are so many in all at most.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    """A line without white space at its ends, as a 16-byte digest."""
    return F.unhex(F.md5(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")))


def boilerplate(
    docs: DataFrame, host_col: str, text_col: str, max_ratio: float = 0.03, min_pages: int = 5
) -> DataFrame:
    """host, key, pages, host_pages of each line that is on more than max_ratio of its host's pages and on min_pages at least.

    A page counts once for a line however often the line is on it.  Counting is
    by (host, line) with partial sums before the shuffle, so neither a hot host
    nor a hot line gathers rows in one task.  A host has at most (mean lines of
    a page) / max_ratio such lines.
    """
    # a null host is a host of its own
    pages = docs.select(F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = pages.select(
        "host",
        F.explode(
            F.array_distinct(
                F.transform(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), _key)
            )
        ).alias("key"),
    )
    counts = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    t = totals.withColumnRenamed("host", "total_host")
    return (
        counts.join(t, counts["host"].eqNullSafe(t["total_host"]))
        .filter(F.col("pages") > max_ratio * F.col("host_pages"))
        .select("host", "key", "pages", "host_pages")
    )


def _without_lines(docs: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> tuple[DataFrame, str, str]:
    """docs with two columns at the end, and their names: the lines of each text (null for a null text), and those that stay."""
    keys = materialize(boilerplate(docs, host_col, text_col, max_ratio, min_pages), "line-dedup")
    host, own = fresh(docs, "bp_host"), fresh(docs, "bp_keys")
    per_host = keys.groupBy(F.col("host").alias(host)).agg(F.collect_set("key").alias(own))
    if keys.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        per_host = F.broadcast(per_host)
    joined = docs.join(per_host, docs[host_col].eqNullSafe(F.col(host)), "left")
    parts = fresh(joined, "parts")
    left = fresh(joined, "left")
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    kept = F.filter(F.col(parts), lambda x: ~(has_word(x) & F.coalesce(F.array_contains(own, _key(x)), F.lit(False))))
    out = joined.withColumn(parts, F.split(F.col(text_col), "\n"))
    out = out.withColumn(left, F.when(F.col(own).isNull(), F.col(parts)).otherwise(kept))
    return out.drop(host, own), parts, left


def line_dedup(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = 0.03,
    min_pages: int = 5,
) -> DataFrame:
    """docs with cleaned texts, and the columns n_lines, n_lines_dropped and text_before at the end.

    Every row stays, also one whose text is dropped whole (it gets the empty
    text).  A null text stays null; lines without a word are never dropped; a
    null host is a host of its own; repeated rows count as pages of their own;
    an empty table gives an empty result; other columns pass through unchanged,
    and a column of the input named like an added one, in any case of letters,
    is replaced.
    """
    out, parts, left = _without_lines(docs, host_col, text_col, max_ratio, min_pages)
    return out.select(
        *[c for c in docs.columns if c.lower() not in (text_col.lower(), "n_lines", "n_lines_dropped", "text_before")],
        F.array_join(F.col(left), "\n").alias(text_col),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(parts) - F.size(left), F.lit(0)).cast("long").alias("n_lines_dropped"),
        F.col(text_col).alias("text_before"),
    )


def drop_lines(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    size_col: str = "n_chars",
    max_ratio: float = 0.03,
    min_pages: int = 5,
) -> DataFrame:
    """docs without the boilerplate lines, in the same columns.

    As line_dedup, but no column is added or replaced: the text is cleaned, and
    size_col, if there is one, follows where a text lost a line.
    """
    out, parts, left = _without_lines(docs, host_col, text_col, max_ratio, min_pages)
    kinds, text = dict(docs.dtypes), F.array_join(F.col(left), "\n")
    size = F.when(F.size(left) < F.size(parts), F.char_length(text).cast(kinds[size_col])).otherwise(F.col(size_col)) if size_col in kinds else None
    return out.select(*[text.alias(c) if c == text_col else size.alias(c) if c == size_col else F.col(f"`{c}`") for c in docs.columns])
