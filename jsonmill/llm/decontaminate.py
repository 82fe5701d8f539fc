"""Benchmark decontamination, in DataFrame functions only.

The windows of the benchmark items form a hash set.  A window of ten words
always holds one whole run of five words that starts at a multiple of five, so
documents are probed at every fifth word only; around each hit the full windows
are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, lower_ascii, materialize, split_words

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: The broadcast set is made only of so many windows at most; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 2_000_000


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """size, win (its words, space-joined) and items (the ids as strings, distinct; an item without an id adds none) of every window of every item."""
    w = benchmark.select(
        F.col(item_col).cast("string").alias("item"), split_words(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), GAP).alias("w")
    ).select("item", "w", F.least(F.size("w"), F.lit(window)).alias("size"))
    every = w.filter("size > 0").select(
        "item",
        "size",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " ")
            )
        ).alias("win"),
    )
    return every.groupBy("size", "win").agg(F.collect_set("item").alias("items"))


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _short_windows(size: int):
    """Each window of `size` words of w, itself the run that is probed."""
    return F.transform(
        F.sequence(F.lit(0), F.col("n") - size),
        lambda i: F.struct(
            F.xxhash64(F.lit(100 + size), *[F.get(F.col("w"), i + j) for j in range(size)]).alias("h"),
            i.alias("p"),
            F.lit(size).alias("len"),
            i.alias("from"),
            F.slice("w", i + 1, F.lit(size)).alias("ctx"),
        ),
    )


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per input row: id_col, n_words, n_hit, n_items, items (sorted), spans.

    spans are the [start, end) word positions that windows cover, merged and in
    order.  Null texts have no words; items whose text is null or has no word
    hit nothing; items without an id hit, but are not in n_items and items; null and repeated ids stay rows of their own; equal items
    share their windows; other input columns are ignored; an empty table gives
    none; without benchmark windows nothing is hit.
    """
    wins = item_windows(benchmark, item_col, item_text_col, window).persist()
    rows = wins.count()
    sizes = sorted(r[0] for r in wins.select("size").distinct().collect())  # at most `window` values
    # a window of `size` words holds an aligned run of `step` words if size >= 2 * step - 1
    step = (window + 1) // 2 if window > 1 else 1
    far = [s for s in sizes if s >= 2 * step - 1]
    short = [s for s in sizes if s < 2 * step - 1]

    probes = []
    if far:
        grams = wins.filter(F.col("size").isin(far)).select(F.split("win", " ").alias("b"), "size")
        probes.append(
            grams.select(
                F.explode(
                    F.transform(
                        F.sequence(F.lit(0), F.col("size") - step),
                        lambda i: F.xxhash64(F.lit(step), *[F.get(F.col("b"), i + k) for k in range(step)]),
                    )
                ).alias("probe")
            )
        )
    for s in short:
        probes.append(
            wins.filter(F.col("size") == s)
            .select(F.split("win", " ").alias("b"))
            .select(F.xxhash64(F.lit(100 + s), *[F.get(F.col("b"), F.lit(k)) for k in range(s)]).alias("probe"))
        )

    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("t")
    )
    words = base.select("row", "id", split_words(F.col("t"), GAP).alias("w")).select("row", "id", "w", F.size("w").alias("n"))
    first = F.array(
        F.struct(
            F.lit(None).cast("long").alias("h"), F.lit(0).alias("p"), F.lit(0).alias("len"), F.lit(0).alias("from"), F.array().cast("array<string>").alias("ctx")
        )
    )
    kinds = [first]
    if far:
        longest = max(far)
        back = longest - step
        kinds.append(
            F.when(
                F.col("n") >= step,
                F.transform(
                    F.sequence(F.lit(0), F.floor((F.col("n") - step) / step).cast("int")),
                    lambda k: F.struct(
                        F.xxhash64(F.lit(step), *[F.get(F.col("w"), k * step + j) for j in range(step)]).alias("h"),
                        (k * step).alias("p"),
                        F.lit(0).alias("len"),
                        F.greatest(k * step - back, F.lit(0)).alias("from"),
                        F.slice("w", F.greatest(k * step - back, F.lit(0)) + 1, F.lit(2 * longest - step)).alias("ctx"),
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<h:long,p:int,len:int,from:int,ctx:array<string>>>"))
        )
    for s in short:
        kinds.append(F.when(F.col("n") >= s, _short_windows(s)).otherwise(F.array().cast("array<struct<h:long,p:int,len:int,from:int,ctx:array<string>>>")))
    asked = words.select("row", "id", "n", F.explode(F.concat(*kinds)).alias("a")).select("row", "id", "n", "a.*")
    if probes:
        probe = probes[0]
        for p in probes[1:]:
            probe = probe.unionByName(p)
        asked = asked.join(_hinted(probe.distinct(), rows * (step + 1)), F.col("h") == F.col("probe"), "left").filter(
            F.col("probe").isNotNull() | F.col("h").isNull()
        )
    else:
        asked = asked.filter(F.col("h").isNull())

    def around(size: int):
        """The windows of `size` words that hold the run of `step` words at p."""
        first_at = F.greatest(F.col("p") + step - size, F.lit(0))
        last_at = F.least(F.col("p"), F.col("n") - size)
        cut = F.transform(
            F.sequence(first_at, last_at),
            lambda s: F.struct(s.alias("s"), F.lit(size).alias("size"), F.array_join(F.slice("ctx", s - F.col("from") + 1, F.lit(size)), " ").alias("win")),
        )
        return F.when(F.col("h").isNotNull() & (F.col("len") == 0) & (last_at >= first_at), cut).otherwise(none)

    none = F.array().cast("array<struct<s:int,size:int,win:string>>")
    whole = F.when(F.col("len") > 0, F.array(F.struct(F.col("p").alias("s"), F.col("len").alias("size"), F.array_join("ctx", " ").alias("win")))).otherwise(none)
    windows = asked.select("row", "id", "n", F.explode_outer(F.concat(whole, *[around(s) for s in far])).alias("x")).select("row", "id", "n", "x.*")
    known = wins.select(F.col("size").alias("k_size"), F.col("win").alias("k_win"), "items")
    found = windows.join(_hinted(known, rows), (F.col("size") == F.col("k_size")) & (F.col("win") == F.col("k_win")), "left")
    span = F.when(F.col("items").isNotNull(), F.struct(F.col("s").alias("s"), (F.col("s") + F.col("size")).alias("e")))
    per_doc = found.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("n").alias("n"),
        F.sort_array(F.collect_set(span)).alias("iv"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    ints = "array<struct<s:int,e:int>>"
    merged = F.aggregate(
        "iv",
        F.array().cast(ints),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    hit = F.aggregate(
        "iv",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(x["e"] - F.greatest(acc["end"], x["s"]), F.lit(0))).alias("n")
        ),
        lambda acc: acc["n"],
    )
    return per_doc.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.when(F.size("iv") == 0, F.array().cast(ints)).otherwise(merged).alias("spans"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones, columns unchanged.

    Rows that share an id go together, null ids too.  Null texts stay; an empty
    table stays empty; an empty benchmark removes nothing.
    """
    bad = fresh(docs, "bad")
    hits = materialize(find_hits(docs, benchmark, id_col, text_col).filter("n_hit > 0").select(F.col(id_col).alias(bad)).distinct(), "contaminated")
    return docs.join(broadcast_if_small(hits), docs[id_col].eqNullSafe(F.col(bad)), "left_anti")
