"""The queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    found = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("clean_chars", F.char_length("clean_text").cast("long")).drop("clean_text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs).select("doc_id", "source", "text", "n_lines", "n_lines_dropped")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    out = extract_main_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_hits

    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a row without an id is never learned from
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    scored = score(docs, train(docs, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))  # a row without an id is never learned from
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialize, remove_path
    from .warc import archive_path, gaps, read_archives, records, write_archives

    path = archive_path(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    read = materialize(read_archives(spark, path), "warc-read")
    remove_path(spark, path)
    lost = gaps(read)
    if not lost.isEmpty():  # the archives were written a moment ago: nothing may be missing
        raise RuntimeError(f"unreadable bytes in the archives: {lost.first()}")
    return records(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, secret_spans

    found = secret_spans(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[F.array_size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_html": op5_html,
    "op6_decontaminate": op6_decontaminate,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_secrets": op10_secrets,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    from .sql import SQL

    return dict(SQL)
