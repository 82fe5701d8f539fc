"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: The white space that ends a word: space and the controls 9 to 13.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows re-reads the files, also after executors are lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    name, taken = f"__{base}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else.  Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def split_words(c: Column, gap: str = WS) -> Column:
    """The pieces between gaps, without empty ones."""
    return F.array_remove(F.split(c, gap), "")


#: Ids of 8 bytes that a join sends to all executors at most.
BROADCAST_IDS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_IDS) -> DataFrame:
    """df (a stored table) with a broadcast hint if a count proves it has max_rows rows at most; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df



#: Rows of texts that a Python worker is handed at once at most.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, so that workers that read texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker, which lives on, gives Arrow's free memory back."""

    def wrapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped
