"""JSON text in files: lines, whole documents, values one after another, and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import strict
from ..operators import rewrite
from ..operators.encode import STD, Options, marshal_in
from ..operators.validate import is_valid


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block: a row per line that is not blank; files are split and read in parallel."""
    df = spark.read.text(path)
    return df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).filter(F.trim(F.col("value"), F.lit(" \t\r\n")) != "")


#: About so many bytes of text are sorted by one task.
SORTED_BYTES = 4 << 20


def in_order(spark: SparkSession, path: str) -> DataFrame:
    """The lines of read_lines with seq, sorted as they stand in the files: by file, block and place in the block.

    Tasks grow in number with the bytes of the files, not in size.
    """
    text = spark.read.text(path)
    tasks = -(-int(text._jdf.queryExecution().analyzed().stats().sizeInBytes()) // SORTED_BYTES) or 1
    df = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    # ranges follow one another, so sorted ranges are sorted as a whole
    return df.filter(F.trim(F.col("value"), F.lit(" \t\r\n")) != "").repartitionByRange(tasks, "file", "block", "seq").sortWithinPartitions("file", "block", "seq")


def good_and_bad(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """The lines that are documents, and those that are not with the fault's message and offset.

    Whole-stage code passes what nests up to 1,000 deep; only the lines that it
    refuses meet the exact reader, which goes to 10,000.  A null line is bad,
    without a message.  Two columns, message and offset, are added to the bad.
    """
    from ..operators.validate import syntax_error

    sure = F.coalesce(is_valid(F.col(value)), F.lit(False))
    fault = next(n for n in ("__fault" + "_" * k for k in range(len(lines.columns) + 1)) if n.lower() not in {c.lower() for c in lines.columns})
    unsure = lines.filter(~sure).withColumn(fault, syntax_error(F.col(value)))
    fine = F.col(value).isNotNull() & F.col(f"{fault}.message").isNull()
    good = lines.filter(sure).unionByName(unsure.filter(fine).drop(fault))
    return good, unsure.filter(~fine).select(*lines.columns, F.col(f"{fault}.message").alias("message"), F.col(f"{fault}.offset").alias("offset"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """value, file: a row per file."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def _value_batches(elements: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, data, rows = b.column(0)[k].as_py(), b.column(1)[k].as_py(), []
                try:
                    if elements:
                        at = strict._skip(data, 0)
                        if strict.kind_at(data, at) != "array":
                            raise strict.SyntaxFault("the document is no array", at + 1)
                        found = ((a, z) for _, a, z in strict.members(data, at))
                    else:
                        found = strict.values(data)
                    for n, (a, z) in enumerate(found):
                        rows.append((name, n, a, z, strict.repair(data[a:z]), None))
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
                except strict.JsonError as e:
                    rows.append((name, None, max(e.offset - 1, 0), len(data), None, e.message))
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "ord", "start", "end", "value", "error"])

    return run


def read_values(spark: SparkSession, path: str, elements: bool = False) -> DataFrame:
    """file, ord, start, end, value, error: the values of each file, with or without space between them.

    end is the offset after a value.  The values before a fault are delivered,
    then one row with the error.  elements: of one array its elements, one at a
    time.  A file is read by one task and must be less than 2 GiB; read_ranges
    has no such limit, and files of lines should use read_lines.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_value_batches(elements), "file string, ord long, start long, end long, value string, error string")


def remainder(text: Column) -> Column:
    """What is left of a text after its first value."""
    from ..operators.validate import skip

    data, end = F.encode(text, "UTF-8"), F.coalesce(skip(text)["end"], F.lit(0)).cast("int")
    return F.decode(F.substring(data, end + 1, F.length(data)), "UTF-8")


def write_lines(df: DataFrame, json: str, path: str, mode: str = "errorifexists") -> None:
    """A file per task with a document a line."""
    df.select(F.col(json).cast("string").alias("value")).write.mode(mode).text(path)


def marshal_write(df: DataFrame, value: Column, path: str, options: Options = STD, separator: str = " ", indent: str | None = None, mode: str = "errorifexists") -> None:
    """The JSON of a column of any type, one value after another without line ends: read_values reads it back.

    indent: an element a line, by this text.
    """
    json = marshal_in(df, value, options)
    if indent is not None:
        json = rewrite.indent(json, by=indent)["value"]
    df.select(json.alias("value")).write.mode(mode).option("lineSep", separator).text(path)


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A streaming DataFrame of the lines that come into a folder."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).filter(F.trim(F.col("value"), F.lit(" \t\r\n")) != "")


def stream_values(spark: SparkSession, path: str, elements: bool = False, max_files: int | None = None) -> DataFrame:
    """What read_values gives, of the files that come into a folder: values need no line ends between them."""
    reader = spark.readStream.format("binaryFile")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.schema("path string, modificationTime timestamp, length long, content binary").load(path).select("path", "content")
    return files.mapInArrow(_value_batches(elements), "file string, ord long, start long, end long, value string, error string")


def stream_out(df: DataFrame, json: str, path: str, checkpoint: str):
    """Starts a query that appends documents, a line each."""
    return df.select(F.col(json).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
