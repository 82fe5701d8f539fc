"""Values and array elements of files of any size, read by many tasks.

A file is cut into byte ranges.  A first pass tells of each range how many
quotes and brackets it adds, if it begins within a string and if not; running
sums over a file's ranges, a few numbers each, then give the true state at each
range's beginning.  From it a task finds the first border in its range, reads
value after value from there, and stops at the first border in a later range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import strict

BLOCK = 1 << 20
ROWS, BYTES = 10_000, 8 << 20  # of a batch that is passed on
_STRUCTURE = re.compile(rb'"(?:[^"\\]|\\.)*+"|"(?:[^"\\]|\\.)*+\\?\Z|[\[\]{},]', re.S)
_REST_OF_STRING = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)
_OUTSIDE = re.compile(rb'[ \t\n\r"\[\]{}]')
_TEXT = re.compile(rb"[^ \t\n\r]")


def _open(path: str) -> Any:
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _backslashes(f: Any, at: int) -> int:
    """How many stand right before a position."""
    n = 0
    while at > n:
        size = min(4096, at - n)
        block = f.read_at(size, at - n - size)
        run = size - len(block.rstrip(b"\\"))
        n += run
        if run < size:
            break
    return n


def _summary(f: Any, start: int, end: int) -> tuple[int, int, int, bool]:
    """(quotes mod 2, brackets if it begins outside a string, brackets if inside, whether any text)."""
    odd, outside, inside, text = 0, 0, 0, False
    slashes = _backslashes(f, start) & 1
    for at in range(start, end, BLOCK):
        # an open escape of the block before goes on here
        raw = b"\\" * slashes + f.read_at(min(BLOCK, end - at), at)
        text = text or _TEXT.search(raw) is not None
        a = np.frombuffer(raw, np.uint8)
        marks = np.flatnonzero((a == 0x22) | (a == 0x5B) | (a == 0x5D) | (a == 0x7B) | (a == 0x7D))
        quotes = marks[a[marks] == 0x22]
        back = np.flatnonzero(a == 0x5C)
        if len(back) and len(quotes):
            first = back[np.r_[True, np.diff(back) != 1]]  # where runs of backslashes begin
            before = (quotes > 0) & (a[quotes - 1] == 0x5C)
            run = quotes[before] - first[np.searchsorted(first, quotes[before]) - 1]
            real = np.ones(len(quotes), bool)
            real[before] = run % 2 == 0
            quotes = quotes[real]
        brackets = marks[a[marks] != 0x22]
        step = np.where((a[brackets] == 0x5B) | (a[brackets] == 0x7B), 1, -1)
        even = (np.searchsorted(quotes, brackets) + odd) % 2 == 0
        outside, inside, odd = outside + int(step[even].sum()), inside + int(step[~even].sum()), (odd + len(quotes)) % 2
        slashes = (len(raw) - len(raw.rstrip(b"\\"))) & 1
    return odd, outside, inside, text


class _Buffer:
    """The bytes of a file from a position on, more of them as they are asked for."""

    def __init__(self, f: Any, start: int, end: int, size: int) -> None:
        self.f, self.base, self.size = f, start, size
        self.data = f.read_at(end - start, start)
        self.text = self.data.decode("latin-1")

    @property
    def whole(self) -> bool:
        return self.base + len(self.data) >= self.size

    def more(self) -> None:
        at = self.base + len(self.data)
        got = self.f.read_at(min(self.size - at, max(BLOCK, len(self.data))), at)
        self.data, self.text = self.data + got, self.text + got.decode("latin-1")

    def skip(self, at: int) -> int:
        """The next text, len(data) at the end of the file."""
        at = strict._skip(self.data, at)
        while at >= len(self.data) and not self.whole:
            self.more()
            at = strict._skip(self.data, at)
        return at

    def value_end(self, at: int) -> int:
        while True:
            try:
                end = self._end(at)
                # what looks like the end of a number may be a part of it
                if self.whole or end + 8 < len(self.data) or self.data[end - 1 : end] in (b"}", b"]", b'"'):
                    return end
            except strict.JsonError as e:
                if self.whole or (e.offset + 8 < len(self.data) and not e.message.startswith("unexpected end")):
                    raise
            self.more()

    def _end(self, at: int) -> int:
        try:
            end = strict._SCANNER.scan(self.text, at)[1]
            if self.data.count(b"[", at, end) + self.data.count(b"{", at, end) <= strict._PLAIN_DEPTH:
                return end
        except (ValueError, StopIteration, RecursionError):
            pass
        return strict.value_end(self.data, at)


def _border(b: _Buffer, limit: int, in_string: bool, depth: int, elements: bool) -> int | None:
    """The first border before `limit`: a comma of the array, or a place outside all values after a space or a bracket."""
    data, at = b.data, 0
    if in_string:
        m = _REST_OF_STRING.match(data, 1 if _backslashes(b.f, b.base) & 1 else 0)
        if not m:
            return None
        at = m.end()
    if elements:
        for m in _STRUCTURE.finditer(data, at):
            c = m[0][:1]
            if m.start() >= limit:
                return None
            if c == b"," and depth == 1:
                return m.start()
            depth += 1 if c in b"[{" else -1 if c in b"]}" else 0
            if depth == 0:
                _only_space(b, m.end(), limit)
                return None
        return None
    if depth == 0 and at == 0 and b.f.read_at(1, b.base - 1) in (b" ", b"\t", b"\n", b"\r", b"]", b"}"):
        return 0
    while at < limit:
        if depth == 0:
            m = _OUTSIDE.search(data, at)
            if not m or m.start() >= limit:
                return None
            if m[0] in b" \t\n\r":
                return m.end() if m.end() < limit else None
            at = m.start()
        m = _STRUCTURE.search(data, at)
        if not m or m.start() >= limit:
            return None
        c, at = m[0][:1], m.end()
        depth += 1 if c in b"[{" else -1 if c in b"]}" else 0
        if depth == 0 and c in b"]}":
            return at if at < limit else None
    return None


def _values(b: _Buffer, at: int, limit: int) -> Iterator[tuple[int, int]]:
    last, bracket = at, True
    while True:
        at = b.skip(at)
        if at >= len(b.data) or (at >= limit and (at > last or bracket)):
            return
        end = b.value_end(at)
        yield at, end
        at, last, bracket = end, end, b.data[end - 1] in b"]}"


def _only_space(b: _Buffer, at: int, limit: int) -> None:
    m = _TEXT.search(b.data, at, max(at, min(limit, len(b.data))))
    if m:
        raise strict.SyntaxFault(f"invalid character {strict._char(b.data, m.start())} after top-level value", m.start() + 1)


def _elements(b: _Buffer, at: int, limit: int, first: bool) -> Iterator[tuple[int, int]]:
    """The elements after the comma, or the bracket, at `at`, until one that a comma from `limit` on begins."""
    while True:
        at = b.skip(at + 1)
        if first and b.data[at : at + 1] == b"]":
            return _only_space(b, at + 1, limit)
        end = b.value_end(at)
        yield at, end
        at, first = b.skip(end), False
        c = b.data[at : at + 1]
        if c == b"]":
            return _only_space(b, at + 1, limit)
        if c != b",":
            raise strict.SyntaxFault("unexpected end of JSON input" if not c else f"invalid character {strict._char(b.data, at)} after array element", at + len(c))
        if at >= limit:
            return


def _frame(f: Any, size: int, start: int, end: int, in_string: bool, depth: int, seen: bool, elements: bool) -> Iterator[tuple[int, int, str | None, str | None]]:
    """(start, end, value, error) of what begins in a range."""
    b, limit = _Buffer(f, start, end, size), end - start
    try:
        if elements and not seen:
            at = strict._skip(b.data, 0)
            if at == len(b.data):
                if not b.whole:
                    return
                raise strict.SyntaxFault("the document is no array", at + 1)
            if b.data[at] != 0x5B:
                raise strict.SyntaxFault("the document is no array", at + 1)
            found = _elements(b, at, limit, True)
        elif elements and depth == 0 and not in_string:
            return _only_space(b, 0, limit)
        else:
            border = 0 if start == 0 else _border(b, limit, in_string, depth, elements)
            if border is None:
                return
            found = _elements(b, border, limit, False) if elements else _values(b, border, limit)
        for a, z in found:
            yield start + a, start + z, strict.repair(b.data[a:z]), None
    except strict.JsonError as e:
        yield start + max(e.offset - 1, 0), size, None, e.message


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with _open(r["file"]) as f:
                odd, outside, inside, text = _summary(f, r["start"], r["end"])
            yield pa.RecordBatch.from_pylist([{**r, "odd": odd, "outside": outside, "inside": inside, "text": text}], _SUMMARY)


_RANGE = [("file", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
_SUMMARY = pa.schema([*_RANGE, ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64()), ("text", pa.bool_())])
_VALUE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("error", pa.string())])


def _framer(elements: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["file"]) as f:
                    for a, z, value, error in _frame(f, r["size"], r["start"], r["end"], r["in_string"], r["depth"], r["seen"], elements):
                        rows.append((r["file"], a, z, value, error))
                        held += z - a if value is not None else 0
                        if len(rows) >= ROWS or held >= BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _VALUE.types, strict=True)], schema=_VALUE)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _VALUE.types, strict=True)], schema=_VALUE)

    return run


def read_ranges(spark: SparkSession, path: str, elements: bool = False, range_bytes: int = 16 << 20, tasks: int | None = None, cut: bool = True) -> DataFrame:
    """file, start, end, value, error: the values of each file, or the elements of the array that it holds; start is their order.

    Files are read by byte ranges, so neither a file's size nor the number of
    files in one task is bounded; a task holds one range, or the one value that
    is longer.  What stands before a file's first fault is delivered, and one
    row with the error.  cut=False saves the pass that finds first faults, for
    files known to be sound: behind a fault there may be any rows.  Files are
    opened by Arrow's file systems.  An empty file gives no values, and is no array.
    """
    n = tasks or max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    last = F.greatest(F.col("size") - 1, F.lit(0)).cast("bigint")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(range_bytes).cast("bigint")))
    ranges = files.select("file", "size", starts.alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, "size"))
    told = ranges.repartition(n).mapInArrow(_summaries, "file string, size long, start long, end long, odd int, outside long, inside long, text boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    told = told.withColumn("adds", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    state = told.select("file", "size", "start", "end", "in_string", F.coalesce(F.sum("adds").over(before), F.lit(0)).alias("depth"), F.coalesce(F.max("text").over(before), F.lit(False)).alias("seen"))
    rows = state.repartition(n).mapInArrow(_framer(elements), "file string, start long, end long, value string, error string")
    if not cut:
        return rows
    faults = rows.filter("error IS NOT NULL").groupBy("file").agg(F.min("start").alias("fault"))
    kept = rows.join(faults, "file", "left").filter("fault IS NULL OR start < fault OR (start = fault AND error IS NOT NULL)")
    return kept.select("file", "start", "end", "value", "error")
