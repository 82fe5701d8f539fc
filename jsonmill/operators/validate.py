"""Validity of documents and of their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import strict
from .exact import as_bytes, column, struct_column


def parse(json: Column) -> Column:
    """A VARIANT, null if the document is invalid or nests deeper than a VARIANT can (1,000).

    A prefix parse is not enough: see is_valid.  The value is taken out of the
    array that the check parses, so a document is parsed twice, not three times.
    """
    return F.when(_in_object(json).isNotNull(), F.try_variant_get(_in_array(json), "$[0]", "variant"))


def must_parse(json: Column) -> Column:
    """A VARIANT; an invalid document ends the query."""
    v = parse(json)
    return F.when(v.isNotNull(), v).otherwise(F.raise_error(F.concat(F.lit("invalid JSON: "), F.left(json, F.lit(80)))))


def scan(json: Column) -> Column:
    """A VARIANT of the first value, without a look at what follows it."""
    return F.try_parse_json(json)


def _in_array(json: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))


def _in_object(json: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit('{"x":'), json, F.lit("}")))


def is_valid(json: Column) -> Column:
    """Whether the text is one JSON document, inside whole-stage code.

    Spark's parser reads one value and ignores the rest.  No rest that hides
    behind the value in an array also does in an object, so both must parse.
    Needs spark.sql.variant.allowDuplicateKeys.  Nesting beyond 1,000 counts as
    invalid here; is_valid_exact goes to 10,000.
    """
    return _in_array(json).isNotNull() & _in_object(json).isNotNull()


def is_valid_exact(json: Column) -> Column:
    """The grammar to its last rule, also for BINARY that is no UTF-8."""
    return column(lambda j: strict.valid(as_bytes(j)), "boolean")(json)


def _fault(j) -> tuple:
    e = strict.check(as_bytes(j))
    return (e.message, e.offset) if e else (None, None)


def syntax_error(json: Column) -> Column:
    """struct<message, offset>: the first fault and one more than its byte; nulls if there is none."""
    return struct_column(_fault, "message string, offset long")(json)


def _first(j) -> tuple:
    e = strict.first_extent(as_bytes(j))
    return (*e, True) if e else (None, None, False)


def skip(json: Column) -> Column:
    """struct<start, end, ok>: the bytes of the first value."""
    return struct_column(_first, "start long, end long, ok boolean")(json)


def is_utf8(binary: Column) -> Column:
    return F.is_valid_utf8(binary)


def repair_utf8(binary: Column) -> Column:
    """Text with U+FFFD for each byte that is no part of a valid sequence."""
    return F.when(F.is_valid_utf8(binary), binary.cast("string")).otherwise(column(lambda b: strict.repair(bytes(b)), "string")(binary))
