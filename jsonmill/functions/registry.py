"""User hooks: encoders by name, and converters as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import strict
from ..operators.encode import STD, Options, marshal
from ..operators.exact import as_bytes, column
from ..operators.rewrite import quote

_ENCODERS: dict[str, Callable[[Column], Column]] = {}


def register_encoder(name: str, build: Callable[[Column], Column]) -> None:
    """The text of values of this schema name is what build(column) gives."""
    _ENCODERS[name] = build


def encode_as(name: str, value: Column) -> Column:
    return _ENCODERS[name](value) if name in _ENCODERS else marshal(value)


def append_string(c: Column, options: Options = STD) -> Column:
    return quote(c, options.escape_html)


def append_int(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def append_uint(c: Column) -> Column:
    return c.cast("decimal(20,0)").cast("string")


def append_float(c: Column) -> Column:
    return column(lambda x: strict.float_text(float(x)), "string")(c.cast("double"))


def append_bool(c: Column) -> Column:
    return F.when(c, "true").when(~c, "false")


def marshaler(fn: Callable, options: Options = STD) -> Callable[..., Column]:
    """A user's conversion to JSON text, Arrow-batched; its text is checked, compacted and escaped, and ends the query if it is no document."""

    def run(*args) -> str:
        text = strict.compact(as_bytes(fn(*args)))
        return strict.repair(strict.escape_html(text) if options.escape_html else text)

    return column(run, "string")


def text_marshaler(fn: Callable, options: Options = STD) -> Callable[..., Column]:
    """A user's conversion to text, which is written as a string."""
    return column(lambda *args: strict.quote(fn(*args), options.escape_html), "string")


def struct_encoder(schema: str | T.StructType, options: Options = STD) -> Callable[[Column], Column]:
    """An encoder for structs of this schema built as one expression; kinds that need run-time choices are refused."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    plain = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)

    def check(k: T.DataType) -> None:
        if isinstance(k, T.StructType):
            for f in k.fields:
                check(f.dataType)
        elif isinstance(k, T.ArrayType):
            check(k.elementType)
        elif not isinstance(k, plain):
            raise TypeError(f"{k.simpleString()} has no generated encoder")

    check(kind)
    return lambda c: marshal(F.struct(*[c[f.name].alias(f.name) for f in kind.fields]), options)
