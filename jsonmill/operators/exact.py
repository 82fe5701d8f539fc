"""The exact reader as Arrow-batched column functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import strict


def as_bytes(x: Any) -> bytes:
    return x.encode("utf-8", "surrogatepass") if isinstance(x, str) else bytes(x)


def _rows(columns: tuple[pa.Array, ...]) -> Any:
    return zip(*(c.to_pylist() for c in columns), strict=True)


def column(fn: Callable[..., Any], returns: str) -> Callable[..., Column]:
    """fn on each row as an Arrow UDF; a row with a null argument gives null."""
    kind = to_arrow_type(T._parse_datatype_string(returns))

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([None if any(x is None for x in row) else fn(*row) for row in _rows(columns)], kind)

    # the kind of UDF is told by its type hints, which are text in this module
    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)


def struct_column(fn: Callable[..., tuple], returns: str) -> Callable[..., Column]:
    """Like column() for functions that give tuples; the result is a struct, null fields where an argument is null."""
    kind = to_arrow_type(T._parse_datatype_string(returns))
    fields = [kind.field(k) for k in range(kind.num_fields)]
    nothing = (None,) * len(fields)

    def run(*columns: pa.Array) -> pa.Array:
        rows = [nothing if any(x is None for x in row) else fn(*row) for row in _rows(columns)]
        parts = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, fields, strict=True)], fields=fields)

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)


def _try(fn: Callable[..., bytes]) -> Callable[..., tuple]:
    def run(*args: Any) -> tuple:
        try:
            return strict.repair(fn(*args)), None, None
        except strict.JsonError as e:
            return None, e.message, e.offset

    return run


RESULT = "value string, error string, offset long"


def result(fn: Callable[..., bytes]) -> Callable[..., Column]:
    """A struct of the text, or else of the error and its offset."""
    return struct_column(_try(fn), RESULT)
