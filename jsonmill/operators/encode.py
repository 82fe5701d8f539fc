"""Columns to JSON text."""

from __future__ import annotations

import base64
import re
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import strict
from ..strict import FAST, STD, Options
from .exact import column
from .rewrite import compact, html_escape, line_escape, lower_hex

__all__ = ["FAST", "STD", "Options", "marshal", "marshal_any", "marshal_exact", "marshal_in", "marshal_indent", "marshal_to", "object_of", "sort_map_keys"]


def sort_map_keys(m: Column) -> Column:
    """A map with its entries in the order of their keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def marshal(value: Column, options: Options = STD) -> Column:
    """Compact JSON of a struct, array, map or VARIANT, inside whole-stage code.

    For values without floats, which Spark prints as 1.0 where 1 is wanted: one
    that holds any, or one whose zero fields are to be left out, ends the query
    with an error.  marshal_in takes every type.  Null fields are written.  Maps
    must come through sort_map_keys.
    """
    text = F.substring(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), 6, 1 << 30)
    text = lower_hex(F.left(text, F.length(text) - 1))
    text = html_escape(text) if options.escape_html else line_escape(text)
    kind = F.typeof(value)  # a constant: the branch that is not taken costs nothing
    needs_exact = kind.rlike(r"\b(float|double)\b") | (F.lit(options.omit_zero_struct_fields) & kind.contains("struct<"))
    return F.when(needs_exact, F.raise_error(F.concat(F.lit("marshal_in is needed for "), kind)).cast("string")).otherwise(text).alias("marshal")


#: Types that to_json writes as wanted.
_NATIVE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def _native(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_native(f.dataType) for f in kind.fields)
    return _native(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, _NATIVE)


def marshal_in(df: DataFrame, value: Column, options: Options = STD) -> Column:
    """JSON of any column of df: its type, which analysis knows, chooses marshal or marshal_exact."""
    kind = df.select(value.alias("v")).schema["v"].dataType
    if isinstance(kind, T.VariantType):
        return marshal_any(value, options)
    plain = _native(kind) and not options.omit_zero_struct_fields
    return marshal(value, options) if plain else marshal_exact(value, kind, options)


def marshal_to(prefix: Column, value: Column, options: Options = STD) -> Column:
    """The prefix with the value's JSON after it."""
    return F.concat(prefix, marshal(value, options))


_PART = re.compile(r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*')


def _any_text(json: str) -> str:
    """Spark's text of a VARIANT with numbers in their shortest form and small hex digits."""

    def fix(m: re.Match) -> str:
        t = m[0]
        if t[0] == '"':
            return re.sub(r"\\(?:u00[01][A-F]|.)", lambda e: e[0].lower() if e[0][1] == "u" else e[0], t)
        return t if t.lstrip("-").isdigit() else strict.float_text(float(t))

    return _PART.sub(fix, json)


def marshal_any(v: Column, options: Options = STD) -> Column:
    """JSON of a VARIANT: keys sorted, numbers that are no integers as doubles in their shortest form."""
    text = F.to_json(v)
    text = F.when(v.isNotNull(), column(_any_text, "string")(text))
    return html_escape(text) if options.escape_html else line_escape(text)


def _plain(x: Any, kind: T.DataType) -> Any:
    """A pandas or Row value as what strict.encode takes; structs keep their field order."""
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        get = x.get if isinstance(x, dict) else (lambda n: x[n])
        return _Fields([(f.name, _plain(get(f.name), f.dataType), f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in x]
    if isinstance(kind, T.MapType):
        pairs = x.items() if isinstance(x, dict) else x
        return {str(k): _plain(v, kind.valueType) for k, v in pairs}
    if isinstance(kind, T.FloatType):
        return _Single(x)
    if isinstance(kind, T.DecimalType):
        return strict.Number(format(x, "f"))
    if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return x.isoformat()
    if isinstance(kind, T.DoubleType):
        return float(x)
    if isinstance(kind, T.BooleanType):
        return bool(x)
    if isinstance(kind, T.BinaryType):
        return bytes(x)
    if isinstance(kind, T.StringType):
        return x
    return int(x)


class _Fields(list):
    pass


class _Single(float):
    pass


def _zero(v: Any) -> bool:
    return v is None or (not isinstance(v, _Fields) and isinstance(v, (bool, int, float, str)) and v == type(v)()) or (isinstance(v, _Fields) and all(_zero(x) for _, x, _ in v))


def encode_typed(v: Any, options: Options) -> str:
    if isinstance(v, _Fields):
        own = [(n, x) for n, x, _ in v if not (options.omit_zero_struct_fields and _zero(x))]
        return "{" + ",".join(f"{strict.quote(n, options.escape_html)}:{encode_typed(x, options)}" for n, x in own) + "}"
    if isinstance(v, _Single):
        return strict.float_text(float(v), single=True)
    if isinstance(v, list):
        return "[" + ",".join(encode_typed(x, options) for x in v) + "]"
    if isinstance(v, dict):
        keys = sorted(v, key=lambda k: k.encode()) if options.sort_map_keys else list(v)
        return "{" + ",".join(f"{strict.quote(k, options.escape_html)}:{encode_typed(v[k], options)}" for k in keys) + "}"
    return strict.encode(v, options)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_LEAVES = (*_WHOLE, T.NullType, T.BooleanType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BinaryType)


def _arrow(kind: T.DataType) -> bool:
    """Whether _texts takes the type: all but times and maps with keys of other types than text and whole numbers."""
    if isinstance(kind, T.StructType):
        return all(_arrow(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, (*_WHOLE, T.StringType)) and _arrow(kind.valueType)
    return _arrow(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, _LEAVES)


def _each(a: pa.Array, fn: Any) -> pa.Array:
    return pa.array([None if x is None else fn(x) for x in a.to_pylist()], pa.string())


def _float_texts(a: pa.Array, single: bool) -> pa.Array:
    if not pc.all(pc.is_finite(a), min_count=0).as_py():
        strict.float_text(pc.filter(a, pc.invert(pc.is_finite(a)))[0].as_py())  # raises
    text = a.cast(pa.string())
    text = pc.if_else(pc.ends_with(text, ".0"), pc.utf8_slice_codeunits(text, 0, -2), text)
    # Arrow turns to exponents sooner
    far = pc.match_substring(text, "e")
    if single:  # the float next to 1e-6 is less than that
        far = pc.or_(far, pc.and_(pc.less(pc.abs(a.cast(pa.float64())), 1e-6), pc.not_equal(a, pa.scalar(0, a.type))))
    far = pc.fill_null(far, False)
    if pc.any(far, min_count=0).as_py():
        own = a.filter(far).dictionary_encode()
        text = pc.replace_with_mask(text, far, _each(own.dictionary, lambda x: strict.float_text(x, single)).take(own.indices))
    return text


_ESCAPED = sorted(strict._QUOTE.items(), key=lambda e: e[0] != 0x5C)  # the backslash first, as all others give some


def _quoted_texts(a: pa.Array, html: bool) -> pa.Array:
    try:
        a.validate(full=True)
    except pa.ArrowInvalid:  # no UTF-8
        return _each(a.cast(pa.binary()), lambda t: strict.quote(t, html))
    a = pa.concat_arrays([a.cast(pa.string())])
    data = a.buffers()[2]
    found = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data is not None and data.size else np.zeros(256)
    for code, escape in (*_ESCAPED, *(strict.HTML if html else strict._LINES).items()):
        if found[chr(code).encode()[0]]:
            a = pc.replace_substring(a, chr(code), escape)
    return pc.binary_join_element_wise('"', a, '"', "")


def _zeros(a: pa.Array, kind: T.DataType) -> pa.Array:
    """What _zero says of each value."""
    if isinstance(kind, T.StructType):
        out = pa.array(np.ones(len(a), bool))
        for k, f in enumerate(kind.fields):
            out = pc.and_(out, _zeros(pc.struct_field(a, [k]), f.dataType))
    elif isinstance(kind, (*_WHOLE, T.FloatType, T.DoubleType)):
        out = pc.equal(a, pa.scalar(0, a.type))
    elif isinstance(kind, T.BooleanType):
        out = pc.invert(a)
    else:
        out = pc.equal(a, "") if isinstance(kind, T.StringType) else pa.array(np.zeros(len(a), bool))
    return pc.or_(pc.is_null(a), pc.fill_null(out, True))


def _texts(a: pa.Array, kind: T.DataType, options: Options) -> pa.Array:
    """The JSON of a column of values, all values of a type in one step."""
    if isinstance(kind, T.StructType):
        parts: list[Any] = []
        for k, f in enumerate(kind.fields):
            child, name = pc.struct_field(a, [k]), strict.quote(f.name, options.escape_html) + ":"
            text = _texts(child, f.dataType, options)
            if options.omit_zero_struct_fields:
                parts.append(pc.if_else(_zeros(child, f.dataType), "", pc.binary_join_element_wise(name, text, ",", "")))
            else:
                parts += [("," if k else "{") + name, text]
        if not parts:
            out = pa.array(["{}"] * len(a), pa.string())
        elif options.omit_zero_struct_fields:
            out = pc.binary_join_element_wise("{", *parts, "")
            out = pc.binary_join_element_wise(pc.if_else(pc.ends_with(out, ","), pc.utf8_slice_codeunits(out, 0, -1), out), "}", "")
        else:
            out = pc.binary_join_element_wise(*parts, "}", "")
        out = pc.if_else(pc.is_valid(a), out, "null")
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        bounds = a.offsets.to_numpy()
        first, count = (int(bounds[0]), int(bounds[-1] - bounds[0])) if len(bounds) else (0, 0)
        if isinstance(kind, T.ArrayType):
            items = _texts(a.values.slice(first, count), kind.elementType, options)
        else:
            keys, items = a.keys.slice(first, count).cast(pa.string()), a.items.slice(first, count)
            if options.sort_map_keys:
                row = np.repeat(np.arange(len(a)), np.diff(bounds))
                order = pc.sort_indices(pa.table({"row": row, "key": keys}), [("row", "ascending"), ("key", "ascending")])
                keys, items = keys.take(order), items.take(order)
            items = pc.binary_join_element_wise(_quoted_texts(keys, options.escape_html), _texts(items, kind.valueType, options), ":")
        lists = pa.ListArray.from_arrays(pa.array(bounds - first, pa.int32()), items)
        left, right = "[]" if isinstance(kind, T.ArrayType) else "{}"
        out = pc.if_else(pc.is_valid(a), pc.binary_join_element_wise(left, pc.binary_join(lists, ","), right, ""), "null")
    elif isinstance(kind, T.NullType):
        out = pa.nulls(len(a), pa.string())
    elif isinstance(kind, T.BooleanType):
        out = pc.if_else(a, "true", "false")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = _float_texts(a, isinstance(kind, T.FloatType))
    elif isinstance(kind, T.StringType):
        out = _quoted_texts(a, options.escape_html)
    elif isinstance(kind, T.BinaryType):
        out = _each(a, lambda x: f'"{base64.b64encode(x).decode()}"')
    else:
        out = a.cast(pa.string())
        if isinstance(kind, T.DecimalType) and pc.any(pc.match_substring(out, "E"), min_count=0).as_py():
            out = _each(a, lambda x: format(x, "f"))
    return pc.fill_null(out, "null")


def marshal_exact(value: Column, schema: T.DataType | str, options: Options = STD) -> Column:
    """JSON of any column of the given type: shortest floats, sorted map keys, base64 of BINARY; NaN and infinities end the query."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if _arrow(kind):

        def texts(values: pa.Array) -> pa.Array:
            return _texts(values, kind, options)

        texts.__annotations__ = {"values": pa.Array, "return": pa.Array}
        return F.arrow_udf(texts, "string")(value).alias("marshal")

    def run(batch: pd.DataFrame) -> pd.Series:
        rows = batch["v"] if "v" in batch else pd.Series([None] * len(batch))
        return pd.Series([encode_typed(_plain(x, kind), options) for x in rows], dtype=object)

    run.__annotations__ = {"batch": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, "string")(F.struct(value.alias("v"))).alias("marshal")


def marshal_indent(value: Column, schema: T.DataType | str, prefix: str = "", by: str = "\t", options: Options = STD) -> Column:
    p, b = prefix.encode(), by.encode()
    return column(lambda j: strict.indent(j.encode(), p, b).decode(), "string")(marshal_exact(value, schema, options)).alias("marshal")


_ZERO = r'(?:null|false|-?0(?:\.0+)?(?:[eE][+-]?[0-9]+)?|"")'
_ZERO_STRUCT = r'^\{(?:"(?:[^"\\]|\\.)*+":(?:' + _ZERO + r'|(?=\{))|[,{}])*+$'


def _omitted(col: Column, rule: list[str]) -> Column:
    """Whether the rule leaves the field out, by the type and value of the column."""
    kind, json = F.typeof(col), F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"})
    text = F.substring(json, F.lit(6), F.length(json) - 6)  # what stands between {"v": and }
    zero = ~kind.isin("variant") & text.rlike(f"^{_ZERO}$")
    if "omitempty" in rule:
        return col.isNull() | zero | (kind.startswith("array<") & (text == "[]")) | (kind.startswith("map<") & (text == "{}"))
    # a struct is zero if all its fields are, also those of structs in it; an empty map or array in it is no zero
    return col.isNull() | zero | (kind.startswith("struct<") & text.rlike(_ZERO_STRUCT) & ~text.contains("{}"))


_NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"


def _checked(col: Column, text: Column, message: str) -> Column:
    return F.when(col.isNull(), "null").when(text.isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit(message), F.left(col, F.lit(80)))).cast("string"))


def object_of(*fields: tuple, options: Options = STD, df: DataFrame | None = None) -> Column:
    """JSON of an object built field by field: (name, column), or (name, column, rule).

    Rules: 'omitempty' leaves the field out if it is null, false, 0, '' or an
    empty array or map (a struct never is empty); 'omitzero' if it is null or
    the zero of its type, for a struct all fields zero (empty collections stay);
    'string' writes the value inside a string; 'number' writes the digits that a
    text holds (none: 0) and 'raw' the document that it holds, compacted, and
    both end the query if it holds none.  df, the rows that the columns
    belong to, is needed for floats and other types that marshal cannot write.
    """
    parts = []
    for name, col, *rule in fields:
        key = F.lit(strict.quote(name, options.escape_html) + ":")
        if "number" in rule:
            text = _checked(col, F.when(col == "", "0").when(col.rlike(_NUMBER), col), "invalid number literal: ")
        elif "raw" in rule:
            text = _checked(col, html_escape(compact(col)) if options.escape_html else line_escape(compact(col)), "invalid raw value: ")
        else:
            text = marshal_in(df, col, options) if df is not None else marshal(col, options)
        if "string" in rule:
            text = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        entry = F.concat(key, F.coalesce(text, F.lit("null")))
        if "omitempty" in rule or "omitzero" in rule:
            entry = F.when(_omitted(col, rule), None).otherwise(entry)
        parts.append(entry)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
