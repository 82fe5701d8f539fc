"""JSON text to typed columns."""

from __future__ import annotations

import base64
import datetime
import re
from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import strict
from .exact import as_bytes
from .validate import is_valid

MAX_EMBEDDING = 10


@dataclass(frozen=True)
class Field:
    """A field of a target: its name in JSON, its type, and its rules.

    embed: the fields of this Schema count as fields of the one around it, less
    dominant the deeper they are.
    """

    name: str
    kind: str = ""
    string: bool = False
    embed: Schema | None = None
    tagged: bool = True


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...] = field(default=())
    name: str = ""

    def plan(self) -> list[Field]:
        """The fields that count: of one name the shallowest; then the one that is tagged; else none of them."""
        found: dict[str, list[tuple[int, Field]]] = {}
        order: list[str] = []

        def walk(s: Schema, depth: int) -> None:
            if depth > MAX_EMBEDDING:
                return
            for f in s.fields:
                if f.embed is not None:
                    walk(f.embed, depth + 1)
                    continue
                if f.name not in found:
                    order.append(f.name)
                found.setdefault(f.name, []).append((depth, f))

        walk(self, 0)
        out = []
        for name in order:
            least = min(d for d, _ in found[name])
            top = [f for d, f in found[name] if d == least]
            if len(top) > 1:
                top = [f for f in top if f.tagged]
            if len(top) == 1:
                out.append(top[0])
        return out

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T._parse_datatype_string(f.kind)) for f in self.plan()])


def schema(*fields: tuple | Field, name: str = "") -> Schema:
    return Schema(tuple(f if isinstance(f, Field) else Field(*f) for f in fields), name)


def unmarshal(json: Column, ddl: str) -> Column:
    """A struct from valid documents, null for all others; inside whole-stage code.

    from_json matches names by case and reads a number into a string; where that
    matters, use unmarshal_exact.
    """
    return F.when(is_valid(json), F.from_json(json, ddl, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}))


def decode_value(v: Column, ddl: str) -> Column:
    """A part of a parsed document, or all of it, as any type; null for a null VARIANT and what does not fit.

    The text is not read again: only the part is written and decoded, inside
    whole-stage code.  For the first misfit, give to_json of it to unmarshal_detail.
    """
    boxed = F.concat(F.lit('{"v":'), F.to_json(v), F.lit("}"))
    return F.from_json(boxed, f"v {ddl}", {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})["v"]


def unknown_fields(json: Column, *names: str) -> Column:
    """The keys of an object that no name fits, in either case."""
    known = F.array(*[F.lit(n.lower()) for n in names])
    return F.filter(F.json_object_keys(json), lambda k: ~F.array_contains(known, F.lower(k)))


_RFC3339 = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", re.A)
_RANGES = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


@dataclass(frozen=True)
class Misfit:
    """A value that does not fit: what it is, the type wanted, the path of struct fields, and the way to it (None: no position)."""

    what: str
    kind: str
    names: str
    trail: tuple[str | int, ...] | None
    depth: int

    def offset(self, data: bytes) -> int:
        """After the value; of an object or array, after its bracket; 0 without a position."""
        if self.trail is None:
            return 0
        at, end, plain = strict._skip(data, 0), len(data.rstrip(strict.WHITE)), strict._plain(data)
        for part in self.trail:
            for n, (key, a, z) in enumerate(strict.members(data, at, plain)):
                # of equal keys the last was read
                if n == part if key is None else strict.unquote(data[key[0] : key[1]]) == part:
                    hit = a, z
            at, end = hit
        return at + 1 if data[at] in b"[{" else end


class _Reader:
    """Walks a parsed tree along a type; the first misfit is kept and the rest still read."""

    def __init__(self, disallow_unknown: bool = False, hooks: Collection[str] = ()) -> None:
        self.hooks = hooks
        self.error: str | None = None
        self.misfit: Misfit | None = None
        self.disallow_unknown = disallow_unknown
        self.trail: list[str | int] = []  # keys and positions down to where the reader is
        self.names: list[str] = []  # the struct fields among them

    def fail(self, what: str, path: str, kind: str, placed: bool = True) -> None:
        if self.error is None:
            self.error = f"cannot decode {what} into {f'field {path} of type ' if path else ''}{kind}"
            self.misfit = Misfit(what, kind, ".".join(self.names), tuple(self.trail) if placed else None, len(self.names))

    def child(self, key: str | int, v: Any, kind: T.DataType, path: str, string: bool = False, name: str | None = None) -> Any:
        self.trail.append(key)
        if name is not None:
            self.names.append(name)
        out = self.read(v, kind, path, string)
        self.trail.pop()
        if name is not None:
            self.names.pop()
        return out

    def read(self, v: Any, kind: T.DataType, path: str, string: bool = False) -> Any:
        if v is None:
            return None
        name = kind.simpleString()
        if string:
            if not isinstance(v, str) or isinstance(v, strict.Number):
                self.fail(_what(v), path, f"{name} in a string")
                return None
            if v == "null":
                return None
            if isinstance(kind, T.StringType):
                return strict.unquote(v.encode()) if strict.valid(v.encode()) and v.startswith('"') else self.fail("string", path, "string in a string")
            if not strict.valid(v.encode()) or v != v.strip():
                self.fail(f"string {v!r}", path, f"{name} in a string")
                return None
            return self.read(strict.decode(v.encode(), True), kind, path)
        if isinstance(kind, T.BooleanType):
            return v if isinstance(v, bool) else self.fail(_what(v), path, name)
        if type(kind) in _RANGES or (isinstance(kind, T.DecimalType) and kind.scale == 0):
            if not isinstance(v, strict.Number) or any(c in v for c in ".eE"):
                return self.fail(f"number {v}" if isinstance(v, strict.Number) else _what(v), path, name)
            x = int(v)
            if type(kind) in _RANGES:
                half = 1 << _RANGES[type(kind)] - 1
                return x if -half <= x < half else self.fail(f"number {v}", path, name)
            import decimal

            return decimal.Decimal(x) if 0 <= x < 10**kind.precision else self.fail(f"number {v}", path, name)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            if not isinstance(v, strict.Number):
                return self.fail(_what(v), path, name)
            x = float(v)
            if isinstance(kind, T.FloatType):
                import numpy as np

                with np.errstate(over="ignore"):
                    x = float(np.float32(str(v)))
            return self.fail(f"number {v}", path, name) if x in (float("inf"), float("-inf")) else x
        if isinstance(kind, T.StringType):
            return str(v) if isinstance(v, str) and not isinstance(v, strict.Number) else self.fail(_what(v), path, name)
        if isinstance(kind, T.BinaryType):
            if isinstance(v, list):
                got = [self.read(x, T.ShortType(), path) for x in v]
                return bytes(x or 0 for x in got) if all(0 <= (x or 0) < 256 for x in got) else self.fail("array", path, name)
            try:
                return base64.b64decode(v, validate=True) if isinstance(v, str) and not isinstance(v, strict.Number) else self.fail(_what(v), path, name)
            except ValueError:
                return self.fail("string", path, name)
        if isinstance(kind, T.ArrayType):
            return [self.child(n, x, kind.elementType, path) for n, x in enumerate(v)] if isinstance(v, list) else self.fail(_what(v), path, name)
        if isinstance(kind, T.MapType):
            if not isinstance(v, dict):
                return self.fail(_what(v), path, name)
            out = {}
            for k, x in v.items():
                key: Any = k
                if not isinstance(kind.keyType, T.StringType):
                    try:
                        key = self.read(strict.Number(k), kind.keyType, path) if k.lstrip("-").isdigit() else self.fail(f"key {k!r}", path, name, placed=False)
                    except ValueError:
                        key = self.fail(f"key {k!r}", path, name, placed=False)
                    if key is None:
                        continue
                out[key] = self.child(k, x, kind.valueType, f"{path}.{k}" if path else k)
            return out
        if isinstance(kind, T.StructType):
            return self.struct(v, [Field(f.name, f.dataType.simpleString()) for f in kind.fields], kind, path)
        if isinstance(kind, T.TimestampType):
            try:
                return datetime.datetime.fromisoformat(v) if _RFC3339.fullmatch(v) else self.fail(_what(v), path, name)
            except (TypeError, ValueError):
                return self.fail(_what(v), path, name)
        return self.fail(_what(v), path, name)

    def struct(self, v: Any, fields: list[Field], kind: T.StructType, path: str) -> dict | None:
        if not isinstance(v, dict):
            return self.fail(_what(v), path, "struct")
        out: dict[str, Any] = dict.fromkeys(f.name for f in fields)
        exact = {f.name: k for k, f in enumerate(fields)}
        folded: dict[str, int] = {}
        for k, f in enumerate(fields):
            folded.setdefault(_fold(f.name), k)
        for key, x in v.items():
            k = exact.get(key, folded.get(_fold(key)))
            if k is None:
                if self.disallow_unknown:
                    self.error = self.error or f"unknown field {key!r}"
                continue
            f = fields[k]
            if f.name in self.hooks and not path:
                continue
            out[f.name] = self.child(key, x, kind.fields[k].dataType, f"{path}.{f.name}" if path else f.name, f.string, f.name)
        return out


def _fold(name: str) -> str:
    """Lower case of A-Z only."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)


def _what(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, strict.Number) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


DETAIL = "what string, type string, struct string, field string, offset long"


def _hooked(data: bytes, hooks: Mapping[str, Callable[[str], Any]]) -> dict[str, Any]:
    """What the hooks make of the raw text of their fields; a field that is not there is not asked for."""
    at, plain, out = strict._skip(data, 0), strict._plain(data), {}
    if data[at : at + 1] != b"{":
        return out
    folded = {_fold(n): n for n in hooks}
    for key, a, z in strict.members(data, at, plain):
        text = strict.unquote(data[key[0] : key[1]])
        name = text if text in hooks else folded.get(_fold(text))
        if name is not None:
            out[name] = strict.repair(data[a:z])
    return {n: hooks[n](raw) for n, raw in out.items()}


def _decoder(target: Schema | str, disallow_unknown: bool, hooks: Mapping[str, Callable[[str], Any]], detail: bool) -> Callable[[Column], Column]:
    if isinstance(target, Schema):
        fields, kind, title = target.plan(), target.struct(), target.name
    else:
        kind = T._parse_datatype_string(target)
        fields, title = [Field(f.name, f.dataType.simpleString()) for f in kind.fields], ""

    more = T._parse_datatype_string(DETAIL).fields if detail else []
    whole = T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType()), *more])
    shape, names, maps = to_arrow_type(whole), whole.names, "map<" in kind.simpleString()

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for j in rows.to_pylist():
            value, error, parts = None, None, (None,) * 5
            if j is not None:
                data = as_bytes(j)
                try:
                    reader = _Reader(disallow_unknown, hooks)
                    value = reader.struct(strict.decode(data, True), fields, kind, "")
                    if hooks and value is not None:
                        value |= _hooked(data, hooks)
                    error, m = reader.error, reader.misfit
                    if detail and m is not None:
                        # the innermost struct's name: only the outermost has one
                        parts = (m.what, m.kind, title if m.depth == 1 else "", m.names, m.offset(data))
                except strict.JsonError as e:
                    value, error, parts = None, e.message, (None, None, None, None, e.offset)
            out.append(dict(zip(names, (_pairs(value, kind) if maps else value, error, *parts), strict=False)))
        return pa.array(out, shape)

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, whole)


def _pairs(v: Any, kind: T.DataType) -> Any:
    """The value with each map as Arrow takes it, a list of pairs."""
    if v is None:
        return None
    if isinstance(kind, T.MapType):
        return [(k, _pairs(x, kind.valueType)) for k, x in v.items()]
    if isinstance(kind, T.ArrayType):
        return [_pairs(x, kind.elementType) for x in v]
    return {f.name: _pairs(v[f.name], f.dataType) for f in kind.fields} if isinstance(kind, T.StructType) else v


def unmarshal_exact(json: Column, target: Schema | str, disallow_unknown: bool = False, hooks: Mapping[str, Callable[[str], Any]] | None = None) -> Column:
    """struct<value, error>: the decoded struct and the first misfit.

    Names fit exactly or else in either case; a misfit leaves its field null and
    the others are read; text that is no document gives no value.  hooks: fields
    of the document's object that a function decodes from their raw text, 'null'
    too; what it raises ends the query, other than a JsonError, which is the error.
    """
    return _decoder(target, disallow_unknown, hooks or {}, False)(json)


def unmarshal_detail(json: Column, target: Schema | str, disallow_unknown: bool = False) -> Column:
    """unmarshal_exact with the misfit in parts: struct<value, error, what, type, struct, field, offset>.

    what: the kind of the JSON value, a number with its digits; type: the one
    wanted; struct: the schema's name, '' if the misfit is in a struct within
    it; field: its path of struct fields; offset: after the value, or after the
    bracket of an object or array, 0 for a map's key.  Of text that is no
    document only error and offset are told; of an unknown field only error.
    """
    return _decoder(target, disallow_unknown, {}, True)(json)


def text_hook(fn: Callable[[str], Any]) -> Callable[[str], Any]:
    """A hook for unmarshal_exact that is given the text of a string; null stays null, other values are the row's error."""

    def run(raw: str) -> Any:
        if raw == "null":
            return None
        if not raw.startswith('"'):
            raise strict.TypeFault(f"cannot decode {strict.kind_at(raw.encode(), 0)} into text")
        return fn(strict.unquote(raw.encode()))

    return run


def with_defaults(value: Column, **defaults: Any) -> Column:
    """A struct whose null fields take defaults: null leaves a scalar as it was."""
    for name, d in defaults.items():
        value = value.withField(name, F.coalesce(value[name], F.lit(d)))
    return value


def number_text(json: Column, path: str) -> Column:
    """The digits of a number as they stand, null for anything else."""
    from .navigate import path_exact

    raw = path_exact(json, path)
    return F.when(raw.rlike(r"^-?[0-9]"), raw)


def fixed_array(items: Column, size: int, zero: Column) -> Column:
    """An array of exactly `size`: what is beyond is dropped, what is missing is zero; null stays null."""
    return F.when(items.isNotNull(), F.slice(F.concat(items, F.array_repeat(zero, size)), 1, size))


def any_tree(json: Column, use_number: bool = False) -> Column:
    """The document as it decodes into a free tree and is written again: keys sorted, the last of equal ones, numbers as doubles (or as their text).

    struct<value, error, offset>.
    """
    from .exact import result

    return result(lambda j: strict.encode(strict.decode(as_bytes(j), use_number)).encode())(json)
