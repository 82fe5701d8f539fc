"""Text to text: compact, indent, escapes, edits."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import strict
from .exact import RESULT, _try, as_bytes, column, result
from .validate import is_valid

#: What HTML escaping replaces.
HTML = (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"))


def compact(json: Column) -> Column:
    """Without white space outside strings, null if invalid; numbers and escapes keep their text."""
    return F.when(is_valid(json), F.regexp_replace(json, r'("(?:[^"\\]|\\.)*+")|[ \t\r\n]+', "$1"))


def compact_exact(json: Column) -> Column:
    """struct<value, error, offset>."""
    return result(lambda j: strict.compact(as_bytes(j)))(json)


def indent(json: Column, prefix: str = "", by: str = "\t") -> Column:
    """struct<value, error, offset>: an element a line."""
    p, b = prefix.encode(), by.encode()
    return result(lambda j: strict.indent(as_bytes(j), p, b))(json)


def line_escape(json: Column) -> Column:
    """The two line separators, which are escaped in every string that is written."""
    for a, b in HTML[3:]:
        json = F.replace(json, F.lit(a), F.lit(b))
    return json


def html_escape(json: Column) -> Column:
    """Neither parsed nor checked: five replacements."""
    for a, b in HTML:
        json = F.replace(json, F.lit(a), F.lit(b))
    return json


def lower_hex(json: Column) -> Column:
    """Escapes of control characters, which Spark writes with capital letters, with small ones."""
    fixed = json
    for k in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        # an escaped backslash before the u is no escape of a control character
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u00{k:02X}", rf"$1\\u00{k:02x}")
    return F.when(json.rlike(r"\\u00[01][A-F]"), fixed).otherwise(json)


def quote(text: Column, html: bool = True) -> Column:
    """A string literal of a STRING, inside whole-stage code; quote_bytes takes BINARY."""
    json = F.to_json(F.array(text.cast("string")))
    out = lower_hex(F.substring(json, F.lit(2), F.length(json) - 2))
    return F.when(text.isNotNull(), html_escape(out) if html else line_escape(out))


def quote_bytes(data: Column, html: bool = True) -> Column:
    """A string literal of a BINARY; each byte that is no UTF-8 becomes the six characters of U+FFFD's escape."""
    return column(lambda t: strict.quote(bytes(t), html), "string")(data)


def unquote(literal: Column) -> Column:
    return column(lambda t: strict.unquote(as_bytes(t)), "string")(literal)


# For Arrow's regular expressions: an object of scalars, keys without escapes; with such, a name is a key byte by byte.
_WS = r"[ \t\n\r]*"
_SCALAR = r'(?:"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)'
_MEMBER = rf'"[^"\\\x00-\x1f]*"{_WS}:{_WS}{_SCALAR}'
_ALONE = rf"^{_WS}(?P<raw>{_SCALAR}){_WS}\z"
_FLAT = rf"^(?P<left>{_WS}\{{(?:{_WS}{_MEMBER}(?:{_WS},{_WS}{_MEMBER})*)?)(?P<right>{_WS}\}}{_WS})\z"
_FIRST = (('"', "string"), ("t", "bool"), ("f", "bool"), ("n", "null"))


def _sound(a: pa.Array) -> pa.Array | None:
    """A STRING array of valid UTF-8, or None."""
    try:
        a = a.cast(pa.string())
        a.validate(full=True)
    except pa.ArrowInvalid:
        return None
    return a


def _set_flat(docs: pa.Array, parts: tuple[str, ...], raw: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Texts and errors of set_raw, all rows in one step: of objects of scalars; both null for all other documents."""
    name, *below = (strict.unescape_part(p) for p in parts)
    key = "".join(rf"\x{{{ord(c):x}}}" for c in name)
    hit = pc.extract_regex(docs, rf'^(?P<left>{_WS}\{{{_WS}(?:{_MEMBER}{_WS},{_WS})*?"{key}"{_WS}:{_WS})(?P<old>{_SCALAR})(?P<right>(?:{_WS},{_WS}{_MEMBER})*{_WS}\}}{_WS})\z')
    part = lambda m, k: pc.struct_field(m, k)
    values, errors = pa.nulls(len(docs), pa.string()), pa.nulls(len(docs), pa.string())
    if not below:
        values = pc.binary_join_element_wise(part(hit, "left"), raw, part(hit, "right"), "")
    else:
        first, kind = pc.utf8_slice_codeunits(part(hit, "old"), 0, 1), pa.scalar("number")
        for c, k in _FIRST:
            kind = pc.if_else(pc.equal(first, c), k, kind)
        errors = pc.if_else(pc.is_valid(raw), pc.binary_join_element_wise("a ", kind, f" has no member {below[0]!r}", ""), errors)
    missing = pc.is_null(hit)
    if pc.any(missing, min_count=0).as_py():
        flat = pc.extract_regex(pc.if_else(missing, docs, pa.scalar(None, pa.string())), _FLAT)
        left, right = part(flat, "left"), part(flat, "right")
        try:
            before, after = strict._build(parts[1:], b"\0").decode().split("\0")
        except strict.JsonError as e:
            errors = pc.coalesce(errors, pc.if_else(pc.and_(pc.is_valid(flat), pc.is_valid(raw)), e.message, pa.scalar(None, pa.string())))
        else:
            comma = pc.if_else(pc.ends_with(left, "{"), "", ",")
            values = pc.coalesce(values, pc.binary_join_element_wise(left, comma, strict.quote(name, html=False) + ":" + before, raw, after, right, ""))
    return values, errors


def _set(path: str, sound: bool):
    parts = strict._parts(path)
    simple = parts and path.isprintable() and not any(strict.is_wild(p) for p in parts) and not set(strict.unescape_part(parts[0])) & set('"\\')
    one = _try(lambda j, r: strict.set_raw(as_bytes(j), path, as_bytes(r)))

    def run(docs: pa.Array, raw: pa.Array) -> pa.Array:
        n = len(docs)
        values, errors, offsets = pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())
        texts, news = (_sound(docs), _sound(raw)) if simple else (None, None)
        if texts is not None and news is not None:
            if not sound:
                news = pc.struct_field(pc.extract_regex(news, _ALONE), "raw")
            values, errors = _set_flat(texts, parts, news)
            offsets = pc.if_else(pc.is_valid(errors), pa.scalar(0, pa.int64()), offsets)
        todo = pc.and_(pc.and_(pc.is_null(values), pc.is_null(errors)), pc.and_(pc.is_valid(docs), pc.is_valid(raw)))
        if pc.any(todo, min_count=0).as_py():
            rows = zip(docs.filter(todo).to_pylist(), raw.filter(todo).to_pylist(), strict=True)
            own = [pa.array(x, t) for x, t in zip(zip(*(one(j, r) for j, r in rows), strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)]
            values, errors, offsets = (pc.replace_with_mask(a, todo, b) for a, b in zip((values, errors, offsets), own, strict=True))
        return pa.StructArray.from_arrays([values, errors, offsets], ["value", "error", "offset"])

    run.__annotations__ = {"docs": pa.Array, "raw": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT)


def set_raw_path(json: Column, path: str, raw: Column) -> Column:
    """struct<value, error, offset>: the document with raw JSON at path, all other bytes as they were."""
    return _set(path, sound=False)(json, raw)


def set_path(json: Column, path: str, value: Column) -> Column:
    """struct<value, error, offset>: the document with the encoded value at path."""
    from .encode import marshal

    return _set(path, sound=True)(json, marshal(value))


def delete_path(json: Column, path: str) -> Column:
    """struct<value, error, offset>: the document without the member at path."""
    return result(lambda j: strict.delete(as_bytes(j), path))(json)
