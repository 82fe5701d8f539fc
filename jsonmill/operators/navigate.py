"""Paths into documents and the values found there.

Built on VARIANT: one parse serves all paths of a document, and Catalyst sees
plain expressions.  A VARIANT keeps the last of equal keys and no key order;
the exact functions find the first and know the order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import strict
from .exact import as_bytes, column

_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def _child(v: Column, key: str) -> Column | None:
    if "'" in key or "\\" in key:
        return None if '"' in key or "\\" in key else F.try_variant_get(v, f'$["{key}"]', "variant")
    return F.try_variant_get(v, f"$['{key}']", "variant")


def path(v: Column, dotted: str) -> Column:
    """The VARIANT at a dotted path of a VARIANT, null if there is none.

    A number names an element of an array and a key of an object, whichever is
    there.  Wildcards and keys that variant paths cannot name need path_exact.
    """
    for part in strict.split_path(dotted):
        name = strict.unescape_part(part)
        child = None if strict.is_wild(part) else _child(v, name)
        if child is None:
            raise ValueError(f"path part {part!r} needs path_exact")
        n = strict.part_index(name)
        v = F.coalesce(F.try_variant_get(v, f"$[{n}]", "variant"), child) if n is not None and n < 1 << 31 else child
    return v


def get(v: Column, *keys: str) -> Column:
    """Object keys only, one after another."""
    for k in keys:
        v = _child(v, k)
        if v is None:
            raise ValueError("a key with both kinds of quotes or a backslash needs path_exact")
    return v


def index(v: Column, n: int) -> Column:
    return F.try_variant_get(v, f"$[{n}]", "variant") if n >= 0 else F.lit(None).cast("variant")


def get_path(json: Column, dotted: str) -> Column:
    return path(F.try_parse_json(json), dotted)


def get_many(json: Column, *paths: str) -> Column:
    """struct<p0, p1, ...> of VARIANTs from one parse; all null for an invalid document."""
    from .validate import parse

    v = parse(json)
    return F.struct(*[path(v, p).alias(f"p{k}") for k, p in enumerate(paths)])


def path_exact(json: Column, dotted: str) -> Column:
    """The value's text as it stands in the document (Raw), by the first of equal keys; wildcards in document order."""

    def run(j):
        data = as_bytes(j)
        e = strict.find(data, dotted)
        return None if e is None else strict.repair(data[e[0] : e[1]])

    return column(run, "string")(json)


raw = path_exact


def first_key(json: Column, key: str) -> Column:
    """The first field of that name, as VARIANT; null for a name with a wildcard, which a path cannot spell."""
    if strict.is_wild(key):
        return F.lit(None).cast("variant")
    return F.try_parse_json(path_exact(json, "".join("\\" + c if c in ".\\" else c for c in key)))


# --- values -----------------------------------------------------------------------------------


def kind(v: Column) -> Column:
    """invalid, null, bool, number, string, array or object."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "invalid")
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "bool")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def exists(v: Column) -> Column:
    return v.isNotNull()


def is_null(v: Column) -> Column:
    return v.isNotNull() & F.is_variant_null(v)


def as_string(v: Column) -> Column:
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string")).otherwise("")


def as_int(v: Column) -> Column:
    """A whole number; a fraction is cut off; 0 for what is no number."""
    return F.when(kind(v) == "number", F.coalesce(F.try_variant_get(v, "$", "bigint"), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def as_float(v: Column) -> Column:
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double")).otherwise(F.lit(0.0))


def as_bool(v: Column) -> Column:
    return F.coalesce((kind(v) == "bool") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def as_time(v: Column) -> Column:
    """A timestamp from RFC 3339 text, null for anything else."""
    s = as_string(v)
    return F.when(s.rlike(_TIME), F.try_to_timestamp(F.when(s.rlike(_TIME), s)))


def length(json: Column) -> Column:
    """Elements of an array or fields of an object, equal keys counted; else 0."""
    return F.coalesce(F.json_array_length(json), F.size(F.json_object_keys(json)), F.lit(0)).cast("int")
