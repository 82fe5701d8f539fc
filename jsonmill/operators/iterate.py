"""From documents to rows of elements, fields and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import strict
from .exact import as_bytes, column

MEMBERS = "array<struct<pos:int,key:string,value:string>>"
TOKENS = "array<struct<ord:int,depth:int,kind:string,text:string>>"


def elements(v: Column) -> Column:
    """array<variant> of an array VARIANT, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def for_each(df: DataFrame, v: Column, pos: str = "pos", value: str = "value") -> DataFrame:
    """A row per array element with its position."""
    return df.select("*", F.posexplode(elements(v)).alias(pos, value))


def keys(json: Column) -> Column:
    """Field names in document order, equal ones too."""
    return F.json_object_keys(json)


def for_each_key(df: DataFrame, json: Column, pos: str = "pos", key: str = "key") -> DataFrame:
    return df.select("*", F.posexplode(keys(json)).alias(pos, key))


def _members(j):
    data = as_bytes(j)
    e = strict.find(data, "")
    if e is None or strict.kind_at(data, e[0]) not in ("array", "object"):
        return None
    return [
        {"pos": n, "key": strict.unquote(data[k[0] : k[1]]) if k else None, "value": strict.repair(data[a:z])}
        for n, (k, a, z) in enumerate(strict.members(data, e[0], strict._plain(data)))
    ]


def members(json: Column) -> Column:
    """(pos, key, value text) of each child in document order, equal keys too; key is null in arrays."""
    return column(_members, MEMBERS)(json)


def for_each_member(df: DataFrame, json: Column, alias: str = "member") -> DataFrame:
    return df.select("*", F.explode(members(json)).alias(alias))


def variant_members(df: DataFrame, v: str) -> DataFrame:
    """pos, key, value of a VARIANT's children without Python: keys sorted, the last of equal ones."""
    name = v.replace("`", "``").replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql("SELECT t.*, m.pos, m.key, m.value FROM {rows} t, LATERAL variant_explode(t.`" + name + "`) m", rows=df)


def take_while(items: Column, holds) -> Column:
    """The elements before the first for which holds(x) is not true."""
    stop = F.array_position(F.transform(items, lambda x: F.coalesce(holds(x), F.lit(False))), False)
    return F.when(stop == 0, items).otherwise(F.slice(items, F.lit(1), (stop - 1).cast("int")))


def _token_rows(j):
    data, out = as_bytes(j), []
    try:
        for a, z in strict.values(data):
            for t in strict.tokens(data, a, whole=False):
                raw = data[t.start : t.end]
                text = strict.unquote(raw) if t.kind in ("key", "string") else raw.decode()
                out.append({"ord": len(out), "depth": t.depth, "kind": "string" if t.kind == "key" else t.kind if t.kind not in "{}[]" else "delim", "text": text})
    except strict.JsonError as e:
        out.append({"ord": len(out), "depth": 0, "kind": "error", "text": e.message})
    return out


def tokens(json: Column) -> Column:
    """Tokens in order: commas and colons left out, keys are strings; at a fault one of kind 'error'."""
    return column(_token_rows, TOKENS)(json)


class TokenTable:
    """The UDTF json_tokens(json): one row per token."""

    def eval(self, json: str):
        for r in _token_rows(json) if json is not None else ():
            yield r["ord"], r["depth"], r["kind"], r["text"]


def register_udtf(spark) -> None:
    schema = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
    spark.udtf.register("json_tokens", F.udtf(TokenTable, returnType=schema))


def _split_rows(j):
    data, out = as_bytes(j), []
    try:
        for a, z in strict.values(data):
            out.append({"start": a, "end": z, "value": strict.repair(data[a:z]), "error": None})
    except strict.JsonError as e:
        out.append({"start": e.offset - 1, "end": len(data), "value": None, "error": e.message})
    return out


def split_values(text: Column) -> Column:
    """The values of a text that holds several, with or without space between; the last entry tells a fault, the ones before it stand."""
    return column(_split_rows, "array<struct<start:long,end:long,value:string,error:string>>")(text)
