"""One query per operator over the test tables, and the SQL that says what it must give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import decode, encode, iterate, navigate, rewrite, validate
from ..session import configure, shared_folder
from ..sources import ndjson, ranges
from ..streaming.carry import carry_forward, carry_forward_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that all executors can write to."""
    return f"{shared_folder(spark)}/jsonmill-{tag}-{uuid.uuid4().hex}"


def tasks_of(rows: DataFrame, rows_each: int) -> int:
    """How many tasks give each about that many rows, so that no task's share grows with the table."""
    return -(-rows.count() // rows_each) or 1


def props(table) -> DataFrame:
    return table("events").select("event_id", "props")


# --- navigation -------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def path_int(spark, table):
    return props(table).select("event_id", navigate.as_int(navigate.get_path(F.col("props"), "k")).alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, false AS has_missing, 'number' AS kind, 'invalid' AS missing_kind FROM events")
def get_many(spark, table):
    found = props(table).withColumn("g", navigate.get_many(F.col("props"), "k", "missing.x"))
    return found.select("event_id", navigate.as_int(F.col("g.p0")).alias("k"), navigate.exists(F.col("g.p1")).alias("has_missing"), navigate.kind(F.col("g.p0")).alias("kind"), navigate.kind(F.col("g.p1")).alias("missing_kind"))


@query("SELECT event_id FROM events WHERE event_id % 3 = 0")
def exists_filter(spark, table):
    doc = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.lit('{"other":1}'))
    return props(table).filter(navigate.exists(navigate.get_path(doc, "k"))).select("event_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def raw_text(spark, table):
    return props(table).select("event_id", navigate.raw(F.col("props"), "k").alias("k"))


def customers(table) -> DataFrame:
    """A document per customer: {"name", "orders": [{"id", "status"}], "0": number of orders}."""
    o = table("orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).alias("o"))
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o")).alias("orders"))
    doc = F.to_json(F.struct(F.concat(F.lit("c"), F.col("o_custkey")).alias("name"), "orders", F.size("orders").alias("0")))
    return per.select(F.col("o_custkey").alias("custkey"), doc.alias("doc"))


@query("SELECT o_custkey AS custkey, min(o_orderkey)::BIGINT AS first_id, count(*)::BIGINT AS zero, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def path_nested(spark, table):
    v = F.try_parse_json("doc")
    at = lambda p: navigate.path(v, p)
    return customers(table).select(
        "custkey", navigate.as_int(at("orders.0.id")).alias("first_id"), navigate.as_int(at("0")).alias("zero"), navigate.as_string(at("orders.00.status")).alias("status")
    )


@query("SELECT o_custkey AS custkey, 'c' || o_custkey AS by_star, count(*)::BIGINT AS by_mark, min(o_orderkey)::BIGINT AS in_array FROM orders GROUP BY 1")
def path_wildcard(spark, table):
    d = F.col("doc")
    return customers(table).select(
        "custkey",
        rewrite.unquote(navigate.path_exact(d, "n*e")).alias("by_star"),
        navigate.path_exact(d, "?").cast("bigint").alias("by_mark"),
        navigate.path_exact(d, "orders.*.id").cast("bigint").alias("in_array"),
    )


@query("SELECT o_custkey AS custkey, count(*)::BIGINT AS n, 3::BIGINT AS fields FROM orders GROUP BY 1")
def value_len(spark, table):
    return customers(table).select("custkey", navigate.length(F.to_json(navigate.get_path(F.col("doc"), "orders"))).cast("bigint").alias("n"), navigate.length(F.col("doc")).cast("bigint").alias("fields"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'invalid' ELSE 'bool' END AS kind, event_id % 3 = 0 AS is_null, event_id % 3 <> 1 AS there, event_id % 3 = 2 AS b FROM events")
def null_vs_missing(spark, table):
    m = F.col("event_id") % 3
    v = navigate.get(F.try_parse_json(F.when(m == 0, '{"a":null}').when(m == 1, "{}").otherwise('{"a":true}')), "a")
    return table("events").select("event_id", navigate.kind(v).alias("kind"), navigate.is_null(v).alias("is_null"), navigate.exists(v).alias("there"), navigate.as_bool(v).alias("b"))


@query("SELECT event_id, event_id AS first, event_id + 2 AS last, 3::BIGINT AS n FROM events")
def duplicate_keys(spark, table):
    e = F.col("event_id")
    doc = F.concat(F.lit('{"a":'), e, F.lit(',"b":0,"a":'), e + 2, F.lit("}"))
    return table("events").select("event_id", navigate.path_exact(doc, "a").cast("bigint").alias("first"), navigate.as_int(navigate.get_path(doc, "a")).alias("last"), navigate.length(doc).cast("bigint").alias("n"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS at, event_id % 2 = 0 AS plain FROM events")
def value_time(spark, table):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    v = F.try_parse_json(F.concat(F.lit('{"t":"'), text, F.lit('","d":"'), F.when(F.col("event_id") % 2 == 0, "2024-01-02").otherwise(text), F.lit('"}')))
    return table("events").select("event_id", F.unix_seconds(navigate.as_time(navigate.get(v, "t"))).alias("at"), navigate.as_time(navigate.get(v, "d")).isNull().alias("plain"))


# --- validity ---------------------------------------------------------------------------------


def doctored(table) -> DataFrame:
    """Every seventh document has a bracket too many."""
    return props(table).select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("]"))).otherwise(F.col("props")).alias("doc"))


@query("SELECT event_id, event_id % 7 <> 0 AS valid FROM events")
def valid_flag(spark, table):
    return doctored(table).select("event_id", validate.is_valid(F.col("doc")).alias("valid"))


@query("SELECT event_id, event_id % 7 <> 0 AS valid FROM events")
def valid_exact(spark, table):
    return doctored(table).select("event_id", validate.is_valid_exact(F.col("doc")).alias("valid"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN length(props) + 1 ELSE 0 END::BIGINT AS fault_at FROM events")
def syntax_error(spark, table):
    return doctored(table).select("event_id", F.coalesce(validate.syntax_error(F.col("doc"))["offset"], F.lit(0)).alias("fault_at"))


@query("SELECT event_id, 2::BIGINT AS start_at, (length(props) + 2)::BIGINT AS end_at, true AS ok, ' 77' AS rest FROM events")
def skip_value(spark, table):
    doc = F.concat(F.lit("  "), F.col("props"), F.lit(" 77"))
    s = validate.skip(doc)
    return props(table).select("event_id", s["start"].alias("start_at"), s["end"].alias("end_at"), s["ok"].alias("ok"), ndjson.remainder(doc).alias("rest"))


@query("SELECT r_regionkey, r_name || chr(65533) || chr(65533) AS repaired, false AS valid FROM region")
def utf8_repair(spark, table):
    b = F.concat(F.col("r_name").cast("binary"), F.unhex(F.lit("E697")))
    return table("region").select("r_regionkey", validate.repair_utf8(b).alias("repaired"), validate.is_utf8(b).alias("valid"))


# --- iteration --------------------------------------------------------------------------------


@query("SELECT o_custkey AS custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS pos, o_orderkey AS id FROM orders")
def for_each(spark, table):
    rows = iterate.for_each(customers(table), navigate.get_path(F.col("doc"), "orders"))
    return rows.select("custkey", F.col("pos").cast("bigint").alias("pos"), navigate.as_int(navigate.get(F.col("value"), "id")).alias("id"))


@query("SELECT event_id, unnest([0, 1, 2])::BIGINT AS pos, unnest(['z', 'a', 'z']) AS key FROM events")
def for_each_key(spark, table):
    return iterate.for_each_key(table("events").select("event_id", F.lit('{"z":1,"a":2,"z":3}').alias("d")), F.col("d")).select("event_id", F.col("pos").cast("bigint").alias("pos"), "key")


@query("SELECT event_id, unnest([0, 1, 2])::BIGINT AS pos, unnest(['z', 'a', 'z']) AS key, unnest([props, '1.50', '\"x\"']) AS value FROM events")
def members(spark, table):
    d = F.concat(F.lit('{"z":'), F.col("props"), F.lit(', "a" : 1.50,"z":"x"}'))
    return iterate.for_each_member(props(table).withColumn("d", d), F.col("d")).select("event_id", F.col("member.pos").cast("bigint").alias("pos"), "member.key", "member.value")


@query("SELECT o_custkey AS custkey, unnest(['0', 'name', 'orders']) AS key FROM (SELECT DISTINCT o_custkey FROM orders)")
def variant_members(spark, table):
    return iterate.variant_members(customers(table).select("custkey", F.try_parse_json("doc").alias("v")), "v").select("custkey", "key")


@query("SELECT o_custkey AS custkey, count(*)::BIGINT AS n FROM (SELECT o_custkey, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders) WHERE s = 0 GROUP BY 1")
def take_while(spark, table):
    ids = F.transform(iterate.elements(navigate.get_path(F.col("doc"), "orders")), lambda x: F.try_variant_get(x, "$.id", "bigint"))
    n = F.size(iterate.take_while(ids, lambda i: i % 3 != 0)).cast("bigint")
    return customers(table).select("custkey", n.alias("n")).filter("n > 0")


@query("SELECT event_id, unnest([0, 1, 2, 3])::BIGINT AS ord, unnest(['delim', 'string', 'number', 'delim']) AS kind, unnest(['{', 'k', json_extract_string(props, '$.k'), '}']) AS text FROM events")
def tokens(spark, table):
    rows = props(table).select("event_id", F.explode(iterate.tokens(F.col("props"))).alias("t"))
    return rows.select("event_id", F.col("t.ord").cast("bigint").alias("ord"), "t.kind", "t.text")


@query("SELECT event_id, unnest([0, 1, 2, 3])::BIGINT AS ord, unnest([0, 1, 1, 0])::BIGINT AS depth FROM events")
def token_table(spark, table):
    iterate.register_udtf(spark)
    return spark.sql("SELECT event_id, CAST(t.ord AS bigint) AS ord, CAST(t.depth AS bigint) AS depth FROM {rows}, LATERAL json_tokens(props) t", rows=props(table))


@query("SELECT event_id, unnest([props, event_id::VARCHAR, '\"a b\"', '[]']) AS value FROM events")
def split_values(spark, table):
    d = F.concat("props", F.col("event_id").cast("string"), F.lit(' "a b"[]'))
    return props(table).select("event_id", F.explode(iterate.split_values(d)).alias("v")).select("event_id", "v.value")


# --- decode -----------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 7 <> 0")
def typed_decode(spark, table):
    return doctored(table).select("event_id", decode.unmarshal(F.col("doc"), "k bigint")["k"].alias("k")).filter("k IS NOT NULL")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_id AS q, 'cannot decode string into field s of type int' AS error FROM events")
def typed_decode_exact(spark, table):
    doc = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(',"S":"x","q":"'), F.col("event_id"), F.lit('","more":[1]}'))
    target = decode.schema(("K", "bigint"), ("s", "int"), decode.Field("q", "bigint", string=True))
    r = props(table).select("event_id", decode.unmarshal_exact(doc, target).alias("r"))
    return r.select("event_id", F.col("r.value.K").alias("k"), F.col("r.value.q").alias("q"), "r.error")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unknown field ''more''' END AS error, CASE WHEN event_id % 5 = 0 THEN 'more' ELSE '' END AS names FROM events")
def unknown_fields(spark, table):
    doc = F.when(F.col("event_id") % 5 == 0, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(',"more":1}'))).otherwise(F.col("props"))
    return props(table).select("event_id", decode.unmarshal_exact(doc, "k bigint", disallow_unknown=True)["error"].alias("error"), F.array_join(decode.unknown_fields(doc, "k"), ",").alias("names"))


@query("SELECT o_custkey AS custkey, sum(o_orderkey)::BIGINT AS ids, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def decode_collections(spark, table):
    d = decode.unmarshal(F.col("doc"), "name string, orders array<struct<id bigint, status string>>")
    ids = F.aggregate(F.transform(d["orders"], lambda x: x["id"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return customers(table).select("custkey", ids.alias("ids"), F.size(d["orders"]).cast("bigint").alias("n"))


# --- encode and rewrite -----------------------------------------------------------------------


@query("""SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '","tags":["\\u003ca\\u003e",null]}' AS doc FROM nation""")
def marshal(spark, table):
    v = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.lit("<a>"), F.lit(None)).alias("tags"))
    return table("nation").select("n_nationkey", encode.marshal(v).alias("doc"))


@query("""SELECT n_nationkey, '{"a":1,"m":' || n_regionkey || ',"z":' || n_nationkey || '}' AS doc FROM nation""")
def marshal_sorted(spark, table):
    m = F.create_map(F.lit("z"), F.col("n_nationkey").cast("bigint"), F.lit("a"), F.lit(1).cast("bigint"), F.lit("m"), F.col("n_regionkey").cast("bigint"))
    return table("nation").select("n_nationkey", encode.marshal(encode.sort_map_keys(m)).alias("doc"))


@query("""SELECT o_orderkey, '{"p":' || regexp_replace(o_totalprice::VARCHAR, '\\.0$', '') || ',"n":null}' AS doc FROM orders""")
def marshal_floats(spark, table):
    v = F.struct(F.col("o_totalprice").cast("double").alias("p"), F.lit(None).cast("string").alias("n"))
    return table("orders").select("o_orderkey", encode.marshal_exact(v, "p double, n string").alias("doc"))


@query(
    """SELECT l_orderkey, l_linenumber, '{"q":' || l_quantity::BIGINT || ',"half":' || (l_quantity::BIGINT // 2) || (CASE WHEN l_quantity::BIGINT % 2 = 1 THEN '.5' ELSE '' END)
    || ',"s":"' || l_returnflag || '\\u001f\\u003c"}' AS doc FROM lineitem"""
)
def marshal_by_type(spark, table):
    rows = table("lineitem").withColumn("q", F.round("l_quantity").cast("bigint").cast("double"))
    v = F.struct("q", (F.col("q") / 2).alias("half"), F.concat("l_returnflag", F.lit("\x1f<")).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", encode.marshal_in(rows, v).alias("doc"))


@query(
    """SELECT event_id, '{' || concat_ws(',', CASE WHEN event_id % 2 = 1 THEN '"f":1' END, '"s":"0"', CASE WHEN event_id % 3 > 0 THEN '"z":{"x":' || event_id % 3 || '}' END) || '}' AS doc FROM events"""
)
def omit_by_type(spark, table):
    e = F.col("event_id")
    rows = table("events").select("event_id", (e % 2).cast("double").alias("f"), F.lit("0").alias("s"), F.struct((e % 3).alias("x")).alias("z"), F.lit(0.0).alias("zero"))
    return rows.select("event_id", encode.object_of(*[(c, F.col(c), "omitzero") for c in ("f", "s", "z", "zero")], df=rows).alias("doc"))


@query("SELECT s_suppkey AS suppkey, s_suppkey % 4 < 2 AS good FROM supplier")
def deep_documents(spark, table):
    key = F.col("s_suppkey")
    depth = F.element_at(F.array(*map(F.lit, (3, 1500, 10_001, 700))), (key % 4 + 1).cast("int"))
    doc = F.concat(F.repeat(F.lit("["), depth), F.repeat(F.lit("]"), depth), F.when(key % 4 == 3, "]").otherwise(""))
    # a file of few bytes is one task, but a row of it becomes a document of up to 20,002;
    # a filter on what a generator gives stays above it, so the documents are read where the keys were sent
    rows = table("supplier").select("s_suppkey")
    rows = rows.repartition(tasks_of(rows, 2000), key)
    good, bad = ndjson.good_and_bad(rows.select(key.alias("suppkey"), F.explode(F.array(doc)).alias("doc")), "doc")
    return good.select("suppkey", F.lit(True).alias("good")).unionByName(bad.select("suppkey", F.lit(False).alias("good")))


@query("SELECT c_custkey AS custkey, '\"' || replace(replace(replace(c_name, '#', '\\u0000'), 'C', '\\u003c'), 'r', '\\\\') || '\"' AS literal FROM customer")
def quote_names(spark, table):
    name = F.replace(F.replace(F.replace("c_name", F.lit("#"), F.lit("\0")), F.lit("C"), F.lit("<")), F.lit("r"), F.lit("\\"))
    return table("customer").select(F.col("c_custkey").alias("custkey"), rewrite.quote(name).alias("literal"))


@query("""SELECT event_id, '{' || concat_ws(',', CASE WHEN event_id % 2 <> 0 THEN '"a":' || (event_id % 2) END, CASE WHEN event_id % 3 = 0 THEN '"b":"x"' END, '"c":[]', '"q":"' || event_id || '"') || '}' AS doc FROM events""")
def omit_rules(spark, table):
    e = F.col("event_id")
    doc = encode.object_of(("a", (e % 2).cast("bigint"), "omitempty"), ("b", F.when(e % 3 == 0, "x").otherwise(""), "omitzero"), ("c", F.array().cast("array<int>"), "omitzero"), ("d", F.array().cast("array<int>"), "omitempty"), ("q", e, "string"))
    return table("events").select("event_id", doc.alias("doc"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e'), chr(8232), '\\u2028'), chr(8233), '\\u2029') AS html FROM pages")
def html_escape(spark, table):
    return table("pages").select("page_id", rewrite.html_escape(F.col("html")).alias("html"))


@query("""SELECT doc_id, '"' || replace(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r'), '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') || '"' AS literal, text FROM documents""")
def quote(spark, table):
    q = rewrite.quote(F.col("text"))
    return table("documents").select("doc_id", q.alias("literal"), rewrite.unquote(q).alias("text"))


@query("""SELECT event_id, replace(props, ': ', ':') AS native, '{"s":"a : b","p":' || replace(props, ': ', ':') || '}' AS exact FROM events""")
def compact(spark, table):
    d = F.concat(F.lit(' {"s" : "a : b" ,\n"p":'), F.col("props"), F.lit("} "))
    return props(table).select("event_id", rewrite.compact(F.col("props")).alias("native"), rewrite.compact_exact(d)["value"].alias("exact"))


@query("""SELECT event_id, '{' || chr(10) || chr(9) || '"k": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS doc FROM events""")
def indent(spark, table):
    return props(table).select("event_id", rewrite.indent(F.col("props"))["value"].alias("doc"))


@query("""SELECT event_id, left(props, length(props) - 1) || ',"new":{"x":[' || event_id || ']}}' AS added, '{"k": "v"}' AS changed, event_id IS NULL AS failed FROM events""")
def set_path(spark, table):
    p, e = F.col("props"), F.col("event_id")
    return props(table).select("event_id", rewrite.set_path(p, "new.x.-1", e)["value"].alias("added"), rewrite.set_path(p, "k", F.lit("v"))["value"].alias("changed"), rewrite.set_path(p, "k.x", e)["error"].isNull().alias("failed"))


@query("""SELECT event_id, '{}' AS gone, '[1,' || props || ']' AS kept FROM events""")
def delete_path(spark, table):
    d = F.concat(F.lit("[1,2,"), F.col("props"), F.lit("]"))
    return props(table).select("event_id", rewrite.delete_path(F.col("props"), "k")["value"].alias("gone"), rewrite.delete_path(d, "1")["value"].alias("kept"))


@query("""SELECT r_regionkey, '{"id":' || r_regionkey || ',"name":"' || r_name || '"}' AS doc, upper(r_name) AS own FROM region""")
def struct_encoder(spark, table):
    registry.register_encoder("region.name", lambda c: F.upper(c))
    v = F.struct(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    build = registry.struct_encoder("id bigint, name string")
    return table("region").select("r_regionkey", build(v).alias("doc"), registry.encode_as("region.name", F.col("r_name")).alias("own"))


@query("""SELECT event_id, '{"a":[1,1e+21,"\\u003c"],"b":' || json_extract_string(props, '$.k') || '}' AS tree, '{"a":[1.0,1e21,"\\u003c"],"b":' || json_extract_string(props, '$.k') || '}' AS numbers FROM events""")
def any_tree(spark, table):
    k = navigate.raw(F.col("props"), "k")
    doc = F.concat(F.lit('{"b":0, "b" : '), k, F.lit(',"a":[1.0,1e21,"<"]}'))
    return props(table).select("event_id", decode.any_tree(doc)["value"].alias("tree"), decode.any_tree(doc, use_number=True)["value"].alias("numbers"))


@query("SELECT event_id, '1.50' AS text, json_extract_string(props, '$.k') AS k, true AS none FROM events")
def number_text(spark, table):
    doc = F.concat(F.lit('{"n":1.50,"s":"2","p":'), F.col("props"), F.lit("}"))
    return props(table).select("event_id", decode.number_text(doc, "n").alias("text"), decode.number_text(doc, "p.k").alias("k"), decode.number_text(doc, "s").isNull().alias("none"))


@query("SELECT o_custkey AS custkey, coalesce(list(o_orderkey ORDER BY o_orderkey)[1], 0)::BIGINT AS a, coalesce(list(o_orderkey ORDER BY o_orderkey)[2], 0)::BIGINT AS b, 3::BIGINT AS n FROM orders GROUP BY 1")
def fixed_array(spark, table):
    ids = F.transform(iterate.elements(navigate.get_path(F.col("doc"), "orders")), lambda x: F.try_variant_get(x, "$.id", "bigint"))
    three = decode.fixed_array(ids, 3, F.lit(0).cast("bigint"))
    return customers(table).select("custkey", three[0].alias("a"), three[1].alias("b"), F.size(three).cast("bigint").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 'hi' AS bytes, 'one' AS named, event_id AS deep FROM events")
def decode_rules(spark, table):
    """Map keys that are numbers, base64, embedded fields of which the shallow one counts."""
    doc = F.concat(F.lit('{"m":{"'), F.col("event_id"), F.lit('":"one","x":"y"},"bytes":"aGk=","K":'), navigate.raw(F.col("props"), "k"), F.lit(',"deep":'), F.col("event_id"), F.lit("}"))
    inner = decode.schema(("k", "string"), ("deep", "bigint"))
    target = decode.schema(("k", "bigint"), ("bytes", "binary"), ("m", "map<bigint,string>"), decode.Field("", embed=inner))
    v = F.col("r.value")
    r = props(table).select("event_id", decode.unmarshal_exact(doc, target).alias("r"))
    return r.select("event_id", v["k"].alias("k"), v["bytes"].cast("string").alias("bytes"), F.element_at(v["m"], F.col("event_id")).alias("named"), v["deep"].alias("deep"))


@query("""SELECT n_nationkey, '[' || chr(10) || '>  {' || chr(10) || '>    "name": "' || n_name || '<"' || chr(10) || '>  }' || chr(10) || '>]' AS pretty, 'x{"name":"' || n_name || '<"}' AS fast, '{"a":"' || n_name || '","b":1}' AS any FROM nation""")
def marshal_options(spark, table):
    v = F.struct(F.concat("n_name", F.lit("<")).alias("name"))
    pretty = encode.marshal_indent(F.array(v), "array<struct<name:string>>", ">", "  ", encode.FAST)
    free = F.try_parse_json(F.concat(F.lit('{"b":1,"a":"'), F.col("n_name"), F.lit('"}')))
    return table("nation").select("n_nationkey", pretty.alias("pretty"), encode.marshal_to(F.lit("x"), v, encode.FAST).alias("fast"), encode.marshal_any(free).alias("any"))


@query("SELECT r_regionkey, r_name AS first, 'last' AS last FROM region")
def first_key(spark, table):
    doc = F.concat(F.lit('{"a.b":"'), F.col("r_name"), F.lit('","a.b":"last"}'))
    return table("region").select("r_regionkey", navigate.as_string(navigate.first_key(doc, "a.b")).alias("first"), navigate.as_string(navigate.get(F.try_parse_json(doc), "a.b")).alias("last"))


# --- parts, hooks, options --------------------------------------------------------------------


@query("SELECT o_custkey AS custkey, 'c' || o_custkey AS name, count(*)::BIGINT AS n, max(o_orderkey)::BIGINT AS last, true AS none FROM orders GROUP BY 1")
def decode_value(spark, table):
    v = F.try_parse_json("doc")
    orders = decode.decode_value(navigate.path(v, "orders"), "array<struct<id bigint, status string>>")
    return customers(table).select(
        "custkey",
        decode.decode_value(v, "struct<name string>")["name"].alias("name"),
        decode.decode_value(navigate.path(v, "0"), "bigint").alias("n"),
        F.array_max(F.transform(orders, lambda o: o["id"])).alias("last"),
        decode.decode_value(navigate.path(v, "nope"), "bigint").isNull().alias("none"),
    )


@query(
    """SELECT event_id, 'number ' || event_id || '.5' AS what, 'bigint' AS type, '' AS struct, 'in.n' AS field, (length(props) + 12 + length(event_id::VARCHAR))::BIGINT AS "offset" FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT event_id, 'array', 'bigint', 'doc', 'k', 6 FROM events WHERE event_id % 2 = 1"""
)
def decode_misfits(spark, table):
    e = F.col("event_id")
    doc = F.when(e % 2 == 0, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(',"in":{"n":'), e, F.lit(".5}}"))).otherwise('{"k":[1]}')
    target = decode.schema(("k", "bigint"), ("in", "struct<n bigint>"), name="doc")
    return props(table).select("event_id", decode.unmarshal_detail(doc, target).alias("r")).select("event_id", "r.what", "r.type", "r.struct", "r.field", "r.offset")


@query("SELECT n_nationkey, n_nationkey * 2 AS twice, lower(n_name) AS low, NULL::BIGINT AS none FROM nation")
def decode_hooks(spark, table):
    doc = F.to_json(F.struct(F.col("n_nationkey").alias("Twice"), F.col("n_name").alias("low"), F.lit(1).alias("other")))
    hooks = {"twice": lambda raw: 2 * int(raw), "low": decode.text_hook(str.lower), "none": lambda raw: 1}
    r = decode.unmarshal_exact(doc, "twice bigint, low string, none bigint", hooks=hooks)
    return table("nation").select("n_nationkey", r.alias("r")).select(F.col("n_nationkey"), "r.value.*").select(F.col("n_nationkey"), F.col("twice").cast("int").alias("twice"), "low", "none")


@query("""SELECT n_nationkey, '{"n":' || n_nationkey || ',"s":"\\u003c"}' AS json, '"' || n_name || '\\u0026"' AS text, n_nationkey::VARCHAR AS i, n_nationkey || '.5' AS f, CASE WHEN n_nationkey > 9 THEN 'true' ELSE 'false' END AS b, '"' || n_name || '"' AS s FROM nation""")
def encode_hooks(spark, table):
    k, name = F.col("n_nationkey"), F.col("n_name")
    own = registry.marshaler(lambda n: f' {{ "n" : {n}, "s" : "<" }} ')
    return table("nation").select(
        "n_nationkey", own(k).alias("json"), registry.text_marshaler(lambda t: t + "&")(name).alias("text"),
        registry.append_int(k).alias("i"), registry.append_float(k + 0.5).alias("f"), registry.append_bool(k > 9).alias("b"), registry.append_string(name).alias("s"),
    )


@query("""SELECT n_nationkey, '{"n":' || n_nationkey || '.50,"zero":0,"r":{"a":[1,"\\u003e"]},"none":null}' AS doc FROM nation""")
def number_and_raw_fields(spark, table):
    n = F.concat(F.col("n_nationkey"), F.lit(".50"))
    doc = encode.object_of(("n", n, "number"), ("zero", F.lit(""), "number"), ("r", F.lit('{ "a" : [1, ">"] }'), "raw"), ("none", F.lit(None).cast("string"), "raw"))
    return table("nation").select("n_nationkey", doc.alias("doc"))


@query("""SELECT n_nationkey, '{"m":{"1":"x","10":"y","2":"' || n_name || '"}}' AS keys, CASE WHEN n_regionkey = 0 THEN '{"id":' || n_nationkey || '}' ELSE '{"id":' || n_nationkey || ',"r":' || n_regionkey || '}' END AS left_out FROM nation WHERE n_nationkey > 0""")
def map_keys_and_zero_fields(spark, table):
    rows = table("nation").filter("n_nationkey > 0")
    m = F.create_map(F.lit(10), F.lit("y"), F.lit(2), F.col("n_name"), F.lit(1), F.lit("x"))
    zero = encode.Options(omit_zero_struct_fields=True)
    return rows.select(
        "n_nationkey",
        encode.marshal_in(rows, F.struct(m.alias("m"))).alias("keys"),
        encode.marshal_in(rows, F.struct(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("r")), zero).alias("left_out"),
    )


@query("SELECT event_id, event_id AS big, CASE WHEN event_id < 128 THEN event_id END AS tiny, event_id / 2.0 AS half, event_id AS second, false AS after, event_id AS first FROM events")
def numbers_read(spark, table):
    e = F.col("event_id")
    doc = F.concat(F.lit('{"tiny":'), e, F.lit(',"big":'), e, F.lit(',"half":'), e / 2, F.lit(',"pair":[0,'), e, F.lit("]}"))
    rows = table("events").select("event_id", doc.alias("d"), F.concat(e, F.lit(" [")).alias("loose"))
    r, v = decode.unmarshal_exact(F.col("d"), "tiny tinyint, big bigint"), validate.must_parse(F.col("d"))
    pair = navigate.get(v, "pair")
    return rows.select(
        "event_id", r["value"]["big"].alias("big"), r["value"]["tiny"].cast("bigint").alias("tiny"), navigate.as_float(navigate.get(v, "half")).alias("half"),
        navigate.as_int(navigate.index(pair, 1)).alias("second"), navigate.exists(navigate.index(pair, 2)).alias("after"), navigate.as_int(validate.scan(F.col("loose"))).alias("first"),
    )


@query("SELECT n_nationkey AS id, n_nationkey / 2.0 AS half, ((n_nationkey > 0 AND n_nationkey % 2 = 1)::INT)::BIGINT AS odd FROM nation")
def marshal_write(spark, table):
    path = scratch(spark, "written")
    rows = table("nation")
    k = F.col("n_nationkey")
    ndjson.marshal_write(rows, F.struct(k.alias("id"), (k / 2).alias("half"), (k % 2).cast("bigint").alias("odd")), path, indent="  ")
    return ndjson.read_values(spark, path).filter("error IS NULL").select(F.from_json("value", "id int, half double, odd bigint").alias("r")).select("r.*")


# --- sources, sinks, streams ------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def ndjson_roundtrip(spark, table):
    path = scratch(spark, "lines")
    doc = encode.marshal(F.struct("event_id", navigate.as_int(navigate.get_path(F.col("props"), "k")).alias("k")))
    ndjson.write_lines(table("events").select(doc.alias("doc")), "doc", path)
    return ndjson.read_lines(spark, path).select(decode.unmarshal(F.col("value"), "event_id bigint, k bigint").alias("r")).select("r.event_id", "r.k")


@query("SELECT event_id, event_id % 7 <> 0 AS good, CASE WHEN event_id % 7 = 0 THEN length(props) + 1 ELSE 0 END::BIGINT AS fault_at FROM events")
def good_and_bad(spark, table):
    good, bad = ndjson.good_and_bad(doctored(table), "doc")
    return good.select("event_id", F.lit(True).alias("good"), F.lit(0).cast("bigint").alias("fault_at")).unionByName(bad.select("event_id", F.lit(False).alias("good"), F.col("offset").alias("fault_at")))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def array_elements(spark, table):
    path = scratch(spark, "array")
    docs = table("nation").select(F.col("n_regionkey").alias("r"), F.to_json(F.struct(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))).alias("d"))
    arrays = docs.groupBy("r").agg(F.concat(F.lit("["), F.array_join(F.collect_list("d"), ", "), F.lit("]")).alias("value"))
    arrays.repartition("r").sortWithinPartitions("r").select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    return ndjson.read_values(spark, path, elements=True).filter("error IS NULL").select(F.from_json("value", "id bigint, name string").alias("r")).select("r.id", "r.name")


@query("SELECT event_id, true AS in_order FROM events")
def lines_in_order(spark, table):
    path = scratch(spark, "ordered")
    rows = table("events").select("event_id", F.to_json(F.struct("event_id")).alias("doc"))
    # a file per range of events, so that the order of its lines is known and no task sorts more than a range
    parts = tasks_of(rows, 200_000)
    rows.repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").select("doc").write.text(path)
    back = ndjson.in_order(spark, path).withColumn("event_id", F.from_json("value", "event_id bigint")["event_id"])
    w = Window.partitionBy("file", "block").orderBy("seq")
    # as many tasks as files: few blocks meet in one
    return back.select("event_id", "file", "block", "seq").repartition(parts, "file", "block").select("event_id", F.coalesce(F.lag("event_id").over(w) < F.col("event_id"), F.lit(True)).alias("in_order"))


@query("SELECT n_nationkey AS id, (length('{\"id\":' || n_nationkey || '}'))::BIGINT AS size, true AS whole FROM nation")
def value_offsets(spark, table):
    path = scratch(spark, "values")
    table("nation").select(F.concat(F.lit('{"id":'), F.col("n_nationkey"), F.lit("} ")).alias("value")).write.text(path)
    found = ndjson.read_values(spark, path).filter("error IS NULL")
    docs = ndjson.read_documents(spark, path).select(F.col("value").alias("text"), F.col("file").alias("whole_file"))
    both = found.join(docs, F.regexp_extract("file", r"[^/]+$", 0) == F.regexp_extract("whole_file", r"[^/]+$", 0))
    same = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("value")
    return both.select(F.from_json("value", "id bigint")["id"].alias("id"), (F.col("end") - F.col("start")).alias("size"), same.alias("whole"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def ranged_elements(spark, table):
    """One array of all events in one file, read by many tasks."""
    path = scratch(spark, "one-array")
    doc = F.to_json(F.struct("event_id", "props", F.lit('"],[{\\').alias("noise")))
    rows = table("events").coalesce(1).select(F.concat(F.when(F.monotonically_increasing_id() == 0, "[").otherwise(","), doc).alias("line"))
    end = spark.sql("SELECT ']' AS line")
    rows.unionByName(end).coalesce(1).write.text(path)
    found = ranges.read_ranges(spark, path, elements=True, range_bytes=100_000).filter("error IS NULL")
    r = F.from_json("value", "event_id bigint, props string")
    return found.select(r.alias("r")).select("r.event_id", navigate.as_int(navigate.get_path(F.col("r.props"), "k")).alias("k"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def stream_values(spark, table):
    source, out, state = scratch(spark, "values-in"), scratch(spark, "values-out"), scratch(spark, "values-state")
    doc = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    # a region's values in a line, with nothing between them
    table("nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(doc), "").alias("value")).select("value").write.text(source)
    rows = ndjson.stream_values(spark, source).filter("error IS NULL").select("value")
    rows.writeStream.format("text").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return ndjson.read_lines(spark, out).select(F.from_json("value", "id int, name string").alias("r")).select("r.*")


@query("SELECT event_type, count(*)::BIGINT AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def stream_lines(spark, table):
    source, out, state = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "state")
    ndjson.write_lines(table("events").select(F.to_json(F.struct("event_type", "props")).alias("doc")), "doc", source)
    v = F.try_parse_json("value")
    k = navigate.as_int(navigate.get_path(navigate.as_string(navigate.get(v, "props")), "k"))
    rows = ndjson.stream_lines(spark, source).select(F.to_json(F.struct(navigate.as_string(navigate.get(v, "event_type")).alias("event_type"), k.alias("k"))).alias("doc"))
    ndjson.stream_out(rows, "doc", out, state).trigger(availableNow=True).start().awaitTermination()
    back = ndjson.read_lines(spark, out).select(F.from_json("value", "event_type string, k bigint").alias("r")).select("r.*")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


CARRY = "SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k')::BIGINT END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) AS k FROM events"


def partial(table) -> DataFrame:
    """Only every third record gives k; every fifth gives null."""
    e = F.col("event_id")
    return table("events").select("event_id", "user_id", F.when(e % 3 == 0, F.col("props")).when(e % 5 == 0, F.lit('{"k":null}')).otherwise(F.lit("{}")).alias("doc"))


@query(CARRY)
def carry(spark, table):
    return carry_forward(partial(table), "doc", {"k": "bigint"}, [F.col("event_id")], ["user_id"]).select("event_id", "user_id", F.coalesce("k", F.lit(-1)).alias("k"))


@query(CARRY)
def carry_stream(spark, table):
    source, state = scratch(spark, "carry-in"), scratch(spark, "carry-state")
    rows = partial(table)
    rows.write.parquet(source)
    out = scratch(spark, "carry-out")
    got = carry_forward_stream(spark.readStream.schema(rows.schema).parquet(source), "doc", {"k": "bigint"}, "user_id", "event_id")
    got.writeStream.outputMode("append").option("checkpointLocation", state).foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", F.coalesce("k", F.lit(-1)).alias("k"))
