"""Column operators, sources and streams on Spark; every query against its SQL."""

import decimal
import json
import os
import shutil
import subprocess
import sys

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from jsonmill import strict
from jsonmill.functions import registry
from jsonmill.operators import decode, encode, iterate, navigate, rewrite, validate
from jsonmill.plans import queries as plans
from jsonmill.session import configure, shared_folder
from jsonmill.sources import ndjson
from jsonmill.streaming.carry import carry_forward, carry_forward_stream

from .test_strict import INVALID, VALID

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", autouse=True)
def configured(spark):
    global J
    configure(spark)
    J = F.col("j")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, j string")


def one(spark, text, *columns):
    return tuple(docs(spark, text).select(*columns).first())


J = None  # a column needs a session


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))
    want = duck.execute(plans.SQL[name])
    order = [[d[0] for d in want.description].index(n) for n in names]
    assert got == sorted(map(repr, (tuple(r[k] for k in order) for r in want.fetchall()))) and got


def test_every_query_has_sql():
    assert plans.QUERIES.keys() == plans.SQL.keys()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_llm_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/jsonmill", tmp_path / "jsonmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'path_int' in e.queries() and e.oracle_sql().keys() == e.queries().keys(); print('fine')"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.stdout.strip() == "fine", said.stderr


def test_both_validity_checks_on_the_vectors(spark):
    rows = docs(spark, *INVALID, *VALID).select("id", validate.is_valid(J).alias("a"), validate.is_valid_exact(J).alias("b")).collect()
    want = [False] * len(INVALID) + [True] * len(VALID)
    assert [r.b for r in sorted(rows)] == want
    assert [bool(r.a) for r in sorted(rows)] == want


def test_null_in_null_out(spark):
    df = spark.createDataFrame([(None,)], "j string")
    r = df.select(validate.is_valid_exact(J), validate.syntax_error(J)["message"], navigate.path_exact(J, "a"), rewrite.compact(J), rewrite.indent(J)["value"], iterate.tokens(J), iterate.members(J), rewrite.quote(J)).first()
    assert all(x is None for x in r)


def test_must_parse_ends_the_query(spark):
    with pytest.raises(Exception, match="invalid JSON"):
        docs(spark, "{").select(validate.must_parse(J)).collect()


def test_paths_by_variant_equal_paths_by_text(spark):
    doc = '{"user":{"name":"Ann","tags":["x",{"0":"in"}]},"0":[1,2],"a.b":{"c d":null},"it\'s":1}'
    for p in ("user.name", "user.tags.1.0", "0", "0.1", "a\\.b", "a\\.b.c d", "it's", "user.tags.9", "nope.x", "", "user."):
        raw, v = one(spark, doc, navigate.path_exact(J, p), F.to_json(F.struct(navigate.get_path(J, p).alias("v"))))
        got = json.loads(v)
        assert (json.loads(raw) if raw is not None else None) == got.get("v") and (raw is None) == ("v" not in got), p
    with pytest.raises(ValueError, match="path_exact"):
        navigate.get_path(J, "a*")


def test_values(spark):
    doc = '{"s":"5","i":7,"f":1.9,"big":12345678901,"b":true,"n":null,"e":1e3,"a":[],"o":{}}'
    v = lambda k: navigate.get_path(J, k)
    assert one(spark, doc, *[navigate.as_int(v(k)) for k in ("s", "i", "f", "big", "b", "n", "e", "x")]) == (0, 7, 1, 12345678901, 0, 0, 1000, 0)
    assert one(spark, doc, *[navigate.as_float(v(k)) for k in ("s", "f", "x")]) == (0.0, 1.9, 0.0)
    assert one(spark, doc, *[navigate.as_string(v(k)) for k in ("s", "i", "x")]) == ("5", "", "")
    assert one(spark, doc, *[navigate.as_bool(v(k)) for k in ("b", "i", "n", "x")]) == (True, False, False, False)
    assert one(spark, doc, *[navigate.kind(v(k)) for k in ("s", "i", "f", "b", "n", "a", "o", "x")]) == ("string", "number", "number", "bool", "null", "array", "object", "invalid")
    assert one(spark, doc, navigate.is_null(v("n")), navigate.is_null(v("x")), navigate.exists(v("n")), navigate.exists(v("x"))) == (True, False, True, False)
    assert one(spark, "[1,[2,3]]", navigate.as_int(navigate.index(F.try_parse_json(J), 0)), navigate.exists(navigate.index(F.try_parse_json(J), -1))) == (1, False)


def test_tokens_and_faults(spark):
    rows = one(spark, '{"a":[1,"x"]} tru', iterate.tokens(J))[0]
    assert [(r.kind, r.text, r.depth) for r in rows][:-1] == [("delim", "{", 0), ("string", "a", 1), ("delim", "[", 1), ("number", "1", 2), ("string", "x", 2), ("delim", "]", 1), ("delim", "}", 0)]
    assert rows[-1].kind == "error"


WIDE = "e1 int, str string, big bigint, u decimal(20,0), f double, f32 float, b boolean, ptr struct<x:int,y:string>, slice array<int>, map map<string,int>, mapint map<int,string>, bytes binary"


def test_typed_decode(spark):
    doc = '{"E1":1,"STR":"s","big":-9,"u":18446744073709551615,"f":1e3,"f32":0.1,"b":true,"ptr":{"X":2,"z":1},"slice":[],"map":{"a":1,"a":2},"mapint":{"7":"x","q":"y"},"bytes":"aGk=","more":{}}'
    value, error = one(spark, doc, decode.unmarshal_exact(J, WIDE))[0]
    assert (value.e1, value.str, value.big, int(value.u), value.f, value.b, value.ptr.x, value.ptr.y, value.slice, value.map, value.mapint, bytes(value.bytes)) == (1, "s", -9, 2**64 - 1, 1000.0, True, 2, None, [], {"a": 2}, {7: "x"}, b"hi")
    assert "key 'q'" in error
    for doc, kind, ok in (('{"a":1.0}', "a int", False), ('{"a":1e2}', "a int", False), ('{"a":300}', "a tinyint", False), ('{"a":1}', "a string", False), ('{"a":1E700}', "a double", False), ('{"a":null}', "a int", True), ("[1]", "a int", False), ('{"a":1}x', "a int", False)):
        value, error = one(spark, doc, decode.unmarshal_exact(J, kind))[0]
        assert (error is None) == ok, doc
    value, error = one(spark, '{"a":"x","b":2}', decode.unmarshal_exact(J, "a int, b int"))[0]
    assert (value.a, value.b) == (None, 2) and "field a" in error


def test_schema_dominance_and_string_fields(spark):
    inner = decode.schema(("id", "int"), ("deep", "int"), decode.Field("same", "int", tagged=False))
    outer = decode.schema(("id", "bigint"), decode.Field("", embed=inner), decode.Field("", embed=decode.schema(decode.Field("same", "int", tagged=False))), decode.Field("q", "int", string=True))
    assert [(f.name, f.kind) for f in outer.plan()] == [("id", "bigint"), ("deep", "int"), ("q", "int")]
    value, error = one(spark, '{"id":1,"deep":2,"q":"3","same":4}', decode.unmarshal_exact(J, outer))[0]
    assert tuple(value) == (1, 2, 3) and error is None
    assert one(spark, '{"q":3}', decode.unmarshal_exact(J, outer)["error"])[0] and one(spark, '{"q":"null"}', decode.unmarshal_exact(J, outer)["error"])[0] is None


def test_marshal(spark):
    kind = "f double, g float, m map<string,int>, s string, b binary, a array<double>, n string"
    df = spark.createDataFrame([(1e21, 0.1, {"b": 1, "a": 2}, "<&\x01", bytearray(b"hi"), [1.0, -0.0], None)], kind)
    v = F.struct(*df.columns)
    assert df.select(encode.marshal_exact(v, kind)).first()[0] == '{"f":1e+21,"g":0.1,"m":{"a":2,"b":1},"s":"\\u003c\\u0026\\u0001","b":"aGk=","a":[1,-0],"n":null}'
    zero = strict.Options(escape_html=False, omit_zero_struct_fields=True)
    assert df.select(encode.marshal_exact(v, kind, zero)).first()[0].endswith('"a":[1,-0]}')
    assert df.select(encode.marshal_indent(F.struct("s"), "s string", by="  ", options=strict.FAST)).first()[0] == '{\n  "s": "<&\\u0001"\n}'
    with pytest.raises(Exception, match="unsupported value"):
        spark.createDataFrame([(float("nan"),)], "f double").select(encode.marshal_exact(F.col("f"), "double")).collect()


def test_native_marshal_equals_exact(spark):
    kind = "id bigint, name string, ok boolean, tags array<string>, kid struct<n:int,s:string>"
    df = spark.createDataFrame([(1, 'a"b\\<é ', True, ["x", None], (1, "y")), (None, None, None, None, None)], kind)
    v = F.struct(*df.columns)
    for a, b, c in df.select(encode.marshal(v), encode.marshal_exact(v, kind), registry.struct_encoder(kind)(v)).collect():
        assert a == b and json.loads(c).keys() == json.loads(a).keys()
    with pytest.raises(TypeError):
        registry.struct_encoder("m map<string,int>")


def test_compact_both_ways(spark):
    text = ' { "a b" : [ 1.50 , "x : , \\" y" , { } ] }\n'
    a, b = one(spark, text, rewrite.compact(J), rewrite.compact_exact(J)["value"])
    assert a == b == '{"a b":[1.50,"x : , \\" y",{}]}'
    assert one(spark, "[1,]", rewrite.compact(J), rewrite.compact_exact(J)["offset"]) == (None, 4)


def test_sources(spark, tmp_path):
    p = tmp_path / "a.ndjson"
    p.write_text('{"id":1}\r\n\n  \n{"id":2}\n{"id":\n{"id":3}')
    lines = ndjson.read_lines(spark, str(p))
    good, bad = ndjson.good_and_bad(lines)
    assert good.count() == 3 and [(r.message, r.offset) for r in bad.collect()] == [("unexpected end of JSON input", 6)]
    q = tmp_path / "b.json"
    q.write_text('{"a":1}{"b":2} 3 [1,2')
    got = sorted(ndjson.read_values(spark, str(q)).collect(), key=lambda r: r.start)
    assert [(r.start, r.end, r.value) for r in got[:3]] == [(0, 7, '{"a":1}'), (7, 14, '{"b":2}'), (15, 16, "3")] and got[3].error
    e = tmp_path / "c.json"
    e.write_text(' [ 1 , {"x":[2]}, "y" ')
    got = sorted(ndjson.read_values(spark, str(e), elements=True).collect(), key=lambda r: (r.ord is None, r.ord))
    assert [r.value for r in got[:3]] == ["1", '{"x":[2]}', '"y"'] and got[3].error
    assert ndjson.read_documents(spark, str(q)).count() == 1


def test_edits_keep_all_other_bytes(spark):
    doc = '{ "a" : 1.50 , "b" : [ 1 ] }'
    assert one(spark, doc, rewrite.set_path(J, "b.-1", F.lit("é<"))["value"], rewrite.delete_path(J, "a")["value"], rewrite.set_path(J, "a.x", F.lit(1))["error"]) == ('{ "a" : 1.50 , "b" : [ 1,"é\\u003c" ] }', '{ "b" : [ 1 ] }', "a number has no member 'x'")


def test_set_path_of_columns_as_of_rows(spark, monkeypatch):
    flat = ['{"k": 76}', ' { "a" : "x,\\"k\\":1" ,\n"k":true , "k":2 } ', "{ }", '{"é":1,"n":null}', '{"k":"{"}', '{"a":"\\u006b"}', '{"k":null,"new":-1.5e3}']
    other = ['{"\\u006b":1}', '{"k":{"x":[1]}}', "[1,2]", '{"k":01}', "", '{"k":1}}', "7", None]
    rows = [(d, r) for d in flat + other for r in ('"é\\u003c"', " 1\n", '{"z":[1]}', "tru", None)]
    df = spark.createDataFrame(rows, "j string, r string").coalesce(1)

    def want(path, d, r):
        try:
            return None if d is None or r is None else strict.set_raw(d.encode(), path, r.encode()).decode(), None, None
        except strict.JsonError as e:
            return None, e.message, e.offset

    paths = ("k", "new.x.-1", "k.x", "é", "k.1", "new.3", "", "a*", "1", 'q"')
    got = df.select(*[rewrite.set_raw_path(F.col("j"), p, F.col("r")).alias(f"p{n}") for n, p in enumerate(paths)]).collect()
    for n, p in enumerate(paths):
        assert [tuple(g[n]) for g in got] == [want(p, d, r) for d, r in rows], p
    monkeypatch.setattr(strict, "set_raw", None)  # objects of scalars are set without the row code
    for p in ("k", "new.x.-1", "k.x"):
        done = rewrite._set(p, True).func(pa.array(flat), pa.array(["1"] * len(flat))).to_pylist()
        assert all((r["value"] is None) != (r["error"] is None) for r in done)


def test_marshal_by_type(spark):
    kind = "d double, s string, m map<string,int>, n struct<f:float>"
    df = spark.createDataFrame([(1e21, "\x1f\x0b\\u001F<", {"b": 1, "a": 2}, (1.0,)), (1.0, "", None, None)], kind)
    got = [r[0] for r in df.select(encode.marshal_in(df, F.struct(*df.columns))).collect()]
    assert got == ['{"d":1e+21,"s":"\\u001f\\u000b\\\\u001F\\u003c","m":{"a":2,"b":1},"n":{"f":1}}', '{"d":1,"s":"","m":null,"n":null}']
    assert df.select(encode.marshal(F.col("s"))).first()[0] == '"\\u001f\\u000b\\\\u001F\\u003c"'
    for bad in (encode.marshal(F.col("d")), encode.marshal(F.col("n"))):
        with pytest.raises(Exception, match="marshal_in"):
            df.select(bad).collect()
    free = [r[0] for r in spark.createDataFrame([('{"b":1,"a":1e21,"c":"<1.0\\u001f","d":[1.0,-0.5,1e2,12345678901234567890]}',)], "j string").select(encode.marshal_any(F.parse_json("j"))).collect()]
    assert free == ['{"a":1e+21,"b":1,"c":"\\u003c1.0\\u001f","d":[1,-0.5,100,12345678901234567890]}']


def test_marshal_exact_of_columns_as_of_rows(spark):
    kind = "a bigint, b array<struct<x:double,y:string>>, c map<string,float>, d decimal(38,18), e struct<f:boolean,g:binary,h:struct<i:int,s:string>>, k map<int,array<string>>, l array<double>"
    small = decimal.Decimal("1E-18")
    rows = [
        (1, [(1.0, 'q"\\\n\x1f<\u2028é𝄞'), (-0.0, ""), None, (1e21, None)], {"b": 1e-6, "a<": 0.1}, small, (True, b"ab", (0, "")), {10: ["x", None], 9: []}, [0.5, None]),
        (None, [], {}, decimal.Decimal("1.5"), (False, None, None), {}, [1e-7, 123456789012345680000.0, 1e15, 1e-5]),
        (0, None, None, None, None, None, None),
        (-5, [(9.99e-7, "plain")], {"": None}, -small, (None, b"", (5, "s")), {-1: None}, []),
    ]
    df = spark.createDataFrame(rows, kind).coalesce(1)
    of = T._parse_datatype_string(kind)
    for options in (encode.STD, encode.FAST, encode.Options(omit_zero_struct_fields=True)):
        want = [encode.encode_typed(encode._plain(r, of), options) for r in (r.asDict() for r in df.collect())]
        assert [r[0] for r in df.select(encode.marshal_exact(F.struct(*df.columns), kind, options)).collect()] == want
    assert [r[0] for r in df.select(encode.marshal_exact(F.col("l"), "array<double>")).collect()] == ["[0.5,null]", "[1e-7,123456789012345680000,1000000000000000,0.00001]", "null", "[]"]
    assert [r[0] for r in df.select(encode.marshal_exact(F.col("a"), "bigint")).collect()] == ["1", "null", "0", "-5"]
    raw = spark.sql("SELECT CAST(X'61E6973C' AS STRING) AS s, X'00' AS b")
    assert raw.select(encode.marshal_exact(F.col("s"), "string")).first()[0] == strict.quote(b"a\xe6\x97<", True)
    with pytest.raises(Exception, match="unsupported value: nan"):
        df.select(encode.marshal_exact(F.lit(float("nan")), "double")).collect()


def test_omitted_fields(spark):
    kind = "s string, d double, z struct<x:int,y:struct<q:string>>, a array<int>, m map<string,int>, i int, b boolean, e decimal(5,2)"
    rows = [("0", 0.0, (0, ("",)), [], {}, 0, False, 0), ("", -0.0, (1, ("",)), None, None, None, None, None), ("false", 0.5, (None, (None,)), [0], {"k": 0}, 7, True, 1)]
    rows = [(*r[:7], None if r[7] is None else decimal.Decimal(r[7])) for r in rows]
    df = spark.createDataFrame(rows, kind)
    of = lambda rule: [r[0] for r in df.select(encode.object_of(*[(c, F.col(c), rule) for c in df.columns], df=df)).collect()]
    assert of("omitempty") == ['{"s":"0","z":{"x":0,"y":{"q":""}}}', '{"z":{"x":1,"y":{"q":""}}}', '{"s":"false","d":0.5,"z":{"x":null,"y":{"q":null}},"a":[0],"m":{"k":0},"i":7,"b":true,"e":1.00}']
    assert of("omitzero") == ['{"s":"0","a":[],"m":{}}', '{"z":{"x":1,"y":{"q":""}}}', '{"s":"false","d":0.5,"a":[0],"m":{"k":0},"i":7,"b":true,"e":1.00}']
    text = df.select(encode.object_of(("s", F.col("s"), "string", "omitempty"), ("i", F.col("i"), "string", "omitempty"))).collect()
    assert [r[0] for r in text] == ['{"s":"\\"0\\""}', "{}", '{"s":"\\"false\\"","i":"7"}']


def test_quote_equals_the_exact_one(spark):
    texts = ["", "a", 'q"\\', "\x00\x0b\x1e\x1f\x7f\b\f\n\r\t", "<&>\u2028\u2029", "\\u001F", "\\\\u001F\x1f\x1f", "é𝄞/"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for html in (True, False):
        assert [r[0] for r in df.select(rewrite.quote(F.col("t"), html)).collect()] == [strict.quote(t, html) for t in texts]
    raw = spark.createDataFrame([(bytearray(b"a\xe6\x97<"),), (None,)], "b binary")
    assert [r[0] for r in raw.select(rewrite.quote_bytes(F.col("b"))).collect()] == [strict.quote(b"a\xe6\x97<", True), None]


def test_deep_documents(spark):
    deep = lambda n: "[" * n + "]" * n
    rows = [(1, deep(900)), (2, deep(1001)), (3, deep(10_000)), (4, deep(10_001)), (5, "[1]]"), (6, None), (7, "{}"), (8, deep(1500) + "x")]
    good, bad = ndjson.good_and_bad(spark.createDataFrame(rows, "id int, value string"))
    assert sorted(r.id for r in good.collect()) == [1, 2, 3, 7]
    faults = {r.id: r.message for r in bad.collect()}
    assert faults.keys() == {4, 5, 6, 8} and faults[6] is None and all(faults[k] for k in (4, 5, 8))


def test_deep_documents_of_a_small_file_are_many_tasks(spark, tmp_path):
    spark.range(4001).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = plans.QUERIES["deep_documents"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 9
    assert {tuple(r) for r in got.filter("suppkey < 8 or suppkey = 4000").collect()} == {(k, k % 4 < 2) for k in (*range(8), 4000)}


def test_lines_in_order_by_ranges(spark, tmp_path, monkeypatch):
    spark.range(450_000).select(((F.col("id") * 7919) % 450_000).alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(plans, "scratch", lambda spark, tag: f"{tmp_path}/{tag}")
    got = plans.QUERIES["lines_in_order"](spark, str(tmp_path))
    # 200,000 rows for a task that sorts, and a file of each
    assert len([f for f in os.listdir(f"{tmp_path}/ordered") if f.endswith(".txt")]) == 3
    assert got.agg(F.count(F.lit(1)), F.countDistinct("event_id"), F.bool_and("in_order")).first() == (450_000, 450_000, True)


def test_in_order_over_files_and_blocks(spark, tmp_path, monkeypatch):
    lines = [f"{n:05d}" + "x" * (n % 40) for n in range(3000)]
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("\n \n".join(lines[k * 1000 : k * 1000 + 1000]))
    monkeypatch.setattr(ndjson, "SORTED_BYTES", 10_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = ndjson.in_order(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 7
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in got] == lines
    assert len({(r.file, r.block) for r in got}) > 6


def test_parse_takes_the_value_out_of_its_check(spark):
    docs = ["null", " 1 ", '"a"', '{"a":[1,null]}', "[1]]", "1,2", "", "[]", "{} x", None]
    got = spark.createDataFrame([(d,) for d in docs], "j string").select(F.to_json(validate.parse(F.col("j"))), navigate.kind(validate.parse(F.col("j")))).collect()
    assert [r[0] for r in got] == ["null", "1", '"a"', '{"a":[1,null]}', None, None, None, "[]", None, None]
    assert [r[1] for r in got][:2] == ["null", "number"]


def test_stream_carries_as_the_batch_does(spark, tmp_path):
    docs = ['{"k":7}', '{"k":"x"}', '{"k":[1]}', '{"k":null}', "NaN", '{"j":"a"}', '{"k":9007199254740993,"j":null}', "{}", '{"j":null}', '{"k":1.5}']
    rows = [(n % 2, n, d) for n, d in enumerate(docs * 2)]
    fields, clears = {"k": "bigint", "j": "string"}, ("j",)
    spark.createDataFrame(rows[:9], "u int, n int, doc string").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame(rows[9:], "u int, n int, doc string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    all_rows = spark.read.parquet(f"{tmp_path}/in")
    want = sorted(tuple(r) for r in carry_forward(all_rows, "doc", fields, [F.col("n")], ["u"], clears).select("u", "n", "k", "j").collect())
    stream = carry_forward_stream(spark.readStream.schema(all_rows.schema).parquet(f"{tmp_path}/in"), "doc", fields, "u", "n", clears)
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("u", "n", "k", "j").collect()) == want


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        def __init__(self, master, path=None):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": path} if path else {}, self
            self.master, self._jsc, self.sc, self.getConf = master, self, lambda: self, lambda: {}
            self.getCheckpointDir = lambda: type("None_", (), {"isDefined": lambda s: False})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Fake("spark://host:7077"))
    assert shared_folder(Fake("spark://host:7077", "hdfs://a/b/")) == "hdfs://a/b"


def test_variant_members_side_by_side(spark):
    one = spark.createDataFrame([(1, '{"a":1}')], "id int, j string").select("id", F.parse_json("j").alias("odd {name}"))
    two = spark.createDataFrame([(2, '[5,6]')], "id int, j string").select("id", F.parse_json("j").alias("v"))
    a, b = iterate.variant_members(one, "odd {name}"), iterate.variant_members(two, "v")
    assert [(r.id, r.key) for r in a.collect()] == [(1, "a")] and [(r.id, r.pos) for r in b.collect()] == [(2, 0), (2, 1)]


def test_misfits_in_parts(spark):
    target = decode.schema(("a", "int"), ("s", "struct<x:int,l:array<int>>"), ("m", "map<int,int>"), name="top")
    rows = [
        ('{"a":"é"}', ("string", "int", "top", "a", 9)), ('{"a":1,"A":[2]}', ("array", "int", "top", "a", 12)), (' {"s":{"l":[1, {"q":1}]}}', ("object", "int", "", "s.l", 16)),
        ('{"s":{"x":1.5}}', ("number 1.5", "int", "", "s.x", 13)), ('{"m":{"x":1}}', ("key 'x'", "map<int,int>", "top", "m", 0)), ("[1]", ("array", "struct", "", "", 1)), ('{"a":null}', (None,) * 5),
    ]
    got = docs(spark, *[r[0] for r in rows]).select("id", decode.unmarshal_detail(J, target).alias("r")).orderBy("id").collect()
    assert [tuple(g.r)[2:] for g in got] == [r[1] for r in rows]
    value, error, *_, offset = one(spark, '{"a":1]', decode.unmarshal_detail(J, target))[0]
    assert value is None and "invalid character" in error and offset == 7
    value, error, what, *_ = one(spark, '{"a":1,"q":2}', decode.unmarshal_detail(J, target, True))[0]
    assert value.a == 1 and "unknown field" in error and what is None


def test_hooks(spark):
    hooks = {"a": lambda raw: raw.upper(), "t": decode.text_hook(lambda t: t + "!")}
    of = lambda doc: one(spark, doc, decode.unmarshal_exact(J, "a string, t string, n int", hooks=hooks))[0]
    assert tuple(of('{"A":{"x":[1]},"t":"\\u0041","n":3}').value) == ('{"X":[1]}', "A!", 3)
    assert tuple(of('{"a":null,"t":null}').value) == ("NULL", None, None) and tuple(of("{}").value) == (None, None, None)
    assert of('{"t":1}').value is None and "number into text" in of('{"t":1}').error
    with pytest.raises(Exception, match="unexpected end"):
        docs(spark, "x").select(registry.marshaler(lambda t: "[1")(J)).collect()
    for rule, bad in (("number", "01"), ("number", "1\n"), ("raw", "{"), ("raw", "1 2")):
        with pytest.raises(Exception, match="invalid"):
            docs(spark, bad).select(encode.object_of(("f", J, rule))).collect()


def test_timestamps_are_rfc_3339(spark):
    of = lambda t: one(spark, f'{{"t":"{t}"}}', decode.unmarshal_exact(J, "t timestamp"))[0]
    assert of("2024-01-02T03:04:05+01:00").error is None and of("2024-01-02T03:04:05+01:00").value.t == of("2024-01-02T02:04:05Z").value.t
    assert all(of(t).value.t is None and of(t).error for t in ("2024-01-02", "20240102T030405Z", "2024-01-02T03:04:05", "2024-W01-1T00:00:00Z"))


def test_a_part_decodes_as_any_type(spark):
    v = F.try_parse_json(F.lit('{"meta":{"page":1},"items":[{"x":1},{"x":2}],"n":7,"s":"a","z":null}'))
    at = lambda p, kind: one(spark, "", decode.decode_value(navigate.path(v, p), kind))[0]
    assert [r.x for r in at("items", "array<struct<x:int>>")] == [1, 2] and at("meta", "map<string,int>") == {"page": 1} and at("n", "int") == 7 and at("s", "string") == "a"
    assert at("z", "int") is None and at("nope", "int") is None
