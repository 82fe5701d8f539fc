"""The exact reader against Python's json where that is strict, and against hand-made vectors."""

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jsonmill import strict
from jsonmill.strict import JsonError

INVALID = [
    "{", "[", "}", "]", '{"a"}', '{"a":}', "{,}", "[1,]", "[1 2]", "[1,,2]", '{"a":1,}', "tru", "nul", "01", '"unterminated', "[}", '{"a":1} x', "1.2.3", '{"a" 1}', "", "  ",
    '"\x01"', '"\\x"', '"\\u12"', "﻿1", "NaN", "Infinity", "{'a':1}", "[1] // c", "[1]]", '{"a":1}]', '{"a":1}}', "1]x", "1],[2", '1},"y":{', '1,"y":2', "-", "+1", ".5", "1.", "1e", "[01]", "--1", '"\t"', '{1:2}',
]
VALID = ["0", "-0", "1e5", "1E+5", "-1.5e-7", '""', '"\\u00e9\\n"', '"\\ud800"', "[]", "{}", " [ 1 , 2 ] ", '{"a":{"a":[]},"a":1}', "true", "null\n", "1E700", '"/\\/"']


@pytest.mark.parametrize("doc", INVALID)
def test_invalid(doc):
    assert not strict.valid(doc.encode())
    assert strict.check(doc.encode()).offset >= 0


@pytest.mark.parametrize("doc", VALID)
def test_valid(doc):
    assert strict.valid(doc.encode())


def test_invalid_utf8_is_no_fault():
    assert strict.valid(b'"\xff\xe6\x97"')
    assert strict.repair(b"\xe6\x97") == "��" and strict.repair(b"a\xf0\x9f\x98b") == "a���b"


@pytest.mark.parametrize(("depth", "good"), [(16, True), (128, True), (1024, True), (9999, True), (10000, True), (10001, False), (20000, False)])
def test_depth(depth, good):
    assert strict.valid(b"[" * depth + b"]" * depth) is good


def strictly(text):
    def no(x):
        raise ValueError(x)

    try:
        json.loads(text, parse_constant=no)
        return text.strip(" \t\r\n") != ""
    except (ValueError, RecursionError):
        return False


def test_mutated_documents_agree_with_json():
    rng = random.Random(11)
    atoms = ["{", "}", "[", "]", ",", ":", '"a"', '"b\\n"', "1", "-2.5e3", "true", "null", " ", "\n", '"', "x", "0", "e", ".", "\\"]
    good = 0
    for _ in range(20_000):
        doc = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 9)))
        want = strictly(doc)
        good += want
        assert strict.valid(doc.encode()) == want, doc
    assert good > 300


trees = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4),
    max_leaves=20,
)


def same(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, float) or isinstance(b, float):
        return isinstance(a, (int, float)) and isinstance(b, (int, float)) and float(a) == float(b)
    return a == b


@settings(max_examples=200, deadline=None)
@given(trees, st.booleans())
def test_round_trips(tree, spaced):
    doc = json.dumps(tree, indent=2 if spaced else None, ensure_ascii=spaced).encode("utf-8", "surrogatepass")
    assert strict.valid(doc)
    small = strict.compact(doc)
    assert strict.compact(strict.indent(doc)) == small
    assert same(json.loads(small), json.loads(json.dumps(tree)))
    own = strict.encode(tree)
    assert same(json.loads(own), tree) or "�" in own
    assert same(strict.decode(doc), json.loads(doc)) or b"\\ud" in doc or any(ord(c) > 0xD7FF for c in str(tree))


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_text_reads_back(x):
    t = strict.float_text(x)
    assert float(t) == x and math.copysign(1, float(t)) == math.copysign(1, x) and "E" not in t and not t.endswith(".0")


@pytest.mark.parametrize(
    ("x", "text"),
    [(0.0, "0"), (-0.0, "-0"), (1.0, "1"), (1e14, "100000000000000"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.5e-9, "1.5e-9"), (123456789.0, "123456789"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (2.5, "2.5"), (1e100, "1e+100")],
)
def test_float_vectors(x, text):
    assert strict.float_text(x) == text


def test_single_floats():
    assert strict.float_text(123456792.0, single=True) == "123456790" and strict.float_text(0.1, single=True) == "0.1"
    with pytest.raises(JsonError):
        strict.float_text(float("nan"))


def test_surrogates_and_escapes():
    assert strict.unquote(b'"\\ud83d\\ude00"') == "😀" and strict.unquote(b'"\\ud800x"') == "�x" and strict.unquote(b'"\\ud800\\ud83d\\ude00"') == "�😀"
    assert strict.quote('<a&"\\\b\f\n\r\t\x01 é') == '"\\u003ca\\u0026\\"\\\\\\b\\f\\n\\r\\t\\u0001\\u2028é"'
    assert strict.quote("< ", html=False) == '"<\\u2029"'
    assert strict.quote(b"a\xffb") == '"a\\ufffdb"'


DOC = b'{"user": {"name": "Ann", "id": 7, "tags": ["x","y"]}, "items": [{"id": 1}, {"id": 2}], "a.b": "dot", "we\\\\ird": 1, "0": "zero", "dup": 1, "dup": 2, "": {"": 3}}'


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("user.name", '"Ann"'), ("user.tags.1", '"y"'), ("items.1.id", "2"), ("items.00.id", "1"), ("items.-1", None), ("items.2", None), ("items.x", None), ("a\\.b", '"dot"'), ("we\\\\ird", "1"),
        ("0", '"zero"'), ("dup", "1"), ("u*.na?e", '"Ann"'), ("items.*.id", "1"), ("user.", '{"name": "Ann", "id": 7, "tags": ["x","y"]}'), (".", '{"": 3}'), ("..", "3"), ("user.name.x", None), ("nope", None),
    ],
)
def test_paths(path, want):
    e = strict.find(DOC, path)
    assert (DOC[e[0] : e[1]].decode() if e else None) == want


def test_root_and_globs():
    assert strict.find(b" 1 ", "") == (1, 2) and strict.find(b"{bad}", "a") is None
    assert not strict.glob_match(b"*a*a*a*a*b", b"a" * 40)
    assert strict.glob_match("?".encode() * 2, "é".encode()) and strict.glob_match(b"a*", b"a") and not strict.glob_match(b"?", b"")


@pytest.mark.parametrize(
    ("doc", "path", "raw", "want"),
    [
        ("{}", "a.b.c", "1", '{"a":{"b":{"c":1}}}'), ('{"a": 1}', "a", "[2]", '{"a": [2]}'), ("[1, 2]", "-1", "3", "[1, 2,3]"), ("[1]", "1", "2", "[1,2]"), ("[]", "0", "1", "[1]"), ('{"x":[]}', "x.-1.y", "1", '{"x":[{"y":1}]}'),
        ("{}", "a.0", "1", '{"a":[1]}'), ('{ "a" : {"b":1} , "c":2}', "a.b", " true ", '{ "a" : {"b":true} , "c":2}'), ('{"a":1,"a":2}', "a", "3", '{"a":3,"a":2}'), ("{}", "a\\.b", "1", '{"a.b":1}'), ("{}", "é", "1", '{"é":1}'),
    ],
)
def test_set(doc, path, raw, want):
    got = strict.set_raw(doc.encode(), path, raw.encode()).decode()
    assert got == want and strict.valid(got.encode())


@pytest.mark.parametrize(("doc", "path", "raw"), [("{}", "", "1"), ("{}", "a.*", "1"), ("{}", "*", "1"), ("{", "a", "1"), ('{"a":1}', "a.b", "1"), ("[]", "1", "1"), ("[1,2]", "9", "1"), ("{}", "a.5", "1"), ("{}", "a", "x"), ("[]", "x", "1"), ("{}", "\udcdc", "1")])
def test_set_refuses(doc, path, raw):
    with pytest.raises(JsonError):
        strict.set_raw(doc.encode(), path, raw.encode())


@pytest.mark.parametrize(
    ("doc", "path", "want"),
    [('{"a":1,"b":2}', "a", '{"b":2}'), ('{"a":1,"b":2}', "b", '{"a":1}'), ('{"a":1}', "a", "{}"), ("[1, 2, 3]", "1", "[1, 3]"), ('{"a":1}', "x", '{"a":1}'), ('{"a":1,"a":2}', "a", '{"a":2}'), ('{"x.y":1}', "x\\.y", "{}"), ('{"a":{"b":[1]}}', "a.b.0", '{"a":{"b":[]}}'), ('{"a":1}', "a.b", '{"a":1}')],
)
def test_delete(doc, path, want):
    assert strict.delete(doc.encode(), path).decode() == want


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.dictionaries(st.text("abc", min_size=1, max_size=2), st.integers(), max_size=3), max_size=4), st.lists(st.text("abc", min_size=1, max_size=2), min_size=1, max_size=2))
def test_set_then_get_then_delete(tree, keys):
    doc, path = json.dumps(tree).encode(), ".".join(keys)
    new = strict.set_raw(doc, path, b'"new"')
    a, z = strict.find(new, path)
    assert new[a:z] == b'"new"'
    assert strict.find(strict.delete(new, path), path) is None


@pytest.mark.parametrize(
    ("data", "want"),
    [('{"a":1}{"b":2}', ['{"a":1}', '{"b":2}']), ("1 2 3", ["1", "2", "3"]), ('"x" "y"', ['"x"', '"y"']), ("[1,2,3][4]", ["[1,2,3]", "[4]"]), ("0000", ["0"] * 4), ("", []), ("  ", [])],
)
def test_values(data, want):
    assert [data[a:z] for a, z in strict.values(data.encode())] == want


@pytest.mark.parametrize(("data", "before"), [('{"a":1}garbage', 1), ('{"a":', 0), ("[1,2", 0), ('"unterminated', 0), ("[01]", 0)])
def test_values_before_a_fault_are_delivered(data, before):
    got = []
    with pytest.raises(JsonError):
        got.extend(iter_into(got, data))
    assert len(got) == before


def iter_into(out, data):
    for e in strict.values(data.encode()):
        out.append(e)
    return []


@pytest.mark.parametrize(("data", "want"), [('  {"a":1}  ', (2, 9)), ("[1,2,3] trailing", (0, 7)), ("{bad}", (0, 5)), ("1 ]", None), ('1 "', None), ("", None), ("12,", (0, 2))])
def test_first_extent(data, want):
    assert strict.first_extent(data.encode()) == want


def test_numbers():
    assert strict.decode(b"[1.0, 1e2]", use_number=True) == ["1.0", "1e2"]
    with pytest.raises(strict.TypeFault):
        strict.decode(b"1E700")
    with pytest.raises(JsonError):
        strict.encode(strict.Number("01"))
    assert strict.encode({"b": 1, "a": [None, True, b"hi", strict.Number("")]}) == '{"a":[null,true,"aGk=",0],"b":1}'


def test_the_quick_way_agrees_with_the_token_walk(monkeypatch):
    more = [b'{"a":NaN}', b"-Infinity", b"\xef\xbb\xbf1", b'"\xff\xfe"', b'{"\xe9":1,"k":[1,2,{}]}', b"[" * 600 + b"]" * 600, b'"' + b"[" * 600 + b'"', b"1" * 5000, b'"\\ud834\\udd1e \\ud834"', b'{"a":1,"a":{"b":[ 1 , 2 ]} , "c":""}', b"1e999"]
    texts = [t.encode() if isinstance(t, str) else t for t in (*VALID, *INVALID)] + more

    def results():
        out = []
        for t in texts:
            row = [strict.valid(t), [strict.find(t, p) for p in ("", "a", "a.b.1", "k.2", "0", "*")]]
            for f in (lambda: strict.decode(t, True), lambda: strict.decode(t), lambda: strict.set_raw(t, "k.-1", b"7"), lambda: strict.delete(t, "a")):  # noqa: B023
                try:
                    row.append(repr(f()))
                except strict.JsonError as e:
                    row.append((e.message, e.offset))
            out.append(row)
        return out

    quick = results()
    monkeypatch.setattr(strict, "_plain", lambda data: None)
    assert quick == results()


def test_deep_trees_are_written_and_read():
    for n in (499, 501, 9_999, 10_000):
        text = b"[" * n + b"]" * n
        assert strict.encode(strict.decode(text)).encode() == text
        assert strict.find(text, "0.0") is not None and strict.compact(b" " + text) == text
    assert strict.check(b"[" * 10_001 + b"]" * 10_001).message == "exceeded max depth"
    assert strict.encode({"b": [1, {"y": None, "x": (True, b"hi")}], "a": strict.Number("1.50")}) == '{"a":1.50,"b":[1,{"x":[true,"aGk="],"y":null}]}'


def test_check_passes_over_runs(monkeypatch):
    """The faults of tokens(), without a token at a time."""
    r, docs = random.Random(7), []
    for _ in range(3000):
        parts = r.choices(["[", "[[ [", '{"a":', '{ "]" : {"":', "]", "] ]", "}", "}]", ",", '1,"[",', '"b":2,', '"b"', " ", "01", "null", "{}", "[]"], k=r.randrange(1, 12))
        docs.append("".join(parts).encode())
    docs += [b"[" * 700 + b"]" * 701, b'[{"a":' * 6000, b"[ " * 10_001, b"[" * 2000 + b"]" * 1000 + b"}" * 1000, b'[{"a":' * 1500 + b"1" + b"}]" * 1500]

    def slow(data: bytes):
        try:
            return list(strict.tokens(data)) and None
        except strict.JsonError as e:
            return e.message, e.offset

    want = [slow(d) for d in docs]
    monkeypatch.setattr(strict, "tokens", None)
    got = [strict.check(d) for d in docs]
    assert [e and (e.message, e.offset) for e in got] == want
    assert want[-1] is None and sum(w is None for w in want) > 20
