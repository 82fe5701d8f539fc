"""Values and elements by byte ranges against the reader of whole files."""

import random

import pytest

from jsonmill import strict
from jsonmill.sources import ranges
from jsonmill.sources.ndjson import read_values

SCALARS = ["1", "-2.5e+10", "true", "null", '"a"', '"\\\\"', '"x\\"[{"', '"]},\\\\\\""', '""', '"é\\u0041"', "1.5"]


def value(rnd, depth=0):
    k = rnd.random()
    if depth < 4 and k < 0.3:
        return "[" + rnd.choice([",", ", ", " ,"]).join(value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))) + "]"
    if depth < 4 and k < 0.55:
        return "{" + ",".join(f'"{rnd.choice(["a", "[", "é}"])}": {value(rnd, depth + 1)}' for _ in range(rnd.randint(0, 3))) + "}"
    return rnd.choice(SCALARS)


def by_ranges(path, size, step, elements):
    rows, in_string, depth, seen = [], 0, 0, False
    with ranges._open(f"file:{path}") as f:
        for start in range(0, max(size, 1), step):
            end = min(start + step, size)
            rows += ranges._frame(f, size, start, end, bool(in_string), depth, seen, elements)
            odd, outside, inside, text = ranges._summary(f, start, end)
            depth, in_string, seen = depth + (inside if in_string else outside), (in_string + odd) % 2, seen or text
    fault = min((r[0] for r in rows if r[3]), default=None)
    return [(r[0], r[2]) for r in rows if fault is None or r[0] < fault or (r[0] == fault and r[3])]


def at_once(data, elements):
    rows = []
    try:
        if elements:
            at = strict._skip(data, 0)
            if strict.kind_at(data, at) != "array":
                raise strict.SyntaxFault("the document is no array", at + 1)
            for _, a, z in strict.members(data, at):
                rows.append((a, strict.repair(data[a:z])))
            rest = strict._skip(data, strict.value_end(data, at))
            if rest < len(data):
                raise strict.SyntaxFault("text after it", rest + 1)
        else:
            for a, z in strict.values(data):
                rows.append((a, strict.repair(data[a:z])))
    except strict.JsonError as e:
        rows.append((max(e.offset - 1, 0), None))
    return rows


@pytest.mark.parametrize("seed", range(8))
def test_any_cut_gives_the_same_rows(tmp_path, seed):
    rnd, path = random.Random(seed), tmp_path / "x"
    for n in range(60):
        elements = n % 2 == 0
        inner = [value(rnd) for _ in range(rnd.randint(0, 6))]
        text = " " * rnd.randint(0, 5) + "[" + rnd.choice([",", ", "]).join(inner) + " ]" + "\n" * rnd.randint(0, 4) if elements else "".join(v + rnd.choice([" ", "\n", ""]) for v in inner)
        data = text.encode()
        if n % 5 == 0 and data:
            k = rnd.randrange(len(data))
            data = data[:k] + rnd.choice([b"", b"]", b"}", b'"', b",", b"x"]) + data[k + rnd.randint(0, 1) :]
        path.write_bytes(data)
        for step in (1, 2, 3, 7, 20, 1000):
            assert by_ranges(path, len(data), step, elements) == at_once(data, elements), (elements, step, data)


def test_on_spark(spark, tmp_path):
    rnd = random.Random(1)
    (tmp_path / "v").mkdir()
    (tmp_path / "e").mkdir()
    for n in range(4):
        (tmp_path / "v" / f"{n} x").write_text("".join(value(rnd) + " " for _ in range(200)) + ("}" + '"' * 9 if n == 3 else ""))
        (tmp_path / "e" / f"{n}").write_text("" if n == 3 else "[" + ",".join(value(rnd) for _ in range(300)) + "]" * (n < 2))
    (tmp_path / "v" / "none").write_text("")
    for kind in "ve":
        whole = [tuple(r) for r in read_values(spark, str(tmp_path / kind), elements=kind == "e").select("file", "start", "value").collect()]
        cut = [tuple(r) for r in ranges.read_ranges(spark, str(tmp_path / kind), elements=kind == "e", range_bytes=100, tasks=5).select("file", "start", "value").collect()]
        assert sorted(map(str, whole)) == sorted(map(str, cut)) and len(cut) > 600
