import random
from collections import defaultdict

import pytest

from jsonmill.llm import queries
from jsonmill.llm.warc import encode_record, gzip_member, read_archives, read_records, sha1_base32, write_archives

PAYLOADS = [b"", b"<p>a</p>", "é\r\n\r\nWARC/1.1\r\nb".encode(), b"x" * 5000, bytes(range(256))]


@pytest.mark.parametrize("wrap", [lambda r: r, gzip_member])
def test_round_trip(wrap):
    data = b"".join(wrap(encode_record(i, f"http://a/{i}", p)) for i, p in enumerate(PAYLOADS))
    assert [r.payload for r in read_records(data)] == PAYLOADS
    revisit = next(read_records(wrap(encode_record(1, None, b"abc", 7, True))))
    assert revisit.payload == b"" and revisit.payload_bytes == 3 and revisit.fields["warc-refers-to"] == "<urn:jsonmill:page:7>"


@pytest.mark.parametrize("wrap", [lambda r: r, gzip_member])
def test_salvage_recovers_all_that_is_whole(wrap):
    rng = random.Random(9)
    for _ in range(150):
        records = [wrap(encode_record(i, "u", rng.choice(PAYLOADS))) for i in range(6)]
        hurt = rng.sample(range(6), rng.randint(1, 3))
        parts = list(records)
        for k in hurt:
            r, how = records[k], rng.randrange(4)
            at = rng.randrange(len(r))
            parts[k] = [r[:at], r[:at] + bytes([r[at] ^ 255]) + r[at + 1 :], b"junk" * 3, r[:at] + b"\x1f\x8b\x08" + r[at:]][how]
        data = b"".join(parts)
        got = list(read_records(data))
        whole = {int(r.fields["warc-record-id"].strip("<>").rsplit(":", 1)[1]) for r in got if not isinstance(r, tuple)}
        assert whole >= set(range(6)) - set(hurt)
        covered = sorted({(r.offset, r.size) for r in got if not isinstance(r, tuple)} | {x[:2] for x in got if isinstance(x, tuple)})
        at = 0
        for offset, size in covered:  # records and gaps cover the file without holes
            assert offset == at
            at += size
        assert at == len(data)
    assert list(read_records(b"")) == []
    assert [x[:2] for x in read_records(b"nothing here")] == [(0, 12)]


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        top = max(groups[h or ""])
        again = len(b) >= least and i != top
        out.append((i, len(b), sha1_base32(b), "revisit" if again else "response", top if again else None))
    return sorted(out)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = queries.op9_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(tuple(r) for r in got) == expected(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(1, "u v\n", "same", 1), (2, None, "same", 2), (3, "u", None, 3), (4, "u", "", 4), (None, "u", "same", 5), (None, "u", "alone", 6), (2, None, "same", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    path = f"file://{tmp_path}/a"
    write_archives(pages, path)
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read_archives(spark, path).collect()]
    assert sorted(got, key=str) == sorted([(1, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 4, "revisit", 2), (None, 5, "response", None)], key=str)
    write_archives(pages, path + "2", min_revisit_bytes=1)
    assert [r.record_type for r in read_archives(spark, path + "2").collect() if r.page_id == 3] == ["response"]
    write_archives(pages.limit(0), path + "3")
    assert read_archives(spark, path + "3").count() == 0
    files = sorted((tmp_path / "a").glob("part-*"))
    data = files[0].read_bytes()
    files[0].write_bytes(data[:20] + b"?" + data[21:])
    (tmp_path / "a" / f".{files[0].name}.crc").unlink(missing_ok=True)
    hurt = read_archives(spark, path).collect()
    assert [r for r in hurt if r.gap_reason] and len([r for r in hurt if not r.gap_reason]) == len(rows) - 1


def ids(found):
    return [int(r.fields["warc-record-id"].strip("<>").rsplit(":", 1)[1]) for r in found if not isinstance(r, tuple)]


def test_members_of_many_records_are_salvaged():
    rng = random.Random(2)
    records = [encode_record(i, "u", rng.randbytes(3000)) for i in range(60)]
    hurt = list(records)
    hurt[20] = hurt[20][:-50] + b"?" + hurt[20][-49:]  # its digest differs
    got = list(read_records(gzip_member(b"".join(hurt))))
    assert ids(got) == [i for i in range(60) if i != 20] and len([x for x in got if isinstance(x, tuple)]) == 1
    whole = gzip_member(b"".join(records))
    cut = whole[: len(whole) * 3 // 4]
    assert len(cut) > 1 << 16
    after = gzip_member(encode_record(99, "u", b"after"))
    for data, last in ((cut, []), (cut + after, [99]), (whole[:-8] + bytes(8), []), (whole[:-8] + bytes(8) + after, [99])):
        got = list(read_records(data))
        n = len(ids(got)) - len(last)
        assert ids(got) == [*range(n), *last] and n >= (44 if data.startswith(cut) and not data.startswith(whole[:-8]) else 60)
        gaps = [x for x in got if isinstance(x, tuple)]
        assert len(gaps) == 1 and gaps[0][0] == next(r for r in got if not isinstance(r, tuple)).size
        assert sum(s for _, s in {(r.offset, r.size) if not isinstance(r, tuple) else r[:2] for r in got}) == len(data)
