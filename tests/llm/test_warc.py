from __future__ import annotations

import glob
import gzip
import hashlib
import random

import pytest

from larkspur.llm import warc as W

BIG = "ä<p>" * 400
PAGES = [(1, "http://a/1", "<p>one"), (2, None, None), (3, "http://a/\r\n3 x", BIG), (4, "u", BIG), (5, "u", BIG), (6, "u", "y" * 1000), (7, "u", "y" * 1000), (8, "u", "z" * 999), (9, "u", "z" * 999), (None, "n", "null id"), (-4, "u", "")]


def expected(pages):
    last = {}
    for n, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000 and n is not None:
            last[b] = max(last.get(b, n), n)
    out = []
    for n, _, h in pages:
        b = (h or "").encode()
        r = last.get(b) if n != last.get(b, n) else None
        out.append((n, len(b), hashlib.sha1(b).hexdigest(), "response" if r is None else "revisit", r))
    return out


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, payload int").repartition(3)
    W.write_archives(df, str(tmp_path / "w"), archive_bytes=600)
    rows = W.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r.reason is None for r in rows) and len(glob.glob(str(tmp_path / "w/*/part-*"))) > 3
    got = [(r.number, r.payload_bytes, r.payload_digest, r.type, r.refers_to_number) for r in rows]
    assert sorted(got, key=str) == sorted(expected(PAGES), key=str)
    html = {r.number: bytes(r.payload).decode() for r in rows if r.type == "response"}
    assert html[5] == BIG and html[2] == "" and {r.uri for r in rows if r.number in (2, 3)} == {"urn:unknown", "http://a/%20%203%20x"}
    assert sum(len(gzip.decompress(open(f, "rb").read())) for f in glob.glob(str(tmp_path / "w/*/part-*"))) > 0


def test_repeated_rows_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(5, "u", BIG), (5, "u", BIG), (4, "u", BIG)], "page_id long, url string, html string")
    W.write_archives(df, str(tmp_path / "a"))
    got = sorted((r.number, r.type, r.refers_to_number) for r in W.read_archives(spark, str(tmp_path / "a"), payloads=False).collect())
    assert got == [(4, "revisit", 5), (5, "response", None), (5, "response", None)]
    W.write_archives(df.limit(0), str(tmp_path / "b"))
    assert W.read_archives(spark, str(tmp_path / "b")).count() == 0


def record(n, payload=b"data", kind="response"):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{n}>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def whole(data, found):
    """Records and gaps cover the bytes, in order."""
    at = 0
    for x in found:
        if (x.start, x.stop) != (at, at) and x.start == at:
            at = x.stop
    return at == len(data)


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    pack = (lambda b: gzip.compress(b, mtime=0)) if packed else (lambda b: b)
    parts = [pack(record(i, b"WARC/1.1\r\nnot a record " + bytes([65 + i]) * 50)) for i in range(6)]
    data = b"".join(parts)
    assert [x.id for x in W.salvage(data)] == [f"<urn:x:{i}>" for i in range(6)] and whole(data, W.salvage(data))
    bounds = [sum(map(len, parts[:i])) for i in range(7)]
    for damaged, lost in (
        (data[: bounds[2] + 40] + b"\xff\xfe" + data[bounds[2] + 42 :], {2}),
        (data[: bounds[2] + 30] + data[bounds[3] :], {2}),
        (b"junk" * 9 + data if not packed else data[: bounds[1]] + b"junk" * 9 + data[bounds[1] :], set()),
        (data[: bounds[5] + 20], {5}),
        (data[: bounds[1] + 25] + data[bounds[4] :], {1, 2, 3}),
    ):
        found = list(W.salvage(damaged))
        assert [x.id for x in found if not x.reason] == [f"<urn:x:{i}>" for i in range(6) if i not in lost]
        gaps = [x for x in found if x.reason]
        assert len(gaps) == 1 and whole(damaged, found)


def test_random_damage_never_crashes():
    rng = random.Random(5)
    for packed in (False, True):
        data = b"".join(gzip.compress(record(i)) if packed else record(i) for i in range(5))
        for _ in range(100):
            b = bytearray(data)
            for _ in range(rng.randrange(1, 4)):
                b[rng.randrange(len(b))] = rng.randrange(256)
            found = list(W.salvage(bytes(b)))
            assert whole(bytes(b), found)
            assert sum(1 for x in found if not x.reason) >= 1


def test_salvage_inside_members_and_mixed_archives():
    rng = random.Random(2)
    parts = [record(i, rng.randbytes(3000)) for i in range(8)]
    text = b"".join(parts)
    wrong = bytearray(text)
    wrong[len(parts[0]) * 3 + 500] ^= 1
    broken = bytearray(gzip.compress(text, mtime=0))
    broken[-4000:-3990] = b"\xff" * 10
    inner = [record(i, gzip.compress(b"page %d" % i)) for i in range(4)]
    for data, kept in (
        (gzip.compress(bytes(wrong), mtime=0), [0, 1, 2, 4, 5, 6, 7]),
        (gzip.compress(text, mtime=0)[:-4000], range(6)),
        (b"x" * 80 + b"".join(inner), range(4)),
        (inner[0] + gzip.compress(inner[1]) + b"junk" + inner[2] + gzip.compress(inner[3]), range(4)),
    ):
        found = list(W.salvage(data))
        assert [x.id for x in found if not x.reason] == [f"<urn:x:{i}>" for i in kept] and whole(data, found) and len([x for x in found if x.reason]) == 1
    found = list(W.salvage(bytes(broken)))
    assert {f"<urn:x:{i}>" for i in range(5)} <= {x.id for x in found if not x.reason} and whole(bytes(broken), found)


def test_long_records_end_in_zero():
    for text in (b"x", b"", b"y" * ((1 << 24) + 5)):
        made = W.member(text) + b"\0"
        assert gzip.decompress(made) == text


def test_record_numbers(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, -1, (1 << 63) - 1, -(1 << 63), 123456789):
        assert W.number_of(spark.range(1).select(W.record_id(F.lit(n).cast("long"), F.lit("s"))).first()[0]) == n
    assert W.number_of(spark.range(1).select(W.record_id(F.lit(None).cast("long"), F.lit("s"))).first()[0]) is None


def test_archives_of_pages_of_very_unlike_sizes(spark, tmp_path):
    """One very long page beside many short ones: archives are cut by their bytes, and all payloads come back, whatever their characters."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghij é\u65e5\U0001f600\0\n\r") for _ in range(n))
    rows = [(i, f"http://x/{i}", text(rng.randrange(50, 400))) for i in range(120)] + [(500, "http://x/long", text(400_000)), (501, None, None), (502, "http://x/y", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, archive string").repartition(2)
    W.write_archives(df, str(tmp_path / "u"), archive_bytes=8_000)
    sizes = [p.stat().st_size for p in (tmp_path / "u").rglob("part-*") if not p.name.endswith(".crc")]
    assert len(sizes) > 4 and sorted(sizes)[-2] <= 8_200 < max(sizes)
    found = W.read_archives(spark, str(tmp_path / "u")).collect()
    assert all(r.reason is None for r in found)
    assert {r.number: bytes(r.payload).decode() for r in found} == {i: t or "" for i, _, t in rows}
