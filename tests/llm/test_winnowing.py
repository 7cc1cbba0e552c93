from __future__ import annotations

import hashlib
import random

import pytest

from larkspur.llm import winnowing as W


def plain(text, gram, span):
    """Winnowing as it is said: (hash, position) of each window's smallest, rightmost k-gram, by the same hash."""
    import numpy as np

    points = np.array([ord(c) for c in text], dtype="<u4")
    if not len(points):
        return []
    gram = min(gram, len(points))
    full = [int(W.gram_hashes(points[i : i + gram], gram)[0]) for i in range(len(points) - gram + 1)]
    kept = set()
    span = min(span, len(full))
    for i in range(len(full) - span + 1):
        kept.add(min(range(i, i + span), key=lambda j: (full[j] >> 24, -j)))
    return [(full[j] >> 32, j) for j in sorted(kept)]


@pytest.mark.parametrize(("gram", "span"), [(1, 1), (3, 4), (5, 7), (20, 100)])
def test_winnow_equals_plain(gram, span, monkeypatch):
    rng = random.Random(gram)
    for segment in (1 << 23, 16):
        monkeypatch.setattr(W, "_SEGMENT", segment)
        for _ in range(60):
            text = "".join(rng.choice("ab\U0001f600é") for _ in range(rng.randrange(150)))
            hashes, pos = W.winnow(text, gram, span)
            assert list(zip(hashes.tolist(), pos.tolist())) == plain(text, gram, span)


def test_guarantee():
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefghij ") for _ in range(W.GRAM + W.SPAN - 1))
    for _ in range(40):
        a, b = ("".join(rng.choice("klmnop ") for _ in range(rng.randrange(400))) + shared + "".join(rng.choice("qrstuv ") for _ in range(rng.randrange(400))) for _ in range(2))
        assert set(W.winnow(a)[0].tolist()) & set(W.winnow(b)[0].tolist())


@pytest.mark.parametrize("size", [40, 41, 59, 60, 100, 118, 250, 399])
def test_short_texts_share_a_hash_with_their_edited_text(size):
    rng = random.Random(size)
    for following in (30, size, 2000):
        for _ in range(20):
            text, after = ("".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcdefghij ", size), ("klmnop ", following)))
            a, b = (set(W.winnow(t)[0].tolist()) for t in (text, W.edited(text, after)))
            assert W.likeness(a, b) > 0


def test_table_equals_plain(spark):
    rng = random.Random(4)
    rows = [(i * 7 % 101 - 20, "".join(rng.choice("ab cé") for _ in range(rng.randrange(300)))) for i in range(90)]
    rows += [(500, None), (501, ""), (502, "x" * 50_000), (503, "same text here"), (504, "same text here"), (505, "twin"), (505, "twin two"), (None, "null id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(5)
    got = sorted(W.fingerprint_documents(df, 5, 8).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(rows)
    for i, r in enumerate(got):
        text, after = order[i][1], order[(i + 1) % len(order)][1]
        new = W.edited(text, after)
        show = lambda t: "".join(f"{h:08x}{p:08x}" for h, p in plain(t, 5, 8)) if len(t) < 1000 else W.as_string(*W.winnow(t, 5, 8))
        assert (r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint) == (order[i][0], len(text), show(text), show(new))
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {r.doc_id: r.near_next for r in got}[503] == 1.0


@pytest.mark.parametrize("rows", [[], [(3, "alone")]])
def test_few_rows(spark, rows):
    got = W.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.near_next == 1.0 for r in got)


def test_digests_equal_sql(spark, sf):
    """n_chars and edited_sha256 of the query, as DuckDB has them."""
    import duckdb

    theirs = duckdb.sql(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM '{sf}/documents.parquet'),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS f, length(t) // 2 AS half FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - half) || left(f, half)) AS edited_sha256 FROM n""").fetchall()
    mine = W.op8_winnowing(spark, sf).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, mine)) == sorted(theirs) and len(mine) == 200
