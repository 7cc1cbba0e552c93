from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from larkspur.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """Every entry compared with every part, whole numbers only."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    firsts: dict = {}
    for (i, v, _), c in zip(kept, cut, strict=True):
        if i not in firsts or v < firsts[i][0]:
            firsts[i] = (v, c)
    order = sorted(firsts, key=lambda i: (i is None, i or 0))[:entries]
    books = [[firsts[i][1][p] for i in order] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            got: dict = {}
            for c in cut:
                got.setdefault(nearest(p, c[p])[1], []).append(c[p])
            new.append([tuple(sum(x) // len(x) for x in zip(*got[k], strict=True)) if k in got else e for k, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cut, strict=True):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    return sorted(map(repr, ((i, code, e, by_label[label], digest) for i, code, e, label in out)))


def got(df):
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_all_distances(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-3, 4, (rng.integers(1, 70), 3))  # small numbers: many ties and equal entries
    points = rng.integers(-5, 6, (500, 3))
    found, away = V.Tree(entries).nearest(points)
    d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == d.argmin(axis=1)).all() and (away == d.min(axis=1)).all()


@pytest.mark.parametrize("parts,entries,rounds", [(16, 64, 2), (2, 5, 3), (4, 256, 1), (2, 3, 0)])
def test_equals_plain(spark, parts, entries, rounds):
    rng = random.Random(parts)
    rows = [(i, [rng.choice([-0.3, 0.1, 0.5, rng.uniform(-2, 2)]) for _ in range(16)], rng.choice([None, 1, 2, 2, 2])) for i in rng.sample(range(-50, 400), 150)]
    rows += [rows[0], rows[1], (rows[2][0], [0.25] * 16, 1), (None, rows[3][1], None), (None, [1.0] * 16, 7)]
    rows += [(500, None, 1), (501, [], 1), (502, [None] * 16, 1), (503, [float("nan")] + [0.0] * 15, 1), (504, [float("-inf")] * 16, 2)]
    assert got(V.compress_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), parts, entries, rounds)) == plain(rows, parts, entries, rounds)


def test_edges(spark):
    made = lambda rows, schema=SCHEMA: V.compress_vectors(spark.createDataFrame(rows, schema), 2, 4)
    assert made([]).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and made([]).count() == 0
    assert made([(1, None, 1), (2, [1.0], 1)]).count() == 0  # no length that can be cut in two
    odd = [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0], 1), (3, [0.5, 2.0], 1)]
    assert sorted(r.vec_id for r in made(odd).collect()) == [2, 3]  # the most common length
    big = [(1, [1e30, 1.0], 1), (2, [-1e30, 0.0], 1), (3, [500_000.0, 1.0], 1)]
    assert [r.vec_id for r in made(big).collect()] == [3]  # squares beyond a long
    clash = spark.createDataFrame([(1, [0.5, 0.25], 3, "x", 1, "y")], "vec_id long, embedding array<double>, label int, code string, error int, v string")
    assert [tuple(r)[:4] for r in V.compress_vectors(clash, 2).collect()] == [(1, "0000", 0, 0)]
    with pytest.raises(ValueError):
        V.compress_vectors(clash, 2, 257)


def test_hot_label_is_joined_whole(spark, monkeypatch):
    rows = [(i, [i / 7, -i / 3], 1 if i % 3 else i) for i in range(300)]
    assert got(V.compress_vectors(spark.createDataFrame(rows, SCHEMA), 2, 8)) == plain(rows, 2, 8, 2)


def test_query_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    theirs = db.sql(V.ORACLES["op13_vector_codes"])
    at = [theirs.columns.index(c) for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")]
    assert got(V.op13_vector_codes(spark, sf)) == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())
