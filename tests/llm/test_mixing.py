from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import mixing as M


def plain_targets(sizes, most=3.0):
    """Sharing by weight, capping, and sharing what is over again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        w = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def made(seed, sources, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        s = sources[0] if rng.random() < 0.34 else rng.choice(sources)
        rows.append((i, " ".join("w" * rng.randrange(1, 4) for _ in range(int(rng.paretovariate(0.9)) % 900)), s))
    return rows


@pytest.mark.parametrize(("seed", "sources"), [(1, ["hot", "a", "b", "Z", None, "é"]), (2, ["one"]), (3, ["x", "tiny", "y"])])
def test_targets_and_takes(spark, seed, sources):
    rows = made(seed, sources, 700) + [(1000, None, "empty"), (1001, "", "empty"), (1002, " \n", "a"), (3000, "repeat me", "a"), (3000, "repeat me", "a"), (None, "no id", "b"), (2000, "w " * 4000, sources[0])]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, source string, size int, target int").repartition(3)
    got = M.mix(df).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += count(t)
    want = plain_targets(dict(sizes))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, count(t)) for d, t, _ in rows)
    source = {(d, count(t)): s for d, t, s in rows}
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 8 + longest[s] / 2, s
    assert sorted(map(str, M.mix(df.repartition(6)).collect())) == sorted(map(str, got))


def plain_rates(sizes, target, most=3.0):
    """Rates of one source by bisection of the dual in one multiplier."""
    import math

    mean = sum(sizes) / sum(1 for x in sizes if x)
    words = lambda m: sum(x * min(most, math.exp(min(700.0, m * x / mean))) for x in sizes)
    low, high = -1e6, 1e6
    for _ in range(400):
        middle = (low + high) / 2
        low, high = (middle, high) if words(middle) < target else (low, middle)
    return [min(most, math.exp(min(700.0, low * x / mean))) for x in sizes]


def test_rates_solve_the_dual(spark):
    """Tilts follow documents' sizes; rates meet the plain solver's, and no other feasible rates are closer to 1."""
    import math

    rows = [(i, t, s) for i, t, s in made(11, ["a", "b", "c", "d"], 300)] + [(900, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by, source = defaultdict(list), {i: s for i, _, s in rows}
    for r in M.mix(df).collect():
        by[source[r.doc_id]].append(r)
    differ = 0
    for s, held in by.items():
        sizes, target, rates = [r.size for r in held], held[0].target, [r.rate for r in held]
        if 0 < target < 3 * sum(sizes) * (1 - 1e-9):
            assert rates == pytest.approx(plain_rates(sizes, target), rel=1e-6, abs=1e-9)
            assert sum(n * x for n, x in zip(sizes, rates)) == pytest.approx(target, rel=1e-6)
            differ += len({round(x, 6) for x in rates}) > 2
            # along any direction that keeps the words, relative entropy rises: its slope there is nothing
            free = [(n, x) for n, x in zip(sizes, rates) if 1e-6 < x < 3 and n]
            for (n1, x1), (n2, x2) in zip(free, free[1:]):
                assert math.log(x1) / n1 == pytest.approx(math.log(x2) / n2, rel=1e-5, abs=1e-9)
    assert differ >= 2


def test_many_equal_rows_are_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    rows = [(7, "same words here", "hot")] * 300 + [(100 + i, "other text " * (i % 5 + 1), "hot" if i % 2 else "cold") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    thin = M.thin_rows(df)
    chunks = M._chunks(thin, 8).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in chunks) == [4] + [8] * 37
    one, two = (M.mix_thin(M.thin_rows(x), block=8).collect() for x in (df, df.repartition(7)))
    key = lambda r: (r.doc_id, r.size, r.copies)
    assert Counter(map(key, one)) == Counter(map(key, two))
    taken = Counter()
    for r in M.mix(df).collect():
        taken[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in M.mixed_documents(df).collect()) == +taken


def test_tilted_rates_meet_targets(spark):
    thin = spark.createDataFrame([(s, n, t) for s in ("a", "b", "c") for n, t in ((10, 0.5), (30, 1.0), (5, 2.0))], "source string, size long, tilt double")
    goals = spark.createDataFrame([("a", 100.0), ("b", 20.0), ("c", 135.0)], "source string, target double")
    m = {r.source: r.multiplier for r in M.rates(thin, goals).collect()}
    words = thin.collect()
    import math

    for s, t in (("a", 100.0), ("b", 20.0)):
        assert sum(r.size * min(3.0, math.exp(m[s] * r.tilt)) for r in words if r.source == s) == pytest.approx(t, rel=1e-6)
    assert m["c"] == math.inf


def test_mixed_documents(spark):
    rows = made(5, ["x", "y"], 120) + [(7, "again and again", "x"), (7, "again and again", "x")]
    df = spark.createDataFrame([(t, d, s, 1) for d, t, s in rows], "text string, doc_id long, source string, stable int")
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    a = Counter((r.doc_id, len(r.text.split())) for r in out.collect())
    b = Counter()
    for r in M.mix(df).collect():
        b[r.doc_id, r.size] += r.copies
    assert a == +b


@pytest.mark.parametrize("rate", [0.6, 1.4, 2.6])
def test_long_documents_of_many_blocks(spark, rate):
    rng = random.Random(3)
    sizes = [rng.randrange(50, 400) for _ in range(10_200)] + [400_000] * 40
    rated = [(i, rng.getrandbits(62), 0, "s", n, rate) for i, n in enumerate(sizes)] + [(20_000, 5, 0, None, 7, 1.0)]
    got = {r.row_id: r.copies for r in M.round_copies(spark.createDataFrame(rated, "row_id long, stable long, one long, source string, size long, rate double")).collect()}
    due = rate * sum(sizes)
    assert len(got) == len(rated) and got[20_000] == 1 and {got[i] for i in range(len(sizes))} == {int(rate), int(rate) + 1}
    assert abs(sum(got[i] * n for i, n in enumerate(sizes)) - due) < 0.001 * due


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).count() == 0 and M.mixed_documents(df).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in M.mix(none).collect()] == [(0, 0.0, 0)] * 2
    assert M.word_count(F.lit("x")) is not None


def test_mixed_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "w " * 300_000, "a"), (4, "w", "a"), (5, "same row", "b"), (5, "same row", "b"), (None, "no id here", "b")]
    df = spark.createDataFrame([(*r, {"k": 1}, [r[0]]) for r in rows], "doc_id long, text string, source string, one map<string,int>, copies array<long>")
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    taken, want = Counter(r.doc_id for r in out.collect()), Counter()
    for r in M.mix(df).collect():
        want[r.doc_id] += r.copies
    assert taken == +want and set(taken) <= {r[0] for r in rows}


def test_targets_equal_sql(spark, sf):
    """size, source_size and target of the query by water filling in DuckDB: sources are full from the one with the least room for its weight on."""
    import duckdb

    theirs = duckdb.sql(f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{sf}/documents.parquet'),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3.0 * source_size AS most, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
l AS (SELECT max((total - full_before) / open_weight) FILTER ((total - full_before) / open_weight <= most / weight) AS level FROM o)
SELECT d.doc_id, d.size, w.source_size, least(w.most, l.level * w.weight) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source CROSS JOIN l""").fetchall()
    mine = {r.doc_id: (r.size, r.source_size, r.target) for r in M.op10_mixing(spark, sf).collect()}
    assert len(mine) == len(theirs)
    for doc, size, whole, target in theirs:
        got = mine[doc]
        assert got[:2] == (size, whole) and abs(got[2] - float(target)) <= 1e-9 * float(target), doc
