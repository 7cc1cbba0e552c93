from __future__ import annotations

import bisect
import itertools
import random

import pytest
from pyspark.sql import functions as F

from larkspur.llm import ngram_join as J
from larkspur.llm.shared import components


def plain(docs, num=75, den=100, k=5):
    """Groups by comparing all pairs of sets of word tuples."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    head = list(range(len(docs)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            low[r] = d if low.get(r) is None else min(low[r], d)
    return sorted((str(d), len(s), str(low.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def found(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.near_duplicates(df, **how).collect())


def crowd(seed, groups, size, edits, words=70):
    """Groups of near copies of one text, edited at up to `edits` words, beside a passage that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, docs = [word() for _ in range(40)], []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs) * 3, " ".join(copy + passage * (rng.random() < 0.5))))
    rng.shuffle(docs)
    return docs


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "one two three four five"), (7, "ONE two three\tfour five"), (8, "É one two three four five"), (9, "é one two three four five"), (9, "one two"), (None, "one two"), (None, "alone here")]
    assert found(spark, docs) == plain(docs)
    assert found(spark, []) == []


def test_links_equal_all_pairs(spark):
    docs = crowd(1, 4, 14, 6) + [(1000 + i, t) for i, (_, t) in enumerate(crowd(2, 8, 3, 2, 30))]
    assert found(spark, docs) == plain(docs)


def test_large_groups_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE", 8)
    monkeypatch.setattr(J, "LARGE", 6)
    docs = crowd(3, 2, 60, 7)
    got = found(spark, docs)
    assert got == plain(docs) and len({x[2] for x in got}) > 2


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_tiles_are_bands_of_sizes(spark, monkeypatch, broadcast):
    """One group of documents of very unlike lengths: texts that end alike at many lengths, near copies of each among them."""
    monkeypatch.setattr(J, "TILE", 4)
    monkeypatch.setattr(J, "LARGE", 6)
    monkeypatch.setattr(J, "BROADCAST_ROWS", broadcast)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, docs = [word() for _ in range(12)], []
    for length in (3, 8, 11, 15, 20, 27, 36, 48, 64, 120):
        base = [word() for _ in range(length)]
        for k in range(5):
            copy = base + [word() for _ in range(rng.randrange(0, max(1, length // 4)))]
            copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs) * 2, " ".join(passage + copy)))
    assert found(spark, docs) == plain(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    heads = {x[2] for x in plain(docs)}
    assert {str(r.doc_id) for r in J.without_near_duplicates(df).collect()} == heads
    twice = {str(r.doc_id) for r in J.without_near_duplicates(df.union(df)).collect()}
    assert twice == heads


def test_dealt_tiles_hold_every_pair_that_may_link(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE", 5)
    rng = random.Random(2)
    sizes = {i: rng.choice([1, 2, 3, 4, 5, 40, 41, 53, 54, 70, 71, 72, 95, 400, 530, 535]) for i in range(90)}
    rows = spark.createDataFrame([(g, i, i, 0) for g in (1, 2) for i in range(90 if g == 1 else 4)], "members long, node long, comp long, size long")
    rows = rows.withColumn("size", F.when(F.col("members") == 1, 90).otherwise(4))
    dealt = J._dealt(rows, spark.createDataFrame(list(sizes.items()), "node long, n long"), 75, 100).collect()
    tiles: dict = {}
    for r in dealt:
        tiles.setdefault((r.members, r.i, r.j), []).append((r.node, r.side))
    met = set()
    for (g, i, j), held in tiles.items():
        pairs = [(min(a, b), max(a, b)) for (a, s), (b, t) in itertools.combinations(held, 2) if i == j or s != t]
        assert len(set(pairs)) == len(pairs) and not met & {(g, *p) for p in pairs}  # no pair twice
        met |= {(g, *p) for p in pairs}
    for a, b in itertools.combinations(range(90), 2):
        if 4 * min(sizes[a], sizes[b]) >= 3 * max(sizes[a], sizes[b]):
            assert (1, a, b) in met
    assert {(2, a, b) for a, b in itertools.combinations(range(4), 2)} <= met
    assert len(met) < 0.6 * 90 * 89 / 2


@pytest.mark.parametrize("num,den", [(75, 100), (3, 4), (30, 100), (99, 100)])
def test_alike_sizes_are_in_neighbouring_bands(num, den):
    least = J.size_bands(num, den, 5000)
    band = [bisect.bisect_right(least, n) for n in range(5000)]
    for n in range(1, 3000):
        assert band[min(4999, n * den // num)] <= band[n] + 1


def test_common_order_does_not_matter(spark, monkeypatch):
    docs = crowd(4, 3, 12, 5)
    monkeypatch.setattr(J, "COMMON_FROM", 1)
    assert found(spark, docs) == plain(docs)


@pytest.mark.parametrize("often", [1, 10**9])
def test_common_shingles_are_grouped_alike(spark, monkeypatch, often):
    monkeypatch.setattr(J, "COMMON_FROM", 2)
    monkeypatch.setattr(J, "OFTEN_FROM", often)
    docs = crowd(5, 2, 25, 6)
    assert found(spark, docs) == plain(docs)


def test_groups_of_both_ways(spark):
    rng = random.Random(6)
    keyed = sorted({(rng.randrange(30), rng.randrange(100)) for _ in range(400)} | {(50, n) for n in range(100)} | {(51, n) for n in range(100)} | {(60, 1)})
    df, want = spark.createDataFrame(keyed, "key long, node long").repartition(3), {}
    for k, n in keyed:
        want.setdefault(k, set()).add(n)
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    for common in ([], [50, 51, 60], list(range(100))):
        rows = J.grouped(df, spark.createDataFrame([(c,) for c in common], "key long")).collect()
        got = {}
        for r in rows:
            got.setdefault(r.members, []).append(r.node)
            assert r["size"] == sum(x.members == r.members for x in rows)
        assert {frozenset(v) for v in got.values()} == want and sum(map(len, got.values())) == sum(map(len, want))


@pytest.mark.parametrize("num", [30])
def test_low_thresholds(spark, num):
    docs = [(i, t) for i, (_, t) in enumerate(crowd(7, 3, 8, 12, 60))] + [(100 + i, " ".join(t.split()[: 25 + 20 * (i % 4)])) for i, (_, t) in enumerate(crowd(7, 3, 8, 0, 60))]
    assert found(spark, docs, num=num) == plain(docs, num=num)


def test_very_long_texts(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:60_000], "other", *words[60_001:]])), (3, "short text of a few words"), (4, " ".join(words[:70_000]))]
    assert found(spark, docs) == [("1", 119996, "1"), ("2", 119996, "1"), ("3", 2, "3"), ("4", 69996, "4")] == plain(docs)


def test_threshold_is_exact():
    import numpy as np

    a = np.arange(7, dtype=np.uint64)
    assert J.alike(a, np.append(a[:6], np.uint64(99)), 75, 100)  # 6 of 8
    assert not J.alike(a, np.array([0, 1, 2, 3, 4, 97, 98], dtype=np.uint64), 75, 100)


def test_deduplicated_rows_keep_their_columns(spark):
    docs = [(5, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (7, None, "z"), (8, "q r s t u v", "w")]
    df = spark.createDataFrame(docs, "doc_id long, text string, node string")
    assert sorted(map(tuple, J.without_near_duplicates(df).collect())) == [(2, "a b c d e f g", "y"), (7, None, "z"), (8, "q r s t u v", "w")]
    again = spark.createDataFrame([*docs, (2, "a b c d e f g", "y"), (8, "a b c d e f g", "v")], "doc_id long, text string, node string")
    assert sorted(map(tuple, J.without_near_duplicates(again).collect())) == [(2, "a b c d e f g", "y"), (7, None, "z"), (8, "q r s t u v", "w")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    head = {x: x for e in edges for x in e}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).df.where(F.lit(True)).count() == 0


def test_deduplicated_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(80_000))
    docs = [(1, None, "a"), (2, "", "b"), (None, "x y z x y z", "c"), (4, long, "d"), (5, long + " end", "e"), (6, "x y z x y z", "f"), (6, "x y z x y z", "f")]
    df = spark.createDataFrame(docs, "doc_id long, text string, keys string")
    kept = sorted((str(r.doc_id), r.keys_) for r in J.without_near_duplicates(df).withColumnRenamed("keys", "keys_").collect())
    assert kept == [("1", "a"), ("2", "b"), ("4", "d"), ("6", "f")]
    assert J.without_near_duplicates(df.limit(0)).count() == 0


def test_groups_of_one_crowd_are_dealt_as_one(spark, monkeypatch):
    docs, seen, real = crowd(11, groups=2, size=150, edits=5), [], J._dealt
    monkeypatch.setattr(J, "_dealt", lambda rows, *a: seen.append(rows.count()) or real(rows, *a))
    assert found(spark, docs) == plain(docs)
    assert 0 < seen[0] <= 5 * len(docs)


def test_united_groups_lose_no_pair(spark):
    rng = random.Random(5)
    groups = {g: sorted({*rng.sample(range(40), 25), *rng.sample(range(40, 400), rng.randrange(8))}) for g in range(30)}
    groups |= {g: rng.sample(range(400, 4000), 6) for g in range(30, 60)}  # of one component each: they stay
    comp = lambda x: 0 if x < 30 else x
    rows = [(g, x, comp(x), len(m)) for g, m in groups.items() for x in m]
    made = {}
    for r in J.united(spark.createDataFrame(rows, "members long, node long, comp long, size long")).collect():
        made.setdefault(r.members, []).append((r.node, r.size))
    assert all(len({x for x, _ in m}) == len(m) == n for m in made.values() for _, n in m)
    pairs = lambda sets: {p for m in sets for p in itertools.combinations(sorted(m), 2)}
    assert pairs(groups.values()) <= pairs([x for x, _ in m] for m in made.values())
    assert len(made) < len(groups) and sum(map(len, made.values())) < len(rows)
