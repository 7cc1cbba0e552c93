from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import language_model as L

SCHEMA = "doc_id long, text string"
NAMES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), "\n"]


def rest(doc):
    return zlib.crc32(str(doc).encode()) % 5


def plain_base(rows):
    count = Counter(w for i, t in rows if i is not None and rest(i) != 1 for w in words_of(t))
    n, v, out = sum(count.values()), len(count), []
    for i, t in rows:
        w = words_of(t)
        out.append((i, i is not None and rest(i) == 1, len(w), sum(x in count for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


class Tables:
    """The same counts as the filter, in a dictionary: what it should answer if no probe were ever wrong."""

    def __init__(self, items, cut):
        self.held, self.cut = {(k, key): level for k, key, level in items}, cut

    def counts(self, kind, keys):
        level = np.array([self.held.get((kind, int(k)), 0) for k in keys], np.int64)
        return L.count_at(np.where(level > self.cut.get(kind, 0), level, 0))


def corpus(n, seed, words=60):
    rng = random.Random(seed)
    pool = [f"W{i}" if i % 7 else f"ü{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text, at = [], rng.randrange(words)
        for _ in range(rng.randrange(0, 40)):
            at = (at * 3 + rng.choice([0, 0, 1])) % words if rng.random() < 0.8 else rng.randrange(words)
            text.append(pool[at])
        rows.append((i, rng.choice([" ", "\t\n", "  \x0b"]).join(text)))
    return rows


def held(got):
    return sorted((repr(r[0]), *r[1:5], round(r[5], 6)) for r in got)


def test_tokens_equal_plain():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aBÄß \t\n\x0b\x0c\r\x1c\x85  .,") for _ in range(rng.randrange(0, 30))) for _ in range(400)] + [None, "", " ", "A"]
    array = pa.array(texts)
    for part, mine in ((array, texts), (array.slice(37, 200), texts[37:237]), (array.slice(399), texts[399:])):
        counts, index, words = L.tokens(part)
        shown, at = words.to_pylist(), 0
        for text, n in zip(mine, counts, strict=True):
            assert [shown[i] for i in index[at : at + n]] == words_of(text)[:-1]
            at += n
        assert at == len(index)


def test_levels(spark):
    n = [*range(1, 3000), 2**20, 2**40 + 12345, 2**62]
    got = [r.level for r in spark.createDataFrame([(x,) for x in n], "n long").select(L.level_of(F.col("n")).alias("level")).collect()]
    assert all(a <= b <= a + 1 for a, b in zip(got, got[1:-3], strict=False)) and got[:8] == list(range(1, 9))
    assert all(0.88 < c / x < 1.13 for c, x in zip(L.count_at(np.array(got)), n, strict=True))


@pytest.mark.parametrize("bits", [12, 25])
def test_filter_never_under_estimates(spark, bits, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT_BITS", min(L.SEGMENT_BITS, 20))
    rng = random.Random(bits)
    n = 60 if bits == 12 else 30_000
    items = [(rng.choice([0, 1, 4]), rng.getrandbits(62), rng.randrange(1, 12)) for _ in range(n)]
    made = L.build(spark.createDataFrame(items, "kind int, key long, level int").repartition(5), bits, {4: 2})
    want = Tables(items, {4: 2})
    for kind in (0, 1, 4):
        keys = np.array([k for q, k, _ in items if q == kind])
        got, exact = made.counts(kind, keys), want.counts(kind, keys)
        assert (got >= exact).all() and (got == exact).mean() > 0.9
    strange = np.array([rng.getrandbits(62) for _ in range(20_000)])
    assert (made.counts(0, strange) > 0).mean() < 0.05


def test_base_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(L, "WORD_BITS", 4)  # 14 words in the vocabulary, the others are met in the join
    rows = corpus(150, 1) + [(900, None), (901, ""), (902, "  only one"), (None, "W1 W2 lost"), (3, "W1 again"), (3, "W1 again"), (903, "W5 " * 100_000)]
    df = spark.createDataFrame([(*r, "en", 1, 2.0) for r in rows], SCHEMA + ", word string, n int, score double").repartition(3)
    got = L.score_texts(df, filter_bits=18).collect()
    assert held(got) == held(plain_base(rows)) and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id == 3 and r.n_tokens == 3}) == 1
    again = L.score_texts(df.repartition(7), filter_bits=18).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_score_equals_plain_tables(spark, order):
    """The filter's answers against a dictionary of the same levels, and the recursion against one written out."""
    rows = corpus(200, order)
    docs = spark.createDataFrame(rows, SCHEMA)
    model, words = L.learnt(docs.where(L.learnable("doc_id")), order)
    train = [words_of(t) for i, t in rows if rest(i) != 1]
    ids = {w: i + 1 for i, w in enumerate(model.vocabulary.to_pylist())}
    counts: dict = {k: Counter() for k in range(1, order + 1)}
    for t in train:
        seq = [1, *(ids[w] for w in t)]
        counts[1].update(seq[1:])
        for k in range(2, order + 1):
            counts[k].update(g for i in range(len(seq) - k + 1) if 1 not in (g := tuple(seq[i : i + k]))[1:-1])
    n, novel = sum(counts[1].values()), max(1, sum(c == 1 for c in counts[1].values()))

    def quantised(c):
        e = max(0, c.bit_length() - 3)
        low = (4 * e + (c >> e) - 4 * e) << e
        return low + ((1 << e) - 1) / 2

    def p(gram):
        if len(gram) == 1:
            c = counts[1][gram[0]]
            return quantised(c) / (n + novel) if c else novel / (len(counts[1]) + 1) / (n + novel)
        shorter, past = p(gram[1:]), gram[:-1]
        of_past = {g: c for g, c in counts[len(gram)].items() if g[:-1] == past and c >= 2}
        if not of_past:
            return shorter
        whole = counts[1][past[0]] if len(past) == 1 else counts[len(past)][past]
        left = quantised(max(1, math.floor(whole - sum(c - L.DISCOUNT for c in of_past.values()) + 0.5)))
        times = quantised(whole)
        return min(1.0, max(0, (quantised(of_past[gram]) if gram in of_past else 0) - L.DISCOUNT) / times + min(1, left / times) * shorter)

    got = {r.doc_id: r.score for r in L.score_texts(docs, order).collect()}
    seen = 0
    for i, t in rows:
        w = words_of(t)
        if not all(x in ids for x in w):
            continue
        seq, total = [1, *(ids[x] for x in w)], 0.0
        for at in range(1, len(seq)):
            low = max(0, at - order + 1)
            while 1 in seq[low + 1 : at]:
                low += 1
            total += math.log10(p(tuple(seq[low : at + 1])))
        seen += abs(total - got[i]) < 0.02 * len(seq)
    assert seen > 0.97 * sum(all(x in ids for x in words_of(t)) for _, t in rows)
    words.drop()


def test_learns_more_than_the_base(spark):
    rows = corpus(900, 8)
    got = [r for r in L.score_texts(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    assert len(got) > 100 and sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)


def test_small_filter_cuts_rare_ngrams(spark):
    """Counts that do not fit are left to shorter histories; the base stays exact."""
    rows = corpus(400, 4, 3000)
    docs = spark.createDataFrame(rows, SCHEMA)
    model, words = L.learnt(docs.where(L.learnable("doc_id")), 2, 16)
    words.drop()
    assert model.filter.bits == 16 and model.filter.cut[L.GRAM + 2] > 1 and np.unpackbits(model.filter.data.view(np.uint8)).mean() < 0.45
    assert held(L.score_texts(docs, 2, 16).collect()) == held(plain_base(rows))


def test_edges(spark):
    made = lambda rows: L.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert made([]) == []
    out = next(i for i in range(50) if rest(i) == 1)
    none = made([(out, "nothing to learn from")])  # no training rows at all
    assert held(none) == held(plain_base([(out, "nothing to learn from")])) and math.isfinite(none[0].score)
    only = [(None, None), (None, "a")]
    assert held(made(only)) == held(plain_base(only))
    with pytest.raises(ValueError):
        L.learnt(spark.createDataFrame([], SCHEMA), 4)


def plain_pairs(rows):
    """Scores of the model of pairs that keeps every count, written out with exact counts; text by text."""
    train = [words_of(t) for i, t in rows if i is not None and rest(i) != 1]
    single, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["\n", *t], t, strict=False))
    after, n, novel = Counter(h for h, _ in pairs), sum(single.values()), max(1, sum(c == 1 for c in single.values()))

    def p(h, w):
        low = (single[w] or novel / (len(single) + 1)) / (n + novel)
        return (max(pairs[h, w] - L.DISCOUNT, 0) + L.DISCOUNT * after[h] * low) / single[h] if single[h] else low

    return {i: sum(math.log10(p(h, w)) for h, w in zip(["\n", *words_of(t)], words_of(t), strict=False)) for i, t in rows}


@pytest.mark.parametrize("bits", [29, 17, 16])
def test_every_pair_counts_at_least_one(spark, bits):
    """Also those seen once, with a filter that has room for all, for those that repeat, and for fewer: the rest is met by exact counts."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(0, 60)))) for i in range(1500)] + [(9000, None), (9001, "never seen"), (9002, "w1 w1 w1 " * 50)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model, words = L.learnt(docs.where(L.learnable("doc_id")), 2, bits, 1)
    words.drop()
    cut = model.filter.cut[L.GRAM + 2]
    assert cut == {29: 0, 17: 1}.get(bits, max(cut, 2)) < 100
    want = plain_pairs([r for r in rows if r[0] != 9001])
    got = {r.doc_id: r for r in L.score_texts(docs, 2, bits, 1).collect()}
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    off = [abs(got[i].score - want[i]) / got[i].n_tokens for i in want]
    assert np.mean(off) < 0.02 and np.quantile(off, 0.98) < 0.06
    again = L.score_texts(docs.repartition(7), 2, bits, 1).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


@pytest.mark.parametrize("least", [1, 2])
def test_small_filter_scores_as_a_large_one(spark, least):
    """Triples, whose histories may not fit either: what is in the tables alone is met exactly, where it was lost before."""
    rows = corpus(250, 11, 400)
    docs = spark.createDataFrame(rows, SCHEMA)
    model, words = L.learnt(docs.where(L.learnable("doc_id")), 3, 16, least)
    words.drop()
    assert model.filter.cut[L.GRAM + 3] > 1
    large, small = ({r.doc_id: r for r in L.score_texts(docs, 3, bits, least).collect()} for bits in (29, 16))
    off = [abs(small[i].score - large[i].score) / large[i].n_tokens for i, _ in rows]
    assert np.mean(off) < 0.01 and np.quantile(off, 0.98) < 0.05


def test_levels_in_numpy_equal_those_of_columns(spark):
    n = [*range(1, 3000), 2**20, 2**40 + 12345, 2**53 - 1]
    got = [r.level for r in spark.createDataFrame([(x,) for x in n], "n long").select(L.level_of(F.col("n")).alias("level")).collect()]
    assert L.levels_of(np.array(n)).tolist() == got


@pytest.mark.parametrize("segment", [20, 10])
def test_members_put_in_here_equal_those_of_tasks(spark, segment, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT_BITS", segment)
    rng = random.Random(segment)
    items = [(q, rng.getrandbits(62), rng.randrange(1, 40)) for q in (0, 4) for _ in range(500)]
    made = lambda rows: L.build(spark.createDataFrame(rows, "kind int, key long, level int"), 16, {4: 2})
    whole, part = made(items), made([x for x in items if x[0]])
    _, keys, levels = (np.array(x) for x in zip(*(x for x in items if not x[0]), strict=True))
    assert (part.data != whole.data).any()
    part.put(0, keys, levels)
    assert (part.data == whole.data).all()


@pytest.mark.parametrize("bits", [29, 16])
def test_driver_holds_no_vocabulary_as_rows_and_no_used_filter(spark, bits, monkeypatch):
    """Words and left-over masses come as arrays, not as a Row each, and a broadcast goes when its readers are done."""
    rows = [(i, " ".join(f"w{(i * 40 + k) * 7 % 6007}" for k in range(40))) for i in range(400)]
    docs, rows_seen, made = spark.createDataFrame(rows, SCHEMA), [], []
    frame, session, context = type(docs), type(spark), type(spark.sparkContext)
    collect, create, broadcast = frame.collect, session.createDataFrame, context.broadcast
    monkeypatch.setattr(frame, "collect", lambda self: (got := collect(self), rows_seen.append(len(got)))[0])
    monkeypatch.setattr(session, "createDataFrame", lambda self, data, *a, **b: (rows_seen.append(len(data)), create(self, data, *a, **b))[1])
    monkeypatch.setattr(context, "broadcast", lambda self, value: (made.append((type(value), b := broadcast(self, value))), b)[1])
    out = L.score_texts(docs, 2, bits, 1)
    assert max(rows_seen) < 300
    assert {t for t, _ in made} >= {L.Model, pa.StringArray} and [t for t, b in made if os.path.exists(b._path)] == ([tuple] if bits == 16 else [])
    assert out.count() == len(rows)
