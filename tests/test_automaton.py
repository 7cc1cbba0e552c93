from __future__ import annotations

import pickle
import random
import re
import time
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import automaton
from larkspur.functions.keywords import match_keywords, top_matching_keywords

LETTERS = ["a", "B", "b", "ß", "ẞ", "é", "É", "é", "_", "1", "²", " ", " ", "-", "!", "Σ", "σ", "ς", "İ", "ı", "i", "I", "ſ", "s", "K", "k", "ǅ", "ŉ", "\U00010400", "\U00010428", "\n"]


def keyword_of(rng, least=1, most=4):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randrange(least, most)))


def both(spark, texts, words, most):
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_id int, review string")
    vocabulary = spark.createDataFrame(list(enumerate(words)), "ord int, keyword string")
    got = {r.review_id: r.keywords for r in match_keywords(reviews, vocabulary, most=most).collect()}
    listed = reviews.select("review_id", top_matching_keywords(F.col("review"), F.array(*map(F.lit, words)), F.lit(most)).alias("k"))
    return got, {r.review_id: r.k for r in listed.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_array_form(spark, seed):
    rng = random.Random(seed)
    words = [keyword_of(rng) for _ in range(40)] + ["a", "a", "A", " ", "b a", "a b a"]
    texts = ["".join(keyword_of(rng, 0, 12) for _ in range(rng.randrange(0, 5))) for _ in range(150)] + [None, "", " \n", "a" * 5000 + " b"]
    got, want = both(spark, texts, words, rng.choice([1, 2, 3, 50]))
    assert got == want


@pytest.mark.parametrize("at_a_time", [16, 2])
def test_shards_chunks_and_passes_change_nothing(spark, monkeypatch, at_a_time):
    rng = random.Random(9)
    words, texts = [keyword_of(rng) for _ in range(60)], [keyword_of(rng, 0, 30) for _ in range(200)]
    monkeypatch.setattr(automaton, "SHARD_BYTES", 200)
    monkeypatch.setattr(automaton, "CHUNK_BYTES", 500)
    monkeypatch.setattr(automaton, "SHARDS", at_a_time)
    made = []
    monkeypatch.setattr(automaton, "_shards", lambda rows, n, some, f=automaton._shards: made.append(some) or f(rows, n, some))
    got, want = both(spark, texts, words, 3)
    assert got == want and len(made) == (1 if at_a_time == 16 else -(-made[-1].stop // 2)) and made[-1].stop > 3


def test_folding_keeps_lengths_and_classes():
    for c in map(chr, range(0x20000)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        assert len(automaton.folded(c)) == 1 and automaton.folded(c) == automaton._simple(c) and automaton.folded("é" + c)[1] == automaton._simple(c), hex(ord(c))
        assert automaton._is_word(c) == (c == "_" or unicodedata.category(c)[0] in "LN")


def test_finder_equals_a_search_for_each():
    rng = random.Random(2)
    for _ in range(200):
        words = [(i, "".join(rng.choice("ab -_") for _ in range(rng.randrange(1, 5)))) for i in range(rng.randrange(1, 12))]
        text = "".join(rng.choice("abAB -_") for _ in range(rng.randrange(0, 60)))
        want = sorted((m.start(), i, w) for i, w in words if (m := re.search(rf"\b{re.escape(w)}\b", text, re.IGNORECASE)))
        finder, most = automaton.Finder(words), rng.choice([None, 1, 2, 5])
        assert finder.first(text, most) == want[:most]
        plain = sorted((text.index(w), i, w) for i, w in words if w in text)
        assert automaton.Finder(words, whole=False).first(text) == plain


def test_empty_list(spark):
    reviews = spark.createDataFrame([(1, "a"), (None, None)], "review_id int, review string")
    none = spark.createDataFrame([(None, "a"), (1, None), (2, "  ")], "ord int, keyword string")
    assert [r.keywords for r in match_keywords(reviews, none).collect()] == [[], []]


def test_time_does_not_follow_the_list():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    took = []
    for n in (100, 100_000):
        finder = automaton.Finder([(i, f"zq{i}") for i in range(n)])
        began = time.perf_counter()
        for _ in range(20):
            finder.first(text, 3)
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.05


def test_hits_of_a_pass_are_held_in_bounded_pieces(spark, monkeypatch):
    """Texts that hold very many phrases: neither their batches nor their hits are Python objects all at once."""
    real = pa.RecordBatch.from_arrays
    monkeypatch.setattr(automaton, "SLICE_BYTES", 2000)
    monkeypatch.setattr(automaton, "HITS", 300)
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(i % 60)) for i in range(400)] + [None, ""]
    phrases = [(k % 3, f"w{k}") for k in range(97)]
    caught = {}

    class Rows:
        columns, schema, sparkSession = ["id", "text", "hits"], [], spark

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            caught["run"] = run

    shards = [type("Shard", (), {"value": (f"piece{k}", pickle.dumps(phrases[k::2]))}) for k in range(2)]
    automaton._pass(Rows(), 1, shards, None, False, False)
    hits = pa.array([[]] * len(texts), pa.list_(pa.struct([("at", pa.int64()), ("place", pa.int64()), ("phrase", pa.string())])))
    batch = real([pa.array(range(len(texts))), pa.array(texts), hits], Rows.columns)
    found = list(caught["run"](iter([batch])))
    sizes = [len(x.column(1).flatten()) for x in found]
    assert max(sizes) <= 300 and len(found) > 10
    rows = [[(h["at"], h["place"], h["phrase"]) for h in r] for x in found for r in x.column(1).to_pylist()]
    whole = automaton.Finder(phrases, whole=False)
    assert rows == [whole.first(t) if t else [] for t in texts]
