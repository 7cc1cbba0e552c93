from __future__ import annotations

import random
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(tokenizer):
    encode, rng = P.Encoder(PATH), random.Random(1)
    assert encode.words is not None
    texts = ["", " ", "Hello, World's end!! it's we'll 3.14 <|endoftext|> x", "ÄÖÜ straße ÉÈ ñandú ½²", "naïve café", "日本 語 ١٢  x\x1cy İstanbul ΟΔΟΣ", "a\r\n\tb\x0bc\x0cd\x85e", "don'ts 'S 'RE ''s", "word" * 50, "﻿​z"]
    letters = "abcdeorstnäéñß .,'!-0123\nXYZ’“日ｶ"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for t in texts:
        assert encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_best_fill_equals_search():
    rng = random.Random(2)
    for _ in range(300):
        room = rng.randrange(1, 40)
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        best = 0
        for n in range(1, 13):
            for c in combinations_with_replacement(sorted(counts), n):
                if sum(c) <= room and all(c.count(x) <= counts[x] for x in set(c)):
                    best = max(best, sum(c))
        lengths = sorted((x for x in counts if x <= room), reverse=True)
        slack, used = P.best_fill(lengths, counts, room)
        assert slack == room - best and sum(k * v for k, v in used.items()) == best and all(0 < v <= counts[k] for k, v in used.items())


def holds(rows, docs, window):
    """Every id in one piece, sequences gapless and within the window; the ids of padding."""
    parts, sequences, n = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in rows:
        parts[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, ids in docs:
        n[d] += 1
    for d, ids in docs:
        mine = sorted(parts[d])
        assert sum(x[1] for x in mine) == len(ids) * n[d]
        if n[d] == 1:
            at = 0
            for start, length, crc, total in mine:
                assert (start, total) == (at, len(ids)) and zlib.crc32(ids[start : start + length].tobytes()) == crc
                at += length
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding, len(sequences)


@pytest.mark.parametrize(("window", "texts"), [(64, "mixed"), (64, "alike"), (16, "long"), (2048, "edge")])
def test_packing(spark, tokenizer, window, texts):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["the", "onharent", "x", "zürich,"]) for _ in range(n))
    made = {
        "mixed": [some(rng.randrange(80)) for _ in range(150)],
        "alike": ["the " * 40] * 90 + ["x"],
        "long": ["the end. " * 3000, "", "a"],
        "edge": [None, "", " ", "x", "x", "the " * 2047, "the " * 2048, "the " * 9000],
    }[texts]
    rows = [(i, t, 1, 2) for i, t in enumerate(made)] + ([(3, "x", 1, 2), (None, "null id", 1, 2)] if texts == "edge" else [])
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, row_id int").repartition(3)
    out = P.with_digest(P.pack(df, window=window)).collect()
    docs = [(r[0], np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")) for r in rows]
    padding, n = holds(out, docs, window)
    total = sum(len(x) for _, x in docs)
    assert padding <= max(0.01 * total, P.MAX_SLACK * 3) and n <= total / window * 1.07 + 14


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
