from __future__ import annotations

import numpy as np

from larkspur.llm import quality as Q


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    right = [0.9, 0.8, 0.75, 0.6]
    votes = np.array([[(t if rng.random() < a else not t) for a in right] for t in truth], dtype=int)
    names, counts = np.unique(["".join("bg"[v] for v in row) for row in votes], return_counts=True)
    post, acc, prior = Q.estimate(names.tolist(), counts.astype(float))
    assert abs(prior - 0.7) < 0.05
    for i, a in enumerate(right):
        assert abs(acc[i, 1, 1] - a) < 0.06 and abs(acc[i, 0, 0] - a) < 0.08
    by = dict(zip(names, post))
    hit = np.mean([(by["".join("bg"[v] for v in row)] >= 0.5) == t for row, t in zip(votes, truth)])
    assert hit >= np.mean((votes.mean(axis=1) >= 0.5) == truth) - 0.005 and hit > 0.9


def test_silence_is_no_evidence():
    post, _, _ = Q.estimate(["gg", "g-", "bb", "--"], np.array([500.0, 50.0, 80.0, 3.0]))
    assert post[0] > 0.9 and post[1] > 0.8 and post[2] < 0.2


def test_scores_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.score_quality(docs).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    good = [got[d].kept for d, q in truth.items() if q == 1]
    bad = [got[d].kept for d, q in truth.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "The cat sat on the mat."), (5, "The cat sat on the mat."), (None, "### $$$ ***"), (6, "word " * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, votes int, score int")
    got = Q.score_quality(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert {r.votes for r in got if r.doc_id in (1, 2, 3)} == {"b" * len(Q.LABELLERS)}
    assert Q.score_quality(df.limit(0)).count() == 0


def plain_em(rows, steps):
    """EM document by document, in plain loops: share of good ones and each document's posterior."""
    n = len(rows[0])
    post = []
    for r in rows:
        cast = [c for c in r if c != "-"]
        post.append(min(0.98, max(0.02, cast.count("g") / len(cast) if cast else 0.5)))
    for _ in range(steps):
        prior = (sum(post) + 1) / (len(post) + 2)
        rate = {}
        for k in range(n):
            for good in (0, 1):
                says = {v: 0.5 + sum((p if good else 1 - p) for r, p in zip(rows, post) if r[k] == v) for v in "bg"}
                for v in "bg":
                    rate[k, good, v] = says[v] / (says["b"] + says["g"])
        new = []
        for r in rows:
            odds = [1 - prior, prior]
            for k, c in enumerate(r):
                if c != "-":
                    odds = [odds[good] * rate[k, good, c] for good in (0, 1)]
            new.append(odds[1] / (odds[0] + odds[1]))
        moved, post = max(abs(a - b) for a, b in zip(new, post)), new
        if moved < Q.EM_STILL:
            break
    return prior, post


def test_em_equals_plain_em():
    rng = np.random.default_rng(3)
    rows = ["".join("-" if rng.random() < 0.2 else "bg"[int(t if rng.random() < a else not t)] for a in (0.9, 0.8, 0.7, 0.6)) for t in rng.random(400) < 0.6]
    names, at, counts = np.unique(rows, return_inverse=True, return_counts=True)
    post, _, prior = Q.estimate(names.tolist(), counts.astype(float))
    want_prior, want = plain_em(rows, Q.EM_STEPS)
    assert abs(prior - want_prior) < 1e-6 and np.abs(post[at] - np.array(want)).max() < 1e-6


def test_copies_keep_the_sample_bounded(spark):
    """Half of the rows are copies or null: the model is trained on different texts, no more than asked for."""
    rows = [(None, None)] * 300 + [(1, "The same text, again and again.")] * 300 + [(i, f"Some words of text number {i}, which is a sentence.") for i in range(200)] + [(i, "### $$$ " * (i % 7 + 1)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index, value = Q.train(docs, by_majority(docs), len(rows), rows=50)
    assert len(index) > 1 and np.isfinite(value).all()


def by_majority(docs):
    return {r.votes: 0.9 if r.votes.count("g") > r.votes.count("b") else 0.1 for r in Q.voted(docs).select("votes").distinct().collect()}
