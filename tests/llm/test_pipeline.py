from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("corpus_pipeline")


def test_stages_against_plain_versions(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from larkspur.llm.mixing import WORDS
    from larkspur.llm.pseudonyms import DEMO_KEY, Feistel, pseudonymise

    sf, steps = "/root/testdata/sf0.001", {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps["documents"], columns = docs.collect(), docs.columns
    for name, stage in C.STAGES:
        docs = C.Table(stage(spark, docs, sf), name).df
        steps[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps["toxicity"]}
    assert kept <= {r.doc_id for r in steps["documents"]}
    assert sum(labels[d] for d in kept if d in labels) < 0.5 * sum(labels.values())
    assert sum(1 for d, t in labels.items() if not t and d in kept) > 0.95 * sum(1 for t in labels.values() if not t)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    rows = sorted(steps["toxicity"], key=lambda r: r.doc_id)
    sets, head = [shingles(r.text) for r in rows], {}
    for i in range(len(rows)):
        group = {head[j] for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
        head[i] = min(group, default=i)
        head |= {j: head[i] for j in head if head[j] in group}
    assert {r.doc_id for r in steps["near_duplicates"]} == {rows[i].doc_id for i in head if head[i] == i}

    f = Feistel(DEMO_KEY)
    assert {r.doc_id: r.text for r in steps["pii"]} == {r.doc_id: pseudonymise(r.text, f)[0] for r in steps["near_duplicates"]}

    size, want = (lambda t: len(re.findall(WORDS, t))), Counter()
    totals, taken = Counter(), Counter()
    for r in steps["pii"]:
        totals[r.source] += size(r.text)
    for r in steps["mixing"]:
        taken[r.source] += size(r.text)
        want[r.doc_id] += 1
    assert max(want.values()) <= 3 and set(want) <= {r.doc_id for r in steps["pii"]} and sum(taken.values()) == pytest.approx(sum(totals.values()), rel=0.05)

    tok, sequences = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    ids = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps["mixing"]}
    per_doc = Counter()
    for r in steps["packing"]:
        sequences[r.sequence_id].append((r.offset, r.length))
        per_doc[r.doc_id] += r.length
    assert per_doc == Counter({d: ids[d] * n for d, n in want.items()})
    lengths = [sum(n for _, n in s) for s in sequences.values()]
    assert max(lengths) <= 2048 and sum(2048 - n for n in lengths if n & (n - 1)) <= 0.01 * sum(lengths) + 8
    assert all(np.cumsum([0] + [n for _, n in sorted(s)])[:-1].tolist() == [o for o, _ in sorted(s)] for s in sequences.values())
    assert sorted(map(tuple, C.run(spark, sf).collect())) == sorted(map(tuple, steps["packing"]))
