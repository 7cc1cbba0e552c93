from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from larkspur.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_of(rows):
    held: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in held.items()}


def rebuilt(rows):
    held, out = turns_of(rows), {}
    for c, mine in held.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = held.get(base, [])[:h] + mine[h:]
    return out


def plain(sequences):
    """Every node with its whole list of members, and whole subtrees by looking at all nodes."""
    members: dict = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children: dict = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def subtree(path):
        todo, leaves, saved = [path], 0, 0
        while todo:
            at = todo.pop()
            todo += children.get(at, [])
            leaves += at not in children
            saved += (len(members[at]) - 1) * len(at[-1][1].encode()) if at else 0
        return leaves, saved

    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(sequences[c]) == len(path)))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children.get(path, [])), *subtree(path), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=lambda r: r[:2])


def talk(seed, n=120, deepest=12):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-40, 400), n):
        for t in range(rng.randrange(1, deepest)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", rng.choice(["hi", "hello", "Grüße", "x" * 30])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_rebuilt_conversations_equal_plain(spark, seed, monkeypatch):
    monkeypatch.setattr(P, "FAN", 2)
    rows = talk(seed)
    rows += [(c, None, "system", "first of all") for c in {r[0] for r in rows[::5]}] + [(7001, 3, None, None), (7002, 3, "", ""), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(P.trie_of(P.reopened(P.digested(df)))) == plain(rebuilt(rows))


def test_small_tables_and_pieces(spark, monkeypatch):
    """Tables of a few nodes and pieces of three ends: every flush and every split of a list."""
    monkeypatch.setattr(P, "NODES", 4)
    monkeypatch.setattr(P, "ENDS", 3)
    monkeypatch.setattr(P, "FAN", 2)
    rows = talk(5) + [(c, t, "user", "same") for c in range(1000, 1080) for t in range(3)] + [(2000, t, "user", f"deep {t}") for t in range(70)]
    assert got(P.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(turns_of(rows))


def test_edges(spark):
    made = lambda rows, schema=SCHEMA: got(P.conversation_trie(spark.createDataFrame(rows, schema)))
    assert made([]) == [] and made([(None, 1, "a", "b")]) == []
    long = [(1, 0, "u", "é" * 700_000), (2, 0, "u", "é" * 700_000), (3, 0, "u", "é" * 699_999 + "e")]
    assert made(long) == plain(turns_of(long))
    twice = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a")]  # a repeated row is a turn of its own
    assert made(twice) == plain(turns_of(twice))
    apart = [(1, 0, "ab", "c"), (2, 0, "a", "bc")]  # roles and texts do not run together
    assert made(apart) == plain(turns_of(apart))
    clash = [(1, 0, "u", "a", "x", 5, 9), (2, 0, "u", "a", "y", 6, 8)]
    assert made(clash, SCHEMA + ", digest string, depth int, n long") == plain(turns_of([r[:4] for r in clash]))


def test_hot_opening(spark):
    rows = [(c, t, "user", "hi" if t < 2 else f"{c}") for c in range(600) for t in range(3)]
    assert got(P.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(turns_of(rows))


def test_query_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    theirs = db.sql(P.ORACLES["op12_prefix_trie"])
    at = [theirs.columns.index(c) for c in NAMES]
    mine = got(P.op12_prefix_trie(spark, sf))
    assert mine == sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=lambda r: r[:2])
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert mine == plain(rebuilt([tuple(r) for r in rows]))
