"""Exact Jaccard self-join of documents on word shingles, and the groups that its links form.

Candidates come from prefixes: with each set in one common order, rare shingles first, two sets alike enough share
one of their first shingles (Chaudhuri et al., "A Primitive Operator for Similarity Joins"). The order puts shingles
that a bounded sample shows to be common last; any order gives the same result, this one keeps groups small. Groups
with the same members count once. Candidates are then compared in size-banded tiles: parity bitmaps of hashed
shingles, as wide as the band needs, whose differing bits bound the overlap from above (Sandes et al., "Bitmap
Filter"), before sorted arrays are intersected exactly. A first round compares each group's members with one of them
alone, so a large group of near copies costs no more than its size; the second compares what is still in different
components, for which groups that are mostly of one component are put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.llm.shared import Table, components, partitions_of, read_table, rows_in_chunks, through_arrow

WORDS = 5
#: Similarity as a fraction: NUMERATOR / DENOMINATOR or more links.
NUMERATOR, DENOMINATOR = 75, 100
#: Documents whose shingles are counted to learn which are common, and the shingles listed, at most. They order
#: prefixes and have no bearing on the result.
SAMPLE, COMMON, COMMON_FROM = 8_000, 100_000, 4
#: Shingles of so many documents of the sample, or more, are grouped by partial sums.
OFTEN_FROM = 20
#: Members of a tile's side, about; a larger group is several tiles, by bands of size and blocks of them.
TILE = 256
#: Groups with more members tell which pairs another such group has compared already.
LARGE = 64
#: Rows of two longs that may be broadcast.
BROADCAST_ROWS = 500_000
_WORDS_KEPT = 150_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


_CACHE = ("ngram join", _hashes.cache_clear)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ x >> np.uint64(33)


def shingle_set(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of UTF-8 text, lower-cased in A-Z alone, split at ASCII white space."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(words) < k:
            mult = mixed(np.arange(1, len(words) + 1, dtype=np.uint64))
            return mixed(np.array([(h * mult).sum() + np.uint64(len(words))], dtype=np.uint64))
        n = len(words) - k + 1
        mult = _MULTIPLIERS if k == len(_MULTIPLIERS) else mixed(np.arange(101, 101 + k, dtype=np.uint64))
        total = h[:n] * mult[0]
        for j in range(1, k):
            total += h[j : j + n] * mult[j]
    return np.unique(mixed(total))


def signature(items: np.ndarray) -> bytes:
    """Parity bitmap: bit h mod width flips with every shingle; the width is the power of two at or above the set's size, 64 at least."""
    width = 1 << max(6, int(len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to the parity bitmaps of a smaller width."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def set_id(items: np.ndarray) -> int:
    """One number for equal sets, as a signed long."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(items).sum() + np.uint64(len(items)) * _MULTIPLIERS[0]], dtype=np.uint64)).view(np.int64)[0])


def prefix(items: np.ndarray, common: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles of which a similar set must have one: rare ones by hash, then common ones by how common they are."""
    size = len(items) - -(-num * len(items) // den) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, items), len(common) - 1)
        hit = common[at] == items
        rare = items[~hit]
        if len(rare) < size:
            late = items[hit]
            return np.concatenate([rare, late[np.argsort(rank[at[hit]], kind="stable")]])[:size]
        return rare[:size]
    return items[:size]


def _text_bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def common_shingles(docs: DataFrame, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, ranks by count) of shingles that occur in several documents of a sample of about SAMPLE documents."""
    total = docs.count()
    part = _text_bytes(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(1, total)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_chunks(batches, 1, 4 << 20):
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    counts = through_arrow(part, run, "h long", *_CACHE).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_FROM)
    # at most COMMON rows
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h = rows.h.to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows.n.to_numpy()[order].astype(np.int32)


def document_sets(docs: DataFrame, common: np.ndarray, rank: np.ndarray, num: int, den: int, k: int) -> Table:
    """doc_id, node (id of its shingle set, null if empty), n, keys (its prefix), bits (its signature), in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_chunks(batches, 1, 8 << 20):
            nodes, sizes, keys, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k)
                nodes.append(set_id(s) if len(s) else None)
                sizes.append(len(s))
                keys.append(prefix(s, common, rank, num, den).view(np.int64) if len(s) else np.zeros(0, np.int64))
                bits.append(signature(s) if len(s) else b"")
            ends = np.cumsum([0] + [len(x) for x in keys]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(bits, pa.binary())], ["doc_id", "node", "n", "keys", "bits"])

    return Table(through_arrow(_text_bytes(docs), run, "doc_id long, node long, n long, keys array<long>, bits binary", *_CACHE), "sets")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) sorted by key to rows (members, node, size) of keys that several nodes have; equal groups get one number."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # the last key's rows so far, which a large group has many batches of

    def told(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        with np.errstate(over="ignore"):
            number = mixed(np.add.reduceat(mixed(node.view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)
        _, once = np.unique(number[size > 1], return_index=True)
        chosen = np.flatnonzero(size > 1)[once]
        if len(chosen):
            mark = np.zeros(len(first), bool)
            mark[chosen] = True
            rows = np.repeat(mark, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number, size)[rows]), pa.array(node[rows]), pa.array(np.repeat(size, size)[rows])], ["members", "node", "size"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held and held[-1][0][-1] == key[-1]:
            held.append((key, node))
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if held or cut:
            yield from told(*(np.concatenate(x) for x in zip(*held, (key[:cut], node[:cut]), strict=True)))
        held = [(key[cut:], node[cut:])]
    if held:
        yield from told(*(np.concatenate(x) for x in zip(*held, strict=True)))


def grouped(keyed: DataFrame, common: DataFrame) -> DataFrame:
    """(members, node, size), a row for each node of each group, of rows (key, node): nodes with a key in common are a group if there are several, and keys with the same nodes are one group.

    Rows of a key go to one task, but for the keys of `common`, a bounded list of those that a sample shows to be
    frequent: their groups are told by partial sums (128 bits of XOR over their nodes), and their rows stay where they
    are. The list has no bearing on the groups.
    """
    rare = keyed.join(F.broadcast(common), "key", "left_anti").repartition(partitions_of(keyed.sparkSession), "key").sortWithinPartitions("key")
    rare = through_arrow(rare, _groups, "members long, node long, size long").distinct()
    often = keyed.join(F.broadcast(common), "key", "left_semi")
    sums = often.groupBy("key").agg(*[F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(c) for i, c in enumerate("xy")], F.count("*").alias("size")).where("size > 1")
    one = sums.groupBy("x", "y", "size").agg(F.min("key").alias("key")).select("key", F.xxhash64("x", "y").alias("members"), "size")
    return rare.union(often.join(F.broadcast(one), "key").select("members", "node", "size"))  # no more keys than `common` has


def alike(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _bound_passes(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the overlap may suffice: at most (n_a + n_b - differing bits) / 2 shingles are shared."""
    most = (n_a + n_b - differ) // 2
    return den * most >= num * (n_a + n_b - most)


def _bit_rows(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _filter_pairs(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            differ = np.zeros(len(n_a), np.int64)
            for i, (x, y) in enumerate(zip(_bit_rows(batch.column(3)), _bit_rows(batch.column(5)), strict=True)):
                w = min(len(x), len(y))
                differ[i] = np.bitwise_count(folded(x[None], w) ^ folded(y[None], w)).sum()
            keep = pa.array(np.flatnonzero(_bound_passes(n_a, n_b, differ, num, den)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def _tiles(num: int, den: int):
    """Rows (members, i, j, side, node, comp, n, bits, earlier) sorted by tile to pairs (a, b) that may be links, in different components.

    A tile's rows are sorted by size and banded by the width of their bitmaps; only pairs within the length bound and
    within one band of each other are compared. `earlier` lists a row's large groups with smaller numbers: a pair that
    has one of them in common is left to the smallest, so groups of near copies tell each pair once.
    """

    def first_here(earlier: list[frozenset], x: int, who: np.ndarray) -> np.ndarray:
        return who[[earlier[x].isdisjoint(earlier[y]) for y in who.tolist()]] if earlier[x] and len(who) else who

    def told(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        node, comp, n, side = (rows.column(c).to_numpy() for c in ("node", "comp", "n", "side"))
        bits = _bit_rows(rows.column("bits"))
        width = np.array([len(x) for x in bits])
        square = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        earlier = [frozenset(x) for x in rows.column("earlier").to_pylist()]
        out_a, out_b = [], []
        widest = 1 << (-(-den // num) - 1).bit_length()  # alike sets differ in size by den / num at most
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            for v in (v for v in np.unique(width) if w <= v <= widest * w):
                other = np.flatnonzero(width == v)
                if not len(other):
                    continue
                left, right = (mine, other) if square else (mine[side[mine] == 0], other[side[other] == 1])
                jobs = [(left, right)] if square or v == w else [(left, right), (mine[side[mine] == 1], other[side[other] == 0])]
                for left, right in jobs:
                    if not len(left) or not len(right):
                        continue
                    big = folded(np.array([bits[x] for x in right]), w)
                    for x in left:
                        fit = (comp[right] != comp[x]) & (den * np.minimum(n[right], n[x]) >= num * np.maximum(n[right], n[x]))
                        if square and v == w:
                            fit &= right > x
                        who = np.flatnonzero(fit)
                        if len(who):
                            differ = np.bitwise_count(big[who] ^ bits[x]).sum(axis=1, dtype=np.int64)
                            who = first_here(earlier, x, right[who[_bound_passes(n[x], n[right[who]], differ, num, den)]])
                            out_a.append(np.minimum(node[who], node[x]))
                            out_b.append(np.maximum(node[who], node[x]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.column_stack([batch.column(c).to_numpy() for c in ("members", "i", "j")])
            starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for at, to in zip(starts, starts[1:], strict=False):
                this = tuple(ids[at])
                if this != tile and held:
                    yield told(pa.Table.from_batches(held))
                    held = []
                tile = this
                held.append(batch.slice(at, to - at))
        if held:
            yield told(pa.Table.from_batches(held))

    return run


def _verified(pairs: DataFrame, docs: DataFrame, homes: DataFrame, num: int, den: int, k: int) -> Table:
    """Pairs (a, b) of nodes whose sets are alike, by exact intersection; the sets are made anew from the texts of the pairs' documents alone."""
    pairs = Table(pairs, "pairs")
    nodes = pairs.df.select(F.col("a").alias("node")).union(pairs.df.select(F.col("b").alias("node"))).distinct()
    wanted = Table(homes.join(nodes, "node").select("home", "node"), "wanted")
    ids = wanted.df.select(F.col("home").alias("doc_id")).distinct()
    if wanted.df.count() <= BROADCAST_ROWS:  # else both sides are shuffled by doc_id
        ids = F.broadcast(ids)
    texts = _text_bytes(docs)
    texts = texts.join(ids, texts.doc_id.eqNullSafe(ids.doc_id), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_chunks(batches, 1, 4 << 20):
            sets = [s for s in (shingle_set(t, k) for t in batch.column(1).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])

    sets = through_arrow(texts, run, "node long, items binary", *_CACHE).join(wanted.df.select("node"), "node", "left_semi").groupBy("node").agg(F.first("items").alias("items"))
    items = Table(sets, "items")
    sets = items.df

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    with_b = pairs.df.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    links = Table(through_arrow(both.select("a", "b", "items_a", "items_b"), check, "a long, b long", *_CACHE), "links")
    for table in (pairs, wanted, items):
        table.drop()
    return links


def size_bands(num: int, den: int, most: int = 1 << 40) -> list[int]:
    """Least sizes of bands: sets that are alike are of one band or of neighbouring ones."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * den // num + 1)
    return out


def _dealt(rows: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (members, node, comp, size) once for each tile (i, j) that they are in, with the tile's side.

    A group of up to TILE members is one tile. The members of a larger one are dealt to bands by the size of their sets,
    and within a band to blocks of about TILE; a block meets the blocks of its own band and of the bands beside it, as
    sets of other bands differ too much in size.
    """
    small = rows.where(F.col("size") <= TILE).select("members", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "node", "comp", "size")
    band = F.size(F.filter(F.array(*map(F.lit, size_bands(num, den))), lambda least: least <= F.col("n")))
    big = rows.where(F.col("size") > TILE).join(sizes, "node").withColumn("band", band).drop("n")
    near = Window.partitionBy("members").orderBy("band")  # some tens of bands a group
    blocks = big.groupBy("members", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("own"))
    beside = lambda f, d: F.when(f("band").over(near) == F.col("band") + d, f("own").over(near)).otherwise(0)
    blocks = blocks.select("members", "band", "own", beside(F.lead, 1).alias("above"), beside(F.lag, -1).alias("below"))
    if big.limit(1).count() and blocks.count() <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    big = big.join(blocks, ["members", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), "own").cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    named = lambda band, block: band.cast("long") * (1 << 32) + block
    here = named(F.col("band"), F.col("block"))
    same = F.transform(upto("own"), lambda o: F.struct(F.least(here, named(F.col("band"), o)).alias("i"), F.greatest(here, named(F.col("band"), o)).alias("j"), (F.col("block") > o).cast("int").alias("side")))
    above = F.transform(upto("above"), lambda o: F.struct(here.alias("i"), named(F.col("band") + 1, o).alias("j"), F.lit(0).alias("side")))
    below = F.transform(upto("below"), lambda o: F.struct(named(F.col("band") - 1, o).alias("i"), here.alias("j"), F.lit(1).alias("side")))
    big = big.select("members", "node", "comp", "size", F.inline(F.concat(same, above, below)))
    return small.unionByName(big)


def united(rows: DataFrame) -> DataFrame:
    """Rows (members, node, comp, size) of groups, with groups that are mostly of one component put together where that is less work.

    A large component of near copies has a group for each of its members' keys, which all hold much the same nodes. Put
    together they compare each pair that any of them does, once instead of in every group. What a group costs is its rows
    and the rows of its tiles, size * (1 + size / TILE); groups stay apart where their union would cost more than they do.
    """
    cost = lambda n: F.col(n) * (1 + F.col(n) / TILE)
    each = rows.groupBy("members", "comp").agg(F.count("*").alias("n"))
    groups = Table(each.groupBy("members").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("size")).select("members", F.col("most.comp").alias("top"), "size"), "tops")
    alone = groups.df.groupBy("top").agg(F.count("*").alias("groups"), F.sum(cost("size")).alias("apart")).where("groups > 1")
    several = groups.df.join(alone.select("top"), "top").select("members", "top")
    nodes = Table(rows.drop("size").join(several, "members").select("top", "node", "comp").distinct(), "unions")
    unions = nodes.df.groupBy("top").agg(F.count("*").alias("size"))
    unions = Table(unions.join(alone, "top").where(cost("size") <= F.col("apart")).select("top", "size"), "sizes")
    gone = groups.df.join(unions.df, "top", "left_semi").select("members")
    # xxhash64 of two numbers, so that a union is told from the groups
    return rows.join(gone, "members", "left_anti").unionByName(nodes.df.join(unions.df, "top").select(F.xxhash64("top", F.lit(1)).alias("members"), "node", "comp", "size"))


def linked_sets(docs: DataFrame, sets: Table, often: np.ndarray, num: int, den: int, k: int) -> Table:
    """(node, component_id) of nodes that have a link, in the shared folder; what was written on the way is gone."""
    spark = docs.sparkSession
    whole = sets.df.where("node is not null").groupBy("node").agg(F.first(F.struct("n", "keys", "bits")).alias("x"), F.min("doc_id").alias("home"))
    reps = Table(whole.select("node", "x.n", "x.keys", "x.bits", "home"), "nodes")
    common = Table(spark.createDataFrame(pd.DataFrame({"key": often.view(np.int64)}), "key long"), "common")  # at most COMMON rows
    groups = Table(grouped(reps.df.select(F.explode("keys").alias("key"), "node"), common.df).select("members", "node"), "groups")
    common.drop()
    live = groups.df
    facts, homes = reps.df.select("node", "n", "bits"), reps.df.select("node", "home")

    # First round: in each group every member against one of them.
    hubs = live.groupBy("members").agg(F.min_by("node", F.xxhash64("node", "members")).alias("hub"))
    pairs = live.join(hubs, "members").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    one, two = (facts.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    pairs = pairs.join(one, "a").join(two, "b").where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    pairs = through_arrow(pairs.select("a", "b", "n_a", "bits_a", "n_b", "bits_b"), _filter_pairs(num, den), "a long, b long")
    first = _verified(pairs, docs, homes, num, den, k)
    comps = components(first.df)

    # Second round: what is in different components still, group by group, in tiles.
    named = live.join(comps.df, "node", "left").select("members", "node", F.coalesce("component_id", "node").alias("comp"))
    open_groups = named.groupBy("members").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    opened = Table(named.join(open_groups.select("members", "size"), "members"), "opened")
    still = Table(united(opened.df), "open")
    opened.drop()
    large = still.df.where(F.col("size") > LARGE).groupBy("node").agg(F.collect_list("members").alias("large"))  # at most a node's keys
    rows = _dealt(still.df, facts.select("node", "n"), num, den)
    earlier = F.when(F.col("size") > LARGE, F.filter("large", lambda x: x < F.col("members")))
    rows = rows.join(facts.join(large, "node", "left"), "node").select("members", "i", "j", "side", "node", "comp", "n", "bits", F.coalesce(earlier, F.array().cast("array<long>")).alias("earlier"))
    tiles = rows.repartition(partitions_of(spark), "members", "i", "j").sortWithinPartitions("members", "i", "j", "n")
    second = _verified(through_arrow(tiles, _tiles(num, den), "a long, b long").distinct(), docs, homes, num, den, k)
    links = comps.df.select(F.col("node").alias("a"), F.col("component_id").alias("b")).union(second.df)
    out = components(links)
    for table in (reps, groups, first, comps, still, second):
        table.drop()
    return out


def near_duplicates_by_set(docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, node (id of the shingle set) for every row of `docs` (doc_id, text, ...).

    Rows link when den * |intersection| >= num * |union| of their shingle sets; component_id is the smallest doc_id
    reachable. Texts that are null or have no words have no shingles and link with nothing; repeated rows have equal
    sets and link; a null doc_id is never the smallest if others are there; very long texts are taken whole; a similarity
    of just num / den links; an empty table gives no rows; other columns are ignored, whatever their names. Sets stand
    for their 64-bit shingle hashes.
    """
    common, rank = common_shingles(docs, k)
    sets = document_sets(docs, common, rank, num, den, k)
    comps = linked_sets(docs, sets, common[rank >= OFTEN_FROM], num, den, k).df.withColumnRenamed("component_id", "comp")
    rows = Table(sets.df.select("doc_id", "node", "n"), "thin").df
    sets.drop()
    heads = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    heads = heads.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "low")
    lows = heads.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = heads.join(lows, "comp").select(F.col("node").alias("key"), "component_id")
    out = rows.join(named, F.col("node") == F.col("key"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node")


def near_duplicates(docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`, as `near_duplicates_by_set` finds them."""
    return near_duplicates_by_set(docs, num, den, k).drop("node")


def without_near_duplicates(docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, k: int = WORDS) -> DataFrame:
    """One row of `docs` for each group of near duplicates, the one with the smallest doc_id, and all rows without shingles.

    Of rows with that doc_id and the same shingles one stays. Only the ids to drop meet the texts: broadcast up to
    BROADCAST_ROWS, else by a shuffle. Where doc_ids repeat, rows are told apart by their shingle sets as well.
    """
    found = Table(near_duplicates_by_set(docs, num, den, k), "found").df
    drop = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("drop_id"), F.col("node").alias("drop_node")).distinct()
    drop = Table(drop, "drop").df
    if drop.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    if not found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.join(drop, docs.doc_id.cast("long").eqNullSafe(drop.drop_id), "left_anti")
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at, ids = [c.lower() for c in names].index("text"), [c.lower() for c in names].index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_chunks(batches, at, 8 << 20):
            sets = [shingle_set(t, k) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], [*batch.schema.names, "node"])

    rows = through_arrow(plain, run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in plain.schema) + ", node long", *_CACHE)
    rows = rows.join(drop, F.col(f"c{ids}").cast("long").eqNullSafe(F.col("drop_id")) & F.col("node").eqNullSafe(F.col("drop_node")), "left_anti")
    rows = rows.where("node is not null").dropDuplicates([f"c{ids}", "node"]).union(rows.where("node is null"))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: All pairs with a shingle in common; words are joined by blanks, which no word holds.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.size + y.size - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.size, 0) AS n_shingles, component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) low ON low.a = w.doc_id
"""

QUERIES = {"op5_ngram_join": op5_ngram_join}
ORACLES: dict[str, str] = {"op5_ngram_join": ORACLE}
