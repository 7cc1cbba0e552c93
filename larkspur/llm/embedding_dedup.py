"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is the direction made of one code word from each block of a random product code; a vector passes all filters
whose direction it exceeds `reach` in, which list decoding finds block by block with a bound on what later blocks can
add (Becker, Ducas, Gama, Laarhoven, "New directions in nearest neighbor searching"). Vectors that pass a common filter
meet in its tile; a sketch of signs drops tile rows without any near neighbour, and cosines in double precision decide
the rest. Each pair counts in the smallest of its common tiles alone, and each tile returns one row for each of its
vectors (links counted, smallest vector of its local component), so a group of g near copies costs g rows a tile, not
g * g. The reach follows from the number of dimensions and the cosine, by one rule at every size: vectors at just that
cosine are to have EXPECTED filters in common. The few vectors that pass no filter are compared with all others of their
label, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.ngram_join import grouped, mixed
from larkspur.llm.shared import Table, components, partitions_of, read_table, through_arrow

COSINE = 0.93
SKETCH_BITS = 128
#: Share of pairs at the threshold that the sketch may drop.
SKETCH_MISSES = 1e-9
#: Vectors of a tile's side.
TILE = 512
#: Tiles beyond this size skip the sketch: they hold groups of near copies, which it would pass anyway.
SKETCH_TILE = 256
#: Filters that two vectors at the threshold have in common on average: of such pairs 998 in 1,000 share one.
EXPECTED = 20
#: Blocks of a code, codes, and the most words of a block; where vectors would pass more than MOST_FILTERS, in few
#: dimensions or at low cosines, blocks have fewer words.
BLOCKS, CODES, WORDS, MOST_FILTERS = 2, 10, 256, 160
#: Shorter vectors are lengthened by zeros, which changes no cosine.
LEAST_DIM = 8
#: Vectors that pass fewer filters are compared exactly.
FEW = 1
#: Vectors whose filters are counted to learn which are common, and the filters listed, at most: those are dealt out by
#: partial sums. The list has no bearing on the result.
SAMPLE, COMMON, COMMON_FROM = 4_000, 20_000, 20


def _cap_shares(reach: float, cosine: float, dim: int) -> tuple[float, float]:
    """Share of directions that a unit vector exceeds `reach` in, and that two vectors at `cosine` both do, for random directions in `dim` dimensions."""
    at = (np.arange(1, 20001) - 0.5) / 20000
    log = (dim - 3) / 2 * np.log1p(-at * at)
    density = np.exp(log - log.max())
    one = density[at >= reach].sum() / density.sum() / 2
    # the part of a direction in the vectors' plane has length r with this density, and an even angle
    log = np.log(at) + (dim - 4) / 2 * np.log1p(-at * at)
    density = np.exp(log - log.max())
    wide = np.where(at > reach, np.arccos(np.minimum(1.0, reach / at)) - acos(cosine) / 2, 0.0)
    return float(one), float((np.maximum(0.0, wide) / pi * density).sum() / density.sum())


@lru_cache(maxsize=64)
def code_plan(dim: int, cosine: float = COSINE) -> tuple[int, int, int, float]:
    """(blocks, words a block, codes, reach) for vectors of `dim` dimensions that are to be found at `cosine` and above.

    The reach is the largest at which two vectors at `cosine` have EXPECTED filters in common; of the numbers of words
    the largest counts whose filters a vector stay within MOST_FILTERS, or that with the fewest filters.
    """
    plans, dim = [], max(dim, LEAST_DIM)
    words = WORDS
    while words >= 8:
        total, low, high = CODES * words**BLOCKS, 0.0, 1.0
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if total * _cap_shares(middle, cosine, dim)[1] > EXPECTED else (low, middle)
        plans.append((total * _cap_shares(low, cosine, dim)[0], words, low))
        if plans[-1][0] <= MOST_FILTERS:
            break
        words //= 2
    filters, words, reach = plans[-1] if plans[-1][0] <= MOST_FILTERS else min(plans)
    return BLOCKS, words, CODES, reach


@lru_cache(maxsize=64)
def sketch_most(cosine: float) -> int:
    """Differing bits up to which a pair is looked at: of pairs at `cosine` at most SKETCH_MISSES differ in more."""
    p, seen = acos(min(1.0, cosine)) / pi, 0.0
    for n in range(SKETCH_BITS + 1):
        seen += comb(SKETCH_BITS, n) * p**n * (1 - p) ** (SKETCH_BITS - n)
        if 1 - seen <= SKETCH_MISSES:
            return n
    return SKETCH_BITS


@lru_cache(maxsize=8)
def product_code(dim: int, blocks: int, words: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation of `dim` dimensions and unit code words for each block; the last block has what is left over."""
    rng = np.random.default_rng([dim, blocks, words, number])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    code = []
    for part in np.array_split(np.arange(dim), min(blocks, dim)):
        c = rng.standard_normal((words, len(part)))
        code.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return turn, code


def list_decode(unit: np.ndarray, turn: np.ndarray, code: list[np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters of one code that unit vectors (rows) exceed `reach` in."""
    y, at, scores = unit @ turn, 0, []
    for c in code:
        scores.append(y[:, at : at + c.shape[1]] @ c.T)
        at += c.shape[1]
    best = np.array([s.max(axis=1) for s in scores])
    later = np.concatenate([np.cumsum(best[::-1], axis=0)[::-1][1:], np.zeros((1, len(unit)))])
    row, total, key = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
    for j, s in enumerate(scores):
        reached = total[:, None] + s[row]
        i, word = np.nonzero(reached + later[j][row][:, None] >= reach * np.sqrt(len(code)))
        row, total, key = row[i], reached[i, word], key[i] * s.shape[1] + word
    return row, key


def _by_shape(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a batch for each length of vector."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    flat, start = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    flat = flat[lists.offsets.to_numpy()[0] :]
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)]


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components over- or underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _passed(batches: Iterator[pa.RecordBatch], plan: Callable[[int], tuple[int, int, int, float]]) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(node, label, dimensions, (row, filter) of each code) for vectors of one length, of batches (node, label, embedding)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            node, label = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            for rows, x in _by_shape(batch, 2):
                dim = x.shape[1]
                unit = np.pad(_units(x), ((0, 0), (0, max(0, LEAST_DIM - dim))))
                blocks, words, codes, reach = plan(dim)
                yield node[rows], label[rows], dim, [list_decode(unit, *product_code(unit.shape[1], blocks, words, r), reach) for r in range(codes)]


def _filters(plan: Callable[[int], tuple[int, int, int, float]], few: int):
    """Rows (key, node) for the filters that each vector passes, and (null, node) for vectors that pass fewer than `few`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, label, dim, passed in _passed(batches, plan):
            keys, nodes = [], []
            n = np.zeros(len(node), np.int64)
            for r, (row, key) in enumerate(passed):
                with np.errstate(over="ignore"):
                    k = mixed(mixed(label[row].view(np.uint64) + np.uint64(dim)) + mixed(key.view(np.uint64) * np.uint64(len(passed)) + np.uint64(r)))
                keys.append(k.view(np.int64))
                nodes.append(node[row])
                n += np.bincount(row, minlength=len(node))
            rest = node[n < few]
            none = pa.array(np.concatenate([*keys, np.zeros(len(rest), np.int64)]), mask=np.concatenate([*(np.zeros(len(k), bool) for k in keys), np.ones(len(rest), bool)]))
            yield pa.RecordBatch.from_arrays([none, pa.array(np.concatenate([*nodes, rest]))], ["key", "node"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes | None] = [None] * batch.num_rows
        for rows, x in _by_shape(batch, 1):
            planes = np.random.default_rng([x.shape[1], SKETCH_BITS]).standard_normal((x.shape[1], SKETCH_BITS))
            bits = np.packbits(_units(x) @ planes > 0, axis=1)
            for r, b in zip(rows, bits, strict=True):
                out[r] = b.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "sketch"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that have equal keys, of sorted batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.column_stack([batch.column(c).to_numpy() for c in keys])
        starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        for at, to in zip(starts, starts[1:], strict=False):
            if tuple(ids[at]) != now and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = tuple(ids[at])
            held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near_rows(most: int):
    """Of tiles (members, node, sketch) the rows that have another within `most` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, nodes = [], []
        for rows in _runs(batches, ["members"]):
            bits = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
            differ = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
            np.fill_diagonal(differ, SKETCH_BITS + 1)
            keep = np.flatnonzero((differ <= most).any(axis=1))
            if len(keep):
                members.append(rows.column("members").to_numpy()[keep])
                nodes.append(rows.column("node").to_numpy()[keep])
            if len(members) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(members)), pa.array(np.concatenate(nodes))], ["members", "node"])
                members, nodes = [], []
        if members:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(members)), pa.array(np.concatenate(nodes))], ["members", "node"])

    return run


def _heads(node: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Smallest node of each row's component in one tile."""
    low = node.copy()
    while True:
        new = np.minimum(low, np.where(link, low[None], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return low
        low = new


def _link_tiles(cosine: float):
    """Tiles to rows (node, links, head): links that count here, and the smallest node of the local component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["members", "i", "j"]):
            node, weight, side = (rows.column(c).to_numpy() for c in ("node", "weight", "side"))
            square = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
            here = rows.column("members")[0].as_py()
            x = _units(np.array(rows.column("embedding").to_pylist(), dtype=np.float64))
            left, right = (np.arange(len(node)),) * 2 if square else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if not len(left) or not len(right):
                continue
            link = x[left] @ x[right].T >= cosine
            if square:
                np.fill_diagonal(link, False)
            # tiles with smaller numbers that both are in: an incidence matrix of such tiles, and its products
            lists = [np.array(t, dtype=np.int64) for t in rows.column("tiles").to_pylist()]
            lists = [t[t < here] for t in lists]
            names, at = np.unique(np.concatenate(lists), return_inverse=True)
            seen = np.zeros((len(node), len(names)), np.float32)
            seen[np.repeat(np.arange(len(node)), [len(t) for t in lists]), at] = 1
            count = link & (seen[left] @ seen[right].T < 0.5) if len(names) else link
            links = np.zeros(len(node), np.int64)
            links[left] += (count * weight[right]).sum(axis=1)
            if square:
                head = _heads(node, link)
            else:
                links[right] += (count.T * weight[left]).sum(axis=1)
                both = np.zeros((len(node),) * 2, bool)
                both[np.ix_(left, right)], both[np.ix_(right, left)] = link, link.T
                head = _heads(node, both)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(head)], ["node", "links", "head"])

    return run


def _link_few(cosine: float):
    """Blocks of nodes with few filters (side 0) by blocks of all nodes (side 1) to rows as of `_link_tiles`: pairs with a common tile count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["group", "i", "j"]):
            node, weight, side, few = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "weight", "side", "few"))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            x = _units(np.array(rows.column("embedding").to_pylist(), dtype=np.float64))
            # of two nodes with few filters, which meet twice, the smaller one's block tells
            link = (x[left] @ x[right].T >= cosine) & ~(few[right] & (node[left][:, None] >= node[right]))
            lists = [np.array(t, dtype=np.int64) for t in rows.column("tiles").to_pylist()]
            names = np.unique(np.concatenate([lists[i] for i in left]))
            count = link
            if len(names):
                seen = np.zeros((len(node), len(names)), np.float32)
                for i, t in enumerate(lists):
                    seen[i, np.searchsorted(names, t[np.isin(t, names)])] = 1
                count = link & (seen[left] @ seen[right].T < 0.5)
            links, head = np.zeros(len(node), np.int64), node.copy()
            links[left] += (count * weight[right]).sum(axis=1)
            links[right] += (count.T * weight[left]).sum(axis=1)
            held = np.concatenate([left[link.any(axis=1)], right[link.any(axis=0)]])
            if len(held):
                both = np.zeros((len(node),) * 2, bool)
                both[np.ix_(left, right)], both[np.ix_(right, left)] = link, link.T
                head[held] = _heads(node[held], both[np.ix_(held, held)])
                yield pa.RecordBatch.from_arrays([pa.array(node[held]), pa.array(links[held]), pa.array(head[held])], ["node", "links", "head"])

    return run


def _few_links(reps: DataFrame, few: DataFrame, lists: DataFrame, cosine: float) -> DataFrame:
    """node, links, head for the links that nodes of `few` have with any node of their label and number of dimensions, and that no tile counts."""
    spark = reps.sparkSession
    rows = reps.join(few, F.col("node") == F.col("few_node"), "left").join(lists, "node", "left")
    rows = rows.select("node", "weight", "embedding", F.coalesce("tiles", F.array().cast("array<bigint>")).alias("tiles"), F.col("few_node").isNotNull().alias("few"), F.xxhash64("label", F.size("embedding")).alias("group"))
    sizes = rows.groupBy("group").agg(F.ceil(F.sum(F.col("few").cast("int")) / TILE).cast("int").alias("few_blocks"), F.ceil(F.count("*") / (4 * TILE)).cast("int").alias("blocks")).where("few_blocks > 0")
    rows = rows.join(sizes, "group").withColumn("i", F.pmod(F.xxhash64("node"), "few_blocks").cast("int")).withColumn("j", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    names = ["group", "i", "j", "side", "node", "weight", "few", "tiles", "embedding"]
    one = rows.where("few").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    other = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1))).withColumn("side", F.lit(1))
    dealt = one.select(names).union(other.select(names)).repartition(partitions_of(spark), "group", "i", "j").sortWithinPartitions("group", "i", "j")
    return through_arrow(dealt, _link_few(cosine), "node long, links long, head long")


def valid_vector(embedding: str) -> F.Column:
    """Neither null nor zero, and every component present and finite."""
    x = F.col(embedding)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, plan: tuple[int, int, int, float] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their vectors have the same number of dimensions, and their
    cosine is `cosine` (above 0) or more. No pair below it links; of pairs at just that cosine 998 in 1,000 are found, of closer ones
    nearly all, whatever the number of dimensions and rows (`plan` sets blocks, words, codes and reach otherwise). Null,
    zero, or non-finite vectors and null labels link with nothing. Repeated rows are vectors each and link with each
    other; equal vectors, told by 128 bits of hash, go through the tiles once, with their number as weight. A null
    vec_id is never the smallest if others are there; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = valid_vector("embedding") & F.col("label").isNotNull()
    rows = rows.select("vec_id", F.when(valid, F.xxhash64(F.lit(1), "label", "embedding")).alias("one"), F.when(valid, F.xxhash64(F.lit(2), "label", "embedding")).alias("two"), F.when(valid, F.struct("label", "embedding")).alias("x"))
    kinds = rows.where("one is not null").groupBy("one", "two").agg(F.first("x").alias("x"), F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    whole = Table(kinds.select(F.monotonically_increasing_id().alias("node"), "one", "two", "x.label", "x.embedding", "weight", "low"), "nodes")
    reps, plan_of = whole.df, (lambda dim: plan) if plan else lambda dim: code_plan(dim, cosine)
    thin = reps.select("node", "label", "embedding")

    some = thin.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(1, reps.count()))))
    common = through_arrow(some, _filters(plan_of, 0), "key long, node long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_FROM)
    common = Table(common.orderBy(F.desc("n"), "key").limit(COMMON).select("key"), "common")

    passed = Table(through_arrow(thin, _filters(plan_of, FEW), "key long, node long"), "filters")
    met = Table(grouped(passed.df.where("key is not null"), common.df), "tiles")
    small = met.df.where(F.col("size") <= SKETCH_TILE).select("members", "node")
    small = small.join(through_arrow(reps.select("node", "embedding"), _sketches, "node long, sketch binary"), "node").select("members", "node", "sketch")
    small = through_arrow(small.repartition(partitions_of(spark), "members").sortWithinPartitions("members"), _near_rows(sketch_most(cosine)), "members long, node long")
    large = met.df.where(F.col("size") > SKETCH_TILE).select("members", "node", F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    live = Table(small.withColumn("blocks", F.lit(1)).union(large), "tiles")
    lists = live.df.groupBy("node").agg(F.collect_list("members").alias("tiles"))  # at most the filters of one vector
    facts = reps.select("node", "embedding", "weight").join(lists, "node")
    tiles = live.df.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("members", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node")
    tiles = tiles.join(facts, "node").repartition(partitions_of(spark), "members", "i", "j").sortWithinPartitions("members", "i", "j")
    told = through_arrow(tiles, _link_tiles(cosine), "node long, links long, head long")
    few = passed.df.where("key is null").select(F.col("node").alias("few_node"))
    if few.limit(1).count():
        told = told.union(_few_links(reps, few, lists, cosine))
    told = Table(told, "links")
    comps = components(told.df.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    counts = told.df.groupBy("node").agg(F.sum("links").alias("links"))
    named = reps.select("node", "one", "two", "weight", "low").join(counts, "node", "left").join(comps.df, "node", "left")
    named = Table(named.select("one", "two", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "low", F.coalesce("component_id", "node").alias("comp")), "named").df
    for table in (whole, common, passed, met, live, told, comps):
        table.drop()
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    facts = named.join(lows, "comp").select(F.col("one").alias("k1"), F.col("two").alias("k2"), "n_links", "component_id")
    out = rows.drop("x").join(facts, (F.col("one") == F.col("k1")) & (F.col("two") == F.col("k2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: All pairs of a label.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len([c FOR c IN x IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN x IF c <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN n ON n.a = vec_id JOIN low ON low.a = vec_id
"""

QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
ORACLES: dict[str, str] = {"op2_embedding_dedup": ORACLE}
