"""Vector code compression: product codes whose codebooks are searched by kd-trees and updated by distributed integer sums.

Vectors become integers and are cut into parts; each part position has a codebook. A round broadcasts one kd-tree per
codebook (bounded by parts x entries), every task assigns its vectors by branch and bound and adds up what each entry
got, and one aggregation of those integer sums gives the next codebooks. All arithmetic is exact, so results do not
depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.llm.shared import Table, join_counted, read_table, through_arrow

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a codebook that a leaf of its tree holds at most.
LEAF = 4


class Tree:
    """A kd-tree over a codebook's entries: each node has the bounding box of its entries, leaves hold up to LEAF of them."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int, np.ndarray]] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, held: np.ndarray) -> int:
        here, low, high = len(self.nodes), self.entries[held].min(axis=0), self.entries[held].max(axis=0)
        self.nodes.append((low, high, -1, -1, held))
        if len(held) > LEAF and (high > low).any():
            axis = int(np.argmax(high - low))
            order = held[np.argsort(self.entries[held, axis], kind="stable")]
            left, right = self._grow(np.sort(order[: len(order) // 2])), self._grow(np.sort(order[len(order) // 2 :]))
            self.nodes[here] = (low, high, left, right, held)
        return here

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of `points`; of entries at equal distance the lowest.

        All points go down together. A node is passed over for a point only if its box is farther than the point's best
        so far: a box at exactly that distance is visited, as it may hold an equal entry of a lower index.
        """
        best = np.full(len(points), np.iinfo(np.int64).max)
        found = np.full(len(points), len(self.entries))

        def bound(node: int, at: np.ndarray) -> np.ndarray:
            low, high = self.nodes[node][:2]
            p = points[at]
            out = np.maximum(low - p, 0) + np.maximum(p - high, 0)
            return (out * out).sum(axis=1)

        def visit(node: int, at: np.ndarray) -> None:
            _, _, left, right, held = self.nodes[node]
            if left < 0:
                for entry in held:
                    away = points[at] - self.entries[entry]
                    away = (away * away).sum(axis=1)
                    better = (away < best[at]) | (away == best[at]) & (entry < found[at])
                    best[at[better]], found[at[better]] = away[better], entry
                return
            to_left, to_right = bound(left, at), bound(right, at)
            first = to_left <= to_right
            for near, far, far_bound, pick in ((left, right, to_right, first), (right, left, to_left, ~first)):
                sub = at[pick]
                if len(sub):
                    visit(near, sub)
                    rest = far_bound[pick] <= best[sub]
                    if rest.any():
                        visit(far, sub[rest])

        if len(points):
            visit(0, np.arange(len(points)))
        return found, best


def whole_vectors(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(rows vec_id, label, v as integers; their length). See `compress_vectors` for what is left out."""
    vector = F.transform("embedding", lambda x: x.cast("double") * scale)

    def sound(limit: float) -> Column:
        return F.col("embedding").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit))

    rows = vectors.select("vec_id", "label", "embedding", vector.alias("e")).where(sound(2.0**27))
    lengths = rows.groupBy(F.size("e").alias("size")).count().where(f"size > 0 AND size % {parts} = 0")
    top = lengths.orderBy(F.desc("count"), "size").first()
    if not top:
        return rows.where(F.lit(False)).select("vec_id", "label", F.col("e").cast("array<int>").alias("v")), 0
    # squared distances of whole vectors stay below 2 ** 62
    limit = min(2.0**27, math.isqrt((1 << 62) // top["size"]) // 2)
    rows = rows.where((F.size("e") == top["size"]) & sound(limit))
    return rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(x).cast("int")).alias("v")), top["size"]


def _parts(column: pa.Array, size: int, parts: int) -> np.ndarray:
    """Rows x parts x width."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, parts, size // parts)


def first_books(kept: DataFrame, size: int, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width: the vectors of the smallest ids, ascending (null last); of one id's vectors the smallest."""
    ids = [r.vec_id for r in kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    if not ids:
        return np.zeros((parts, 0, 0), np.int64)
    known = F.col("vec_id").isin([x for x in ids if x is not None])
    if None in ids:
        known = F.coalesce(known, F.lit(True))
    found = {r.vec_id: r.v for r in kept.where(known).groupBy("vec_id").agg(F.min("v").alias("v")).collect()}  # at most `entries` rows
    return np.array([found[x] for x in ids], dtype=np.int64).reshape(len(ids), parts, size // parts).transpose(1, 0, 2)


def next_books(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the componentwise floor of the mean of its parts; unused ones stay."""
    parts, entries, width = books.shape
    trees = kept.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)  # the last is the count
        for batch in batches:
            vectors = _parts(batch.column(0), parts * width, parts)
            for p, tree in enumerate(trees.value):
                code, _ = tree.nearest(vectors[:, p])
                np.add.at(sums[p, :, :width], code, vectors[:, p])
                sums[p, :, width] += np.bincount(code, minlength=entries)
        flat = sums.ravel()
        used = np.flatnonzero(np.repeat(sums[:, :, width].ravel() > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(flat[used])], ["cell", "n"])

    cells = through_arrow(kept.select("v"), run, "cell int, n long").groupBy("cell").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    sums = np.zeros(parts * entries * (width + 1), object)
    for r in cells.collect():  # parts x entries x (width + 1) numbers at most
        sums[r.cell] = int(r.n)
    sums, new = sums.reshape(parts, entries, width + 1), books.copy()
    for p, e in zip(*np.nonzero(sums[:, :, width]), strict=True):
        new[p, e] = [s // sums[p, e, width] for s in sums[p, e, :width]]
    trees.unpersist()
    return new


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each kept row of `vectors` (vec_id, label, embedding, ...).

    Left out are rows whose vector is null, empty, holds nulls or non-finite components, or components of 2 ** 27 and
    more after scaling (less for more than 64 components), whose squares a long can't hold; and vectors whose length is
    no multiple of `parts` or is not the most common such length (of equally common ones the shorter). With fewer ids
    than `entries` the codebooks are shorter. Equal vectors get equal codes, repeated rows and null ids a row each; null
    labels add up together; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for a part: 1 to 256 entries")
    spark = vectors.sparkSession
    rows, size = whole_vectors(vectors, parts, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, label_key string, code string, error long"
    kept = Table(rows, "vectors")
    books = first_books(kept.df, size, parts, entries)
    if not books.size:
        kept.drop()
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    for _ in range(rounds):
        books = next_books(kept.df, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    trees = spark.sparkContext.broadcast([Tree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = _parts(batch.column(2), size, parts)
            codes, errors = np.empty((len(cut), parts), np.uint8), np.zeros(len(cut), np.int64)
            for p, tree in enumerate(trees.value):
                code, away = tree.nearest(cut[:, p])
                codes[:, p], errors = code, errors + away
            shown = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shown[i : i + 2 * parts] for i in range(0, len(shown), 2 * parts)], pa.string()), pa.array(errors)], ["vec_id", "label_key", "code", "error"])

    # one string column holds every label, and null apart from all of them
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label_key")
    coded = Table(through_arrow(kept.df.select("vec_id", key, "v"), run, schema), "codes")
    kept.drop()
    labels = Table(coded.df.groupBy("label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n")), "labels")
    return join_counted(coded.df, labels.df, "label_key", "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_vector_codes": op13_vector_codes}


def _sql() -> str:
    """Codebooks b0 to b2 and their assignments, a round after the other."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS (SELECT vec_id, label, part, min({{'d': d, 'entry': entry}}) AS best FROM (
  SELECT v.vec_id, v.label, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS d
  FROM v JOIN b{k} b ON v.part = b.part AND v.pos = b.pos GROUP BY ALL) GROUP BY vec_id, label, part)""")
        if k < ROUNDS:
            steps.append(f"""
s{k} AS (SELECT v.part, a.best.entry AS entry, v.pos, sum(v.x) AS s, count(*) AS n
  FROM v JOIN a{k} a ON v.vec_id = a.vec_id AND v.part = a.part GROUP BY ALL),
b{k + 1} AS (SELECT b.part, b.entry, b.pos, CASE WHEN s.n IS NULL THEN b.x ELSE ((s.s - ((s.s % s.n) + s.n) % s.n) // s.n)::BIGINT END AS x
  FROM b{k} b LEFT JOIN s{k} s ON b.part = s.part AND b.entry = s.entry AND b.pos = s.pos)""")
    return f"""
WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, i // (size // {PARTS}) AS part, i % (size // {PARTS}) AS pos, floor({SCALE} * embedding[i + 1]::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, label, embedding, len(embedding) AS size, unnest(range(len(embedding))) AS i FROM kept)),
few AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS (SELECT v.part, few.entry, v.pos, v.x FROM v JOIN few USING (vec_id)),{",".join(steps)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256 FROM coded"""


ORACLES = {"op13_vector_codes": _sql()}
