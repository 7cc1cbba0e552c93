"""A trie of conversations by shared openings: which turns many conversations begin with, and what storing them once would save.

Only digests of turns move, never texts. Each partition holds a range of conversations, builds the trie of its own in
memory of a fixed size and emits it as a table of nodes, keyed by the hash of the path from the root. Those tables are
merged by key in rounds, FAN of them at a time: members add up, and lists of ends, which come from disjoint ascending
ranges, are put one behind the other in pieces of a bounded size. What is summed over subtrees is rolled up by doubling:
in round k a node hands what it has summed to its ancestor 2 ** k levels up, so that depth d takes log2(d) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.shared import Table, join_counted, partitions_of, read_table, through_arrow

#: Partial tables merged at a time, nodes that a task combines before it emits them, and ends in a piece of a list.
FAN, NODES, ENDS = 32, 50_000, 4096
#: The root's path.
ROOT = bytes(16)
_NODES = "id binary, slot int, first long, n long, depth int, bytes long, up binary, ends binary"


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, at (1, 2, ... in order of turn, null first), digest of role and text, bytes of the text; rows without conv_id are left out.

    Rows of one turn number follow the order of their digests. Null roles and texts are empty.
    """
    from pyspark.sql import Window

    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", at.cast("long").alias("at"), "digest", "bytes")


def reopened(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Turns of conversations rebuilt: the first h turns of conversation c - c % group, then c's own after its first h; h = crc32(c) % most.

    Each conversation also has a row at 0 without a digest, so that one left without turns is still there.
    """
    held = Table(turns, "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = held.df.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    own = held.df.where(F.col("at") > h).withColumn("at", F.col("at") + most)
    opening = held.df.where(F.col("at") < most).withColumnRenamed("conv_id", "base").join(convs, "base").where("at <= h").select("conv_id", "at", "digest", "bytes")
    marks = convs.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(opening).unionByName(marks)


def partial_tries(turns: DataFrame) -> DataFrame:
    """Nodes of each partition's conversations, combined there; a node may come in several rows, each with a piece of its ends.

    Partitions are ranges of conv_id, in order. A conversation is one stream of turns; a task keeps 16 bytes for each of
    its prefixes, beside NODES nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        nodes: dict[bytes, list] = {}
        ends, now, path = 0, None, [ROOT]

        def reach(prefix: bytes, size: int) -> list:
            node = nodes.get(prefix)
            if node is None:
                depth, up, back = len(path) - 1, b"", 1
                while back <= depth:
                    up, back = up + path[depth - back], 2 * back
                nodes[prefix] = node = [now, 0, depth, size, up, []]
            node[1] += 1
            return node

        last = None
        for batch in batches:
            for conv, digest, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if last is not None:
                        last[5].append(now)
                        ends += 1
                    if len(nodes) >= NODES or ends >= 4 * NODES:
                        yield _rows(nodes, slot)
                        nodes, ends = {}, 0
                    now, path = conv, [ROOT]
                    last = reach(ROOT, 0)
                if digest is None:
                    continue
                path.append(hashlib.blake2b(path[-1] + digest, digest_size=16).digest())
                last = reach(path[-1], size)
                if len(nodes) >= 2 * NODES:  # within one conversation: what `last` holds goes on in a new row
                    del nodes[path[-1]]
                    yield _rows(nodes, slot)
                    nodes, ends = {path[-1]: last}, 0
        if last is not None:
            last[5].append(now)
        if nodes:
            yield _rows(nodes, slot)

    dealt = turns.repartitionByRange(partitions_of(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at")
    return through_arrow(dealt.select("conv_id", "digest", "bytes"), run, _NODES)


def _rows(nodes: dict[bytes, list], slot: int) -> pa.RecordBatch:
    out = []
    for key, (first, n, depth, size, up, ends) in nodes.items():
        out.append((key, slot, first, n, depth, size, up, _packed(ends[:ENDS])))
        out += [(key, slot, ends[at], 0, depth, size, up, _packed(ends[at : at + ENDS])) for at in range(ENDS, len(ends), ENDS)]
    return _batch(out, _NODES)


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def _packed(ids: list[int]) -> bytes:
    return b"".join(x.to_bytes(8, "big", signed=True) for x in ids)


def _unpacked(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 8], "big", signed=True) for i in range(0, len(data), 8)]


def merged(nodes: DataFrame) -> DataFrame:
    """One round: the rows of FAN neighbouring slots are combined by node; lists of ends grow to pieces of ENDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, size = None, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] == key and len(out[-1][7]) + len(row[7]) <= 8 * ENDS:
                    out[-1][3] += row[3]  # rows of a node come in order of their first member, so this one's ends follow
                    out[-1][7] += row[7]
                else:
                    if size >= 4 << 20:
                        yield _batch(out, _NODES)
                        out, size = [], 0
                    key = row[:2]
                    out.append(list(row))
                size += len(row[6]) + len(row[7]) + 64
        if out:
            yield _batch(out, _NODES)

    by = nodes.withColumn("slot", F.expr(f"slot div {FAN}").cast("int"))
    dealt = by.repartition(partitions_of(nodes.sparkSession), "id", "slot").sortWithinPartitions("id", "slot", "first")
    return through_arrow(dealt, run, _NODES)


_LAST = "id binary, conv_id long, n_convs long, depth int, bytes long, up binary, ends_sha256 string"


def finished(nodes: DataFrame) -> DataFrame:
    """The last round, one row a node: the digest of its ends runs over the pieces as they come, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends, out = None, None, []
        for batch in batches:
            for key, _, first, n, depth, size, up, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or key != held[0]:
                    if held:
                        out.append((*held, ends.hexdigest()))
                    if len(out) >= 20_000:
                        yield _batch(out, _LAST)
                        out = []
                    held, ends, lead = [key, first, 0, depth, size, up], hashlib.sha256(), ""
                held[2] += n
                if piece:
                    ends.update((lead + ",".join(map(str, _unpacked(piece)))).encode())
                    lead = ","
        if held:
            yield _batch([*out, (*held, ends.hexdigest())], _LAST)

    dealt = nodes.repartition(partitions_of(nodes.sparkSession), "id").sortWithinPartitions("id", "first")
    return through_arrow(dealt, run, _LAST)


def rolled_up(nodes: DataFrame) -> Table:
    """Nodes with n_children, n_leaves and saved_tokens, summed over their subtrees."""
    parent = F.substring("up", 1, 16)
    children = nodes.where("depth > 0").groupBy(parent.alias("id")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    now = Table(own.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    deepest, back = now.df.agg(F.max("depth")).first()[0] or 0, 0
    while 1 << back <= deepest:
        # until now each node has summed what is less than 2 ** back levels below it
        above = F.substring("up", 16 * back + 1, 16)
        handed = now.df.where(F.col("depth") >= 1 << back).groupBy(above.alias("id")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        both = now.df.join(handed, "id", "left")
        new = Table(both.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("l", F.lit(0))).withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("s", F.lit(0))).drop("l", "s"), "nodes")
        now.drop()
        now, back = new, back + 1
    return now


def trie_of(turns: DataFrame) -> DataFrame:
    """One row a node of the trie over rows (conv_id, at, digest, bytes): see `conversation_trie`."""
    held = Table(turns, "sequences")
    partial = partial_tries(held.df)
    slots = partitions_of(turns.sparkSession)
    while slots > FAN:
        partial, slots = merged(partial), -(-slots // FAN)
    nodes = Table(finished(partial), "merged")
    held.drop()
    up = rolled_up(nodes.df)
    nodes.drop()
    out = up.df.withColumn("parent", F.when(F.col("depth") > 0, F.substring("up", 1, 16)))
    # a node with children is the parent of n_children rows, the root's own row has none
    parents = up.df.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    return join_counted(out, parents, "parent", "n").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of `conversations` (conv_id, turn, role, text, ...), the empty one included.

    conv_id is the smallest member and names the node together with depth; parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 are of the node, long but for the last. A turn is its role and text, whole however long;
    nulls in them are empty, rows of equal turn numbers follow the order of their digests, and repeated rows are turns of
    their own. Rows without conv_id are left out. An empty table has no nodes; other columns are ignored, whatever their names.
    """
    return trie_of(digested(conversations))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_of(reopened(digested(read_table(spark, sf_dir, "conversations"))))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {
    "op12_prefix_trie": """
WITH t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 a bit at a time: a number of 0 or more goes in as a byte, -1 is a shift
c AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda x: list_prepend(ascii(x)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a // 2, 3988292384 * (a % 2)) END), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
s AS (SELECT c.c, coalesce((SELECT list(t.turn ORDER BY pos) FROM t WHERE t.c = c.base AND pos <= h), [])
  || coalesce((SELECT list(t.turn ORDER BY pos) FROM t WHERE t.c = c.c AND pos > h), []) AS turns FROM c),
p AS (SELECT c, turns[:d] AS path, d, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM s)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[d].t) END AS own FROM p GROUP BY path, d),
k AS (SELECT a.path, count(b.path) AS n_children FROM n a LEFT JOIN n b ON b.d = a.d + 1 AND b.path[:a.d] = a.path GROUP BY a.path),
u AS (SELECT a.path, sum((k.n_children = 0)::INT)::BIGINT AS n_leaves, sum(b.own)::BIGINT AS saved_tokens
  FROM n a JOIN n b ON b.d >= a.d AND b.path[:a.d] = a.path JOIN k ON k.path = b.path GROUP BY a.path)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
FROM n JOIN k ON k.path = n.path JOIN u ON u.path = n.path LEFT JOIN n q ON q.d = n.d - 1 AND q.path = n.path[:n.d - 1]"""
}
