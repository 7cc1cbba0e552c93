"""Packing token sequences by minimum bin slack.

Documents are tokenised once (`token_pieces`), cut into full windows and one remainder each, and the remainders are
packed: the driver sees only how many remainders of each length there are (at most window - 1 numbers), repeatedly
runs a bitset subset-sum over those counts for the multiset that fills a window closest to its capacity, backtracks
how many of each length it takes, and repeats it as often as the counts allow. The answer is a table of runs ("the
copies numbered from..to of length L go to sequences from..at offset..") that every piece looks itself up in.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.llm.shared import Table, partitions_of, read_table, rows_in_chunks, through_arrow

WINDOW = 2048
END_ID = 1
#: A window may stay this many ids short of full before its longest remainder is left for the cut pool.
MAX_SLACK = 4
#: Words a Python worker remembers.
WORDS_KEPT = 200_000

#: Characters for which lower-casing and NFC act on each alone: ASCII and the letters of Latin-1.
_PLAIN = re.compile("[^ -~\n\r\tÀ-ÖØ-öø-ÿ]")
_PARTS = re.compile("[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \n\r\ta-zß-öø-ÿ0-9]+")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own `encode(...).ids`.

    Any tokenizer file works through `encode`. For a lower-casing byte BPE with word ends, plain texts are split here
    and each different word is encoded once with a byte-pair merger. That path is used only if the tokenizer reports
    that pipeline and each token's own string merges to that token alone, which makes merging by joined bytes and
    merging by listed pairs agree on all inputs.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.words = _word_merger(json.load(f))

    def __call__(self, text: str) -> bytes:
        if self.words is None or "<|" in text or _PLAIN.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, _PARTS.findall(text.lower())))


class _Words(dict):
    def __init__(self, merge) -> None:
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode() + b"\xff"), dtype="<u4").tobytes()
        if len(word) <= 40:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies print for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


def _word_merger(spec: dict) -> _Words | None:
    model, norm, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [x.get("type") for x in norm.get("normalizers", [])]
    pattern = (pre.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
    if (
        steps != ["NFC", "Replace", "Lowercase"]
        or pattern != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        or model.get("end_of_word_suffix") != "</w>"
        or model.get("ignore_merges")
        or model.get("unk_token")
    ):
        return None
    from tokenizers import models
    from tiktoken import Encoding

    letters, ranks, plain = _byte_letters(), {}, {}
    special = {x["content"] for x in spec["added_tokens"]}
    for token, i in model["vocab"].items():
        if token in special:
            continue
        end = token.endswith("</w>")
        core = token[:-4] if end else token
        ranks[bytes(letters[c] for c in core) + b"\xff" * end] = i
        plain[i] = (core, end)
    merges = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]]
    if any(model["vocab"].get(a + b) is None for a, b in merges) or [model["vocab"][a + b] for a, b in merges] != sorted({model["vocab"][a + b] for a, b in merges}):
        return None  # ids must follow the merges' order, one merge a token
    ended, bare = models.BPE(model["vocab"], merges, end_of_word_suffix="</w>"), models.BPE(model["vocab"], merges)
    for i, (core, end) in plain.items():
        if [x.id for x in (ended if end else bare).tokenize(core)] != [i]:
            return None
    core = getattr(Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None)
    merge = getattr(core, "encode_single_piece", None)  # no public name: without it texts go through the tokenizer
    return _Words(merge) if merge else None


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: row_id, doc_id, start, length, doc_tokens, ids (binary, little-endian u32).

    A document's ids are its text's (null: none) and `end_id`; windows are cut from the front, the last piece holds
    the rest. Any other columns are ignored. Rows with a null or repeated doc_id are documents of their own, kept
    apart by row_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in rows_in_chunks(batches, 2, 4 << 20):
            out: list[tuple] = []
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                out += [(row, doc, at, min(window, n - at), n, ids[4 * at : 4 * (at + window)]) for at in range(0, n, window)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)],
                ["row_id", "doc_id", "start", "length", "doc_tokens", "ids"],
            )

    cols = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "text")
    return through_arrow(cols, run, "row_id long, doc_id long, start long, length long, doc_tokens long, ids binary", "packing", encoder.cache_clear)


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """Subset-sum with counts: (slack, {length: how many}) for the multiset that fills `room` closest.

    Bit s of a Python integer says that the sum s can be reached. Lengths enter longest first, in power-of-two
    portions of their counts; the search ends as soon as the room is filled exactly. Backtracking walks the portions
    in reverse: a sum that was out of reach before a portion needs it.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left, portion = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(portion, left)
            left -= take
            portion *= 2
            steps.append((length, take, reach))
            reach |= reach << (length * take) & full
        if reach >> room & 1:
            break
    best = total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return room - best, used


def fill_plan(counts: dict[int, int], window: int = WINDOW, max_slack: int = MAX_SLACK) -> tuple[list[tuple], dict[int, int], int]:
    """Runs (length, first rank, last rank + 1, per window, first sequence, offset), pool {length: first rank}, sequences used.

    Each round starts from the longest length left and fills the rest of the window by `best_fill`. A multiset is
    repeated while its counts last, so rounds follow the number of lengths (below `window`), not of pieces. A length
    whose best window stays more than `max_slack` short goes to the pool, whose pieces are laid end to end and cut.
    """
    left, given = dict(counts), dict.fromkeys(counts, 0)
    lengths = sorted(left, reverse=True)
    runs, pool, sequence = [], {}, 0
    while lengths:
        top = lengths[0]
        left[top] -= 1
        slack, used = best_fill([x for x in lengths if x <= window - top and left[x]], left, window - top)
        left[top] += 1
        if slack > max_slack:
            pool[top] = given[top]
            lengths = lengths[1:]
            continue
        used[top] = used.get(top, 0) + 1
        times, offset = min(left[x] // k for x, k in used.items()), 0
        for x, k in sorted(used.items(), reverse=True):
            runs.append((x, given[x], given[x] + k * times, k, sequence, offset))
            given[x] += k * times
            left[x] -= k * times
            offset += x * k
        sequence += times
        lengths = [x for x in lengths if left[x]]
    return runs, pool, sequence


def pool_plan(pool: dict[int, int], counts: dict[int, int], sequence: int, window: int = WINDOW) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """The pool laid end to end, longest first: rows (length, first rank, first position), and the sequences that tile it.

    Whole windows tile it, and what is left over is tiled by powers of two, which need no padding: rows
    (first position, size, first sequence), positions counted in ids.
    """
    at, rows = 0, []
    for length in sorted(pool, reverse=True):
        rows.append((length, pool[length], at))
        at += length * (counts[length] - pool[length])
    tiles = [(0, window, sequence)] if at >= window else []
    start, sequence = at // window * window, sequence + at // window
    for bit in range(window.bit_length() - 1, -1, -1):
        if (at - start) >> bit & 1:
            tiles.append((start, 1 << bit, sequence))
            start, sequence = start + (1 << bit), sequence + 1
    return rows, tiles


def _placed(pieces: DataFrame, window: int, max_slack: int) -> DataFrame:
    spark = pieces.sparkSession
    salts = partitions_of(spark) * 4
    thin = pieces.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    # at most window lengths times the salts: how many pieces of each length each salt has
    per_salt = Table(thin.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in per_salt.df.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    runs, pool, sequence = fill_plan({k: v for k, v in counts.items() if k < window}, window, max_slack)
    full = counts.get(window, 0)
    if full:
        runs.append((window, 0, full, 1, sequence, 0))
        sequence += full
    laid, tiles = pool_plan(pool, counts, sequence, window)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_salt.df.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = thin.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_id", "start")) - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("base")).drop("nth", "base", "salt")
    return _looked_up(ranked, runs, laid, tiles, window)


def _looked_up(ranked: DataFrame, runs: list[tuple], laid: list[tuple], tiles: list[tuple], window: int) -> DataFrame:
    """Adds start, length, sequence_id, offset of each piece's parts; the tables have at most a few thousand rows."""
    by_length: dict[int, list[np.ndarray]] = {}
    for x in sorted(runs):
        by_length.setdefault(x[0], []).append(x[1:])
    table = {k: np.array(v, dtype=np.int64).T for k, v in by_length.items()}
    pool = {x[0]: x[1:] for x in laid}
    edges, sizes, firsts = (np.array(x, dtype=np.int64) for x in zip(*tiles, strict=True)) if tiles else (np.zeros(0, np.int64),) * 3
    keep = [c for c in ranked.columns if c not in ("length", "rank", "start")]
    schema = ranked.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, start = (batch.column(c).to_numpy() for c in ("length", "rank", "start"))
            row, at, size, seq, off = [], [], [], [], []
            for one in np.unique(length):
                mine = np.flatnonzero(length == one)
                r, pooled = rank[mine], int(pool[one][0]) if one in pool else None
                direct = mine if pooled is None else mine[r < pooled]
                if direct.size:
                    lo, _, per, seq0, off0 = table[one]
                    q = rank[direct]
                    k = np.searchsorted(lo, q, side="right") - 1
                    row.append(direct)
                    at.append(np.zeros(direct.size, np.int64))
                    size.append(np.full(direct.size, one))
                    seq.append(seq0[k] + (q - lo[k]) // per[k])
                    off.append(off0[k] + (q - lo[k]) % per[k] * one)
                if pooled is None or direct.size == mine.size:
                    continue
                rest = mine[r >= pooled]
                pos, end = pool[one][1] + (rank[rest] - pooled) * one, None
                end = pos + one
                src, begin = rest, pos
                while src.size:  # a remainder crosses few tiles: one cut at most but in the last window
                    t = np.searchsorted(edges, begin, side="right") - 1
                    whole = sizes[t] == window
                    tile_start = np.where(whole, begin // window * window, edges[t])
                    stop = np.minimum(end, tile_start + sizes[t])
                    row.append(src)
                    at.append(begin - (end - one))
                    size.append(stop - begin)
                    seq.append(firsts[t] + np.where(whole, begin // window, 0))
                    off.append(begin - tile_start)
                    more = stop < end
                    src, begin, end = src[more], stop[more], end[more]
            row, at, size, seq, off = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, at, size, seq, off))
            held = pa.RecordBatch.from_arrays([batch.column(c) for c in keep], names=keep).take(pa.array(row))
            cols = list(held.columns)
            if "ids" in keep:
                i = keep.index("ids")
                cols[i] = pa.array([x if len(x) == 4 * n else x[4 * a : 4 * (a + n)] for x, a, n in zip(held.column("ids").to_pylist(), at, size, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(start[row] + at), pa.array(size), pa.array(seq), pa.array(off)], [*keep, "start", "length", "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", start long, length long, sequence_id long, `offset` long"
    return through_arrow(ranked, run, out)


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = END_ID, max_slack: int = MAX_SLACK) -> DataFrame:
    """Packs documents (doc_id, text, ...) into sequences of at most `window` ids.

    Returns a row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32 bit), doc_tokens,
    sequence_id, offset. Each id of each document (its text's, then `end_id`) is in exactly one piece; offsets in a
    sequence are gapless from 0. A null or empty text gives one piece with `end_id` alone; repeated rows are packed
    as often as they occur; very long texts are cut into windows; of pieces that tie in length any may come first, which
    changes no sequence's size; an empty table gives no rows; other columns are ignored, whatever their names. Only
    windows within `max_slack` of full and sizes that are powers of two occur.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    pieces = Table(token_pieces(docs, tokenizer_path, window, end_id), "pieces")
    return _placed(pieces.df, window, max_slack).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def with_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack(read_table(spark, sf_dir, "documents")))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
