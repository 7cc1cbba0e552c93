"""Many phrases found in one pass over each text: an automaton for each shard of the phrase list, in Arrow batches.

The phrase list is cut into shards of a bounded size, which are broadcast; a worker has one shard's automaton at a time.
Each text is read once and goes through the shards one after the other, so neither texts nor hits are shuffled.
"""

from __future__ import annotations

import heapq
import pickle
import re
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from larkspur.sources.shared import drop_path, scratch_path

#: Bytes of the phrases of a shard, about, and of the texts that go through the shards together if there are several;
#: shards that are broadcast at a time, at most.
SHARD_BYTES, CHUNK_BYTES, SHARDS = 8 << 20, 32 << 20, 16
#: Bytes of texts, and hits, that are Python objects at a time, about.
SLICE_BYTES, HITS = 2 << 20, 50_000


def _simple(c: str) -> str:
    """A character as Java's case-insensitive patterns compare it: the lower case of its upper case, one character for one."""
    upper = c.upper()
    if len(upper) > 1:
        upper = c.title() if len(c.title()) == 1 else c
    return "i" if upper == "İ" else upper.lower()


@lru_cache(maxsize=1)
def _odd() -> tuple[dict[str, str], re.Pattern]:
    """Lower-case characters that compare as another one, such as ς and ſ."""
    found = {c: _simple(c) for c in map(chr, range(128, 0x20000)) if c == c.lower() and c != c.upper() and _simple(c) != c}
    return found, re.compile("[" + "".join(found) + "]")


def folded(text: str) -> str:
    """Equal for texts that match each other in any case, and as long as the text."""
    low = text.lower()
    if text.isascii():
        return low
    if len(low) != len(text):  # as İ, whose lower case is two characters
        return "".join(map(_simple, text))
    odd, pattern = _odd()
    return pattern.sub(lambda m: odd[m[0]], low)


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


class Finder:
    """Phrases with their places in a list; `whole`: in any case and with a word border at both ends, else as they are."""

    def __init__(self, phrases: list[tuple[int, str]], whole: bool = True) -> None:
        self.whole, self.longest = whole, 0
        self.automaton, self.listed = ahocorasick.Automaton(), []
        by_text: dict[str, list[tuple[int, str]]] = {}
        for place, phrase in sorted(set(phrases)):
            by_text.setdefault(folded(phrase) if whole else phrase, []).append((place, phrase))
        for text, same in by_text.items():
            self.automaton.add_word(text, len(self.listed))
            self.listed.append((len(text), _is_word(text[0]), _is_word(text[-1]), same))
            self.longest = max(self.longest, len(text))
        if by_text:
            self.automaton.make_automaton()

    def first(self, text: str, most: int | None = None) -> list[tuple[int, int, str]]:
        """(position, place in the list, phrase) of each phrase's first occurrence, the first `most` of them in this order."""
        if not self.listed:
            return []
        seen: dict[int, int] = {}
        starts: list[int] = []  # the `most` smallest so far, largest first
        size = len(text)
        for end, k in self.automaton.iter(folded(text) if self.whole else text):
            if most is not None and len(starts) >= most and end - self.longest + 1 > -starts[0]:
                break  # whatever comes now begins behind all of them
            if k in seen:
                continue
            length, word_first, word_last, same = self.listed[k]
            at = end - length + 1
            if self.whole:
                # a border lies between a word character and another; the phrase's own end tells which side has it
                before, after = at > 0 and _is_word(text[at - 1]), end + 1 < size and _is_word(text[end + 1])
                if before == word_first or after == word_last:
                    continue
            seen[k] = at
            for _ in same if most is not None else ():
                (heapq.heappush if len(starts) < most else heapq.heappushpop)(starts, -at)
        found = sorted((at, place, phrase) for k, at in seen.items() for place, phrase in self.listed[k][3])
        return found[:most]


def _shards(rows: DataFrame, n: int, some: range) -> list[Broadcast]:
    """Shards `some` of n of the list (place, phrase), broadcast; each is collected on its own, so the driver holds one at a time.

    As bytes: what a worker keeps of a shard that it does not use is no larger than its phrases.
    """
    name, part, context = uuid.uuid4().hex, F.pmod(F.xxhash64("phrase"), F.lit(n)), rows.sparkSession.sparkContext
    return [context.broadcast((f"{name}-{k}", pickle.dumps([(r.place, r.phrase) for r in (rows.where(part == k) if n > 1 else rows).collect()]))) for k in some]


_held: dict[tuple[str, bool], Finder] = {}


def _finder(shard: Broadcast, whole: bool) -> Finder:
    """The shard's automaton; the worker forgets the one before."""
    name, phrases = shard.value
    key = (name, whole)
    if key not in _held:
        _held.clear()
        _held[key] = Finder(pickle.loads(phrases), whole)
    return _held[key]


def with_phrases(rows: DataFrame, text: str, phrases: DataFrame, place: str, phrase: str, most: int | None = None, whole: bool = True) -> DataFrame:
    """`rows` without column `text`, with `hits` in its place: (at, place, phrase) of the first occurrence of each phrase in the text, the first `most` in this order.

    `phrases` is a list (place, phrase); null places, null and empty phrases are passed over. Up to SHARDS shards, which
    bounds what is broadcast, the texts are read once and not moved; a longer list takes a pass for every SHARDS of them,
    between which texts and hits so far are written to the shared folder.
    """
    listed = phrases.select(F.col(place).cast("long").alias("place"), F.col(phrase).alias("phrase")).where("place IS NOT NULL AND phrase <> ''")
    n = max(1, -(-(listed.agg(F.sum(F.octet_length("phrase") + 16)).first()[0] or 0) // SHARD_BYTES))
    names, spark = [c for c in rows.columns if c != text], rows.sparkSession
    now, last = rows.select(*names, F.col(text).alias(text), F.array().cast(_HITS).alias("hits")), None
    for low in range(0, n, SHARDS):
        shards = _shards(listed, n, range(low, min(n, low + SHARDS)))
        more = low + SHARDS < n
        now = _pass(now, len(names), shards, most, whole, more)
        if more:
            path = scratch_path(spark, "hits")
            now.write.parquet(path)
            now = spark.read.schema(now.schema).parquet(path)
            for shard in shards:
                shard.destroy()
            if last:
                drop_path(spark, last)
            last = path
    return now


_HITS = "array<struct<at:bigint,place:bigint,phrase:string>>"


def _pass(rows: DataFrame, at: int, shards: list[Broadcast], most: int | None, whole: bool, keep_text: bool) -> DataFrame:
    """Rows (..., text, hits), the text at position `at`, with the shards' hits put to the others; without the text unless it is kept."""
    kept = [c for i, c in enumerate(rows.columns) if keep_text or i != at]
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK_BYTES if len(shards) > 1 else 0):
            slices = [x for batch in chunk for x in _slices(batch, at)]
            hits = [_shard_hits(_finder(shard, whole), slices, at, most) for shard in shards]
            begin = 0
            for batch in slices:
                for low, high in _bounded(hits, begin, batch):
                    part = batch.slice(low - begin, high - low)
                    found = _merged([_told(part.column(at + 1)), *(shard.of(low, high) for shard in hits)], part.num_rows, most)
                    yield pa.RecordBatch.from_arrays([*part.columns[:at], *([part.column(at)] if keep_text else []), found], kept)
                begin += batch.num_rows

    # batches are cut by bytes, whatever the texts' lengths
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))
    return rows.mapInArrow(run, schema)


class _Hits:
    """A shard's hits in the texts of a chunk, a few bytes each: the text's number, the position and the number of the phrase."""

    def __init__(self) -> None:
        self.rows, self.at, self.which = array("i"), array("q"), array("i")
        self.places, self.phrases = pa.array([], pa.int64()), pa.array([], pa.string())

    def of(self, low: int, high: int) -> pa.Table:
        """The hits of texts `low` to `high`, which count from 0."""
        a, b = bisect_left(self.rows, low), bisect_left(self.rows, high)
        which = np.array(self.which[a:b], np.int32)
        return pa.table([np.array(self.rows[a:b], np.int32) - low, np.array(self.at[a:b], np.int64), self.places.take(pa.array(which)), self.phrases.take(pa.array(which))], _NAMES)


_NAMES = ["row", "at", "place", "phrase"]


def _told(hits: pa.ListArray) -> pa.Table:
    """Lists of hits as rows of a table, by the number of the list."""
    sizes, flat = hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), hits.flatten()
    return pa.table([np.repeat(np.arange(len(hits), dtype=np.int32), sizes), *(flat.field(i).cast(k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string())))], _NAMES)


def _merged(parts: list[pa.Table], n: int, most: int | None) -> pa.ListArray:
    """For each of n texts its hits in order, the first `most` of them."""
    rows = pa.concat_tables(parts)
    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in _NAMES])).combine_chunks()
    of = rows.column("row").to_numpy()
    if most is not None:
        rows = rows.filter(pa.array(np.arange(len(of)) - np.searchsorted(of, of) < most))
        of = rows.column("row").to_numpy()
    ends = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    fields = [pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in _NAMES[1:]]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, _NAMES[1:]))


def _shard_hits(finder: Finder, slices: list[pa.RecordBatch], at: int, most: int | None) -> _Hits:
    out, known, row = _Hits(), {}, 0
    for batch in slices:
        for text in batch.column(at).to_pylist():
            for begin, place, phrase in finder.first(text, most) if text else ():
                out.rows.append(row)
                out.at.append(begin)
                out.which.append(known.setdefault((place, phrase), len(known)))
            row += 1
    out.places, out.phrases = pa.array([p for p, _ in known], pa.int64()), pa.array([p for _, p in known], pa.string())
    return out


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of text, or one row."""
    n, size = batch.num_rows, batch.column(at).nbytes
    step = max(1, n if size <= SLICE_BYTES else n * SLICE_BYTES // size)
    for low in range(0, n, step):
        yield batch.slice(low, step)


def _bounded(hits: list[_Hits], begin: int, batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows, whose first is `begin`, with about HITS hits each, or one row."""
    counts = np.zeros(batch.num_rows, np.int64)
    for shard in hits:
        a, b = bisect_left(shard.rows, begin), bisect_left(shard.rows, begin + batch.num_rows)
        counts += np.bincount(np.array(shard.rows[a:b], np.int64) - begin, minlength=batch.num_rows)
    low, ends = 0, np.cumsum(counts)
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, HITS + (ends[low - 1] if low else 0), side="right")))
        yield begin + low, begin + min(high, batch.num_rows)
        low = high


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together up to `most` bytes; each alone for 0."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
