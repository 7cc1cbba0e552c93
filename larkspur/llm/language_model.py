"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts, beside an exact unigram base.

Counting is an aggregation for each order over all training texts. The filter holds, for every n-gram that is kept, one
member for each level of its count, four levels to an octave, so that a count is read by probing level after level until
one is absent: it is never under-estimated, and over-estimated with a chance that shrinks geometrically. The filter has at
most 2 ** FILTER_BITS bits whatever the corpus, so it is broadcast; the count from which it holds n-grams follows from the
histogram of all counts and what it can hold. The n-grams below stay in the tables of exact counts: where a text has one that
the filter does not know, its key is listed, and the keys meet those tables in a join. By absolute discounting a history
gives the shorter one what its continuations leave over: an array has that mass of each symbol, the filter of longer ones.

Words outside a vocabulary of at most 2 ** WORD_BITS share one symbol in histories and are told apart by their own exact
counts, met in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.llm.shared import Table, partitions_of, read_table, rows_in_chunks, through_arrow

#: log2 of the bits of the filter, of its segments and of the vocabulary, at most; bits set for a member.
FILTER_BITS, SEGMENT_BITS, WORD_BITS, HASHES = 29, 23, 18, 6
#: Bits of the filter for each member: four of ten are set.
ROOM = 11
#: Bytes of the vocabulary's words together, at most.
VOCABULARY_BYTES = 32 << 20
#: Symbols of an n-gram, and how often it must occur to count where the caller does not say.
ORDER, LEAST, DISCOUNT = 2, 2, 0.75
#: The end of a text, also its begin as a history: no word holds a line feed.
END = "\n"
_OTHER, _END = 0, 1
#: Kinds of counts in the filter: vocabulary words, n-grams and left-over masses by order.
WORD, GRAM, LEFT = 0, 2, 8
#: Parts of 1 that sums of logarithms are taken in, so that the order of rows does not matter.
_UNIT = 10**9
_SLICE = 1 << 18


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words in each text, index of every word, different words): A-Z in lower case, words between the bytes 20 and 09 to 0D; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    sizes, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    real = pc.not_equal(words, "")
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(sizes)
    coded = words.filter(real).dictionary_encode()
    return upto[ends] - upto[ends - sizes], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def symbols(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(symbols of all texts behind each other, an END before the first and after each; tokens of each text; where its words are; index of each word; different words)."""
    counts, index, words = tokens(texts)
    known = pc.index_in(words, value_set=vocabulary).fill_null(_OTHER - 2).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    flat = np.full(len(index) + len(counts) + 1, _END)
    is_word = np.ones(len(flat), bool)
    is_word[0] = is_word[np.cumsum(counts + 1)] = False
    flat[is_word] = known[index]
    return flat, counts + 1, np.flatnonzero(is_word), index, words


def grams(flat: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the n-grams, positions of their last symbols): no n-gram crosses the end of a text but from its begin."""
    key = np.zeros(len(flat) - order + 1, np.int64)
    inner = np.ones(len(key), bool)
    for k in range(order):
        at = flat[k : len(flat) - order + 1 + k]
        key = key << WORD_BITS | at
        if 0 < k < order - 1:
            inner &= at != _END
    return key[inner], np.flatnonzero(inner) + order - 1


def level_of(n: Column) -> Column:
    """The level of a count: itself up to 8, then four to an octave."""
    e = F.greatest(F.length(F.bin(n)) - 3, F.lit(0))
    return (e * 4 + F.call_function("shiftright", n, e)).cast("int")


def levels_of(n: np.ndarray) -> np.ndarray:
    """`level_of` in numpy, for counts below 2 ** 53."""
    e = np.maximum(np.frexp(n.astype(np.float64))[1].astype(np.int64) - 3, 0)
    return 4 * e + (n >> e)


def count_at(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 of level 0."""
    e = np.maximum(level // 4 - 1, 0)
    low = (level - 4 * e) << e
    return low + ((1 << e) - 1) / 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def hashed(kind: np.ndarray | int, key: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(key.astype(np.int64).view(np.uint64)) + np.asarray(kind).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _pattern() -> np.ndarray:
    """Words of 64 bits with half of a member's bits set, by rule."""
    h, out = _mixed(np.arange(1, 4097, dtype=np.uint64)), np.zeros(4096, np.uint64)
    for k in range(HASHES // 2):
        out |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return out


_PATTERN = _pattern()


def _member(hashes: np.ndarray, level: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the segment, bits in it) of each (hash, level): all bits of a member lie in one word, so a probe reads memory once."""
    a = _mixed(hashes + np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    low = np.uint64(4095)
    return a >> np.uint64(40) & np.uint64((1 << segment_bits - 6) - 1), _PATTERN[a & low] | _PATTERN[a >> np.uint64(12) & low]


@dataclass
class CountFilter:
    """The words of bits, log2 of their bits, and by kind how many levels are left out at the bottom (counts below are not held)."""

    data: np.ndarray
    bits: int
    cut: dict[int, int] = field(default_factory=dict)

    def counts(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Count of each key, 0 if absent: levels are probed upwards until one is missing."""
        segment, now = min(self.bits, SEGMENT_BITS), self.cut.get(kind, 0)
        hashes, level, at = hashed(kind, keys), np.zeros(len(keys), np.int64), np.arange(len(keys))
        base = _segment_of(hashes, self.bits, segment) << np.uint64(segment - 6)
        while len(at):
            now += 1
            word, bits = _member(hashes, now, segment)
            found = np.flatnonzero(self.data[base + word] & bits == bits)
            hashes, base, at = hashes[found], base[found], at[found]
            level[at] = now
        return count_at(level)

    def put(self, kind: int, keys: np.ndarray, level: np.ndarray) -> None:
        """Sets the members of some keys here: of the vocabulary's, which are few."""
        segment = min(self.bits, SEGMENT_BITS)
        hashes = hashed(kind, keys)
        base = _segment_of(hashes, self.bits, segment) << np.uint64(segment - 6)
        for k in range(self.cut.get(kind, 0) + 1, int(level.max(initial=0)) + 1):
            mine = level >= k
            word, bits = _member(hashes[mine], k, segment)
            np.bitwise_or.at(self.data, base[mine] + word, bits)


def _segment_of(hashes: np.ndarray, bits: int, segment: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits + segment) if bits > segment else np.zeros(len(hashes), np.uint64)


def build(items: DataFrame, bits: int, cut: dict[int, int]) -> CountFilter:
    """A filter of rows (kind, key, level): segments are dealt by hash and each is filled by one task; 2 ** bits bits reach the driver."""
    segment = min(bits, SEGMENT_BITS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, key, level = (c.to_numpy() for c in batch.columns)
            h = hashed(kind, key)
            low = np.array([cut.get(k, 0) for k in range(16)])[kind]
            yield pa.RecordBatch.from_arrays([pa.array(_segment_of(h, bits, segment).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(level)], ["seg", "h", "low", "level"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(1 << segment - 6, np.uint64)
        for batch in batches:
            segs, h, low, level = (c.to_numpy() for c in batch.columns)
            for seg in np.unique(segs):  # sorted, as the rows are
                if seg != now:
                    if now is not None:
                        yield _segment(now, held)
                        held[:] = 0
                    now = seg
                mine = segs == seg
                hs, lo, up = h[mine].view(np.uint64), low[mine], level[mine]
                for k in range(1, int(up.max()) + 1):
                    np.bitwise_or.at(held, *_member(hs[(lo < k) & (k <= up)], k, segment))
        if now is not None:
            yield _segment(now, held)

    rows = through_arrow(items.select("kind", "key", "level"), spread, "seg int, h long, low int, level int")
    dealt = rows.repartition(partitions_of(items.sparkSession), "seg").sortWithinPartitions("seg")
    data = np.zeros(1 << bits - 6, np.uint64)
    for r in through_arrow(dealt, fill, "seg int, bits binary").toLocalIterator():
        data[r.seg << segment - 6 :][: 1 << segment - 6] = np.frombuffer(r.bits, np.uint64)
    return CountFilter(data, bits, cut)


def _segment(seg: int, held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(seg)], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["seg", "bits"])


def learnable(doc_id: Column | str) -> Column:
    """Rows that the model learns from; the others, and those without an id, do not count."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: how often each token is in the texts, END once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_chunks(batches, 0):
            counts, index, words = tokens(batch.column(0))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(index, minlength=len(words)))], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([len(counts)])], ["word", "n"])

    return through_arrow(texts.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(texts: DataFrame, order: int, vocabulary, least: int, seen=None) -> DataFrame:
    """key, n of the n-grams that occur `least` times or more. `seen` is a broadcast filter of the next shorter ones: an n-gram whose parts don't repeat can't either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_chunks(batches, 0):
            flat = symbols(batch.column(0), vocabulary.value)[0]
            for at in range(0, len(flat), _SLICE):
                part = flat[max(0, at - order + 1) : at + _SLICE]
                if len(part) < order:
                    continue
                key, n = np.unique(grams(part, order)[0], return_counts=True)
                if seen is not None:
                    for part_of in (lambda k: k >> WORD_BITS, lambda k: k & (1 << WORD_BITS * (order - 1)) - 1):
                        there = seen.value.counts(GRAM + order - 1, part_of(key)) > 0
                        key, n = key[there], n[there]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    counted = through_arrow(texts.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least) if least > 1 else counted


@dataclass
class Model:
    """What the workers need: vocabulary (END first), its exact counts, levels of its left-over masses, the filter, and the totals."""

    vocabulary: pa.Array
    exact: np.ndarray
    lefts: np.ndarray
    filter: CountFilter
    order: int
    total: int
    types: int
    other: int
    novel: int
    least: int

    def by_symbol(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability, count, left-over mass) of each symbol as the filter has them: probed once a worker."""
        if not hasattr(self, "_by_symbol"):
            ids = np.arange(len(self.exact))
            count, mass = self.filter.counts(WORD, ids), self.total + self.novel
            p = np.where(count > 0, count, self.novel / (self.types + 1)) / mass
            p[_OTHER] = (self.other + self.novel) / mass
            self._by_symbol = p, count, count_at(self.lefts)
        return self._by_symbol

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_by_symbol"}

    def probabilities(self, flat: np.ndarray, learnt: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability, whether the filter does not settle it) of the symbols at start to stop (start is at least 1), each given what is before it.

        `learnt` tells which symbols are of texts that the model has learnt from: what they hold occurs at least once.
        """
        low = max(0, start - self.order + 1)
        part, learnt = flat[low:stop], learnt[low:stop]
        single, counts, lefts = self.by_symbol()
        p, history, unsettled = single[part], counts[part], np.zeros(len(part), bool)
        for order in range(2, self.order + 1):
            if len(part) < order:
                break
            cut = self.filter.cut.get(GRAM + order, 0)
            key, at = grams(part, order)
            # the history's count, by the order below: that of what ends a symbol before
            times = history[at - 1]
            if order == 2:
                left = lefts[part[at - 1]]
            else:
                past, back = np.unique(key >> WORD_BITS, return_inverse=True)
                left = self.filter.counts(LEFT + order, past)[back]
            # without continuations a history says nothing, and a count there would be a false one
            known = (left > 0) & (times > 0)
            if order > 2 and cut >= self.least:  # such a history may be in the tables alone
                unsettled[at[~known]] = True
            at, times, left, use = at[known], times[known], left[known], key[known]
            keys, back = np.unique(use, return_inverse=True)
            count = self.filter.counts(GRAM + order, keys)[back]
            if cut >= self.least:
                missed = count == 0
                if order == 2 and cut == 1:  # a learnt text's pair that does not repeat
                    count[missed & learnt[at]] = 1
                    missed = count == 0
                unsettled[at[missed]] = True
            p[at] = _given(p[at], count, times, left)
            history = np.zeros(len(part))
            history[at] = count
        return p[start - low :], unsettled[start - low :]

    def keys_at(self, flat: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        """Keys of the n-grams of two symbols and more that end at these positions, null where one would cross the end of a text."""
        out, inner = [], np.ones(len(at), bool)
        key, shift = flat[at], 0
        for order in range(2, self.order + 1):
            before = at - order + 1
            inner = inner & (before >= 0)
            if order > 2:
                inner &= flat[before + 1] != _END
            shift += WORD_BITS
            key = key | flat[np.maximum(before, 0)] << shift
            out.append(pa.array(key, mask=~inner))
        return out


def _given(p: np.ndarray, count: np.ndarray, times: np.ndarray, left: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(count - DISCOUNT, 0) / times + np.minimum(left / times, 1.0) * p, 1.0)


def settled(by_symbol: tuple[np.ndarray, np.ndarray, np.ndarray], pairs: np.ndarray, counts: list[np.ndarray], times: list[np.ndarray], lefts: list[np.ndarray]) -> np.ndarray:
    """Probability of the last symbol of `pairs` from exact counts of the n-grams of each order, and for those of three symbols and more of their histories."""
    single, count, left = by_symbol
    past = pairs >> WORD_BITS
    p = single[pairs & (1 << WORD_BITS) - 1]
    for c, n, rest in zip(counts, [count[past], *times], [left[past], *lefts], strict=True):
        use = np.flatnonzero((rest > 0) & (n > 0))
        p[use] = _given(p[use], c[use], n[use], rest[use])
    return p


def learnt(texts: DataFrame, order: int = ORDER, filter_bits: int = FILTER_BITS, least: int = LEAST) -> tuple[Model, Table]:
    """(model, table of the exact counts of all tokens: word, n)."""
    model, words, tables = _learnt(texts, order, filter_bits, least)
    for t in tables.values():
        t.drop()
    return model, words


def _learnt(texts: DataFrame, order: int, filter_bits: int, least: int) -> tuple[Model, Table, dict[int, Table]]:
    """(model, table of the exact counts of all tokens: word, n; by order the tables of all n-grams that count: key, n)."""
    if least < 1:
        raise ValueError("least must be 1 or more")
    if not 1 <= order <= 63 // WORD_BITS:
        raise ValueError(f"order must be 1 to {63 // WORD_BITS}")
    spark = texts.sparkSession
    words = Table(word_counts(texts), "words")
    total, types, novel = (x or 0 for x in words.df.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long"))).first())
    # the most frequent words, by whole buckets of like counts: as many as the vocabulary's bounds allow
    bucket, plain = F.floor(F.log(F.col("n")) * 50), words.df.where(F.col("word") != END)
    room, size, lowest = (1 << WORD_BITS) - 2, VOCABULARY_BYTES, math.inf
    for r in sorted(plain.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes")).collect(), reverse=True):  # 50 buckets for each factor of e
        room, size = room - r.n, size - r.bytes
        if room < 0 or size < 0:
            break
        lowest = r.b
    # up to 2 ** WORD_BITS rows come to the driver as Arrow, not as objects
    common = plain.where(bucket >= lowest).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    ends = sum(r.n for r in words.df.where(F.col("word") == END).collect())
    vocabulary = pa.concat_arrays([pa.array([], pa.string()), *common["word"].chunks])
    exact = np.concatenate([[0, ends], common["n"].to_numpy()]).astype(np.int64)
    del common
    other = total - int(exact.sum())
    single = np.concatenate([[other], exact[1:]])
    ids = np.flatnonzero(single)
    shared = spark.sparkContext.broadcast(vocabulary)
    kept: dict[int, DataFrame] = {}
    tables, seen = {}, None
    for k in range(2, order + 1):
        tables[k] = Table(gram_counts(texts, k, shared, least, seen), f"grams{k}")
        kept[GRAM + k] = tables[k].df
        if seen is not None:
            seen.destroy()
            seen = None
        if k < order and least > 1:  # counts of two and more, their levels but the first are of no use here
            seen = spark.sparkContext.broadcast(build(tables[k].df.select(F.lit(GRAM + k).alias("kind"), "key", F.lit(2).alias("level")), _bits(tables[k].df.count(), filter_bits), {GRAM + k: 1}))
    shared.destroy()  # its readers have written their tables

    # how many members each kind needs at each cut, from the histogram of all levels
    seen_levels = {WORD: dict(zip(*(x.tolist() for x in np.unique(levels_of(single[ids]), return_counts=True)), strict=True))}
    seen_levels |= {kind: {r.level: r.n for r in df.groupBy(level_of(F.col("n")).alias("level")).agg(F.count("*").alias("n")).collect()} for kind, df in kept.items()}

    def members(kind: int, cut: int) -> int:
        return sum((level - cut) * n for level, n in seen_levels[kind].items() if level > cut)

    def needed(cut: int) -> int:
        # left-over masses are no larger than their histories' counts: n-grams but the longest
        histories = sum(level * n for k in range(2, order) for level, n in seen_levels[GRAM + k].items() if level > cut)
        return members(WORD, 0) + sum(members(GRAM + k, cut) for k in range(2, order + 1)) + histories

    cut = least - 1
    while needed(cut) * ROOM > 1 << filter_bits and cut < 200:
        cut += 1
    cuts = {GRAM + k: cut for k in range(2, order + 1)}
    items = [df.select(F.lit(kind).alias("kind"), "key", level_of(F.col("n")).alias("level")).where(F.col("level") > cuts.get(kind, 0)) for kind, df in kept.items()]
    lefts = np.zeros(len(exact), np.int64)
    for k in range(2, order + 1):
        if k == 2:
            came = spent(tables[k].df).toArrow()
            of, used = came["key"].to_numpy(), came["used"].to_numpy()
            known = np.isin(of, ids)  # as `left_over` joins histories with their counts
            of, used = of[known], used[known]
            lefts[of] = levels_of(np.maximum(np.floor(single[of] - used + 0.5), 1).astype(np.int64))
        else:
            left = left_over(tables[k].df, kept[GRAM + k - 1]).select("key", "times", level_of(F.col("n")).alias("level"))
            items.append(left.where(level_of(F.col("times")) > cut).select(F.lit(LEFT + k).alias("kind"), "key", "level"))
    bits = _bits(needed(cut), filter_bits)
    if items:
        all_items = items[0]
        for x in items[1:]:
            all_items = all_items.unionByName(x)
        held = build(all_items, bits, cuts)
    else:
        held = CountFilter(np.zeros(1 << bits - 6, np.uint64), bits)
    held.put(WORD, ids, levels_of(single[ids]))
    model = Model(pa.concat_arrays([pa.array([END], pa.string()), vocabulary]), exact, lefts, held, order, total, types, other, max(1, novel), least)
    return model, words, tables


def spent(continued: DataFrame) -> DataFrame:
    """key, used: the discounted counts of the continuations of each history."""
    return continued.groupBy(F.shiftright("key", WORD_BITS).alias("key")).agg(F.sum(F.col("n") - DISCOUNT).alias("used"))


def left_over(continued: DataFrame, whole: DataFrame) -> DataFrame:
    """key, times, n: of each history with continuations, its count and the mass that they leave to the shorter one."""
    used = spent(continued)
    return used.join(whole.withColumnRenamed("n", "times"), "key").select("key", "times", F.greatest(F.round(F.col("times") - F.col("used")), F.lit(1)).cast("long").alias("n"))


def _bits(members: int, most: int) -> int:
    """log2 of the bits that so many members need."""
    return min(most, max(16, math.ceil(math.log2(max(1, members) * ROOM))))


def score_texts(docs: DataFrame, order: int = ORDER, filter_bits: int = FILTER_BITS, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of `docs` (doc_id, text, ...).

    The model learns from the rows that `learnable` tells; score is its log10 probability of the whole text, however
    long, and of its end; n-grams that occur `least` times or more count, those that the filter has no room for by a join
    with their exact counts, and at `least` 1 so does every n-gram; base_score is that of single tokens with half a count added, from exact counts. Null texts are
    empty: one token, the end. A null id is neither held out nor learnt from; repeated rows count and are scored each,
    equal texts alike; without training rows every token is unknown; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    model, words, tables = _learnt(docs.where(learnable("doc_id")), order, filter_bits, least)
    names = [f"g{k}" for k in range(2, order + 1)]
    total, cuts, mass, unknown = model.total, model.filter.cut, float(model.other + model.novel), model.novel / (model.types + 1)
    each = math.log10(total + 0.5 * (model.types + 1))
    by_symbol = model.by_symbol() if cuts.get(GRAM + 2, 0) >= least else None
    shared = spark.sparkContext.broadcast(model)
    del model  # with its filter: the driver's copy is in the broadcast
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, head double, score double, tail array<struct<word:string,m:long>>"
    if names:
        schema += f", gaps array<struct<{','.join(f'{g}:long' for g in names)}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 33
        logs, there = np.log10(m.exact + 0.5), m.exact > 0
        logs[_OTHER] = 0.0
        vocabulary = m.vocabulary.slice(1)
        for batch in rows_in_chunks(batches, 2):
            flat, counts, where, index, words = symbols(batch.column(2), vocabulary)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            own = np.concatenate([[False], np.repeat(~batch.column(1).to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False), counts)])
            parts = [m.probabilities(flat, own, at, min(at + _SLICE, len(flat))) for at in range(1, len(flat), _SLICE)]
            log_p, unsettled = np.log10(np.concatenate([x for x, _ in parts])), np.concatenate([x for _, x in parts])
            log_p[unsettled] = 0.0
            rare = np.flatnonzero(flat[where] == _OTHER)
            which, back = np.unique(index[rare], return_inverse=True)
            names_of = words.take(pa.array(which))
            symbol = flat[1:]
            # words outside the vocabulary meet their exact counts in a join: here they are listed by text
            of_row = np.searchsorted(starts, where[rare] - 1, side="right") - 1
            pair, times = np.unique(of_row * max(1, len(which)) + back, return_counts=True)
            upto = np.searchsorted(pair // max(1, len(which)), np.arange(len(counts) + 1))
            tail = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.StructArray.from_arrays([names_of.take(pa.array(pair % max(1, len(which)))), pa.array(times.astype(np.int64))], ["word", "m"]))
            gaps = []
            if names:  # the same of n-grams that the filter does not hold
                open_at = np.flatnonzero(unsettled)
                upto = np.searchsorted(open_at, np.concatenate([starts, [len(unsettled)]]))
                gaps = [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.StructArray.from_arrays(m.keys_at(flat, open_at + 1), names))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(counts))), batch.column(0), batch.column(1), pa.array(counts),
                    pa.array(np.add.reduceat(there[symbol].astype(np.int64), starts)), pa.array(np.add.reduceat(logs[symbol], starts)), pa.array(np.add.reduceat(log_p, starts)), tail, *gaps,
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "head", "score", "tail", *["gaps"][: len(gaps)]],
            )
            row += len(counts)

    plain = docs.select("doc_id", F.coalesce(~learnable("doc_id"), F.lit(False)).alias("held_out"), "text")
    scored = Table(through_arrow(plain, run, schema), "scored")
    shared.destroy()
    listed = scored.df.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.m")
    exact = listed.join(words.df, "word", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    # decimals, so that the order of rows does not matter
    log = F.sum((F.col("m") * F.log10(F.col("n") + 0.5)).cast("decimal(38,15)")).cast("double").alias("log")
    own = F.sum((F.col("m") * F.log10(F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(unknown)) / mass)).cast("decimal(38,15)")).cast("double").alias("own")
    tails = exact.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("more"), log, own)
    out, score = scored.df.drop("tail", "gaps").join(tails, "row", "left"), F.col("score") + F.coalesce("own", F.lit(0.0))
    if by_symbol is not None:
        out = out.join(_settled(scored.df, tables, cuts, spark.sparkContext.broadcast(by_symbol)), "row", "left")
        score = score + F.coalesce(F.col("gap") / _UNIT, F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"), score.alias("score"),
    )


def _settled(scored: DataFrame, tables: dict[int, Table], cuts: dict[int, int], by_symbol) -> DataFrame:
    """row, gap: the sum of the logarithms that the filter did not settle, from exact counts, in units."""
    orders = sorted(tables)
    rows = scored.select("row", F.explode("gaps").alias("g")).select("row", "g.*")
    for k in orders:
        # an n-gram of the longest kind that the filter holds has no gap
        held = tables[k].df if k < orders[-1] else tables[k].df.where(level_of(F.col("n")) <= cuts[GRAM + k])
        rows = rows.join(held.select(F.col("key").alias(f"g{k}"), F.col("n").alias(f"n{k}")), f"g{k}", "left")
        if k > 2:
            whole = left_over(tables[k].df, tables[k - 1].df).select(F.col("key").alias("past"), F.col("times").alias(f"t{k}"), F.col("n").alias(f"l{k}"))
            rows = rows.withColumn("past", F.shiftright(f"g{k}", WORD_BITS)).join(whole, "past", "left").drop("past")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda x: batch.column(x).fill_null(0).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            p = settled(by_symbol.value, col("g2"), [col(f"n{k}") for k in orders], [col(f"t{k}") for k in orders[1:]], [col(f"l{k}") for k in orders[1:]])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.rint(np.log10(p) * _UNIT).astype(np.int64))], ["row", "gap"])

    columns = ["row", "g2", *(f"n{k}" for k in orders), *(f"{x}{k}" for k in orders[1:] for x in "tl")]
    return through_arrow(rows.select(*columns), run, "row long, gap long").groupBy("row").agg(F.sum("gap").alias("gap"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), least=1)


QUERIES = {"op11_language_model": op11_language_model}
ORACLES: dict[str, str] = {}
