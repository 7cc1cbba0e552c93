"""Mixing sources to target weights by entropy balancing.

Targets: sources weigh 1, 2, 3, repeating, in code-point order, and share the words of the corpus; a target stops at
`most` times its source's words and the excess is shared again. Rates: of all rates r(d) in [0, most] whose words meet
the targets, the ones closest to 1 in relative entropy, each document counting once, are exponentially tilted by what a
document adds to its constraint, its size: r(d) = min(most, exp(l(s) t(d))), with one multiplier l(s) a source and the
tilt t(d) = size(d) / mean size of the source (or another, if given). The dual in l is convex; it is solved by safeguarded Newton steps whose
gradient and curvature are sums over documents, taken by one aggregation a step.
Rounding: sources are split into blocks of bounded size; in a block, longest first, each rate is rounded so that
the words taken so far stay nearest to the words due. Long documents, which the rest of a block might not make up, are
rounded before, over their whole source, and the blocks share what that leaves due.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larkspur.llm.shared import Table, partitions_of, read_table

MOST = 3.0
#: Documents in a rounding block, about.
BLOCK = 256
#: Documents of more than a LONG-th of the words of a mean block are long; at most LONG in BLOCK are.
LONG = 32
TOLERANCE = 1e-9
MAX_STEPS = 120
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """source, source_size, target for rows (source, source_size), one a source.

    Sharing again until no target is above its cap ends where target = min(cap, level * weight) for one level: with
    sources sorted by cap / weight, those before some point are at their caps. The windows see one row a source.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    x = sizes.withColumn("weight", (1 + (F.row_number().over(names) - 1) % 3).cast("double")).withColumn("cap", most * F.col("source_size"))
    x = x.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
    x = x.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("free", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    x = x.withColumn("level", (F.col("total") - F.col("capped")) / F.col("free"))
    # the first source, by ratio, whose cap is not below the level of those not yet capped sets that level
    x = x.withColumn("final", F.coalesce(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(all_rows)["level"], F.lit(float("inf"))))
    return x.select("source", "source_size", F.least("cap", F.col("final") * F.col("weight")).alias("target"))


def _exact_sum(x: Column) -> Column:
    """A sum that doesn't follow the order of its rows, as one of doubles does in its last bits."""
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def _counted(state: DataFrame) -> tuple[Table, int]:
    """The multipliers in the shared folder, and whether any source is open still."""
    table = Table(state, "multipliers")
    return table, table.df.where("open").limit(1).count()


def rates(thin: DataFrame, goals: DataFrame, most: float = MOST, tilt: str = "tilt") -> DataFrame:
    """Adds `multiplier` to `goals` (source, target, ...), solving sum of size * min(most, exp(multiplier * tilt)) = target.

    `thin` has source, size and the tilt column (positive). Documents of equal tilt are summed once; then one
    aggregation a step gives each source's words and their slope at the present multiplier; sources that have settled
    keep theirs. Newton's step is taken for the logarithm of the words, inside a bracket that holds the solution from
    the start: at its ends the least tilt alone decides. Targets of nothing, or of all that `most` allows, have the
    multipliers -inf and +inf.
    """
    same = F.col("t.source").eqNullSafe(F.col("g.source"))
    cells = Table(thin.where("size > 0").groupBy("source", F.col(tilt).alias("tilt")).agg(F.sum("size").cast("double").alias("size")), "cells")
    facts = cells.df.groupBy(F.col("source").alias("key")).agg(F.sum("size").alias("all"), F.min("tilt").alias("least"))
    begun = goals.join(facts, F.col("source").eqNullSafe(F.col("key")), "left").drop("key")
    none, full = F.coalesce(F.col("target") <= 0, F.lit(True)) | F.col("all").isNull(), F.col("target") >= most * F.col("all") * (1 - 1e-12)
    end = F.when(none, float("-inf")).when(full, float("inf"))
    begun = begun.withColumns({
        "multiplier": F.coalesce(end, F.lit(0.0)),
        "low": F.least(F.log(F.col("target") / F.col("all")), F.lit(0.0)) / F.col("least") - 1e-9,
        "high": F.log(F.lit(most)) / F.col("least") + 1e-9,
        "open": end.isNull(),
    })
    names = [*goals.columns, "multiplier", "low", "high", "open"]
    state, unsettled = _counted(begun.select(names))
    for _ in range(MAX_STEPS):
        if not unsettled:
            break
        rate = F.exp(F.least(F.col("g.multiplier") * F.col("t.tilt"), F.lit(700.0)))
        held = cells.df.alias("t").join(state.df.where("open").alias("g"), same).withColumn("rate", rate).withColumn("words", F.col("t.size") * F.least("rate", F.lit(most)))
        sums = held.groupBy(F.col("g.source").alias("key")).agg(_exact_sum(F.col("words")).alias("words"), _exact_sum(F.when(F.col("rate") < most, F.col("words") * F.col("t.tilt")).otherwise(0.0)).alias("slope"))
        x = state.df.join(sums, F.col("source").eqNullSafe(F.col("key")), "left").drop("key")
        gap = F.col("words") - F.col("target")
        x = x.withColumn("low", F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high")))
        newton = F.col("multiplier") - F.log(F.col("words") / F.nullif(F.col("target"), F.lit(0.0))) * F.col("words") / F.when(F.col("slope") > 0, F.col("slope"))
        middle = (F.col("low") + F.col("high")) / 2
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        narrow = F.col("high") - F.col("low") <= 1e-14 * F.greatest(F.abs("multiplier"), F.lit(1.0))
        settled = (F.abs(gap) <= TOLERANCE * F.col("target")) | narrow
        x = x.withColumn("multiplier", F.when(F.col("open") & ~settled, step).otherwise(F.col("multiplier"))).withColumn("open", F.col("open") & ~settled)
        old = state
        state, unsettled = _counted(x.select(names))
        old.drop()
    else:
        raise RuntimeError(f"rates did not settle in {MAX_STEPS} steps")
    cells.drop()
    return state.df.select(*goals.columns, "multiplier")


def _rounded(block: pd.DataFrame) -> pd.DataFrame:
    """Copies by error diffusion, longest document first; the shortest ones settle what is left."""
    block = block.sort_values(["size", "stable", "one", "row_id"], ascending=[False, True, True, True], kind="stable")
    size, rate, due = block["size"].to_numpy(), block["rate"].to_numpy(), float(block["due"].iloc[0]) if len(block) else 0.0
    copies = np.floor(rate).astype(np.int64)
    spare = rate - copies
    for i in range(len(size)):
        due += spare[i] * size[i]
        if spare[i] > 1e-12 and due >= size[i] / 2:
            copies[i] += 1
            due -= size[i]
    return pd.DataFrame({"row_id": block["row_id"].to_numpy(), "copies": copies})


def _chunks(rated: DataFrame, block: int) -> DataFrame:
    """row_id, chunk for rows whose `stable` more than `block` rows have: equal rows are told apart by number alone, `block` in a chunk.

    Numbers come from counts by hash of row_id, so that no task sees all rows of a group; which of the equal rows has
    which number has no bearing on the result.
    """
    hot = rated.groupBy("stable").agg(F.count("*").alias("n")).where(F.col("n") > block).select("stable", F.ceil(F.col("n") / block).alias("salts"))
    rows = rated.select("row_id", "stable").join(hot, "stable").withColumn("salt", F.pmod(F.xxhash64("row_id"), "salts"))
    per_salt = rows.groupBy("stable", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("stable").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = per_salt.select("stable", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("stable", "salt").orderBy("row_id")) - 1
    return rows.withColumn("nth", nth).join(base, ["stable", "salt"]).select("row_id", F.floor((F.col("nth") + F.col("base")) / block).alias("chunk"))


def round_copies(rated: DataFrame, block: int = BLOCK) -> DataFrame:
    """row_id, copies for rows (row_id, stable, one, source, size, rate): whole copies, floor or ceiling of the rate.

    `stable` deals rows to blocks, `one` tells apart what ties in it.
    Blocks are a source's documents dealt by hash, about `block` in each, so a source with a third of all rows is
    many small groups, and so are very many equal rows; a block misses its due by about half its shortest document. In
    sources of several blocks the long documents are put in order of size and rounded so that their number so far is
    nearest to the number due, which leaves at most about the longest one due, for all blocks together.
    """
    same = F.col("source").eqNullSafe(F.col("key"))
    n = rated.groupBy("source").agg(F.ceil(F.count("*") / block).alias("blocks"), F.sum("size").alias("words")).withColumnRenamed("source", "key")
    dealt = rated.join(n, same, "left").drop("key").withColumn("long", (F.col("blocks") > 1) & (F.col("size") * LONG * F.col("blocks") > F.col("words")))
    spare = F.col("rate") - F.floor("rate")
    order = Window.partitionBy("source").orderBy(F.desc("size"), "stable", "one", "row_id")
    due_to = lambda last: F.floor(F.coalesce(F.sum("spare").over(order.rowsBetween(Window.unboundedPreceding, last)), F.lit(0.0)) + 0.5)
    long = dealt.where("long").withColumn("spare", F.when(spare > 1e-12, spare).otherwise(0.0))
    long = Table(long.select("row_id", "source", "size", "spare", (F.floor("rate") + due_to(0) - due_to(-1)).cast("long").alias("copies"), "rate"), "long").df
    left = long.groupBy("source").agg(_exact_sum((F.col("rate") - F.col("copies")) * F.col("size")).alias("due")).withColumnRenamed("source", "key")
    rest = dealt.where(~F.col("long")).join(left, same, "left").withColumn("block", F.pmod(F.col("stable"), F.col("blocks")))
    chunks = Table(_chunks(rated, block), "chunks").df
    if chunks.limit(1).count():
        rest = rest.join(chunks, "row_id", "left").withColumn("block", F.when(F.coalesce("chunk", F.lit(0)) > 0, F.pmod(F.xxhash64("stable", "chunk"), F.col("blocks"))).otherwise(F.col("block")))
    rest = rest.select("row_id", "stable", "one", F.xxhash64("source", "block").alias("group"), "size", "rate", (F.coalesce("due", F.lit(0.0)) / F.col("blocks")).alias("due"))
    return rest.groupBy("group").applyInPandas(_rounded, "row_id long, copies long").union(long.select("row_id", "copies"))


def mix_thin(thin: DataFrame, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """`thin` (row_id unique, stable, source, size, tilt) with source_size, target, rate and copies; a null tilt is the size over the source's mean size."""
    sums = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    goals = Table(targets(sums.drop("docs"), most).join(sums.select(F.col("source").alias("key"), "docs"), F.col("source").eqNullSafe(F.col("key"))).drop("key"), "targets").df
    mean = goals.select(F.col("source").alias("key"), (F.col("source_size") / F.greatest("docs", F.lit(1))).alias("mean"))
    tilted = thin.join(mean, F.col("source").eqNullSafe(F.col("key")), "left").withColumn("tilt", F.coalesce("tilt", F.col("size") / F.greatest("mean", F.lit(1.0)))).drop("key", "mean")
    solved = rates(tilted, goals, most).select(F.col("source").alias("key"), "source_size", "target", "multiplier")
    free = F.least(F.exp(F.least(F.col("multiplier") * F.col("tilt"), F.lit(700.0))), F.lit(most))
    rate = F.when(F.col("multiplier") == float("-inf"), 0.0).when(F.col("multiplier") == float("inf"), most).otherwise(free)
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)  # a rate that is whole but for its last bits
    rated = tilted.join(solved, F.col("source").eqNullSafe(F.col("key")), "left").withColumn("rate", near).drop("key", "multiplier")
    rated = Table(rated, "rates").df
    return rated.join(round_copies(rated, block), "row_id")


def _row_hash(docs: DataFrame, names: list[str], seed: int) -> Column:
    """A hash of these columns that tells a null from an absent value beside another."""
    cols = [(F.to_json(F.col(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`")) for c, kind in docs.dtypes if c.lower() in {x.lower() for x in names}]
    return F.xxhash64(F.lit(seed), F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in names]), *cols)


def _row_keys(docs: DataFrame) -> list[Column]:
    return [_row_hash(docs, docs.columns, seed).alias(c) for seed, c in enumerate(("one", "two"), 1)]


def thin_rows(docs: DataFrame, tilt: Column | None = None) -> DataFrame:
    """row_id, stable, one, two, doc_id, source, size, tilt, in the shared folder: texts are read once and row_id holds from here on.

    `stable` hashes doc_id, source and text, so that results don't follow the partitioning; `one` and `two` hash all columns.
    """
    hashes = [_row_hash(docs, ["doc_id", "source", "text"], 0).alias("stable"), *_row_keys(docs)]
    return Table(docs.select(F.monotonically_increasing_id().alias("row_id"), *hashes, "doc_id", "source", word_count("text").alias("size"), F.lit(tilt).cast("double").alias("tilt")), "sizes").df


def mix(docs: DataFrame, most: float = MOST, tilt: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate for every row of `docs` (doc_id, text, source, ...).

    Where a source is to give less than it has, its long documents are taken less often than its short ones, where it
    is to give more, more often: the tilt follows the words that a document adds. What a source's documents take misses
    its target by a few words a block, or where the shorter documents can't make up for the longest one by about that
    document at most.

    Null texts have no words, and documents without words have the rate 1 unless their source gives nothing; a null
    source is a source of its own and comes last; repeated rows are documents each; of rows that tie in everything any
    may be the one that is rounded up, which shows in no column; very long texts are documents like others; an empty
    table gives no rows; other columns are ignored. The result depends on the rows alone, not on timing.
    """
    out = mix_thin(thin_rows(docs, tilt), most)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mixed_documents(docs: DataFrame, most: float = MOST, tilt: Column | None = None) -> DataFrame:
    """The rows of `docs`, with their columns, each as often as the mix takes it; rows are treated as by `mix`.

    Rows meet their copies by 128 bits of hash over all their columns. Rows equal in all of them are one row whose
    copies add up, so that neither they nor their copies gather in one task.
    """
    names = docs.columns
    plain = docs.select(*_row_keys(docs), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    taken = mix_thin(thin_rows(docs, tilt), most).groupBy("one", "two").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    taken = Table(taken, "copies").df
    most_rows, most_copies = taken.agg(F.max("n"), F.max("copies")).first()
    if (most_rows or 0) > 1:
        plain = plain.groupBy("one", "two").agg(F.first(F.struct(*[f"c{i}" for i in range(len(names))])).alias("row")).select("one", "two", "row.*")
    out = plain.join(taken.where("copies > 0").drop("n"), ["one", "two"])
    if (most_copies or 0) > BLOCK:
        out = out.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / BLOCK)))).withColumn("copies", F.least(F.lit(BLOCK), F.col("copies") - F.col("part") * BLOCK))
        out = out.repartition(partitions_of(docs.sparkSession), "one", "part")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {}
