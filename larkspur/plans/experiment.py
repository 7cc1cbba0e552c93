"""The experiment: a repeatable sample of reviews, every variant of each, replies, and one result table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.operators.ledger import Ledger, respond_once
from larkspur.operators.responder import Responder, respond
from larkspur.operators.sampling import bottom_k, seeded_hash
from larkspur.plans import wording
from larkspur.plans.variant_prompt import GROUNDED, LOCKED, Variant, render, variants
from larkspur.sources.tables import numbered_as_read

# The run's constants.
SAMPLE_SIZE, SAMPLE_SEED, RESPONSE_LENGTH, TONE = 30, 7, 80, "Conversational"
# End of fixed values.

#: Rows of a sample that fit one list.
LISTED = 1000

RESULT = ("variant", "review_id", "reviewer_name", "rating", "review", "response")


def seeded_sample(rows: DataFrame, size: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED, key: str = "review_id") -> DataFrame:
    """`size` rows by a hash of seed and key, numbered from 0 in `seq`; the same rows however they are dealt.

    The top-k is taken in every task first; only `size` rows are numbered. Fewer rows than `size` are an error, whatever
    columns are read: the rows come out of one list, which is checked before it is unfolded. Samples of more than LISTED
    rows are cut and numbered by ranges of hashes instead, with the same rows and numbers.
    """
    if size > LISTED:
        return bottom_k(rows, size, seed, key)
    top = rows.withColumn("order_hash", seeded_hash(seed, key)).orderBy("order_hash", key).limit(size)
    numbered = top.withColumn("seq", F.row_number().over(Window.orderBy("order_hash", key)) - 1).drop("order_hash")
    listed = numbered.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in numbered.columns])).alias("sample"))  # `size` rows
    whole = F.when(F.size("sample") == size, F.col("sample")).otherwise(F.raise_error(F.lit(f"fewer than {size} rows to sample from")))
    return listed.select(F.inline(whole))


def with_review_ids(rows: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows as they are if they have ids, else numbered from 0 as they come."""
    return rows if key in rows.columns else numbered_as_read(rows, key)


def fan_out(sample: DataFrame, chosen: tuple[Variant, ...] = (LOCKED, GROUNDED)) -> DataFrame:
    """Each row once for each variant (a handful of rows, broadcast), with its prompt."""
    rows = sample.withColumn("review", F.coalesce("review", F.lit(""))).crossJoin(F.broadcast(variants(sample.sparkSession, chosen)))
    return render(rows)


def builder_columns(reviews: DataFrame, business: Column, tone: str = TONE, response_length: int = RESPONSE_LENGTH) -> DataFrame:
    """What the run passes to every prompt: names and ratings as they are, and the run's constants."""
    if tone not in wording.TONES:
        raise ValueError(f"unknown tone {tone}")
    given = {"rating": F.col("rating").cast("int"), "reviewer_name": F.col("reviewer_name").cast("string"), "business_name": business, "tone": F.lit(tone), "response_length": F.lit(response_length), "signature": business}
    blank = {x: F.lit("") for x in ("client_instructions", "keyword1", "keyword2", "contact_number", "website_url")}
    return reviews.withColumns(given | blank)


def run(
    reviews: DataFrame, business_name: str, answer: Callable[[], Responder], chosen: tuple[Variant, ...] = (LOCKED, GROUNDED), size: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED,
    tasks: int = 1, pause: float = 0.0, spacing: float = 0.0, ledger: Ledger | None = None, model: str = "",
) -> DataFrame:
    """variant_ord, seq, the six result columns, status and error: variants in order, rows in sample order by (variant_ord, seq).

    With a ledger each model's reply to a prompt is asked for once, in this run or an earlier one. Without it write the result before using
    it twice: reading it again asks for the replies again.
    """
    sample = builder_columns(seeded_sample(with_review_ids(reviews), size, seed), F.lit(business_name))
    asked = fan_out(sample, chosen).withColumn("model", F.lit(model))
    if ledger is None:
        replied = respond(asked, answer, tasks=tasks, pause=pause, spacing=spacing)
    else:
        replied = respond_once(asked, answer, ledger, ("prompt", "model"), tasks=tasks, pause=pause, spacing=spacing)
    return replied.select("variant_ord", "seq", *RESULT, "status", "error")
