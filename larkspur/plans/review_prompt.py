"""The reply request for one review: sections, prompt and sampling parameters as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions import features
from larkspur.functions.keywords import top_matching_keywords
from larkspur.functions.text import has_text, present
from larkspur.plans import wording

#: Model that requests name unless another is given.
MODEL = "reply-model"


def with_features(reviews: DataFrame) -> DataFrame:
    """Adds has_text, band, the length settings, matched (approved keywords found in the text) and tokens.

    `reviews` has reviewer_name, rating, review, ai_response_length_type, business_name, approved_keywords and the
    four support columns. Negative reviews show no keywords, so theirs are looked for only where `matched` is read.
    """
    x = features.with_length_settings(reviews.withColumn("has_text", has_text(F.col("review"))))
    x = x.withColumn("band", features.sentiment_band(F.col("rating")))
    x = x.withColumn("matched", top_matching_keywords(F.col("review"), F.col("approved_keywords"), F.col("keyword_count")))
    return x.withColumn("tokens", features.token_line(F.col("contact_number"), F.col("support_email"), F.col("website_url")))


def length_instruction(has_text: Column, word_limit: Column) -> Column:
    text = F.when(has_text, wording.LENGTH_WITH_TEXT).otherwise(wording.LENGTH_WITHOUT_TEXT)
    return F.replace(text, F.lit("{word_limit}"), word_limit.cast("string"))


def prompt() -> Column:
    """Sections joined by blank lines: base, tone, sentiment, review, length, formatting, then tokens and signature where present."""
    c = F.col
    base = F.concat_ws("\n\n", features.voice_section(c("business_name")), F.lit(wording.GUARDRAILS), F.lit(wording.BRAND))
    shown = F.when(c("band") == features.NEGATIVE, F.array().cast("array<string>")).otherwise(c("matched"))
    return F.concat_ws(
        "\n\n",
        base,
        F.lit(wording.TONE_MENU),
        features.sentiment_section(c("band"), shown),
        features.review_section(c("has_text"), c("review"), c("rating"), c("reviewer_name"), c("business_name")),
        length_instruction(c("has_text"), c("word_limit")),
        F.lit(wording.FORMATTING),
        F.when(c("tokens") != "", F.replace(F.lit(wording.TOKENS), F.lit("{tokens}"), c("tokens"))),
        F.when(present(c("signature")), F.replace(F.lit(wording.SIGNATURE), F.lit("{signature}"), c("signature"))),
    )


def requests(reviews: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """The columns of `keep`, then model, prompt, frequency_penalty, presence_penalty, temperature, max_tokens: also the dry run."""
    return with_features(reviews).select(*keep, F.lit(model).alias("model"), prompt().alias("prompt"), "frequency_penalty", "presence_penalty", "temperature", "max_tokens")


def dry_run_text() -> Column:
    """A request as a dry run shows it: a line for the model and each parameter, a blank line, the prompt."""
    lines = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("model", "temperature", "frequency_penalty", "presence_penalty", "max_tokens")]
    return F.concat_ws("\n", *lines, F.lit(""), F.col("prompt"))
