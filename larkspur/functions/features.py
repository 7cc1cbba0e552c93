"""Features of a review: sentiment band, length settings, contact lines, sections."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.functions.text import labelled, present
from larkspur.plans import wording

# Bands, length types, and sampling settings by length type.
NEGATIVE, NEUTRAL, POSITIVE = "Negative", "Neutral", "Positive"
LENGTH_TYPES = ("Concise", "Default", "Elaborate")


class LengthSetting(NamedTuple):
    ai_response_length_type: str
    has_text: bool
    word_limit: int
    keyword_count: int
    frequency_penalty: float
    presence_penalty: float
    temperature: float
    max_tokens: int


LENGTH_SETTINGS = (
    LengthSetting("Concise", True, 50, 2, 0.9, 0.8, 0.8, 70),
    LengthSetting("Concise", False, 25, 2, 0.9, 0.8, 0.8, 70),
    LengthSetting("Default", True, 80, 3, 0.9, 0.8, 0.8, 110),
    LengthSetting("Default", False, 40, 3, 0.9, 0.8, 0.8, 110),
    LengthSetting("Elaborate", True, 150, 3, 1.0, 0.8, 0.8, 200),
    LengthSetting("Elaborate", False, 80, 3, 1.0, 0.8, 0.75, 200),
)
# End of fixed values.


def sentiment_band(rating: Column) -> Column:
    """Two stars or fewer are negative, three neutral, more positive; null for a null rating."""
    return F.when(rating <= 2, NEGATIVE).when(rating == 3, NEUTRAL).when(rating.isNotNull(), POSITIVE)


def length_settings(spark: SparkSession) -> DataFrame:
    """Six rows: word limit, keyword count and sampling parameters by length type and presence of text."""
    kinds = "ai_response_length_type string, has_text boolean, word_limit int, keyword_count int, frequency_penalty double, presence_penalty double, temperature double, max_tokens int"
    return spark.createDataFrame([tuple(x) for x in LENGTH_SETTINGS], kinds)


def with_length_settings(reviews: DataFrame) -> DataFrame:
    """Joins the six rows of settings, which are broadcast, to reviews with ai_response_length_type and has_text."""
    return reviews.join(F.broadcast(length_settings(reviews.sparkSession)), ["ai_response_length_type", "has_text"], "left")


def token_line(contact_number: Column, support_email: Column, website_url: Column) -> Column:
    """Contact details that are present, in this order; empty if none is."""
    return F.concat_ws(", ", labelled("Contact Number: ", contact_number), labelled("Support Email: ", support_email), labelled("Website: ", website_url))


def short_token_line(contact_number: Column, website_url: Column) -> Column:
    """The contact details that variant prompts carry."""
    return F.concat_ws(", ", labelled("Contact Number: ", contact_number), labelled("Website URL: ", website_url))


def has_contact(contact_number: Column, website_url: Column) -> Column:
    return present(contact_number) | present(website_url)


def contact_call(rating: Column, contact: Column) -> Column:
    """How a reply should bring in contact details, by rating; empty without any."""
    by_rating = F.when(rating <= 2, wording.CONTACT_EARLY).when(rating == 3, wording.CONTACT_OFFER).otherwise(wording.CONTACT_OPTIONAL)
    return F.when(contact, by_rating).otherwise("")


def exposed_keywords(band: Column, matched: Column) -> Column:
    """Keywords that a prompt may show: none for negative reviews, the first for neutral ones, all for positive ones."""
    return F.when(band == NEGATIVE, F.slice(matched, 1, 0)).when(band == NEUTRAL, F.slice(matched, 1, 1)).otherwise(matched)


def sentiment_section(band: Column, matched: Column) -> Column:
    """The section for the band, with the keywords it may show."""
    shown = F.array_join(exposed_keywords(band, matched), ", ")
    with_keywords = lambda text: F.replace(F.lit(text), F.lit("{keywords}"), shown)
    none = F.size(matched) == 0
    return (
        F.when(band == NEGATIVE, wording.NEGATIVE)
        .when((band == NEUTRAL) & none, wording.NEUTRAL)
        .when(band == NEUTRAL, with_keywords(wording.NEUTRAL_KEYWORDS))
        .when(none, wording.POSITIVE)
        .otherwise(with_keywords(wording.POSITIVE_KEYWORDS))
    )


def review_section(has_text: Column, review: Column, rating: Column, reviewer_name: Column, business_name: Column) -> Column:
    """The review's lines; without text it has no text line."""
    return F.concat_ws(
        "\n",
        F.when(has_text, F.concat(F.lit("Review Text: "), review)),
        F.concat(F.lit("Rating: "), rating.cast("string")),
        F.concat(F.lit("Reviewer Name: "), reviewer_name),
        F.concat(F.lit("Business Name: "), business_name),
    )


def voice_section(business_name: Column) -> Column:
    return F.replace(F.lit(wording.VOICE), F.lit("{business_name}"), business_name)
