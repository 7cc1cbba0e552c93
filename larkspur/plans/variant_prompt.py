"""Prompts of the experiment: one renderer whose variants are rows of a table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.functions.features import contact_call, has_contact, short_token_line
from larkspur.functions.text import has_text, present, stripped
from larkspur.plans import wording


class Variant(NamedTuple):
    """Which pieces a prompt has: a tone menu or one locked tone, a grounding section, an extraction section."""

    variant: str
    menu: bool = False
    grounding: bool = False
    extraction: bool = False


DEFAULT = Variant("default_tone", menu=True)
LOCKED = Variant("A_no_grounding")
GROUNDED = Variant("B_with_grounding", grounding=True)
EXTRACTION = Variant("forced_extraction", extraction=True)


def variants(spark: SparkSession, rows: tuple[Variant, ...]) -> DataFrame:
    """The variants as a table, numbered in order."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "variant_ord int, variant string, menu boolean, grounding boolean, extraction boolean")


def persona_of(tone: Column, business_name: Column) -> Column:
    """The persona of a tone with the business's name; null for an unknown tone."""
    chosen = F.coalesce(*[F.when(tone == x, wording.PERSONAS[x]) for x in wording.TONES])
    return F.replace(chosen, F.lit("{business_name}"), business_name)


def persona_menu(business_name: Column) -> Column:
    """All tones in order, each with its persona."""
    return F.replace(F.lit("\n\n".join(f"{x}:\n{wording.PERSONAS[x]}" for x in wording.TONES)), F.lit("{business_name}"), business_name)


def keyword_list(first: Column, second: Column) -> Column:
    return F.concat_ws(", ", F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def _filled(text: str, **values: Column) -> Column:
    """Text with its braces filled, piece by piece, so that a value that itself holds braces stays as it is."""
    import re

    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])


def render(rows: DataFrame) -> DataFrame:
    """Adds `prompt` to rows with the variant's flags and the builder's columns.

    Columns: business_name, reviewer_name, rating, review (null: empty), response_length, tone, client_instructions,
    keyword1, keyword2, contact_number, website_url, signature. The prompt is null for an unknown tone, unless the
    variant has the menu.
    """
    c = F.col
    tokens = short_token_line(c("contact_number"), c("website_url"))
    call = contact_call(c("rating"), has_contact(c("contact_number"), c("website_url")))
    listed = keyword_list(c("keyword1"), c("keyword2"))
    client = stripped(c("client_instructions"))
    menu = F.concat_ws("\n\n", F.concat_ws("\n", F.lit(wording.MENU_HEAD), persona_menu(c("business_name"))), F.lit(wording.MENU_TAIL))
    head = F.when(c("menu"), menu).otherwise(persona_of(c("tone"), c("business_name")))
    body = F.concat_ws(
        "\n\n",
        head,
        F.when(~c("menu") & has_text(c("client_instructions")), _filled(wording.CLIENT, client_instructions=client)),
        _filled(wording.CUSTOMER, review_text=c("review"), rating=c("rating"), reviewer_name=c("reviewer_name")),
        F.when(c("grounding"), F.lit(wording.GROUNDING)),
        F.when(c("extraction"), F.lit(wording.EXTRACTION)),
        F.when(c("extraction"), F.lit(wording.GUIDE.replace("{high}", wording.GUIDE_HIGH_EXTRACTED))).otherwise(F.lit(wording.GUIDE.replace("{high}", wording.GUIDE_HIGH))),
        F.concat_ws("\n", _filled(wording.RULES_HEAD, response_length=c("response_length")), F.when(c("menu"), wording.RULES_TONE), F.lit(wording.RULES_TAIL)),
        F.when(listed != "", _filled(wording.KEYWORDS, keywords=listed)),
        F.when(tokens != "", _filled(wording.VARIANT_TOKENS, tokens=tokens)),
        F.when(call != "", call),
        F.when(present(c("signature")), _filled(wording.VARIANT_SIGNATURE, signature=c("signature"))),
    )
    return rows.withColumn("prompt", F.when(head.isNotNull(), stripped(body)))
