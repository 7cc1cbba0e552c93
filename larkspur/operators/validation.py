"""Assembly and checks of review records: valid rows, and rejected ones with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.features import LENGTH_TYPES
from larkspur.operators.joins import join_side, unique
from larkspur.plans import wording

#: Optional columns and their defaults: approved_keywords an empty list, the rest null.
OPTIONAL = {"review": "string", "ai_response_length_type": "string", "approved_keywords": "array<string>", "signature": "string", "contact_number": "string", "support_email": "string", "website_url": "string"}
REQUIRED = ("business_name", "reviewer_name", "rating")


def assemble(reviews: DataFrame, businesses: DataFrame, keywords: DataFrame | None = None, support: DataFrame | None = None, key: str = "business_id") -> DataFrame:
    """One wide row a review: its business, its business's approved keywords and support details, which may be missing.

    The side tables have a row a business; a repeated key, which would double reviews, fails the job with its name. They
    are put together first, so that reviews are joined once, a business of very many reviews in many tasks. Reviews
    without a key or of an unknown business are left out.
    """
    side = unique(businesses, key, "businesses")
    for more, name in ((keywords, "keywords"), (support, "support")):
        if more is not None:
            side = side.join(unique(more, key, name), key, "left")
    return with_defaults(join_side(reviews, side, key, "inner"))


def _only(rows: DataFrame) -> Column:
    """The one row of a table as a struct, by an aggregation that fails on several; null if there is none."""
    found = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return F.when(F.count("*") < 2, F.get(found, F.lit(0))).otherwise(F.raise_error(F.lit("one row is expected")))


def zip_single(review: DataFrame, business: DataFrame, keywords: DataFrame | None = None, support: DataFrame | None = None) -> DataFrame:
    """The same for one-row inputs without keys; several rows of a side are an error, an empty side gives nulls."""
    out = review
    for side in (business, keywords, support):
        if side is not None:
            one = side.limit(2).agg(_only(side).alias("side"))  # one row, whatever the table holds
            out = out.crossJoin(F.broadcast(one)).select(*out.columns, "side.*")
    return with_defaults(out)


def with_defaults(rows: DataFrame) -> DataFrame:
    """Adds the optional columns that are absent; a missing length type is Default, a missing keyword list is empty."""
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("ai_response_length_type", F.coalesce("ai_response_length_type", F.lit("Default")))
    return rows.withColumn("approved_keywords", F.coalesce("approved_keywords", F.array().cast("array<string>")))


def checked(rows: DataFrame) -> DataFrame:
    """Adds `reject_reason`: a required value or column that is missing, a rating outside 1 to 5, an unknown length type or tone, a bad record; null if valid."""
    reasons = [F.when(F.col("_corrupt_record").isNotNull(), "corrupt record")] if "_corrupt_record" in rows.columns else []
    reasons += [F.when(F.col(c).isNull(), f"missing {c}") if c in rows.columns else F.lit(f"missing {c}") for c in REQUIRED]
    if "rating" in rows.columns:
        reasons.append(F.when(~F.col("rating").between(1, 5), "rating out of range"))
    if "tone" in rows.columns:
        reasons.append(F.when(~F.coalesce(F.col("tone").isin(*wording.TONES), F.lit(False)), "unknown tone"))
    if "ai_response_length_type" in rows.columns:
        reasons.append(F.when(~F.coalesce(F.col("ai_response_length_type").isin(*LENGTH_TYPES), F.lit(False)), "unknown length type"))
    return rows.withColumn("reject_reason", F.coalesce(*reasons))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reason)."""
    x = checked(rows)
    return x.where("reject_reason is null").drop("reject_reason"), x.where("reject_reason is not null")


def strict(rows: DataFrame) -> DataFrame:
    """The rows; the job fails at the first invalid one."""
    x = checked(rows)
    return x.where(F.when(F.col("reject_reason").isNull(), True).otherwise(F.raise_error(F.col("reject_reason")).cast("boolean"))).drop("reject_reason")
