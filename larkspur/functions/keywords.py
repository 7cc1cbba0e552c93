"""Approved keywords found in a text, in the order they first occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.automaton import with_phrases
from larkspur.functions.text import has_text

_WORD = r"[\p{L}\p{N}_]"
#: The same: looking behind, Java sees whole characters beyond U+FFFF only where the pattern itself has one there.
_BEHIND = "[\\p{L}\\p{N}_\U00010400]"


def keyword_pattern(keyword: Column) -> Column:
    """Matches the keyword literally, in any case, as whole words.

    A border is drawn between a word character and another, as Python draws it; Java's own treats marks and some digits
    otherwise. Which side of a border has the word character follows from the keyword's own end. The literal comes
    first, so that borders are looked at only where it stands.
    """
    literal = F.regexp_replace(keyword, r"([\\.^$*+?()\[\]{}|])", r"\\$1")
    literal = F.when(keyword == "ß", "[ßẞ]").otherwise(literal)  # alone, the one letter that Java compares as it is
    before = F.when(keyword.rlike(f"^{_WORD}"), f"(?<!{_BEHIND})").otherwise(f"(?<={_BEHIND})")
    after = F.when(keyword.rlike(f"{_WORD}\\z"), f"(?!{_WORD})").otherwise(f"(?={_WORD})")
    return F.concat(F.lit("(?iu)(?="), literal, F.lit(")"), before, literal, after)


def top_matching_keywords(text: Column, keywords: Column, most: Column) -> Column:
    """The first `most` keywords by first occurrence; those at one place keep the list's order.

    Blank text, a null list and no match give an empty array; null and blank keywords are passed over; repeated ones
    are kept; keywords come back as listed.
    """
    placed = F.transform(keywords, lambda w, i: F.struct(F.when(has_text(w), F.regexp_instr(text, keyword_pattern(w))).alias("at"), i.alias("i"), w.alias("w")))
    found = F.array_sort(F.filter(placed, lambda x: x["at"] > 0))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(has_text(text), F.slice(F.transform(found, lambda x: x["w"]), F.lit(1), most)), none)


def match_keywords(reviews: DataFrame, vocabulary: DataFrame, key: str = "review_id", most: int = 3) -> DataFrame:
    """(key, keywords) for large vocabularies: one pass over each text finds all keywords, however many there are.

    `vocabulary` has (ord, keyword); it is one list for all reviews, in order of ord. Equal to `top_matching_keywords`
    with that list, for every row of `reviews`, also where keys repeat. Keywords are found by an automaton and kept
    where they have borders; a text is left as soon as nothing that follows can come before what was found.
    """
    texts = reviews.select(key, F.when(has_text(F.col("review")), F.col("review")).alias("review"))
    found = with_phrases(texts, "review", vocabulary.where(has_text(F.col("keyword"))), "ord", "keyword", most)
    return found.select(key, F.transform("hits", lambda x: x["phrase"]).alias("keywords"))
