"""Text predicates and trims with Python's notion of white space, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space of Unicode, and the four separators that Java's class lacks.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"


def present(value: Column) -> Column:
    """Neither null nor empty; white space counts as present."""
    return F.coalesce(value != "", F.lit(False))


def has_text(value: Column) -> Column:
    """Holds a character that is not white space."""
    return F.coalesce(value.rlike(f"(?U){NOT_SPACE}"), F.lit(False))


def stripped(value: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(value, f"(?U)^{SPACE}+|{SPACE}+\\z", "")


def words(value: Column) -> Column:
    """Runs of other than white space, as an array."""
    return F.filter(F.split(value, f"(?U){SPACE}+"), lambda x: x != "")


def labelled(label: str, value: Column) -> Column:
    """`label` and the value, or null where it is not present: for concat_ws, which leaves nulls out."""
    return F.when(present(value), F.concat(F.lit(label), value))
