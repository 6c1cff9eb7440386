"""Metrics and tags of units as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a decision in the source language.
DECISIONS = ("if", "elseif", "for", "while", "case", "catch", "iif")


def words(col: Column) -> Column:
    """All lower-case ASCII words of a text, in order, repeats included."""
    return F.filter(F.split(F.regexp_replace(F.lower(col), r"[^a-z0-9_]+", " "), " "), lambda w: w != "")


def complexity(col: Column, keywords: Sequence[str] = DECISIONS) -> Column:
    """1 plus the decisions: words among ``keywords``; ``do case`` itself, ``else`` and ``otherwise`` don't count."""
    found = F.filter(words(col), lambda w: w.isin(list(keywords)))
    do_case = F.regexp_count(F.lower(col), F.lit(r"\bdo\s+case\b")) if "case" in keywords else F.lit(0)
    return 1 + F.size(found) - do_case


def loc(col: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(col, "\n", -1), lambda x: F.trim(x) != ""))


def parameters(args: Column) -> Column:
    """Number of declared parameters."""
    return F.when(F.trim(args) == "", 0).otherwise(F.size(F.split(args, ",", -1)))


def tags(conditions: dict[str, Column]) -> Column:
    """Sorted names of the conditions that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()])))
