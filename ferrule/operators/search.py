"""Text search over a column of documents: words, literals, identifiers. Plain column scans, no index to maintain."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import text as X


def parse_query(text: str) -> list[list[list[str]]]:
    """``a "b c" OR d`` -> alternatives of phrases of words, lower case."""
    out: list[list[list[str]]] = []
    for part in re.split(r"\s+OR\s+", text.strip()):
        phrases = [re.findall(r"[a-z0-9_]+", (a or b).lower()) for a, b in re.findall(r'"([^"]*)"|(\S+)', part) if (a or b) != "AND"]
        if phrases := [p for p in phrases if p]:
            out.append(phrases)
    return out


def words_match(col: Column, query: str) -> Column:
    """Whether a text has all words and phrases of one alternative of the query."""
    low = F.lower(col)
    any_ = F.lit(False)
    for phrases in parse_query(query):
        all_ = F.lit(True)
        for p in phrases:
            # most texts without a phrase lack its longest word, which is told before the pattern is tried
            all_ = all_ & low.contains(max(p, key=len)) & low.rlike(X.whole_words(p))
        any_ = any_ | all_
    return any_


def grep_words(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Documents that match a query of words, phrases and OR, with a snippet around its first word."""
    first = next(iter(parse_query(query)), [[""]])[0][0]
    return docs.where(words_match(F.col(text), query)).withColumn("snippet", X.snippet(F.col(text), X.word_position(F.col(text), first)))


def grep_literal(docs: DataFrame, needle: str, text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """Documents that hold a literal, with a snippet from 30 characters before it."""
    col = F.col(text)
    low = col if case_sensitive else F.lower(col)
    at = F.instr(low, needle if case_sensitive else needle.lower())
    return docs.where(at > 0).withColumn("snippet", X.snippet(col, at))


def grep_identifier(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """Documents that hold a whole identifier, its user prefix dropped, with a snippet."""
    name = re.sub(r"^U_", "", name.strip(), flags=re.I)
    return docs.where(X.word_match(F.col(text), name)).withColumn("snippet", X.snippet(F.col(text), X.word_position(F.col(text), name)))
