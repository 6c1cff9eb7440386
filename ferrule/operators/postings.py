"""An optional index for text search: word postings with positions and trigram postings, in parts by hash of the term.

A search reads the parts of its terms only, intersects their documents, and reads the texts of what is left. Terms that
very many documents hold are written by several tasks, so no task gets all postings of a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.search import grep_identifier, grep_literal, grep_words, parse_query
from ferrule.scratch import names_in, put_once, read_small

#: What an index can hold. A text has about twice as many different trigrams as different words (measured on `check_l`).
KINDS = ("word", "gram")
#: Parts of each postings table, and tasks that write one part.
PARTS, SLICES = 64, 8
#: Postings and places of words that a worker holds before it hands them on, about.
ROWS = 100_000
_WORD = re.compile(r"[a-z0-9_]+")


def _terms(frames: Iterator[pd.DataFrame], kinds: Sequence[str] = KINDS) -> Iterator[pd.DataFrame]:
    """(id, text in lower case) -> (id, kind, term, positions): words with their places, trigrams without.

    Postings leave as soon as there are ROWS of them or of words' places, so a worker holds those of a few texts, however many come at once.
    """

    def made() -> pd.DataFrame:
        # as objects: pandas' own strings come as Arrow chunks, of which an empty column has none
        columns = {"kind": named, "term": terms, "positions": positions}
        return pd.DataFrame({"id": pd.Series(ids, dtype=frame["id"].dtype)} | {n: pd.Series(v, dtype=object) for n, v in columns.items()})

    for frame in frames:
        ids, named, terms, positions, places = [], [], [], [], 0
        for key, text in zip(frame["id"], frame["text"]):
            if "word" in kinds:
                at: dict[str, list[int]] = {}
                for k, word in enumerate(_WORD.findall(text)):
                    if word in at:
                        at[word].append(k)
                    else:
                        at[word] = [k]
                    places += 1
                ids += [key] * len(at)
                named += ["word"] * len(at)
                terms += at.keys()
                positions += at.values()
            if "gram" in kinds:
                grams = {text[k : k + 3] for k in range(len(text) - 2)}
                ids += [key] * len(grams)
                named += ["gram"] * len(grams)
                terms += grams
                positions += [None] * len(grams)
            if len(ids) + places >= ROWS:
                yield made()
                ids, named, terms, positions, places = [], [], [], [], 0
        yield made()


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


class Postings:
    """The index of a table of texts under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, docs: DataFrame, key: str, text: str = "text", kinds: Sequence[str] = KINDS) -> Postings:
        """Index ``docs`` anew. Null texts and null keys are not indexed; a key should stand once.

        ``kinds``: what will be searched, words or trigrams. A search for what the index doesn't hold scans all texts.
        """
        plain = docs.select(F.col(key).alias("id"), F.lower(text).alias("text")).where("id is not null and text is not null")
        kind = plain.schema["id"].dataType.simpleString()
        rows = plain.mapInPandas(lambda frames: _terms(frames, kinds), f"id {kind}, kind string, term string, positions array<int>").withColumn("part", _part(F.col("term")))
        dealt = rows.repartition("kind", "part", F.pmod(F.xxhash64("id"), F.lit(SLICES))).sortWithinPartitions("kind", "part", "term")
        dealt.write.mode("overwrite").partitionBy("kind", "part").option("compression", "zstd").parquet(self.root)
        put_once(self.spark, f"{self.root}/_kinds", " ".join(kinds))
        return self

    def _holds(self, kind: str) -> bool:
        """Whether the index was built with this kind; one that doesn't say so has both."""
        return "_kinds" not in names_in(self.spark, self.root) or kind in read_small(self.spark, f"{self.root}/_kinds").split()

    def _of(self, kind: str, terms: list[str]) -> DataFrame:
        """Postings of some terms: only their parts are read, and of these the row groups that can hold them."""
        parts = self.spark.range(1).select(F.array(*[_part(F.lit(t)) for t in terms])).first()[0]
        return self.spark.read.parquet(self.root).where((F.col("kind") == kind) & F.col("part").isin(*parts) & F.col("term").isin(*terms))

    def _phrase(self, words: list[str]) -> DataFrame:
        """Documents in which the words stand in a row: starts that all words agree on."""
        if len(words) == 1:
            return self._of("word", words).select("id").distinct()
        place = F.create_map(*[F.lit(x) for w in dict.fromkeys(words) for x in (w, [k for k, v in enumerate(words) if v == w])])
        rows = self._of("word", sorted({*words})).select("id", F.explode("positions").alias("at"), F.explode(place[F.col("term")]).alias("k"))
        return rows.groupBy("id", (F.col("at") - F.col("k")).alias("start")).count().where(F.col("count") == len(words)).select("id").distinct()

    def words(self, docs: DataFrame, query: str, key: str, text: str = "text") -> DataFrame:
        """``search.grep_words`` on the documents that the postings leave."""
        if not self._holds("word"):
            return grep_words(docs, query, text)
        alternatives = []
        for phrases in parse_query(query):
            found = [self._phrase(p) for p in phrases]
            alternatives.append(reduce(lambda a, b: a.join(b, "id", "left_semi"), found))
        if not alternatives:
            return grep_words(docs.limit(0), query, text)
        return grep_words(self._only(docs, reduce(DataFrame.unionByName, alternatives), key), query, text)

    def literal(self, docs: DataFrame, needle: str, key: str, text: str = "text", case_sensitive: bool = False) -> DataFrame:
        """``search.grep_literal`` on the documents that hold all trigrams of the needle; a needle under 3 characters scans all."""
        return grep_literal(self._holding(docs, needle, key), needle, text, case_sensitive)

    def identifier(self, docs: DataFrame, name: str, key: str, text: str = "text") -> DataFrame:
        """``search.grep_identifier`` on the documents that hold all trigrams of the name."""
        return grep_identifier(self._holding(docs, re.sub(r"^U_", "", name.strip(), flags=re.I), key), name, text)

    def _holding(self, docs: DataFrame, needle: str, key: str) -> DataFrame:
        low = needle.lower()
        grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
        if not grams or not self._holds("gram"):
            return docs
        held = self._of("gram", grams).groupBy("id").count().where(F.col("count") == len(grams))
        return self._only(docs, held, key)

    @staticmethod
    def _only(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
        return docs.join(found.select(F.col("id").alias(key)), key, "left_semi")
