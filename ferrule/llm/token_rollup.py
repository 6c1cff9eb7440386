"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of inserts, deletes and revised counts is resolved against the ledger into signed rows: a delete subtracts what the
ledger holds, a revision subtracts that and adds the new count. Rows and their sums are written in a folder of the attempt's
own. Then the log gets its next entry, which names the folders that count: entries are numbered, appear whole, and are made only
once. A batch resolved against entry n can only become entry n + 1; if another writer was faster, it is resolved anew
against the newer state. So a batch that is committed is skipped, one that broke off leaves nothing that counts, and none is
lost or counted twice. Totals add up the sums of the folders, so they never read documents again. The ledger is
partitioned by a hash of the document, so a batch reads the parts it touches; ``compact`` folds the state of one entry into
one folder, and the names of its batches into a table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import byte_bpe
from ferrule.llm.common import Tables, scratch_path, table
from ferrule.scratch import names_in, put_once, read_small

DIMENSIONS = ("source", "lang", "version")
_KEY = ("doc_id", "version")
_ROWS = "doc_id long, source string, lang string, version string, n_docs long, n_tokens long"
_SUMS = "source string, lang string, version string, n_docs long, n_tokens long"
#: Tokenizer versions as patterns, the same in Java, RE2 and Python: a match is a token.
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-1": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text by a version of PATTERNS; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PATTERNS[version])).cast("long")


#: Parts of the ledger, by a hash of the document, unless a rollup is given another number.
PARTS = 16
#: Times that a batch is resolved anew because another writer was faster.
TRIES = 20


def count_by_codec(docs: DataFrame, path: str, version: str, pattern: str | None = None) -> DataFrame:
    """``docs`` -> changes that put each row's tokens by the byte-level BPE ranks of the file ``path`` (op10's codec).

    Null ids, sources and languages are kept as they are; a null text has no tokens; an empty table gives an empty result.
    """
    rows = docs.select(F.struct("doc_id", "source", "lang").alias("own"), "text")
    found = byte_bpe.counts(rows, path, "own", "text", pattern)
    return found.select("id.*", F.lit(version).alias("version"), "n_tokens", F.lit("put").alias("kind"))


class Rollup:
    """Ledger, totals and commits under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS) -> None:
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(self.parts)).cast("int").alias("part")

    def _state(self) -> tuple[int, dict]:
        """(number, content) of the newest entry of the log: folders that count, batches since the last compaction, table of names before."""
        newest = max((int(n[:-5]) for n in names_in(self.spark, f"{self.path}/log") if n.endswith(".json")), default=0)
        return newest, json.loads(read_small(self.spark, f"{self.path}/log/{newest:012d}.json")) if newest else {"folders": [], "batches": [], "names": None}

    def _next(self, number: int, content: dict) -> bool:
        """Make the entry after ``number``; False where another writer has made it."""
        return put_once(self.spark, f"{self.path}/log/{number + 1:012d}.json", json.dumps(content))

    def _names(self, state: dict) -> DataFrame:
        own = self.spark.createDataFrame([(n,) for n in state["batches"]], "name string")
        return own if state["names"] is None else own.unionByName(self.spark.read.schema("name string").parquet(state["names"]))

    def _known(self, state: dict, batch: str) -> bool:
        return batch in state["batches"] or state["names"] is not None and not self._names(state).where(F.col("name") == batch).isEmpty()

    def batches(self) -> list[str]:
        """Names of the committed batches, in order."""
        return [r[0] for r in self._names(self._state()[1]).orderBy("name").collect()]

    def _commit_file(self, batch: str, folder: str, at: tuple[int, dict] | None = None) -> bool:
        """Let a folder count under the batch's name, from the state that it was resolved against; False where that isn't the newest."""
        number, state = at or self._state()
        return not self._known(state, batch) and self._next(number, {**state, "folders": [*state["folders"], folder], "batches": [*state["batches"], batch]})

    def _folders(self) -> list[str]:
        """Folders that count."""
        return self._state()[1]["folders"]

    def _read(self, kind: str, schema: str, state: dict | None = None) -> DataFrame:
        names = (state or self._state()[1])["folders"]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/attempt={n}" for n in names])

    def _write(self, rows: DataFrame) -> str:
        """Rows and their sums in a new folder."""
        folder = uuid.uuid4().hex
        where = f"{self.path}/rows/attempt={folder}"
        rows.withColumn("part", self._part()).repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(where)
        sums = self.spark.read.schema(_ROWS).parquet(where).groupBy(*DIMENSIONS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.parquet(f"{self.path}/sums/attempt={folder}")
        return folder

    def compact(self) -> bool:
        """Fold all batches committed so far into one; their names stay committed. False where there is nothing to fold.

        What is folded is the state of one entry; if a batch commits meanwhile, the newer state is folded instead.
        """
        for _ in range(TRIES):
            number, state = self._state()
            if len(state["folders"]) < 2:
                return False
            folder = self._write(self._standing(self._read("rows", _ROWS, state)).select(*[c.split()[0] for c in _ROWS.split(", ")]))
            names = f"{self.path}/names/{folder}"
            self._names(state).write.parquet(names)
            if self._next(number, {"folders": [folder], "batches": [], "names": names}):
                return True
        raise RuntimeError("other writers were faster each time")

    def ledger(self) -> DataFrame:
        """What stands: a row for each document and version, with its counts."""
        return self._standing(self._read("rows", _ROWS))

    @staticmethod
    def _standing(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_KEY, "source", "lang").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and version; combinations that hold none are absent."""
        return self._read("sums", _SUMS).groupBy(*DIMENSIONS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply (doc_id, source, lang, version, n_tokens, kind) once; False where ``batch`` was committed before.

        kind: ``put`` inserts or revises, ``delete`` removes whatever stands, if anything; other kinds are an error.
        Within a batch a document and version counts once: a delete wins, else the largest count, then the largest source
        and language. Null ids, versions, sources and languages are values like any other; a null count is 0. Other
        columns are not read; an empty batch commits nothing but its name.
        """
        if self._known(self._state()[1], batch):
            return False
        bad = F.when(F.col("kind").isin("put", "delete"), F.col("kind") == "delete").otherwise(F.raise_error(F.concat(F.lit("kind "), F.coalesce("kind", F.lit("null")))).cast("boolean"))
        last = F.max(F.struct(bad.alias("gone"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang")).alias("new")
        t = Tables(self.spark)
        new = t.write("changes", changes.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version").agg(last))
        parts = [r[0] for r in new.select(self._part()).distinct().collect()]  # at most ``parts`` numbers
        try:
            for _ in range(TRIES):
                number, state = self._state()
                if self._known(state, batch):
                    return False
                if self._commit_file(batch, self._write(self._resolved(new, parts, state)), (number, state)):
                    return True
        finally:
            t.drop("changes")
        raise RuntimeError("other writers were faster each time")

    def _resolved(self, new: DataFrame, parts: list[int], state: dict) -> DataFrame:
        """Signed rows of a batch: what stands of its documents in a state is taken off, what is put is added."""
        rows = self._read("rows", _ROWS + ", part int", state)
        old = self._standing(rows.where(F.col("part").isin(parts))).withColumnsRenamed({"doc_id": "doc_id_", "version": "version_"})
        touched = old.join(new, old.doc_id_.eqNullSafe(new.doc_id) & old.version_.eqNullSafe(new.version), "left_semi").select(
            F.col("doc_id_").alias("doc_id"), "source", "lang", F.col("version_").alias("version"), (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")
        )
        added = new.where("not new.gone").select("doc_id", "new.source", "new.lang", "version", F.lit(1).cast("long").alias("n_docs"), "new.n_tokens")
        return touched.unionByName(added)


def _counts(docs: DataFrame, versions, text: Column = None) -> DataFrame:
    text = F.col("text") if text is None else text
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), count_tokens(text, v).alias("n_tokens")) for v in versions])).alias("c")
    return docs.select("doc_id", "source", "lang", each).select("doc_id", "source", "lang", "c.version", "c.n_tokens", F.lit("put").alias("kind"))


def by_codec(spark, sf_dir: str) -> DataFrame:
    """Totals by the public byte-level BPE (op10's codec): all documents put, toxic ones deleted, and the ledger folded."""
    import public_tokenizers

    docs, labels, version = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "byte_bpe_multi_50k"
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("1-put", count_by_codec(docs, public_tokenizers.path(f"{version}.tiktoken"), version))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_tokens", "long"))]
    rollup.commit("2-delete", labels.where("toxic = 1").select("doc_id", F.lit(version).alias("version"), *nothing, F.lit("delete").alias("kind")))
    rollup.compact()
    return rollup.totals()


def op3(spark, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents put under both versions; toxic ones deleted; low-quality ones revised to
    the words of their distinct lines; the deletes sent again, which changes nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("1-put", _counts(docs, PATTERNS))
    versions = F.explode(F.array(*[F.lit(v) for v in PATTERNS])).alias("version")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_tokens", "long"))]
    toxic = labels.where("toxic = 1").select("doc_id", versions, *nothing, F.lit("delete").alias("kind"))
    rollup.commit("2-delete", toxic)
    poor = labels.where("quality = 0 and coalesce(toxic, 0) <> 1").select("doc_id").distinct()
    lines = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    # counted before the join, so that counts are shuffled and not texts; an inner join, since a semi-join would move below
    rollup.commit("3-revise", _counts(docs, ["words-1"], lines).join(poor, "doc_id"))
    rollup.commit("2-delete", toxic)
    return rollup.totals()


OP3_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, lang, 'words-1' AS version, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents
  UNION ALL
  SELECT doc_id, source, lang, 'marks-1', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) FROM documents
), revised AS (
  SELECT doc_id, 'words-1' AS version, len(regexp_extract_all(coalesce(array_to_string(list_distinct(string_split(text, chr(10))), chr(10)), ''), '[^\x20\x09-\x0D]+')) AS n
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND coalesce(toxic, 0) <> 1)
)
SELECT c.source, c.lang, c.version, count(*) AS n_docs, CAST(sum(coalesce(r.n, c.n)) AS BIGINT) AS n_tokens
FROM counted c LEFT JOIN revised r USING (doc_id, version)
WHERE c.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
GROUP BY ALL
"""
