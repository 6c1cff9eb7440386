"""Language-model scores by prediction by partial matching over bytes: a context trie, escapes and symbol exclusion.

The trie is a table. A node is a context of 0 to ORDER bytes; its parent is the context without its oldest byte, and its rows
are the bytes seen after it with their counts. Every position of a training text is one gram (its context and its byte, packed
in a long), so the rows of all shorter contexts are sums over the rows of the longest.

A byte's probability is read from the longest context that was seen. Where the byte was not seen there, an escape (as likely as
the context had distinct bytes, method C) leads to the parent, and the bytes of the child no longer count in it. The bytes after a
context are among those after its parent, so what is excluded is one sum a node. Probabilities are therefore worked out
for distinct grams, level by level, by joins and sums whose groups have at most 256 rows; texts only look them up.

The grams that stand most often are sent to the tasks that read the texts (at most LOCAL of them), the others meet their
probabilities by a join. The same holds for the words of the base score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ferrule.llm.common import Tables, lexical_id, pieces, portions, table
from ferrule.llm.grams import codes as _codes
from ferrule.llm.grams import least_count as _frequent
from ferrule.llm.grams import pairs as _pairs

#: Bytes of the longest context (at most 6, for a gram is a long).
ORDER = 5
#: Grams and words, at most, that are looked up where the texts are read; the rest is joined.
LOCAL_GRAMS, LOCAL_WORDS = 1 << 20, 1 << 18
FOLDS, HELD = 7, 2
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(part: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, its code, the distinct words)."""
    lists = pc.ascii_split_whitespace(part)
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(full))
    return parents.filter(full).to_numpy(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, ""))


def _counted(order: int):
    """(text, held) -> gram or word, and how often it stands in training texts and in the others; the empty word is the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 0):
            for held in (False, True):
                texts = _lowered(b.column(0).filter(pc.equal(b.column(1), held)))
                if not len(texts):
                    continue
                found = [(pa.array([""]), np.array([len(texts)]))]
                for _, part, lead, ends in pieces(texts, _SPACE):
                    grams, n = np.unique(_codes(part, lead, ends, order)[1], return_counts=True)
                    yield _count_rows(pa.array(grams), None, n, held)
                    _, codes, names = _words(part)
                    found.append((names, np.bincount(codes, minlength=len(names))))
                for names, n in found:
                    yield _count_rows(None, names, n, held)

    return count


def _count_rows(grams: pa.Array | None, words: pa.Array | None, n: np.ndarray, held: bool) -> pa.RecordBatch:
    rows, none = len(n), pa.array(np.zeros(len(n), np.int64))
    n = pa.array(n.astype(np.int64))
    return pa.record_batch(
        [pa.nulls(rows, pa.int64()) if grams is None else grams, pa.nulls(rows, pa.string()) if words is None else words, none if held else n, n if held else none],
        names=["gram", "word", "n", "n_held"],
    )


def probabilities(grams: DataFrame, order: int, tables: Tables) -> DataFrame:
    """gram, n_all, log_p (base 10) from gram, n (training count, 0 allowed) and n_all; the training counts make the trie."""
    levels = {order: tables.write("level", grams)}
    for k in range(order - 1, -1, -1):  # the counts of a shorter context are sums over the longer ones
        shorter = levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        levels[k] = tables.write(f"level{k}", shorter)
    done = None
    for k in range(order + 1):
        level, after = levels[k], Window.partitionBy(F.shiftright("gram", 8))
        if done is None:
            level = level.withColumns({"up_n": F.lit(0), "up_total": F.lit(0), "up_kinds": F.lit(256), "up_left": F.lit(0.0), "up_fresh": F.lit(-8 * np.log10(2))})
        else:
            up = done.select(F.col("gram").alias("up"), F.col("n").alias("up_n"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"), F.col("left").alias("up_left"), F.col("fresh").alias("up_fresh"))
            level = level.withColumn("up", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(up, "up").drop("up")
        seen = F.col("n") > 0
        level = level.withColumns(
            {"total": F.sum("n").over(after), "kinds": F.sum(seen.cast("long")).over(after), "out": F.sum(F.when(seen, F.col("up_n")).otherwise(0)).over(after)}
        )
        new = F.col("up_kinds") - F.col("kinds")  # bytes of the parent that this context did not have
        if done is None:  # below the empty context all bytes that it did not have are alike
            left = -F.log10(new)
        else:
            rest = F.col("up_total") - F.col("out") + new
            left = F.when(F.col("up_n") > 0, F.log10(F.col("up_n") / rest)).otherwise(F.when(new > 0, F.log10(new / rest)).otherwise(0.0) + F.col("up_left"))
        whole = F.col("total") + F.col("kinds")
        fresh = F.when(F.col("total") == 0, F.col("up_fresh")).when(seen, F.log10(F.col("n") / whole)).otherwise(F.log10(F.col("kinds") / whole) + F.col("left"))
        level = level.withColumn("left", F.when(~seen, left).otherwise(0.0)).withColumn("fresh", fresh)
        done = level
    out = tables.write("probabilities", done.select("gram", "n_all", F.col("fresh").alias("log_p")))
    tables.drop("level", *[f"level{k}" for k in range(order)])
    return out


def _looked_up(id_type: pa.DataType, order: int, grams: pa.Array, log_p: np.ndarray, words: pa.Array, word_n: np.ndarray, total: int, kinds: int):
    """(id, text, held) -> a row for each text with what is found here, and rows for the grams and words that are not."""

    def unfound(rows: np.ndarray, times: np.ndarray, grams: np.ndarray | None = None, words: pa.Array | None = None) -> pa.RecordBatch:
        n, zero, none = len(rows), pa.array(np.zeros(len(rows), np.int64)), pa.array(np.zeros(len(rows)))
        rest = [pa.nulls(n, pa.int64()) if grams is None else pa.array(grams), pa.nulls(n, pa.string()) if words is None else words, pa.array(times)]
        return pa.record_batch([pa.array(rows), pa.nulls(n, id_type), pa.nulls(n, pa.bool_()), zero, zero, none, none, *rest], names=_NAMES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 36, 0
        base = np.log10((word_n + 1.0) / (total + 1.0 * (kinds + 1)))
        end = int(pc.fill_null(pc.index_in(pa.array([""]), value_set=words), -1)[0].as_py())
        for b in portions(batches, 1):
            n = b.num_rows
            tokens, known = np.ones(n, np.int64), np.full(n, int(end >= 0 and word_n[end] > 0), np.int64)
            score, base_score = np.zeros(n), np.full(n, base[end] if end >= 0 else 0.0)
            rows = task + done + np.arange(n)
            done += n
            if end < 0:
                yield unfound(rows, np.ones(n, np.int64), words=pa.array([""] * n))
            for at, part, lead, ends in pieces(_lowered(b.column(1)), _SPACE):
                m = len(part)
                here = slice(at, at + m)
                text, codes = _codes(part, lead, ends, order)
                found = pc.fill_null(pc.index_in(pa.array(codes), value_set=grams), -1).to_numpy()
                hit = found >= 0
                score[here] += np.bincount(text[hit], log_p[found[hit]], m)
                if not hit.all():
                    owners, rest, times = _pairs(text[~hit], codes[~hit])
                    yield unfound(rows[here][owners], times, grams=rest)
                text, codes, names = _words(part)
                tokens[here] += np.bincount(text, minlength=m)
                found = pc.fill_null(pc.index_in(names, value_set=words), -1).to_numpy()[codes] if len(names) else codes
                hit = found >= 0
                base_score[here] += np.bincount(text[hit], base[found[hit]], m)
                known[here] += np.bincount(text[hit], word_n[found[hit]] > 0, m).astype(np.int64)
                if not hit.all():
                    owners, rest, times = _pairs(text[~hit], codes[~hit])
                    yield unfound(rows[here][owners], times, words=names.take(pa.array(rest)))
            yield pa.record_batch(
                [pa.array(rows), b.column(0), b.column(2), *map(pa.array, (tokens, known, base_score, score)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=_NAMES
            )

    return look


_NAMES = ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "gram", "word", "times"]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, folds: int = FOLDS, held: int = HELD, local_grams: int = LOCAL_GRAMS, local_words: int = LOCAL_WORDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document.

    The models learn from the documents whose crc32 of the id as text does not leave ``held`` when divided by ``folds``. Texts
    are lower-cased (A-Z only). ``score`` is the base-10 log probability of the text's bytes and its end under the trie;
    ``base_score`` that of its words and its end under add-one word counts.

    A null text is empty: it has the end alone. A null id counts as the empty text in the fold. Repeated rows each count in
    training and are each returned. Without training documents every byte has probability 1/256 and every token 1. An empty
    table gives an empty result. Other columns are ignored, whatever their names. Long texts are read in parts that overlap by
    a context, so their scores are those of the whole. Sums of doubles may differ in the last digits between runs.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    plain = plain.withColumn("held_out", F.crc32(lexical_id("id").cast("binary")) % folds == held)
    counts = plain.select("text", "held_out").mapInArrow(_counted(order), "gram long, word string, n long, n_held long")
    counts = tables.write("counts", counts.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum(F.col("n") + F.col("n_held")).alias("n_all")))
    words = counts.where("word is not null").select("word", "n", "n_all")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    grams = probabilities(counts.where("gram is not null").select("gram", "n", "n_all"), order, tables)
    g = grams.where(F.col("n_all") >= _frequent(grams, local_grams)).select("gram", "log_p").toArrow()
    w = words.where(F.col("n_all") >= _frequent(words, local_words)).select("word", "n").toArrow()
    look = _looked_up(to_arrow_type(plain.schema["id"].dataType), order, g["gram"].combine_chunks(), g["log_p"].to_numpy(), w["word"].combine_chunks(), w["n"].to_numpy(), total, kinds)
    id_type = plain.schema["id"].dataType.simpleString()
    found = plain.select("id", "text", "held_out").mapInArrow(
        look, f"row long, id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, gram long, word string, times long"
    )
    found = tables.write("found", found)
    by_gram = found.where("gram is not null").select("row", "gram", "times").join(grams.select("gram", "log_p"), "gram")
    by_word = found.where("word is not null").select("row", "word", "times").join(words.select("word", "n"), "word")
    base = F.log10((F.col("n") + 1.0) / F.lit(total + 1.0 * (kinds + 1)))
    none = F.lit(0).cast("long")
    parts = [
        found.where("gram is null and word is null").drop("gram", "word", "times").withColumn("of", F.struct("id", "held_out")).drop("id", "held_out"),
        by_gram.groupBy("row").agg(F.sum(F.col("times") * F.col("log_p")).alias("score")).select("row", none.alias("n_tokens"), none.alias("n_known"), F.lit(0.0).alias("base_score"), "score"),
        by_word.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * base).alias("base_score")).select(
            "row", none.alias("n_tokens"), "n_known", "base_score", F.lit(0.0).alias("score")
        ),
    ]
    merged = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    merged = merged.groupBy("row").agg(F.first("of", True).alias("of"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return merged.select("of.id", "of.held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the trie of the documents outside the held-out fold."""
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
