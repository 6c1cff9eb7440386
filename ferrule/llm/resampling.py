"""Target-distribution importance resampling: documents are drawn by how much more often a target holds their n-grams.

Words and n-grams are hashed into buckets; a bucket's gain is the log ratio of its smoothed shares in the target and in the
documents, a document's weight is the sum of the gains of its features, and adding a Gumbel variable to it and keeping the
highest sums draws without replacement in proportion to the weights.

Texts are read twice (to count, then to weigh) by Arrow kernels: lower-casing, splitting, flattening and dictionary encoding
of a portion at a time. An n-gram is a pair of dictionary indices, one of its first n - 1 words and one of its last, so
strings are joined and hashed once for each distinct pair of a portion. Counts leave a task as one row for each bucket. The
ranking sorts by range of the scores; no task sees more than its range.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import Tables, lexical_id, pieces, portions, table

#: What parts words, after A-Z are lower-cased: all of ASCII but digits and a-z.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = re.compile(_BETWEEN[:-1].encode())
ORDER, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Rows of a range of the ranking, about.
RANGE_ROWS = 1_000_000


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, its code, the distinct words), in order of the texts."""
    lists = pc.split_pattern_regex(texts, _BETWEEN)
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(full))
    return parents.filter(full).to_numpy(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _crc(names: pa.Array, buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(x) % buckets for x in names.cast(pa.binary()).to_pylist()], np.int64)


def features(texts: pa.Array, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text of each feature, its bucket, its number of words) for the runs of 1 to ``order`` words of a portion's texts.

    Parts of a cut text hand on their last ``order`` - 1 words, so no run is lost or counted twice.
    """
    tail: tuple[int, pa.Array | None] = (-1, None)
    for base, part, _, _ in pieces(pc.ascii_lower(texts), _END):
        parents, codes, names = _words(part)
        parents, carried = parents + base, 0
        if order > 1 and tail[0] == base and tail[1] is not None:
            again = pc.dictionary_encode(pa.concat_arrays([tail[1], names.take(pa.array(codes))]))
            carried, codes, names = len(tail[1]), again.indices.to_numpy(zero_copy_only=False).astype(np.int64), again.dictionary
            parents = np.concatenate([np.full(carried, base, parents.dtype), parents])
        if order > 1 and len(codes):
            tail = (int(parents[-1]), names.take(pa.array(codes[parents == parents[-1]][-(order - 1) :])))
        gram, runs = codes, names
        for k in range(1, order + 1):
            if k > 1:  # a run of k words: the index of its first k - 1 and the index of its last
                same = parents[k - 1 :] == parents[: len(parents) - k + 1]
                pair = gram[: len(gram) - 1] * len(names) + codes[k - 1 :] if len(gram) > 1 else gram[:0]
                distinct, gram = np.unique(pair, return_inverse=True)
                runs = pc.binary_join_element_wise(runs.take(pa.array(distinct // len(names))), names.take(pa.array(distinct % len(names))), " ")
            else:
                same = np.ones(len(codes), bool)
            same[: max(0, carried - k + 1)] = False  # runs that lie in the words handed on were counted with them
            if len(gram):
                yield parents[: len(gram)][same], _crc(runs, buckets)[gram][same], k


def bucket_counts(texts: DataFrame, col: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall in each bucket (those without any are absent). Null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in portions(batches, 0):
            for _, at, _ in features(b.column(0), order, buckets):
                n += np.bincount(at, minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.record_batch([pa.array(held), pa.array(n[held])], names=["bucket", "n"])

    return texts.select(F.col(f"`{col}`").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths: floor(1000 * ln of the ratio of the add-one shares of target and documents)."""
    both = bucket_counts(docs, text_col, order, buckets).withColumn("of", F.lit(0)).unionByName(bucket_counts(target, text_col, order, buckets).withColumn("of", F.lit(1)))
    n = [[0] * buckets, [0] * buckets]
    for r in both.collect():  # at most two rows a bucket, whatever the input
        n[r["of"]][r["bucket"]] = r["n"]
    docs_all, target_all = (float(sum(x) + buckets) for x in n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * docs_all / ((s + 1.0) * target_all))) for s, t in zip(*n)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """id, n_words, n_features, weight of each document: the sum of the gains of its features; 0 where it has none."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = pa.array(gain)
        for b in portions(batches, 1):
            n = b.num_rows
            words, total, weight = (np.zeros(n, np.int64) for _ in range(3))
            for text, at, k in features(b.column(1), order, len(gain)):
                starts = np.flatnonzero(np.diff(text, prepend=-1))  # features come in order of their texts
                took = np.diff(np.append(starts, len(text)))
                if len(text):
                    weight[text[starts]] += np.add.reduceat(buckets.take(pa.array(at)).to_numpy(), starts)
                    total[text[starts]] += took
                    words[text[starts]] += took if k == 1 else 0
            yield pa.record_batch([b.column(0), *map(pa.array, (words, total, weight))], names=["id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(weigh, f"id {plain.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """id, n_words, n_features, weight, score, rank: every document, with a rank where it is drawn.

    Of the N documents with at least ``least_words`` words, floor(``percent`` * N / 100) are drawn, the highest scores first,
    ties to the smaller id. The score is the weight plus a Gumbel variable that the id and the seed fix, in thousandths.

    Null and empty texts, and texts without a word, have no features, weight 0 and are never drawn. A null id counts as empty
    in the hash and comes first among ties. Repeated rows each count, weigh and may be drawn; which of them has the smaller
    rank is open. Without documents the result is empty; without a target all gains measure against even shares. Other
    columns are ignored, whatever their names.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    gain = gains(docs, target, text_col, order, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), lexical_id("id")), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed(docs, gain, id_col, text_col, order).withColumn("score", F.col("weight") + gumbel)
    # written with a number a row, so that the sort below reads the same rows each time and equal keys can lie in several ranges
    scored = tables.write("weighed", scored.withColumn("row", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).count()
    drawn = percent * n // 100
    order_by = [F.col("score").desc(), F.col("id").asc(), F.col("row").asc()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS)
    ranged = scored.where(fit).repartitionByRange(parts, *order_by).withColumn("part", F.spark_partition_id())
    ranged = tables.write("ranged", ranged)
    before, starts = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # one row a range
        starts.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    reached = F.col("part") <= max((p for p, s in starts if s < drawn), default=-1)
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order_by)) + F.col("start")
    kept = ranged.where(reached).join(offsets, "part").withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    none = F.lit(None).cast("long").alias("rank")
    rest = ranged.where(~reached).select("*", none).unionByName(scored.where(~fit).select("*", F.lit(0).alias("part"), none))
    columns = ["id", "n_words", "n_features", "weight", "score", "rank"]
    return kept.select(columns).unionByName(rest.select(columns))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's words."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: crc32 of a list of bytes, by the table of its 256 remainders (a rule, not a listing): what DuckDB lacks.
CRC_TABLE = "SELECT list(r ORDER BY i) t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) r FROM range(256) x(i))"


def crc_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of a text's UTF-8 bytes; ``t`` is the column of CRC_TABLE."""
    of = f"[('0x' || hex(encode({text}))[2 * k + 1 : 2 * k + 2])::BIGINT for k in range(octet_length(encode({text})))]"
    return f"xor(list_reduce(list_prepend(4294967295, {of}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
OP11_SQL = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
doc AS (SELECT row_number() OVER () r, doc_id, text FROM documents),
dw AS MATERIALIZED (SELECT r, w, count(*) n FROM (SELECT r, {_SPLIT} w FROM doc) GROUP BY ALL),
bw AS (SELECT w, count(*) n FROM (SELECT {_SPLIT} w FROM benchmark) GROUP BY ALL),
names AS MATERIALIZED (SELECT w, {crc_sql("w")} % 10000 b FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT b, sum(n) n FROM dw JOIN names USING (w) GROUP BY b),
t AS (SELECT b, sum(n) n FROM bw JOIN names USING (w) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + 10000 FROM s)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + 10000 FROM t)::DOUBLE)))::BIGINT g
  FROM s FULL JOIN t USING (b)),
weight AS (SELECT r, sum(n)::BIGINT n, sum(n * g)::BIGINT g FROM dw JOIN names USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(weight.n, 0) n_features, coalesce(g, 0) weight,
    coalesce(g, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT score
  FROM doc LEFT JOIN weight USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) k, count(*) OVER (PARTITION BY n_features >= 20) of FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * of // 100 THEN k END AS rank FROM ranked
"""
