"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels only.

A sentence's score is logistic in its distinct words and their beginnings (stems that take many endings); a document is toxic unless every sentence is clean, so its score is one
less the product of (1 - sentence score). Training lowers the documents' log loss through that product, and the
sentence scores then locate what offends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import drawn, lexical_id, table, written

#: Labelled rows that the model is fitted on, about half of each class, drawn by a hash of their id (never over twice as many).
TRAIN_ROWS = 8000
#: Features that the model has at most: those whose class rates differ most.
VOCABULARY = 20_000
#: A document is rejected from this score on; a sentence offends from OFFENDS on.
THRESHOLD, OFFENDS = 0.7, 0.5
#: A word is a feature if its class rates differ by so many standard errors and so many documents hold it.
WORD_Z, WORD_DOCS = 4.0, 5
#: Tasks that read the labelled rows.
TASKS = 24
ROUNDS, RATE, RIDGE = 300, 0.2, 1e-5
#: Bytes of a word's beginnings that are features besides the whole word.
STEMS = (4, 5, 6)
#: Words whose weight a worker remembers; beyond it the table starts anew.
WORDS = 200_000
#: Byte -> itself, lower-cased; ends of sentences -> newline; other ASCII signs -> space. Lengths stay.
_FOLD = bytes(
    ord("\n") if chr(b) in ".!?\n\r" else b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def sentences(data: bytes) -> list[tuple[int, list[bytes]]]:
    """(byte offset, words) of each sentence with words."""
    out, at = [], 0
    for line in data.translate(_FOLD).split(b"\n"):
        if words := line.split():
            out.append((at, words))
        at += len(line) + 1
    return out


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by a leading sign that no word has."""
    return [word, *[b"^" + word[:k] for k in STEMS if len(word) >= k]]


class _Weights(dict):
    """Word -> weight, filled as words are met."""

    def __init__(self, weights: dict[bytes, float]) -> None:
        self.of = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > WORDS:
            self.clear()
        self[word] = found = sum(self.of.get(f, 0.0) for f in features(word))
        return found


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]

    def table(self) -> _Weights:
        return _Weights(self.weights)

    def scores(self, data: bytes, table: _Weights) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Scores and byte spans of the sentences; a text without words has one empty sentence."""
        at, z, spans = 0, [], []
        for line in data.translate(_FOLD).split(b"\n"):
            if words := line.split():
                z.append(sum([table[w] for w in {*words}]))
                spans.append((at, at + len(line)))
            at += len(line) + 1
        return 1 / (1 + np.exp(-(self.bias + np.array(z or [0.0])))), spans or [(0, 0)]


def noisy_or(scores: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


def fit(vocab: list[bytes], docs: list[tuple[int, list[int], list[int]]], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """From documents as (sentences, sentence of each feature, feature), labels (0 or 1) and weights."""
    n = len(docs)
    sizes = np.array([d[0] for d in docs], np.int64)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(n), sizes)
    held = np.array([len(d[1]) for d in docs])
    sent = np.array(list(chain.from_iterable(d[1] for d in docs)), np.int64) + np.repeat(first, held)
    word = np.array(list(chain.from_iterable(d[2] for d in docs)), np.int64)
    y, total, theta = toxic.astype(float), float(weight.sum()), np.zeros(len(vocab) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, ROUNDS + 1):
        z = theta[-1] + np.bincount(sent, theta[word], len(doc))
        s = 1 / (1 + np.exp(-np.maximum(z, -500)))
        clean = np.bincount(doc, -np.logaddexp(0, z), n)  # log of the chance that no sentence offends
        p0 = np.exp(np.minimum(clean, -1e-9))
        # d loss / d clean: y = 0 wants it up; y = 1 wants it down
        g_doc = weight / total * np.where(y == 1, p0 / (1 - p0), -1.0)
        g = -g_doc[doc] * s
        grad = np.append(np.bincount(word, g[sent], len(vocab)) + RIDGE * theta[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model(float(theta[-1]), {w: float(theta[k]) for k, w in enumerate(vocab) if abs(theta[k]) > 0.05})


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) -> (feature, n0, n1): documents of each label that hold a feature, summed over a batch."""
    for b in batches:
        seen = (Counter(), Counter())
        for x, y in zip(b.column(0), b.column(1).to_pylist()):
            seen[y].update({f for w in {w for _, ws in sentences(x.as_py()) for w in ws} for f in features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.record_batch([pa.array(names, pa.binary()), *[pa.array([c[f] for f in names], pa.int64()) for c in seen]], names=["feature", "n0", "n1"])


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(lexical_id(id_col).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` labelled documents outside the held-out fold, about half of each class, weighted by class size.

    Labels other than 0 and 1, and rows without an id, are left out. Of several texts of an id one is taken, by its hash;
    without rows of both classes every text scores alike.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id"))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    each = [drawn(own.where(F.col("y") == y), F.col("id"), sizes.get(y, 0), rows // 2) for y in (0, 1)]
    picked = each[0].unionByName(each[1]).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    # the broadcast side has at most 2 * ``rows`` ids; one text an id is left before anything is dealt out
    sample = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = written(sample.select("text", "y").repartition(TASKS, F.xxhash64("text")), "labelled")
    taken = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    d0, d1 = taken.get(0, 0), taken.get(1, 0)
    if not d0 or not d1:
        return Model(4.0 if d1 else -9.0, {})  # without both classes all score alike
    p = (F.col("n0") + F.col("n1")) / (d0 + d1)
    z = F.abs(F.col("n1") / d1 - F.col("n0") / d0) / F.sqrt(p * (1 - p) * (1 / d0 + 1 / d1) + 1e-12)
    counts = sample.mapInArrow(_document_counts, "feature binary, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    chosen = counts.where((F.col("n0") + F.col("n1") >= WORD_DOCS) & (z > WORD_Z)).orderBy(F.desc(z), "feature").limit(VOCABULARY).select("feature").collect()
    vocab = sorted(bytes(r["feature"]) for r in chosen)
    sent = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(vocab)})  # at most VOCABULARY features

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            rows = []
            for x in b.column(0):
                parts = sentences(x.as_py())
                found = [(k, index[f]) for k, (_, ws) in enumerate(parts) for f in chain.from_iterable(map(features, sorted({*ws}))) if f in index]
                rows.append((max(1, len(parts)), [k for k, _ in found], [f for _, f in found]))
            yield pa.record_batch([b.column(1), pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (1, 2)]], names=["y", "n", "sent", "word"])

    found = sample.mapInArrow(hits, "y int, n long, sent array<int>, word array<int>").orderBy("y", "n", F.xxhash64("sent", "word")).collect()
    y = np.array([r["y"] for r in found])
    weight = np.array([sizes.get(0, 0) / d0, sizes.get(1, 0) / d1])[y]
    return fit(vocab, [(r["n"], r["sent"], r["word"]) for r in found], y, weight)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (id, score, n_sentences, offending): whole texts scored by words alone.

    offending: byte start, byte end and score of each sentence that reaches OFFENDS. One row per row, repeated rows
    included; a null or empty text has one empty sentence; other columns are not read; an empty table gives an empty
    result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most the words of TRAIN_ROWS documents
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.LongType()), T.StructField("offending", T.ArrayType(span))])
    arrow_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weights = m.table()
        for b in batches:
            found, n, spans = [], [], []
            for x in b.column(1):
                s, where = m.scores(x.as_py() or b"", weights)
                found.append(noisy_or(s))
                n.append(len(s))
                spans.append([{"start": where[k][0], "end": where[k][1], "score": float(s[k])} for k in np.flatnonzero(s >= OFFENDS)])
            yield pa.record_batch([b.column(0), pa.array(found, pa.float64()), pa.array(n, pa.int64()), pa.array(spans, arrow_spans)], names=["id", "score", "n_sentences", "offending"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data")).mapInArrow(work, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` less the rows that score ``threshold`` or more; all their columns, unchanged, in one pass over the texts.

    A null or empty text has one empty sentence; repeated rows all stay or all go; without labels of both classes none
    goes unless all labels are toxic; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        weights = m.table()
        for b in batches:
            yield b.filter(pa.array([noisy_or(m.scores((x.as_py() or "").encode(), weights)[0]) < threshold for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").alias("n_offending"),
    )
