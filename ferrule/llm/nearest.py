"""Nearest neighbours by multi-index hashing: learned rotated binary codes, cut into substrings, each indexed.

A bounded sample gives the rotation (iterative quantisation) and the Hamming radius. All rows are dealt by hash into
blocks of a fixed size, and so are the queries: a task holds one block of each. A block holds an index for each substring of its codes, and every query probes it: of two codes
within the radius one substring at least differs by no more than its share, so all values within that share are
looked up. Candidates within the radius are reranked by exact cosine in the block, which reports its nearest few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import drawn, table, written

#: Rows that the rotation is learned from, and queries that the radius is learned from, drawn by hash (never over twice as many).
SAMPLE, PROBES = 4096, 128
#: Rows of a block and queries of a query block; share of true neighbours that the radius must hold on the learning queries.
BLOCK, QUERY_BLOCK, HELD = 32768, 32768, 0.99
BITS, SUBSTRING, ROUNDS = 64, 8, 30


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v), each once: rows with an id whose vector has the table's commonest length (ties: the shorter), is finite and not zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0)).dropDuplicates(["vec_id", "v"])


def _stack(values) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in values])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotation(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions, turned so that signs lose least. Short vectors get several turns."""
    rng = np.random.default_rng(0)
    mean = x.mean(axis=0)
    c = x - mean
    d = x.shape[1]
    _, _, axes = np.linalg.svd(c, full_matrices=True)
    parts = []
    for at in range(0, bits, d):
        width = min(d, bits - at)
        base = axes[:width].T
        y = c @ base
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.sign(y @ r).T @ y)
            r = (u @ vt).T
        parts.append(base @ r)
    return mean, np.concatenate(parts, axis=1)


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Codes of BITS bits as rows of bytes."""
    return np.packbits((x - model[0]) @ model[1] > 0, axis=1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _nearest(q_id, qu, ids, xu, pairs_q, pairs_x, k: int) -> pd.DataFrame:
    """The k nearest ids of each query id among the pairs, by exact cosine; ties to smaller ids. An id's best pair counts."""
    score = np.empty(len(pairs_q))
    for at in range(0, len(pairs_q), 1 << 17):
        score[at : at + (1 << 17)] = np.einsum("ij,ij->i", qu[pairs_q[at : at + (1 << 17)]], xu[pairs_x[at : at + (1 << 17)]])
    asked, found = q_id[pairs_q], ids[pairs_x]
    order = np.lexsort([-score, found, asked])
    order = order[np.append(True, (np.diff(asked[order]) != 0) | (np.diff(found[order]) != 0))[: len(order)]]
    order = order[np.lexsort([found[order], -score[order], asked[order]])]
    q = asked[order]
    first = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    top = order[np.arange(len(q)) - start < k]
    return pd.DataFrame({"query_id": asked[top], "vec_id": found[top], "score": score[top]})


def probe(query: np.ndarray, base: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of queries and rows -> (query, row) of every pair within the radius, each once, in portions.

    Substring j may differ by share[j] bits, shares summing to radius - substrings + 1; a pair is told by the first
    substring within its share.
    """
    m = query.shape[1]
    base_share, more = divmod(max(0, radius - m + 1), m)
    share = np.full(m, base_share)
    share[:more] += 1
    near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
    q64, b64 = query.copy().view("<u8")[:, 0], base.copy().view("<u8")[:, 0]
    for j in range(m):
        order = np.argsort(base[:, j], kind="stable")
        edges = np.searchsorted(base[order, j], np.arange(257))
        for value in np.unique(query[:, j]):
            asked = np.flatnonzero(query[:, j] == value)
            hits = np.flatnonzero(near[value] <= share[j])
            found = np.concatenate([order[edges[h] : edges[h + 1]] for h in hits])
            for at in range(0, len(asked), max(1, (1 << 20) // max(1, len(found)))):
                some = asked[at : at + max(1, (1 << 20) // max(1, len(found)))]
                a, b = np.nonzero(np.bitwise_count(q64[some][:, None] ^ b64[found]) <= radius)
                a, b = some[a], found[b]
                seen = np.zeros(len(a), bool)
                for i in range(j):
                    seen |= near[query[a, i], base[b, i]] <= share[i]
                if not seen.all():
                    yield a[~seen], b[~seen]


def learn(rows: DataFrame, queries: DataFrame, k: int, n: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The rotation, from a bounded sample, and the radius: what holds the true neighbours of a few queries among all rows."""
    spark = rows.sparkSession
    sample = drawn(rows, F.struct("vec_id", "v"), n, SAMPLE).toPandas().sort_values("vec_id", kind="stable")
    model = rotation(_unit(_stack(sample["v"])))
    asked = drawn(queries, F.struct("vec_id", "v"), queries.count(), PROBES).toPandas().sort_values("vec_id", kind="stable")
    if not len(asked):
        return model, 0
    q_id, qu = asked["vec_id"].to_numpy(np.int64), _unit(_stack(asked["v"]))
    sent = spark.sparkContext.broadcast((q_id, qu, model))  # PROBES vectors

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_id, qu, model = sent.value
        qc = codes(qu, model)
        for f in frames:
            if not len(f):
                continue
            ids, xu = f["vec_id"].to_numpy(np.int64), _unit(_stack(f["v"]))
            s = qu @ xu.T
            s[q_id[:, None] == ids] = -2
            top = np.argsort(-s, axis=1)[:, : k]
            a = np.repeat(np.arange(len(q_id)), top.shape[1])
            b = top.ravel()
            out = pd.DataFrame({"q": q_id[a], "score": s[a, b], "bits": _distance(qc[a], codes(xu[b], model))})
            yield out[out["score"] > -2]

    found = rows.mapInPandas(work, "q long, score double, bits long").toPandas()  # k rows a probe and batch
    if not len(found):
        return model, BITS
    top = found.sort_values(["q", "score"], ascending=[True, False]).groupby("q").head(k)
    return model, int(np.ceil(np.quantile(top["bits"], HELD)))


def dealt(rows: DataFrame, asked: DataFrame, n: int, n_asked: int) -> tuple[DataFrame, DataFrame]:
    """Rows and queries by hash in blocks: each block of either side once for every block of the other, by (block, part)."""
    blocks, parts = -(-n // BLOCK), max(1, -(-n_asked // QUERY_BLOCK))
    place = F.xxhash64("vec_id", F.hash("v"))
    own = lambda size: F.pmod(place, F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    return rows.withColumn("block", own(blocks)).withColumn("part", every(parts)), asked.withColumn("part", own(parts)).withColumn("block", every(blocks))


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vectors`` -> (query_id, rank, vec_id, score): the nearest found of each query, among all rows but its own id.

    is_query: condition on ``vec_id``. score: cosine in double precision. Vectors that are null, zero, hold null or
    non-finite components, or aren't of the table's commonest length take no part, nor do rows without an id. Ties go to the
    smaller id. Repeated rows count once; of several vectors of an id the nearest counts. Where the radius leaves a query fewer than k neighbours of k
    there are, its rest comes from an exact scan of the blocks. Other columns are not read; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    asked = rows.where(is_query)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model, radius = learn(rows, asked, k, n)
    sent = spark.sparkContext.broadcast(model)
    left, right = dealt(rows, asked, n, asked.count())

    def block(key: tuple, base: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(query):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, xu = base["vec_id"].to_numpy(np.int64), _unit(_stack(base["v"]))
        q_id, qu = query["vec_id"].to_numpy(np.int64), _unit(_stack(query["v"]))
        bc, qc = codes(xu, sent.value), codes(qu, sent.value)
        best, held, size = [], [], 0

        def rerank() -> None:
            nonlocal held, size
            if held:
                a, b = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                own = q_id[a] != ids[b]
                best.append(_nearest(q_id, qu, ids, xu, a[own], b[own], k))
            held, size = [], 0

        for a, b in probe(qc, bc, radius):
            held.append((a, b))
            size += len(a)
            if size > 1 << 21:
                rerank()
        rerank()
        found = pd.concat(best) if best else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        found = found.sort_values("score", ascending=False).drop_duplicates(["query_id", "vec_id"])
        known, copies = np.unique(ids, return_counts=True)  # an id may have several vectors
        there = np.minimum(k, len(known) - np.isin(q_id, known))
        short = np.flatnonzero(pd.Series(q_id).map(found.groupby("query_id").size()).fillna(0).to_numpy() < there)
        for at in range(0, len(short), 64):
            some = short[at : at + 64]
            close = np.argsort(-(qu[some] @ xu.T), axis=1)[:, : (k + 1) * int(copies.max())]
            a, b = np.repeat(some, close.shape[1]), close.ravel()
            own = q_id[a] != ids[b]
            found = pd.concat([found, _nearest(q_id, qu, ids, xu, a[own], b[own], k)])
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
        return found.groupby("query_id").head(k)

    near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(block, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # vectors of an id may lie in several blocks
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # Spark cuts each partition to k a query before the shuffle
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
