"""Conflict-constrained best-fit packing of documents into bins of a fixed size.

Bins are ordered by what room they have left and carry bitmaps of the sources and duplicate clusters they hold. A piece
goes to the tightest bin with room for it; while a bin's bitmaps conflict, the search goes on to the next tightest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import table, written

#: Bytes of a bin, pieces that are packed together, pieces of one source in a bin at most.
CAPACITY, SHARD, PER_SOURCE = 16384, 16384, 2
_SCAN = 256


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, per_source: int = PER_SOURCE) -> np.ndarray:
    """Bin of each piece, in the given order; sources and clusters are codes from 0 on, cluster -1: conflicts with none."""
    n = len(size)
    bins = np.empty(n, np.int64)
    room = np.empty(n + 1, np.int64)  # room left * 2**32 + bin, ascending
    full = np.zeros((n, int(source.max(initial=0)) // 64 + 1, per_source), np.uint64)  # plane k: holds more than k of a source
    held = np.zeros((n, int(cluster.max(initial=0)) // 64 + 1), np.uint64)
    used = 0
    for k in range(n):
        sw, sb = source[k] // 64, np.uint64(1 << int(source[k] % 64))
        cw, cb = max(0, cluster[k]) // 64, np.uint64(1 << int(cluster[k] % 64) if cluster[k] >= 0 else 0)
        at, chosen = int(np.searchsorted(room[:used], int(size[k]) << 32)), -1
        while at < used:
            some = room[at : min(at + _SCAN, used)] & 0xFFFFFFFF
            fits = ((full[some, sw, per_source - 1] & sb) | (held[some, cw] & cb)) == 0
            first = int(fits.argmax())
            if fits[first]:
                at, chosen = at + first, int(some[first])
                break
            at += _SCAN
        if chosen < 0:
            chosen, left = used, capacity
            used += 1
            end = used - 1  # the ordered list is one longer after the insertion below
        else:
            left = int(room[at] >> 32)
            room[at : used - 1] = room[at + 1 : used].copy()
            end = used - 1
        key = ((left - int(size[k])) << 32) | chosen
        to = int(np.searchsorted(room[:end], key))
        room[to + 1 : end + 1] = room[to:end].copy()
        room[to] = key
        bins[k] = chosen
        for plane in range(per_source):
            if not full[chosen, sw, plane] & sb:
                full[chosen, sw, plane] |= sb
                break
        held[chosen, cw] |= cb
    return bins


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, id_col: str = "doc_id", capacity: int = CAPACITY, shard: int = SHARD, per_source: int = PER_SOURCE) -> DataFrame:
    """``docs`` -> (id, piece, start, size, bin, pos): every unit of every document placed once.

    size, source and cluster are columns of ``docs``: a whole number (null: 0), and values of any kind (null: a source of
    its own, no cluster). A document beyond ``capacity`` is cut into pieces of that size and a rest. A bin holds no two
    pieces of one cluster and at most ``per_source`` of one source; full pieces have a bin to themselves. Pieces are dealt
    by hash into shards of ``shard`` pieces or so, which bounds memory and spreads a hot source evenly; a shard is packed
    largest first, so the result depends on the rows alone, not on machines or partitions. Bin ids are shard * 2**32 + number. Repeated rows are placed as often as they stand; an empty table
    gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(size.cast("long"), F.lit(0)).alias("total"), F.coalesce(F.xxhash64(source.cast("string")), F.lit(0)).alias("source"), F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("cluster")
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / capacity).cast("long") - 1)
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity).alias("size"), "source", "cluster"
    )
    # equal pieces are counted and numbered, so that copies, rows without an id among them, spread over all shards
    pieces = written(pieces.groupBy("id", "piece", "start", "size", "source", "cluster").agg(F.count("*").alias("copies")), "pieces")
    shards = max(1, -(-(pieces.agg(F.sum("copies")).first()[0] or 0) // shard))
    each = pieces.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "cluster", "copy"), F.lit(shards)))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("piece", "start", "size", "bin", "pos")]])

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "order", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        copies = part["cluster"].map(part["cluster"].value_counts()).fillna(0)
        clusters = part["cluster"].where(copies > 1)  # one alone conflicts with none
        bins = best_fit(part["size"].to_numpy(np.int64), pd.factorize(part["source"])[0], pd.factorize(clusters)[0], capacity, per_source)
        out = part[["id", "piece", "start", "size"]].copy()
        out["bin"] = (int(key[0]) << 32) + bins
        out["pos"] = out.groupby("bin").cumcount()
        return out

    return dealt.withColumn("order", F.xxhash64("id")).groupBy("shard").applyInPandas(work, schema)


def pack_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of documents, packed by the bytes of their texts; equal texts are a duplicate cluster.

    A null text has no bytes, is in no cluster and takes a place all the same; repeated rows are placed as often as they stand and
    are a cluster; an empty table gives an empty result; other columns are not read.
    """
    return pack(docs, F.octet_length("text"), F.col("source"), F.when(F.col("text").isNotNull(), F.xxhash64("text"))).withColumnRenamed("id", "doc_id").withColumnsRenamed({"bin": "bin_id"})


def op7(spark, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
