"""What the operators share: tables by name, hashing of ids, drawing of bounded samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.scratch import Tables, scratch_path, written  # noqa: F401
from ferrule.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexical_id(col: str):
    """A document's id as text, for hashing into folds and shards; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def drawn(df: DataFrame, key: Column, total: int, n: int) -> DataFrame:
    """About ``n`` of the ``total`` rows of ``df`` by a hash of ``key``; all, if there are no more. Never over 2 * n.

    Only a count is needed to draw; what the hash has drawn, and nothing else, is then ordered by hash, so the same rows
    come each time. Rows of equal keys are drawn together or not at all: take a key that tells rows apart.
    """
    h = F.xxhash64(key)
    return df if total <= n else df.where(F.pmod(h, F.lit(total)) < n).orderBy(h).limit(2 * n)


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the values of ``column`` (text or bytes) make ``size`` bytes or so; a longer value is alone."""
    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at)
            at = to


def pieces(texts: pa.Array, between: re.Pattern[bytes], size: int = 4 << 20) -> Iterator[tuple[int, pa.Array, bytes, bool]]:
    """(place of the first text, texts, bytes before them, whether they end here): a portion's texts, the long ones cut.

    Texts of ``size`` bytes or fewer come together and whole. A longer one comes alone, in parts of ``size`` bytes and up to
    the next match of ``between``, a pattern of single ASCII signs, which ends the part.
    """
    long, at = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > size), 0
    for k in [*long.tolist(), len(texts)]:
        if k > at:
            yield at, texts.slice(at, k - at), b"", True
        if k < len(texts):
            data, start = texts[k].as_buffer(), 0
            while start < len(data):
                cut = between.search(data, start + size)
                stop = cut.end() if cut else len(data)
                yield k, pa.array([bytes(data[start:stop])], pa.binary()).cast(pa.string()), bytes(data[max(0, start - 16) : start]), stop == len(data)
                start = stop
        at = k + 1
