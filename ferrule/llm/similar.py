"""Groups of texts whose word shingles have a Jaccard similarity of SIMILARITY or more, by their SimHash fingerprints.

Such texts differ by up to 20 bits of 64 and more, a radius at which bands of a fingerprint part nothing. So cells come
from minima of the shingles' hashes (BANDS bands of ROWS minima; a pair at 0.8 shares no cell with a chance of 3 in a
million), fingerprints are compared within the cells, by tiles (``simhash``), and each pair within RADIUS bits (a pair at 0.8
is beyond with a chance of about 6 in a million) is confirmed by exact Jaccard.

Equal texts are one node. Each node is first compared with the smallest node of its cells, mostly the same in all; in cells
that then still hold several groups the nodes meet with their shingles, and a task reports a spanning forest of the links
between groups that it has confirmed, never the pairs. So what is shuffled stays linear in a large group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm import simhash
from ferrule.llm.common import Tables, portions
from ferrule.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Bits that fingerprints of texts at SIMILARITY differ by at most: 9.7 are expected, with a deviation of 2.9.
RADIUS = 24
BANDS, ROWS = 32, 5
#: Rows of a cell that meet in one task (of two tiles twice as many), and shingles compared at a time.
TILE, STRIPE = 1024, 4096
_SEED = 42
_RNG = np.random.default_rng(5)
_TURN = _RNG.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)
_TIMES = _RNG.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 12


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, no words give none."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[shingle - 1 :] or ends[-1:]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], _SEED) for a, b in zip(starts, ends)), np.uint64, len(ends)))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D only


def bands(hashes: np.ndarray) -> np.ndarray:
    """A cell for each band: a hash of the band's number and its minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        low = np.minimum(low, ((hashes[at : at + _BLOCK, None] ^ _TURN) * _TIMES).min(axis=0))
    cell = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        cell = (cell + low[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        cell ^= cell >> np.uint64(31)
    return cell.view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: the bits set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        counts += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def mark(id_col: str, text_col: str) -> list[Column]:
    """What a row is told by: its id and two hashes of its text."""
    text = F.col(text_col).cast("string")
    return [F.col(id_col), F.xxhash64(text), F.hash(text)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> their words' 128-bit hash, number of shingles, fingerprint and cells."""
    for b in portions(batches, 3):
        keys, sizes, cells, fps = [], [], [], []
        for text in b.column(3).cast(pa.large_binary()):
            words = _words(text.as_py())
            h = shingles(words)
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sizes.append(len(h))
            fps.append(fingerprint(h))
            cells.append(bands(h) if len(h) else np.empty(0, np.int64))
        yield pa.record_batch([*b.columns[:3], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], names=["id", "h1", "h2", "key", "size", "fp", "cells"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches, 0):
        words = [_words(text.as_py()) for text in b.column(0).cast(pa.large_binary())]
        yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()), pa.array([shingles(w).tobytes() for w in words], pa.binary())], names=["key", "hashes"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        near = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.unique(np.concatenate([x, y]))
            # the intersection over the union, in whole numbers
            near.append(10 * (len(x) + len(y) - len(both)) >= round(10 * SIMILARITY) * len(both))
        yield pa.record_batch(b.columns[:2], names=["u", "v"]).filter(pa.array(near, pa.bool_()))


def alike(hashes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets a[k] and b[k] have SIMILARITY: their intersections by bit counts over the values that several sets hold."""
    size = np.array([len(h) for h in hashes])
    values = np.concatenate(hashes)
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[place] > 1
    row, column = np.repeat(np.arange(len(hashes)), size)[shared], number[place[shared]]
    both = np.zeros(len(a), np.int64)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, STRIPE):  # a stripe of the values at a time
        own = (column >= at) & (column < at + STRIPE)
        flags = np.zeros((len(hashes), STRIPE), bool)
        flags[row[own], column[own] - at] = True
        bits = np.packbits(flags, axis=1).view(np.uint64)
        for k in range(0, len(a), 1 << 16):
            x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            both[k : k + (1 << 16)] += np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
    # the intersection over the union, in whole numbers
    return 10 * both >= round(10 * SIMILARITY) * (size[a] + size[b] - both)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of cells -> a forest of the confirmed links between nodes of different groups."""
    for block, unit, fp, tile, lone in simhash.units(batches):
        key, root, sets = (block.column(c).combine_chunks() for c in ("key", "root", "hashes"))
        group = root.dictionary_encode().indices.to_numpy()
        size = block.column("size").to_numpy()
        found = []
        for a, b in simhash.pairs(unit, fp, tile, lone, RADIUS):
            low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            fit = (group[a] != group[b]) & (10 * low >= round(10 * SIMILARITY) * high)
            if fit.any():
                found.append((a[fit], b[fit]))
        if not found:
            continue
        a, b = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(unit[a], kind="stable")
        a, b = a[order], b[order]
        edges = [0, *(np.flatnonzero(np.diff(unit[a])) + 1).tolist(), len(a)]
        for s, e in zip(edges, edges[1:]):
            rows, ends = np.unique(np.concatenate([a[s:e], b[s:e]]), return_inverse=True)
            x, y = ends[: e - s], ends[e - s :]
            near = alike([np.frombuffer(sets[k].as_py(), np.uint64) for k in rows.tolist()], x, y)
            if near.any():
                u, v = simhash._forest(rows[x[near]], rows[y[near]])
                yield pa.record_batch([key.take(pa.array(u)), key.take(pa.array(v))], names=["u", "v"])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all with ids -> (mark, component): one row per row; component names those linked by such similarity.

    mark: (id, h1, h2), the row's id and hashes of its text; component: the smallest mark of its group. Case (A-Z) and
    kind of white space don't count. Null texts and texts without words are equal; repeated rows give repeated results;
    an empty table gives an empty result.
    """
    t = Tables(docs.sparkSession)
    source = docs.select(*[c.alias(n) for c, n in zip(mark(f"`{id_col}`", f"`{text_col}`"), ("id", "h1", "h2"))], F.col(f"`{text_col}`").cast("string").alias("text"))
    columns = {"key": T.BinaryType(), "size": T.LongType(), "fp": T.LongType(), "cells": T.ArrayType(T.LongType())}
    schema = T.StructType([*source.schema.fields[:3], *[T.StructField(c, kind) for c, kind in columns.items()]])
    keyed = t.write("keyed", source.mapInArrow(_keys, schema).select(F.struct("id", "h1", "h2").alias("mark"), *columns))
    nodes = t.write("nodes", keyed.groupBy("key").agg(F.min("mark").alias("low"), *[F.first(c).alias(c) for c in ("size", "fp", "cells")]))
    spread = nodes.select("key", "size", "fp", F.explode("cells").alias("cell"))
    lead = F.min(F.struct("key", "size", "fp")).alias("lead")
    leads = t.write("leads", spread.groupBy("cell").agg(lead, F.count("*").alias("n")).where("n > 1").select("cell", "lead"))
    crowd = t.write("crowd", spread.join(leads, "cell").select("cell", "key", "size", "fp", "lead"))
    t.drop("leads")
    # texts of nodes that share a cell; equal texts by one of their rows
    asked = crowd.select("key").distinct().join(nodes, "key").select("low.*")
    owned = source.join(asked, ["id", "h1", "h2"], "left_semi").select("text")
    sets = t.write("sets", owned.mapInArrow(_sets, "key binary, hashes binary").dropDuplicates(["key"]))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        of_u = sets.select(F.col("key").alias("u"), F.col("hashes").alias("x"))
        of_v = sets.select(F.col("key").alias("v"), F.col("hashes").alias("y"))
        own = pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        return t.write(name, own.join(of_u, "u").join(of_v, "v").select("u", "v", "x", "y").mapInArrow(_confirm, "u binary, v binary"))

    def led(rows: DataFrame) -> DataFrame:
        """Pairs of each node and the lead of its cell that may be similar."""
        small, large = F.least("size", "lead.size"), F.greatest("size", "lead.size")
        fit = (F.col("key") != F.col("lead.key")) & (small * 10 >= large * round(10 * SIMILARITY)) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp"))) <= RADIUS)
        return rows.where(fit).select(F.col("lead.key").alias("x"), F.col("key").alias("y"))

    def mixed(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Rows (cell, key, size, fp) with their groups by the links, in cells of three nodes or more that hold several groups."""
        rooted = rows.select("cell", "key", "size", "fp").join(components(links).withColumnRenamed("node", "key"), "key", "left")
        known = t.write(f"{name}_known", rooted.withColumn("root", F.coalesce("root", "key")))
        several = known.groupBy("cell").agg((F.min("root") != F.max("root")).alias("mixed"), F.count("*").alias("n")).where("mixed and n > 2").select("cell")
        out = t.write(name, known.join(several, "cell", "left_semi"))
        t.drop(f"{name}_known")
        return out

    first = confirmed(led(crowd), "first")
    some = mixed(crowd, first, "some").select("cell", "fp", "key", "size", "root")
    rest = t.write("rest", simhash.dealt(t, some, RADIUS, TILE, sets).mapInArrow(_near, "u binary, v binary"))
    stars = t.write("stars", components(first.unionByName(rest)).withColumnRenamed("node", "key"))
    lows = stars.join(nodes.select("key", "low"), "key")
    named = stars.join(lows.groupBy("root").agg(F.min("low").alias("component")), "root").select("key", "component")
    whole = t.write("whole", nodes.select("key", "low").join(named, "key", "left").select("key", F.coalesce("component", "low").alias("component")))
    t.drop("crowd", "sets", "some")
    return keyed.select("mark", "key").join(whole, "key").select("mark", "component")
