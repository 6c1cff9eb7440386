"""SimHash near-duplicates: fingerprints, tiled exact comparison, linked groups.

Every pair of fingerprints within the radius is found. 64 bits are cut into ``radius + AGREE`` bands, so two such
fingerprints agree in AGREE bands at least; rows that share the values of so many bands form a cell. A cell is compared
whole, ordered by population count, and rows whose population counts differ beyond the radius are never compared. A cell
above ``TILE`` rows is cut into tiles by population count and hash, and only the tile pairs whose counts lie within
the radius are dealt out, each to one task. Comparison is numpy exclusive-or and bit counts. A task reports a spanning
forest of the links it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import Tables, table
from ferrule.llm.components import components

RADIUS = 4
SHINGLE = 4
#: Bands that the rows of a cell share: cells of two of six bands hold about N / 2**21 unrelated fingerprints.
AGREE = 2
SEED = 42
#: Rows of a cell, or of a tile of a larger cell, that one task compares at a time.
TILE = 2048
#: Links held by a task before it reduces them to a forest.
LINKS_HELD = 2_000_000
_BLOCK = 1 << 16


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's UTF-8 bytes as an unsigned integer; no words: zero."""
    words = data.lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[shingle - 1 :] or ends[-1:]
    n, h64 = len(ends), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = [h64(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the fingerprint's bits as a signed long. A null text counts as empty."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between values -> one link from each value to the smallest value it reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while True:
            deeper = low[low]
            if (deeper == low).all():
                break
            low = deeper
        low = low[root]
        if (low == root).all():
            break
        root = low
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def pairs(unit: np.ndarray, fp: np.ndarray, tile: np.ndarray, lone: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows ordered by unit, then population count -> portions of the row pairs of a unit within the radius.

    In a unit that pairs two different tiles (not ``lone``) only rows of different tiles are compared.
    """
    n = len(fp)
    count = np.bitwise_count(fp).astype(np.int16)
    last = np.flatnonzero(np.append(unit[1:] != unit[:-1], True))
    end = last[np.searchsorted(last, np.arange(n))]
    active, d = np.arange(n), 0
    while len(active):
        d += 1
        active = active[active + d <= end[active]]
        active = active[count[active + d] - count[active] <= radius]
        other = active + d
        hit = np.bitwise_count(fp[active] ^ fp[other]) <= radius
        hit &= lone[active] | (tile[active] != tile[other])
        if hit.any():
            yield active[hit], other[hit]


def dealt(t: Tables, rows: DataFrame, radius: int, tile: int, load: DataFrame | None = None) -> DataFrame:
    """``rows`` (cell, fp, more) -> units of comparison (cell, lo, hi), each whole in one task: cells, or tile pairs of crowded cells.

    A tile holds a range of population counts, a quarter of the radius wide, or a part of it, and is numbered
    range * 2**20 + part; each row of a crowded cell goes to every tile pair within the radius of its own.
    ``load`` (key, more) is joined to what is dealt out.
    """
    more = [c for c in rows.columns if c not in ("cell", "fp")]
    width = max(1, radius // 4)
    rows = rows.withColumn("pc", F.bit_count("fp"))
    ranged = rows.withColumn("range", F.floor(F.col("pc") / width).cast("int"))
    # written tables: Spark knows their sizes, and broadcasts them only where they are small
    crowded = t.write("crowded", rows.groupBy("cell").count().where(F.col("count") > tile).select("cell"))
    hot = t.write("hot", ranged.join(crowded, "cell", "left_semi").groupBy("cell", "range").agg(F.ceil(F.count("*") / tile).cast("int").alias("k")))
    plain = rows.join(crowded, "cell", "left_anti").select("cell", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("tile"), "pc", "fp", *more)
    own = ranged.join(hot, ["cell", "range"]).withColumn("tile", (F.col("range") * (1 << 20) + F.pmod(F.xxhash64("fp", *more), F.col("k"))).cast("int"))
    other = hot.select("cell", F.col("range").alias("range2"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    other = other.select("cell", "range2", (F.col("range2") * (1 << 20) + F.col("part")).cast("int").alias("tile2"))
    split = (
        own.drop("k")
        .join(other, "cell")
        .where(F.abs(F.col("range2") - F.col("range")) <= (max(1, radius) - 1) // width + 1)
        .select("cell", F.least("tile", "tile2").alias("lo"), F.greatest("tile", "tile2").alias("hi"), "tile", "pc", "fp", *more)
    )
    whole = plain.unionByName(split)
    return (whole if load is None else whole.join(load, "key")).repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "pc")


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows as dealt -> whole units: the rows, and what ``pairs`` takes of them."""
    rest = None
    for b in batches:
        block = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        keys = [block.column(c).to_numpy() for c in ("cell", "lo", "hi")]
        new = np.flatnonzero(sum(np.diff(k) != 0 for k in keys)) + 1
        rest = block.slice(int(new[-1]) if len(new) else 0)
        if len(new):
            yield _unit(block.slice(0, int(new[-1])))
    if rest is not None and rest.num_rows:
        yield _unit(rest)


def _unit(block: pa.Table) -> tuple:
    cell, lo, hi = (block.column(c).to_numpy() for c in ("cell", "lo", "hi"))
    unit = np.cumsum(np.append(0, (cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    return block, unit, block.column("fp").to_numpy().astype(np.int64).view(np.uint64), block.column("tile").to_numpy(), lo == hi


def cells(radius: int, agree: int = AGREE):
    """All cells of a fingerprint column ``fp``: the values of each choice of ``agree`` of ``radius + agree`` bands."""
    bands = radius + agree
    edges = [64 * k // bands for k in range(bands + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(bands), agree)):
        value = F.lit(number).cast("long")
        for k in chosen:
            width = edges[k + 1] - edges[k]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned("fp", edges[k]).bitwiseAND((1 << width) - 1))
        out.append(value)
    return F.array(*out)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, agree: int = AGREE) -> DataFrame:
    """``distinct`` (fp: distinct signed longs) -> (u, v): links that connect all that lie within ``radius`` bits.

    An empty table gives none; null fingerprints aren't expected.
    """
    t = Tables(distinct.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit, fp, own, lone in units(batches):
            us, vs, held = [], [], 0
            for a, b in pairs(unit, fp, own, lone, radius):
                us.append(fp[a])
                vs.append(fp[b])
                held += len(a)
                if held > LINKS_HELD:
                    u, v = _forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], 0
            if us:
                u, v = _forest(np.concatenate(us), np.concatenate(vs))
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    rows = distinct.select(F.explode(cells(radius, agree)).alias("cell"), "fp")
    return dealt(t, rows, radius, tile).mapInArrow(work, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``docs`` -> (id, fp, component): one row per row of ``docs``.

    fp: SimHash as a signed long; component: the smallest id of the group reachable by links of ``radius`` bits or
    fewer, null only where every id of the group is null. Null texts and texts without words have fingerprint zero and
    link like any other; repeated rows give repeated results; other columns, whatever their names, are not read; an
    empty table gives an empty result.
    """
    t = Tables(docs.sparkSession)
    fps = t.write("fingerprints", fingerprints(docs, id_col, text_col, shingle))
    distinct = t.write("distinct", fps.groupBy("fp").agg(F.min("id").alias("low")))
    stars = t.write("stars", components(links(distinct.select("fp"), radius, tile)).select(F.col("node").alias("fp"), "root"))
    linked = stars.join(distinct, "fp")
    groups = stars.join(linked.groupBy("root").agg(F.min("low").alias("component")), "root").select("fp", "component")
    whole = distinct.join(groups, "fp", "left").select("fp", F.coalesce("component", "low").alias("component"))
    # a table, so that the join below is of two plain scans: AQE can then split the rows of a very common fingerprint
    whole = t.write("whole", whole)
    t.drop("distinct", "stars")
    return fps.join(whole, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less near-duplicates: of each group the document with the smallest id stays, all its columns unchanged.

    Near-duplicates are texts whose 5-word shingles have a Jaccard similarity of 0.8 or more: their SimHash fingerprints
    are compared by tiles, and what lies within that similarity's radius is confirmed pair by pair (``similar``). A group
    is what such pairs link. Of several texts of the smallest id the one with the smallest hash stays; a text that is in
    no group stays whatever its id. Repeated rows of one id and text count once. Documents without an id can't be named
    as duplicates; they stay. An empty table gives an empty one.
    """
    from ferrule.llm import similar

    own = docs.where(F.col(f"`{id_col}`").isNotNull())
    kept = similar.groups(own, id_col, text_col).groupBy("component").agg(F.min("mark").alias("mark")).select("mark.*")
    taken = {c.lower() for c in docs.columns}
    names = [next(n for n in (c + "_" * k for k in range(99)) if n.lower() not in taken) for c in ("id1", "h1", "h2")]
    marked = own.select("*", *[c.alias(n) for c, n in zip(similar.mark(f"`{id_col}`", f"`{text_col}`"), names)])
    named = marked.join(kept.toDF(*names), names, "left_semi").dropDuplicates(names)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return named.select(*columns).unionByName(docs.where(F.col(f"`{id_col}`").isNull()).select(*columns))


def op4(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
