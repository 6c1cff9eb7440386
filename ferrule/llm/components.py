"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import Tables


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v of one orderable type) -> (node, root), root the smallest node reachable; isolated nodes absent.

    Each round hooks every node to the smallest node in its neighbourhood, first over both directions (large star),
    then towards smaller nodes (small star); the edge table never grows and the rounds grow with the logarithm of the
    number of nodes. Minima are aggregated before the shuffle, so a node of a very large component costs no more than
    a row per task. Each round is a written table; only its count and checksum reach the driver. Null ends and loops
    are ignored; an empty table gives an empty one.
    """
    t = Tables(edges.sparkSession)
    e = t.write("edges", edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    before = _state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u > v")
            .distinct()
        )
        t.paths["last edges"] = t.paths["edges"]
        e = t.write("edges", small)
        t.drop("last edges")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
