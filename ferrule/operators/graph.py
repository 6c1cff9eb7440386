"""Call graph, bounded breadth-first search and lineage traces over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.scratch import written


def callers(calls: DataFrame, name: str) -> DataFrame:
    """Who calls ``name``, and whether it calls itself. calls: (file, caller, line, callee)."""
    from ferrule.functions.text import stem, strip_user_prefix

    target = name.strip().upper().removeprefix("U_")
    own = strip_user_prefix(F.col("callee")) == target
    self_call = (strip_user_prefix(F.col("caller")) == target) | (F.upper(stem(F.col("file"))) == target)
    return calls.where(own).withColumn("is_self_call", self_call).orderBy("file", "line")


def callees(calls: DataFrame, name: str) -> DataFrame:
    """What ``name`` calls: a file, if it has a source extension, else a unit."""
    by_file = "." in name.rsplit("/", 1)[-1]
    return calls.where(F.upper("file" if by_file else "caller") == name.upper()).orderBy("file", "line")


def reach(edges: DataFrame, start: DataFrame, rounds: int, both_ways: bool = False) -> DataFrame:
    """Nodes within ``rounds`` steps of the start nodes, with the first level that meets each: (node, level).

    edges: (src, dst); start: (node). Each round is one join of the new nodes and one anti-join against those known, and
    is written as a table, so no round computes an earlier one again. It stops where a round meets nothing new.
    """
    hops = edges.select("src", "dst")
    if both_ways:
        hops = hops.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    known = written(start.select("node").distinct().withColumn("level", F.lit(0)), "reached")
    new = known
    for level in range(1, rounds + 1):
        step = new.join(hops, new.node == hops.src).select(F.col("dst").alias("node")).distinct()
        new = written(step.join(known.select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "reached")
        known = known.unionByName(new)
        if new.isEmpty():
            break
    return known


def trace(edges: dict[str, DataFrame], max_per_edge: int = 20, layers: dict[str, int] | None = None) -> DataFrame:
    """Rows of several edge kinds as one table, each kind's first ``max_per_edge``: (layer, edge, target, detail).

    The cap is a feature of the trace; the order within a kind is by target and detail, so it is a top-k of each frame
    before the union, never a global window.
    """
    layers = layers or {}
    parts = [df.select(F.lit(layers.get(k, 1)).alias("layer"), F.lit(k).alias("edge"), F.col("target").cast("string").alias("target"), F.col("detail").cast("string").alias("detail")).orderBy("target", "detail").limit(max_per_edge) for k, df in edges.items()]
    return reduce(DataFrame.unionByName, parts)


def entity_kind(probes: dict[str, DataFrame], fallback: str) -> DataFrame:
    """The first kind, in the given order, whose probe finds a row."""
    found = reduce(DataFrame.unionByName, [df.limit(1).select(F.lit(k).alias("p"), F.lit(kind).alias("kind")) for k, (kind, df) in enumerate(probes.items())])
    return found.agg(F.coalesce(F.min(F.struct("p", "kind"))["kind"], F.lit(fallback)).alias("kind"))


def priority_match(events: DataFrame, candidates: DataFrame, steps: list[tuple[str, list[str]]], columns: list[str], order: Column) -> DataFrame:
    """For each event the best candidate by the first key list that matches; ``match`` tells which, ``none`` if none does.

    For each step the candidates are cut to one per key first (the smallest by ``order``), so each join adds no rows.
    """
    out, match = events, F.lit("none")
    for k, (name, keys) in enumerate(steps):
        w = Window.partitionBy(*keys).orderBy(order)
        best = candidates.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])).withColumn("_k", F.row_number().over(w)).where("_k = 1")
        best = best.select(*keys, *[F.col(c).alias(f"_{k}_{c}") for c in columns], F.lit(True).alias(f"_{k}"))
        out = out.join(best, keys, "left")
    for k in reversed(range(len(steps))):
        match = F.when(F.col(f"_{k}"), steps[k][0]).otherwise(match)
    picked = [F.coalesce(*[F.when(F.col(f"_{k}"), F.col(f"_{k}_{c}")) for k in range(len(steps))]).alias(c) for c in columns]
    return out.select(*events.columns, match.alias("match"), *picked)


def impact_in_text(docs: DataFrame, field: str, severities: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Where a field occurs as a whole word; severity by the first pattern that its surroundings match, else info."""
    from ferrule.functions import text as X

    around = X.snippet(F.col(text), X.word_position(F.col(text), field), 30, 160)
    severity = F.lit("info")
    for name, pattern in reversed(severities):
        severity = F.when(F.col("snippet").rlike(pattern), name).otherwise(severity)
    return docs.where(X.word_match(F.col(text), field)).withColumn("snippet", around).withColumn("severity", severity).drop(text)


def impact_in_slots(fields: DataFrame, key: list[str], slots: list[str], field: str) -> DataFrame:
    """Rows that mention a field in any of several rule texts, and in which: one row a row, slots listed in order."""
    from ferrule.functions.text import word_match

    hits = F.array_compact(F.array(*[F.when(word_match(F.col(s), field), F.lit(s)) for s in slots]))
    return fields.select(*key, hits.alias("slots")).where(F.size("slots") > 0).withColumn("slots", F.array_join("slots", ","))
