"""The store of facts on sources that are derived from the parts, and the traces that read it."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.registry import query
from ferrule.scratch import scratch_path, scratch_root, written
from ferrule.sources.code import with_bare
from ferrule.sources.store import FactStore


#: Sources in a partition, about: what a task holds doesn't grow with their number.
SOURCES = 5_000


def partitions(t) -> int:
    """As many partitions as keep each at about ``SOURCES`` parts, a core each at least."""
    return max(t.spark.sparkContext.defaultParallelism, -(-t.part.count() // SOURCES))


def spread(t, path: Column) -> DataFrame:
    """The parts and their paths over all cores: their file is small, the texts that are made from them are not."""
    return t.part.withColumn("path", path).repartition(partitions(t), "path")


def kept(t, files: DataFrame) -> DataFrame:
    """Sources with their texts without comments, as a table: they are stripped once, whatever is read from them.

    They are dealt by path again, since a Python step forgets how its rows were: what is told line by line then stays in its partition.
    """
    return written(with_bare(files), "sources").repartition(partitions(t), "path")


def sources(t, more: str = "") -> DataFrame:
    """(path, text): a unit that calls another, locks a table and reads a parameter, by the part's size."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("User Function P"), F.col("p_partkey").cast("string"), F.lit("()\n  U_P"), size, F.lit('()\n  RecLock("SA'), (F.col("p_size") % 10).cast("string"), F.lit('", .T.)\n  x := SuperGetMV("MV_S'), size, F.lit('")\n' + more + "Return\n"))
    return spread(t, F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".prw"))).select("path", text.alias("text"))


def stored(t) -> FactStore:
    """The store of this application and folder in the scratch folder, brought up to date: the first query derives the facts, later ones find them."""
    own = hashlib.sha256(t.folder.encode()).hexdigest()[:16]
    store = FactStore(t.spark, f"{scratch_root(t.spark)}/tables/facts-{t.spark.sparkContext.applicationId}-{own}", parts=8)
    store.ingest(sources(t))
    return store


@query("""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 1000 = 1) AS gone, count(*) FILTER (p_partkey % 1000 = 2) AS late FROM part)
SELECT 'files' AS table_name, n - gone AS n_rows FROM n UNION ALL SELECT 'units', n - gone FROM n UNION ALL SELECT 'defaults', n - gone FROM n
UNION ALL SELECT 'calls', n - gone + late FROM n UNION ALL SELECT 'state_changed', late FROM n UNION ALL SELECT 'state_deleted', gone FROM n UNION ALL SELECT 'state_kept', n - gone - late FROM n UNION ALL SELECT 'state_new', 0 FROM n""")
def facts_after_change(t):
    """A second ingest after some files have changed and some have gone (SRC-03, 07, 15, 16): rows of the tables, and what was done."""
    store = FactStore(t.spark, scratch_path(t.spark, "facts"), parts=8)
    store.ingest(sources(t))
    number = F.regexp_extract("path", r"(\d+)", 1).cast("int") % 1000
    files = sources(t).where(number != 1).withColumn("text", F.when(number == 2, F.concat("text", F.lit("U_LATE()\n"))).otherwise(F.col("text")))
    done = store.ingest(files)
    found = {"files": store.table("files"), "units": store.table("units"), "defaults": store.table("defaults"), "calls": store.table("refs").where("what = 'call'")}
    rows = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in found.items()]
    states = [(f"state_{k}", n) for k, n in done.items() if k != "parts"]
    return reduce(DataFrame.unionByName, rows).unionByName(t.spark.createDataFrame(states, "table_name string, n_rows long"))
