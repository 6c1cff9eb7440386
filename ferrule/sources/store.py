"""A store of source facts that reads changed files only: tables in parts by hash of the path, snapshots that are committed whole.

A snapshot is one small file that names, for each table and part, the folder that holds its rows. An ingest compares content
hashes, derives the facts of new and changed files, and writes again only the parts that such files, or deleted ones, lie in; the next snapshot
points to the new folders there and to the old ones elsewhere. Until the snapshot's file is there, readers see the old state.
Snapshots are numbered and made only once: of two ingests that began from one snapshot the second starts over from the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ferrule.scratch import Tables, delete_path, names_in, put_once, read_small
from ferrule.sources.code import with_bare
from ferrule.sources.facts import fact_tables

#: Parts of every table. Choose it once for a store, so that a part's facts are at most a few hundred MB.
PARTS = 32
#: Times that an ingest starts over because another one was faster.
TRIES = 5


class FactStore:
    """Fact tables of a set of sources under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.parts = self._snapshot()[1].get("parts", parts)

    def _snapshot(self) -> tuple[int, dict]:
        """(number, content) of the newest snapshot; (0, {}) before the first ingest."""
        numbers = [int(n[:-5]) for n in names_in(self.spark, f"{self.root}/snapshots") if n.endswith(".json") and n[:-5].isdigit()]
        newest = max(numbers, default=0)
        return newest, json.loads(read_small(self.spark, f"{self.root}/snapshots/{newest:08d}.json")) if newest else {}

    def _read(self, content: dict, name: str, parts: set[str] | None = None) -> DataFrame | None:
        of = content.get("tables", {}).get(name)
        if of is None:
            return None
        schema = StructType.fromJson(of["schema"])
        folders = sorted({f for k, f in of["parts"].items() if parts is None or k in parts})
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """A fact table as of the newest snapshot. A DataFrame keeps reading the snapshot that it was made from."""
        found = self._read(self._snapshot()[1], name)
        if found is None:
            raise ValueError(f"no table {name!r} in {self.root}")
        return found

    def tables(self) -> dict[str, DataFrame]:
        """All fact tables of one snapshot, by name."""
        content = self._snapshot()[1]
        return {n: self._read(content, n) for n in content.get("tables", {}) if n != "files"}

    def ingest(self, files: DataFrame, routines: DataFrame | None = None, full: bool = False) -> dict[str, int]:
        """Bring the store to the state of ``files`` (path, text): what was new, changed, deleted, kept, and how many parts were written.

        A path that ``files`` lacks is deleted. Null texts count as empty and have no facts. Of several rows of a path one is
        taken, that of the smallest content hash. ``full`` derives all files again (after a change of the rules of extraction).
        """
        for _ in range(TRIES):
            done = self._ingest(files, routines, full)
            if done is not None:
                return done
        raise RuntimeError("other ingests were faster each time")

    def _part(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("string")

    def _ingest(self, files: DataFrame, routines: DataFrame | None, full: bool) -> dict[str, int] | None:
        number, content = self._snapshot()
        scratch = Tables(self.spark)
        text = F.coalesce("text", F.lit(""))
        now = files.where("path is not null").groupBy("path").agg(F.min(F.struct(F.sha2(text, 256).alias("hash"), text.alias("text"))).alias("f")).select("path", "f.*")
        stored = self._read(content, "files")
        stored = self.spark.createDataFrame([], "path string, hash string") if stored is None else stored
        both = now.select("path", "hash").join(stored.select("path", F.col("hash").alias("was")), "path", "full")
        same = F.lit(False) if full else F.col("hash") == F.col("was")
        state = F.when(F.col("hash").isNull(), "deleted").when(F.col("was").isNull(), "new").when(same, "kept").otherwise("changed")
        states = scratch.write("states", both.select("path", "hash", state.alias("state"), self._part().alias("part")))
        counts = {"new": 0, "changed": 0, "deleted": 0, "kept": 0, "parts": 0}
        touched = set()
        for r in states.groupBy("part", "state").count().collect():  # at most four rows a part
            counts[r["state"]] += r["count"]
            touched |= {r["part"]} if r["state"] != "kept" else set()
        counts["parts"] = len(touched)
        if not touched and number:
            scratch.drop("states")
            return counts
        fresh = states.where("state in ('new', 'changed')").select("path")
        gone = states.where("state in ('changed', 'deleted')").select("path")
        sources = scratch.write("sources", with_bare(now.join(fresh, "path", "left_semi").select("path", "text")))
        made = {"files": states.where("state in ('new', 'changed')").select("path", "hash"), **fact_tables(sources, routines)}
        batch, tables = uuid.uuid4().hex, {}
        for name, df in made.items():
            old = self._read(content, name, touched)
            if old is not None:
                df = old.join(gone, "path", "left_anti").unionByName(df)
            folder = f"data/{name}/{batch}"
            df.withColumn("part", self._part()).repartition("part").write.partitionBy("part").parquet(f"{self.root}/{folder}")
            written = {n.removeprefix("part="): f"{folder}/{n}" for n in names_in(self.spark, f"{self.root}/{folder}") if n.startswith("part=")}
            kept = {k: f for k, f in content.get("tables", {}).get(name, {"parts": {}})["parts"].items() if k not in touched}
            tables[name] = {"schema": df.schema.jsonValue(), "parts": kept | written}
        scratch.drop("states", "sources")
        snapshot = json.dumps({"parts": self.parts, "tables": tables})
        return counts if put_once(self.spark, f"{self.root}/snapshots/{number + 1:08d}.json", snapshot) else None

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the newest ``keep`` snapshots names, and older snapshots; how many folders went.

        Not to be run while an ingest is going on: its folders are named by no snapshot yet.
        """
        snapshots = [n for n in names_in(self.spark, f"{self.root}/snapshots") if n.endswith(".json")]
        used = set()
        for n in snapshots[-keep:]:
            for of in json.loads(read_small(self.spark, f"{self.root}/snapshots/{n}"))["tables"].values():
                used |= {"/".join(f.split("/")[:3]) for f in of["parts"].values()}
        gone = [f"data/{t}/{b}" for t in names_in(self.spark, f"{self.root}/data") for b in names_in(self.spark, f"{self.root}/data/{t}") if f"data/{t}/{b}" not in used]
        for path in gone + [f"snapshots/{n}" for n in snapshots[:-keep]]:
            delete_path(self.spark, f"{self.root}/{path}")
        return len(gone)
