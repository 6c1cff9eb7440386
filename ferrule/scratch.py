"""Written intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder (tests); on a cluster it is an error, since executors
    share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="spark-tables-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tables/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, by the file system it lies in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that appears whole or not at all; False, and nothing changed, if the path is taken.

    The text goes to a file of another name first, which then gets the path without overwriting. A writer that dies on the way
    leaves the path free.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    fs = target.getFileSystem(conf)
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """A file of the driver's own, as a whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(conf)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


@contextmanager
def _shuffle_files_go(spark: SparkSession):
    """Shuffle files go when the query that made them has ended, where this Spark knows how."""
    before = spark.conf.get(_FILES_GO, None)
    spark.conf.set(_FILES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FILES_GO) if before is None else spark.conf.set(_FILES_GO, before)


class Tables:
    """Tables written in the scratch folder, deleted by name when they are of no more use."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as a table: cuts the lineage and survives lost executors. A name written before stands for the new table."""
        self.paths[name] = path = scratch_path(self.spark, name)
        with _shuffle_files_go(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for n in names:
            delete_path(self.spark, self.paths.pop(n))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the scratch folder."""
    return Tables(df.sparkSession).write(name, df)
