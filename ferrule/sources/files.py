"""File listings and texts: filters, decoding, incremental state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.text import glob_regex

#: Folders that are never read, and endings of back-up copies.
SKIPPED_FOLDERS = (".git", "node_modules", ".venv")
BACKUPS = (".bak", ".old", ".orig", ".tmp", "~")
MOST_BYTES = 5_000_000
#: Windows-1252 characters of the bytes 80 to 9F; the five unused bytes keep their code.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, a byte order mark dropped; else Windows-1252."""
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252)
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^\ufeff", "")).otherwise(latin)


def encoding_of(content: Column) -> Column:
    text = content.cast("string")
    bom = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    return F.when(bom, "utf-8-bom").when(~F.is_valid_utf8(text), "cp1252").when(text.rlike(r"[^\x00-\x7F]"), "utf-8").otherwise("ascii")


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[/\\]", "")


def kept_files(files: DataFrame, endings: Sequence[str], ignore: Sequence[str] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files with one of the endings, in no skipped folder, no back-up, not ignored, and neither empty nor of more than ``most_bytes``.

    What the last bound leaves out is listed by ``too_large``.
    """
    low = F.lower("path")
    cond = low.rlike("(" + "|".join(e.lower().replace(".", r"\.") for e in endings) + ")$")
    cond &= ~low.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in SKIPPED_FOLDERS) + ")/")
    for b in BACKUPS:
        cond &= ~low.endswith(b)
    cond &= (F.col("length") > 0) & (F.col("length") <= most_bytes)
    for pattern in ignore:
        cond &= ~F.col("path").rlike(glob_regex(pattern))
    return files.where(cond)


def too_large(files: DataFrame, endings: Sequence[str], ignore: Sequence[str] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length) of the files that ``kept_files`` would keep but for their size."""
    return kept_files(files, endings, ignore, (1 << 63) - 1).where(F.col("length") > most_bytes).select("path", "length")


def collisions(files: DataFrame) -> DataFrame:
    """Base names that several files share, regardless of case."""
    return files.groupBy(F.lower(basename(F.col("path"))).alias("file")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).where("n > 1")


def first_of_name(files: DataFrame) -> DataFrame:
    """One file for each base name: the one with the smallest path."""
    first = files.groupBy(F.lower(basename(F.col("path"))).alias("_f")).agg(F.min("path").alias("path"))
    return files.join(first.select("path"), "path", "left_semi")


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that the stored state lacks or holds with an older time. state: (path, mtime)."""
    known = state.select("path", F.col("mtime").alias("_stored"))
    return files.join(known, "path", "left").where(F.col("_stored").isNull() | (F.col("modificationTime") > F.col("_stored"))).drop("_stored")


def replaced(store: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """The store with all rows of the fresh files replaced."""
    return store.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def read_texts(spark: SparkSession, root: str, endings: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """(path, modificationTime, encoding, text) of a folder tree; the listing is pruned before any content is decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return kept_files(files, endings, ignore).select("path", "modificationTime", encoding_of(F.col("content")).alias("encoding"), decoded(F.col("content")).alias("text"))
