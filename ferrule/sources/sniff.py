"""What encoding and delimiter a delimited file has, told from its first bytes in tasks; files with the same answer are read together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.files import CP1252

#: Bytes that are looked at.
HEAD = 4096
#: Delimiters, the likelier first where two are as frequent.
DELIMITERS = (",", ";", "\t", "|")
#: Spark's names of the encodings. It has none for Windows-1252, which is read as Latin-1 and mended.
CHARSETS = {"utf-8-bom": "UTF-8", "utf-8": "UTF-8", "ascii": "UTF-8", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "cp1252": "ISO-8859-1"}


def mended(df: DataFrame, encoding: str) -> DataFrame:
    """Text columns of a file that was read by CHARSETS, and their names, as what the encoding means."""
    names = [c.lstrip("\ufeff").strip().translate(dict(zip(range(0x80, 0xA0), CP1252))) if encoding == "cp1252" else c.lstrip("\ufeff").strip() for c in df.columns]
    if encoding != "cp1252":
        return df.toDF(*names)
    return df.select(*[F.translate(F.col(f"`{c}`"), "".join(map(chr, range(0x80, 0xA0))), CP1252).alias(n) for c, n in zip(df.columns, names)])


def _share(latin: Column, signs: str) -> Column:
    """How large a share of the bytes is among some; bytes are given as Latin-1 text."""
    return F.char_length(F.regexp_replace(latin, f"[^{signs}]", "")) / F.greatest(F.char_length(latin), F.lit(1))


def encoding_of_head(head: Column) -> Column:
    """The encoding by byte statistics: marks, zeros at odd or even places, validity as UTF-8 (a character cut at the end may be broken)."""
    latin = F.decode(head, "ISO-8859-1")
    whole = F.regexp_replace(latin, "[Â-ô][\u0080-¿]{0,2}$", "")
    kept = F.when(F.length(head) >= HEAD, F.substring(head, F.lit(1), F.char_length(whole))).otherwise(head)
    odd, even = F.regexp_replace(latin, r"(?s)(.)(.)", "$2"), F.regexp_replace(latin, r"(?s)(.)(.)", "$1")
    mark = F.hex(F.substring(head, 1, 3))
    wide = F.when(mark.startswith("FFFE"), "utf-16le").when(mark.startswith("FEFF"), "utf-16be").when(_share(odd, r"\x00") > 0.4, "utf-16le").when(_share(even, r"\x00") > 0.4, "utf-16be")
    narrow = F.when(mark == "EFBBBF", "utf-8-bom").when(~F.is_valid_utf8(kept.cast("string")), "cp1252").when(_share(latin, "\u0080-ÿ") > 0, "utf-8").otherwise("ascii")
    return F.coalesce(wide, narrow)


def delimiter_of_header(header: Column) -> Column:
    """The sign that stands most often outside quotes in a header line; a comma if none does."""
    bare = F.regexp_replace(header, '"[^"]*"', "")
    n = lambda d: F.char_length(bare) - F.char_length(F.replace(bare, F.lit(d), F.lit("")))
    best = F.greatest(*[F.struct(n(d).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)])
    return best["d"]


def sniffed(spark: SparkSession, *paths: str, pattern: str = "*") -> DataFrame:
    """(path, encoding, sep, header) of the files under some folders; ``encoding`` is ``spreadsheet`` for a packed one in disguise.

    Empty files give no row. A header longer than HEAD bytes is cut there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(list(paths))
    head = files.select("path", F.substring("content", 1, HEAD).alias("head"))
    encoding = F.when(F.hex(F.substring("head", 1, 4)) == "504B0304", "spreadsheet").otherwise(encoding_of_head(F.col("head")))
    named = head.withColumn("encoding", encoding)
    text = F.lit("")
    for name, charset in CHARSETS.items():
        text = F.when(F.col("encoding") == name, F.decode("head", charset) if charset.startswith("UTF") and "16" in charset else F.decode("head", "ISO-8859-1")).otherwise(text)
    # Latin-1 keeps ASCII signs apart whatever the encoding of the rest, and never fails on a character that is cut
    header = F.regexp_extract(F.regexp_replace(text, "^(﻿|ï»¿)", ""), r"^([^\r\n]*)", 1)
    return named.withColumn("header", header).select("path", "encoding", delimiter_of_header(F.col("header")).alias("sep"), "header")


def read_delimited(spark: SparkSession, *paths: str, pattern: str = "*") -> DataFrame:
    """All rows of the delimited files under some folders as text, with ``_path``; columns by name, null where a file lacks one.

    Files are sniffed in one job; those of one encoding, delimiter and header are one scan. What comes to the driver is a row a
    file, as in Spark's own file listing. Empty files have no rows; a spreadsheet in disguise is an error.
    """
    found = sniffed(spark, *paths, pattern=pattern).where("header <> '' or encoding = 'spreadsheet'").orderBy("path").collect()
    groups: dict[tuple, list[str]] = {}
    for r in found:
        if r.encoding == "spreadsheet":
            raise ValueError(f"{r.path} is a spreadsheet, not delimited text")
        groups.setdefault((r.encoding, r.sep, r.header), []).append(r.path)
    parts = []
    for (encoding, sep, _), files in groups.items():
        read = spark.read.options(header="true", sep=sep, encoding=CHARSETS[encoding], quote='"', escape='"', multiLine="true")
        parts.append(mended(read.csv(files), encoding).withColumn("_path", F.input_file_name()))
    if not parts:
        return spark.createDataFrame([], "_path string")
    return reduce(lambda a, b: a.unionByName(b, True), parts)
