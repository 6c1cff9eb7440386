"""Configuration files: sections, keys and notes from lines, by windows over each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.rules.static import lines

_SECTION = r"^\s*([;#]?)\s*\[([^\]]+)\]"
_KEY = r"^\s*([A-Za-z0-9_./ -]+?)\s*=(.*)$"
_COMMENT = r"^\s*[;#]"


def parse(files: DataFrame, key: str = "path") -> DataFrame:
    """files (key, text) -> (key, section, line, key_name, value, note, kind).

    kind: ``key``; ``commented`` for keys of a section whose header is commented out; ``dirty`` for lines that are neither
    key, comment, header nor blank. A note is what follows ; in the value, else the comment lines right above. Keys
    before the first section have an empty section; sections that occur twice are one by name.
    """
    rows = lines(files.select(key, "text"), [key]).withColumn("text", F.regexp_replace("text", "\r$", ""))
    head = F.when(F.col("text").rlike(_SECTION), F.trim(F.regexp_extract("text", _SECTION, 2)))
    off = F.when(F.col("text").rlike(_SECTION), F.regexp_extract("text", _SECTION, 1) != "")
    w = Window.partitionBy(key).orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    comment = F.when(F.col("text").rlike(_COMMENT) & ~F.col("text").rlike(_SECTION), F.trim(F.regexp_replace("text", r"^\s*[;#]+\s*", "")))
    # comment lines in a row: those since the last line that is none
    other = F.sum(F.when(comment.isNull(), 1).otherwise(0)).over(upto)
    marked = rows.select("*", F.coalesce(F.last(head, ignorenulls=True).over(upto), F.lit("")).alias("section"), F.coalesce(F.last(off, ignorenulls=True).over(upto), F.lit(False)).alias("_off"), comment.alias("_c"), other.alias("_run"))
    above = F.array_join(F.collect_list("_c").over(Window.partitionBy(key, "_run").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), " ")
    marked = marked.withColumn("_block", above)
    marked = marked.withColumn("_above", F.when(F.lag("_c").over(w).isNotNull(), F.lag("_block").over(w)))
    is_key = F.col("text").rlike(_KEY) & F.col("_c").isNull() & head.isNull()
    kind = F.when(is_key & F.col("_off"), "commented").when(is_key, "key").when(F.col("_c").isNull() & head.isNull() & (F.trim("text") != ""), "dirty")
    value = F.regexp_extract("text", _KEY, 2)
    inline = F.nullif(F.trim(F.regexp_extract(value, r"\s;(.*)$", 1)), F.lit(""))
    return marked.select(key, "section", "line", F.when(is_key, F.regexp_extract("text", _KEY, 1)).otherwise("").alias("key_name"), F.when(is_key, F.trim(F.regexp_replace(value, r"\s;.*$", ""))).otherwise(F.trim("text")).alias("value"), F.coalesce(inline, "_above", F.lit("")).alias("note"), kind.alias("kind")).where("kind is not null")


def classify(keys: DataFrame, rules: dict[str, Column], default: str, key: str = "path") -> DataFrame:
    """The first class whose condition some key of a file meets. rules: conditions on (section, key_name, value), in order."""
    marks = [F.max(F.when(c, 1).otherwise(0)).alias(f"_{k}") for k, c in enumerate(rules.values())]
    found = keys.groupBy(key).agg(*marks)
    out = F.lit(default)
    for k, name in reversed(list(enumerate(rules))):
        out = F.when(F.col(f"_{k}") == 1, name).otherwise(out)
    return found.select(key, out.alias("class"))
