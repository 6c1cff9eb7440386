"""Doc blocks of sources: where they stand, their tags, and the declaration that follows each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.rules.static import lines
from ferrule.scratch import written

#: Lines after the end of a block within which a declaration still belongs to it.
NEAR = 80
_OPEN = r"(?i)/\*/\s*\{[^}]*\bdoc\s*\}[ \t]*([\w:]*)"
_CLOSE = r"^[ \t]*/\*/[ \t]*$"
_TAG = r"^[ \t]*@(\w+)\b[ \t]*"
_DECLARED = r"(?i)^\s*(?:(?:(?:user|static|main)\s+)?function\s+(\w+)\s*\(|method\s+(\w+)\s*\(|ws(?:struct|service|restful|method)\s+(\w+)\b)"
#: A part of a tag's value: commas inside quotes or brackets don't end it. Possessive, so that long values need no stack.
_PART = r"((?:[^,\"'(\[{]++|\"[^\"]*\"|'[^']*'|\([^)]*\)|\[[^\]]*\]|\{[^}]*\})*+)"


def _declaration(text: Column) -> Column:
    return F.concat(*[F.regexp_extract(text, _DECLARED, k) for k in (1, 2, 3)])


def _parts(value: Column, n: int) -> list[Column]:
    """The first n - 1 parts of a value between commas and what is left; null where there is none."""
    pattern = "(?s)^" + _PART + "".join(f"(?:,{_PART}" for _ in range(n - 2)) + "(?:,(.*))?" + ")?" * (n - 2) + "$"
    fits = value.rlike(pattern)
    plain = F.split(value, ",", n)
    return [F.nullif(F.trim(F.when(fits, F.regexp_extract(value, pattern, k + 1)).otherwise(F.get(plain, F.lit(k)))), F.lit("")) for k in range(n)]


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "^([\"'])(.*)\\1$", "$2")


def _bodies(rows: DataFrame, key: str) -> DataFrame:
    """(key, line, text, at): the lines of closed blocks, the first without what opens it, and their block.

    ``at`` has line, end_line, id, unit and unit_line (the declaration within ``NEAR`` lines after the block). Windows over the lines of
    a file, down and up; nothing is joined, since Spark takes lines for as few as their files and would send a side of a join to the driver.
    """
    text = F.col("text")
    mark = F.when(text.rlike(_OPEN), "open").when(text.rlike(_CLOSE), "close").when(text.rlike(_DECLARED), "declared")
    down, up = Window.partitionBy(key).orderBy(F.desc("line")), Window.partitionBy(key).orderBy("line")
    after, before = down.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, -1)
    name = F.when(F.col("mark") == "declared", F.struct(F.col("line"), _declaration(text).alias("name")))
    marks = rows.where(F.col(key).isNotNull()).withColumn("mark", mark).withColumn("_name", name)
    marks = marks.withColumn("_next", F.last("_name", ignorenulls=True).over(after))
    marks = marks.withColumn("_end", F.last(F.when(F.col("mark") == "close", F.struct("line", F.col("_next").alias("next"))), ignorenulls=True).over(after))
    # an opening inside an open block is a part of it
    last = F.last(F.when(F.col("mark") != "declared", F.col("mark")), ignorenulls=True).over(before)
    near = F.col("_end.next.line") - F.col("_end.line") <= NEAR
    block = F.struct(
        "line", F.col("_end.line").alias("end_line"), F.nullif(F.regexp_extract("text", _OPEN, 1), F.lit("")).alias("id"), F.when(near, F.col("_end.next.name")).alias("unit"), F.when(near, F.col("_end.next.line")).alias("unit_line")
    )
    starts = F.when((F.col("mark") == "open") & F.col("_end").isNotNull() & (F.col("_last").isNull() | (F.col("_last") == "close")), block)
    marks = marks.withColumn("_last", last).withColumn("at", F.last(starts, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.when(F.col("line") == F.col("at.line"), F.regexp_replace("text", "(?i)^.*?" + _OPEN.removeprefix("(?i)"), ""))
    return marks.where(F.col("line") < F.col("at.end_line")).select(key, "line", F.coalesce(first, text).alias("text"), "at")


def doc_details(files: DataFrame, key: str = "path", prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """files (key, text) -> a row for each doc block with its tags.

    Columns: key, line, end_line, id (the name that it opens with), unit and unit_line (the next declaration, null beyond
    ``NEAR`` lines), module, summary, kind, author, since, version, description, language, deprecated, deprecated_reason,
    params (name, type, desc, optional), returns (type, desc), history (date, user, desc), examples, see, tables, todos, notes, links,
    and ``other``, the tags that are none of these. Of tags that stand once the last counts; what is missing is null, lists are
    empty. A tag's value goes on over lines. Blocks that aren't closed by a line of their own are none; null texts give none.

    The module is named in the path, else by the first prefix that begins the base name: ``prefixes`` in the order of trial.
    """
    rows = lines(files.select(key, "text"), [key]).withColumn("text", F.regexp_replace("text", "\r$", ""))
    body = _bodies(rows, key).withColumn("_tagged", F.col("text").rlike(_TAG).cast("int"))
    body = body.withColumn("_k", F.sum("_tagged").over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.regexp_replace("text", _TAG, "").alias("t")))), lambda x: x["t"]), "\n")
    tags = body.groupBy(key, "at", "_k").agg((F.max("_tagged") * F.col("_k")).alias("_n"), F.max(F.regexp_extract("text", _TAG, 1)).alias("tag"), F.regexp_replace(value, r"^\s+|\s+$", "").alias("value"))
    held = tags.groupBy(key, "at").agg(F.array_sort(F.collect_list(F.struct("_n", "tag", "value"))).alias("_tags"))

    low = lambda t: F.lower(t["tag"])
    of = lambda *names: F.transform(F.filter("_tags", lambda t: (t["_n"] > 0) & low(t).isin(*names)), lambda t: t["value"])
    one = lambda name: F.nullif(F.get(of(name), F.size(of(name)) - 1), F.lit(""))
    known = ("type", "author", "since", "version", "description", "language", "deprecated", "param", "return", "history", "example", "sample", "see", "table", "todo", "obs", "link")

    def param(v: Column) -> Column:
        name, kind, desc = _parts(v, 3)
        optional = F.coalesce(name.rlike(r"^\[\s*\w+\s*\]$"), F.lit(False))
        return F.struct(F.when(optional, F.regexp_extract(name, r"(\w+)", 1)).otherwise(name).alias("name"), kind.alias("type"), _unquoted(desc).alias("desc"), optional.alias("optional"))

    def returned(v: Column) -> Column:
        kind, desc = _parts(v, 2)
        return F.struct(kind.alias("type"), _unquoted(desc).alias("desc"))

    def change(v: Column) -> Column:
        date, user, desc = (F.coalesce(p, F.lit("")) for p in _parts(v, 3))
        return F.struct(date.alias("date"), user.alias("user"), _unquoted(desc).alias("desc"))

    base = F.upper(F.element_at(F.split(F.coalesce(F.col(key), F.lit("")), r"[/\\]"), -1))
    module = F.nullif(F.upper(F.regexp_extract(key, r"(?i)\b(SIGA\w{3,4})\b", 1)), F.lit(""))
    for prefix, name in (prefixes or {}).items():
        module = F.coalesce(module, F.when(base.startswith(prefix.upper()), F.lit(name)))
    other = F.transform(F.filter("_tags", lambda t: (t["_n"] > 0) & ~low(t).isin(*known)), lambda t: F.struct(t["tag"].alias("tag"), t["value"].alias("value")))
    return held.select(key, "at.*", "_tags").select(
        key, "line", "end_line", "id", "unit", "unit_line", module.alias("module"),
        F.nullif(F.get(F.filter("_tags", lambda t: t["_n"] == 0), F.lit(0))["value"], F.lit("")).alias("summary"), F.lower(one("type")).alias("kind"),
        *[one(n).alias(n) for n in ("author", "since", "version", "description", "language")],
        (F.size(of("deprecated")) > 0).alias("deprecated"), one("deprecated").alias("deprecated_reason"),
        F.transform(of("param"), param).alias("params"), F.transform(of("return"), returned).alias("returns"), F.transform(of("history"), change).alias("history"),
        of("example", "sample").alias("examples"), of("see").alias("see"), of("table").alias("tables"), of("todo").alias("todos"), of("obs").alias("notes"), of("link").alias("links"), other.alias("other"),
    )


def _named(name: str) -> Column:
    return (F.lower("unit") == name.lower()) | (F.lower("id") == name.lower())


def find_docs(docs: DataFrame, module: str | None = None, author: str | None = None, unit: str | None = None, file: str | None = None, deprecated: bool | None = None, kind: str | None = None, key: str = "path") -> DataFrame:
    """Doc blocks that meet all given conditions, by module, file and line; case never counts.

    An author is met by a part of their name, a unit by the declaration or by the name that the block opens with, a file by its base name.
    What is found is written before it is sorted: a sort draws a sample first, and would read all the blocks twice.
    """
    conditions = [
        (module, lambda: F.lower("module") == module.lower()),
        (author, lambda: F.lower("author").contains(author.lower())),
        (unit, lambda: _named(unit)),
        (file, lambda: F.lower(F.element_at(F.split(key, r"[/\\]"), -1)) == file.lower()),
        (deprecated, lambda: F.col("deprecated") == deprecated),
        (kind, lambda: F.lower("kind") == kind.lower()),
    ]
    for given, condition in conditions:
        if given is not None:
            docs = docs.where(condition())
    return written(docs, "docs").orderBy("module", key, "line")


def homonyms(docs: DataFrame, unit: str, key: str = "path") -> DataFrame:
    """The files that document a unit of this name."""
    return docs.where(_named(unit)).select(key).distinct().orderBy(key)


def show_doc(docs: DataFrame, unit: str, file: str | None = None, key: str = "path") -> DataFrame:
    """The first doc block of a unit, by file and line; of one file, if its base name is given. No row if there is none."""
    return find_docs(docs, unit=unit, file=file, key=key).orderBy(key, "line").limit(1)
