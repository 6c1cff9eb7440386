"""Look-ups that answer with one shaped table: a table's fields, a source's architecture, calls of standard routines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for the operation of a routine call.
OPERATION_WORDS = {3: ("inc", "inclusao", "include"), 4: ("alt", "alteracao", "alter"), 5: ("exc", "exclusao", "exclude", "delete")}
#: Longest text field whose listed values make it a discriminator.
DISCRIMINATOR_LENGTH = 2


def listed_values(box: Column) -> Column:
    """``1=Yes;2=No`` as ``1=Yes, 2=No``, blanks around code and label gone; empty parts are left out, parts without = stay."""
    parts = F.filter(F.transform(F.split(F.coalesce(box, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    shown = F.transform(parts, lambda p: F.when(p.contains("="), F.concat(F.trim(F.substring_index(p, "=", 1)), F.lit("="), F.trim(F.regexp_replace(p, "^[^=]*=", "")))).otherwise(p))
    return F.array_join(shown, ", ")


def table_catalog(fields: DataFrame, table: str | None = None) -> DataFrame:
    """(table_code, field, type, title, values, discriminator) of a table's fields, or of all tables.

    fields: (table_code, field, type, size, decimals, title, box). The type reads ``N(9,2)`` or ``C(1)``, and is empty where unknown.
    A discriminator is a text field of at most two characters with listed values. Nulls count as empty or 0.
    """
    own = fields if table is None else fields.where(F.col("table_code") == table.upper())
    kind, size, decimals = F.coalesce("type", F.lit("")), F.coalesce("size", F.lit(0)).cast("string"), F.coalesce("decimals", F.lit(0))
    shown = F.when(kind == "", "").when(decimals != 0, F.concat(kind, F.lit("("), size, F.lit(","), decimals.cast("string"), F.lit(")"))).otherwise(F.concat(kind, F.lit("("), size, F.lit(")")))
    values = listed_values(F.col("box"))
    return own.select("table_code", "field", shown.alias("type"), F.coalesce("title", F.lit("")).alias("title"), values.alias("values"), ((values != "") & (kind == "C") & (F.coalesce("size", F.lit(0)) <= DISCRIMINATOR_LENGTH)).alias("discriminator"))


def find_routine_calls(calls: DataFrame, routine: str | None = None, module: str | None = None, file: str | None = None, op: str | None = None, dynamic: bool | None = None, op_dynamic: bool | None = None, key: str = "path") -> DataFrame:
    """Calls of standard routines (as of ``sources.code.routine_calls``) that meet all given conditions, by file and line.

    An operation is given by any of ``OPERATION_WORDS``; an unknown word has no rows. ``op_dynamic``: the call passes more arguments but
    no number for the operation. None of a condition means both.
    """
    code = {w: n for n, words in OPERATION_WORDS.items() for w in words}.get(op.lower(), -1) if op is not None else None
    conditions = [
        (routine, lambda: F.upper("routine") == routine.upper()),
        (module, lambda: F.upper("module") == module.upper()),
        (file, lambda: F.lower(F.element_at(F.split(key, r"[/\\]"), -1)) == file.lower()),
        (code, lambda: F.col("op_code") == code),
        (dynamic, lambda: F.col("dynamic") == dynamic),
        (op_dynamic, lambda: (F.col("op_code").isNull() & F.col("dynamic")) == op_dynamic),
    ]
    for given, condition in conditions:
        if given is not None:
            calls = calls.where(condition())
    return calls.orderBy(key, "line")


def architecture(files: DataFrame, kinds: DataFrame, facts: dict[str, DataFrame], entries: DataFrame, key: str = "path") -> DataFrame:
    """One row a file: what it is, what it defines, uses and includes. Each part is one aggregate a file, joined by the file.

    files: (key, text); kinds: (key, tags, source_type), as of ``rules.capabilities``; facts: the fact tables; entries: (key, unit), as of
    ``sources.code.entry_points``. ``routine_tables`` are the tables that the catalog gives for the standard routines called;
    ``via_routines`` says that such calls are there, so that the lists of tables may lack some. Lists are sorted and without
    repeats; files without a kind of fact have empty lists. The last line counts if it has text.
    """
    text = F.coalesce("text", F.lit(""))
    loc = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - text.endswith("\n").cast("int"))
    units = facts["units"].groupBy(key).agg(_sorted(F.col("name")).alias("units"), _sorted(F.when(F.col("kind") == "user_function", F.col("name"))).alias("user_units"))
    table = F.when((F.col("what") == "table") & F.upper("value").rlike("^[SZQND][A-Z][0-9A-Z]$"), F.upper("value"))
    of = lambda *modes: _sorted(F.when(F.col("kind").isin(*modes), table))
    refs = facts["refs"].where("what in ('table', 'include', 'namespace')").groupBy(key).agg(
        of("read", "alias").alias("read_tables"), of("write", "model").alias("write_tables"), of("lock").alias("lock_tables"), _sorted(F.when(F.col("what") == "include", F.col("value"))).alias("includes"), F.min(F.when(F.col("what") == "namespace", F.col("value"))).alias("namespace")
    )
    entry = entries.groupBy(key).agg(_sorted(F.col("unit")).alias("entry_points"))
    parts, lists = [units, refs, entry], ["units", "user_units", "entry_points", "read_tables", "write_tables", "lock_tables", "includes"]
    if "routine_calls" in facts:
        parts.append(facts["routine_calls"].groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tables", F.array().cast("array<string>")))))).alias("routine_tables")))
        lists.append("routine_tables")
    rows = files.select(key, loc.cast("long").alias("lines_of_code")).join(kinds.select(key, "source_type", "tags"), key, "left")
    for p in parts:
        rows = rows.join(p, key, "left")
    none = F.array().cast("array<string>")
    return rows.select(key, "source_type", "tags", "lines_of_code", "namespace", *[F.coalesce(c, none).alias(c) for c in lists], F.coalesce(F.array_contains("tags", "EXEC_AUTO_CALLER"), F.lit(False)).alias("via_routines"))


def _sorted(c: Column) -> Column:
    return F.array_sort(F.collect_set(c))
