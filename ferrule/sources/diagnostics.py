"""Compiler output as diagnostics: the first pattern that a line fits tells severity, file, place, code and message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import CONFIG_SECRETS, redact

#: Shapes of output lines in the order of trial, with what each group holds and the severity where no group tells it.
#: The file of a missing include is as short as it can be, so that a line number behind it counts as one.
SHAPES = (
    (r"^([^\s()]+)\((\d+)(?:,(\d+))?\)\s+(error|warning|info):\s*(.+)$", ("file", "line", "column", "severity", "message"), None),
    (r"^([^\s()]+)\((\d+)(?:,(\d+))?\)\s+(erro|aviso|info):\s*(.+)$", ("file", "line", "column", "severity", "message"), None),
    (r"^Erro\s+ao\s+compilar\s+(\S+):\s*linha\s+(\d+)\s*-\s*(.+)$", ("file", "line", "message"), "error"),
    (r"^Aviso\s+em\s+(\S+):\s*linha\s+(\d+)\s*-\s*(.+)$", ("file", "line", "message"), "warning"),
    (r"^Include\s+['\"]([^'\"]+)['\"]\s+not\s+found\s+in\s+(\S+?)(?::(\d+))?$", ("message", "file", "line"), "error"),
    (r"^([Aa][Pp][Pp][Rr][Ee]41(?:\.[Pp][Rr][Ww])?)\((\d+)\)\s+Error\s+(C\d+)\s+(.+)$", ("file", "line", "code", "message"), "error"),
)
#: Lines of the compiler's own log, and severities in the other language.
NOISE = (r"connection_manager\.cc.*has no valid content after precompiled", r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+\(\s*\d")
SEVERITIES = {"erro": "error", "aviso": "warning"}


def _read(text: Column, shape: tuple[str, Sequence[str], str | None]) -> Column:
    pattern, names, severity = shape
    part = lambda n: F.regexp_extract(text, pattern, names.index(n) + 1) if n in names else F.lit("")
    number = lambda n: F.coalesce(part(n).try_cast("long"), F.lit(0))
    low = F.lower(part("severity"))
    told = F.coalesce(*[F.when(low == k, v) for k, v in SEVERITIES.items()], low)
    return F.struct((F.lit(severity) if severity else told).alias("severity"), part("file").alias("file"), number("line").alias("at_line"), number("column").alias("at_column"), part("code").alias("code"), part("message").alias("message"))


def diagnostics(output: DataFrame, requested: DataFrame | None = None, shapes: Sequence = SHAPES, key: str = "path") -> DataFrame:
    """output (key, line, text) -> (key, line, severity, file, at_line, at_column, code, message, raw, matched): a row a line.

    Blank lines and the compiler's own log give none. A line of no known shape stays, as ``unknown``, with its whole text. A file is
    one of ``requested`` (path) by its path or else by its base name regardless of case, and gets that path, the smallest of several; if it is
    none of them ``matched`` is false. Without ``requested`` all are matched. Secrets are redacted in messages and raw lines.
    """
    text = F.regexp_replace("text", "\r$", "")
    noise = F.lit(False)
    for p in NOISE:
        noise |= text.rlike(p)
    unknown = F.struct(F.lit("unknown").alias("severity"), F.lit("").alias("file"), F.lit(0).cast("long").alias("at_line"), F.lit(0).cast("long").alias("at_column"), F.lit("").alias("code"), F.trim(text).alias("message"))
    found = F.coalesce(*[F.when(text.rlike(s[0]), _read(text, s)) for s in shapes], unknown)
    rows = output.where((F.trim(text) != "") & ~noise).select(key, "line", found.alias("d"), text.alias("raw")).select(key, "line", "d.*", "raw")
    rows = rows.withColumns({"message": redact(F.col("message"), CONFIG_SECRETS), "raw": redact(F.col("raw"), CONFIG_SECRETS)})
    if requested is None:
        return rows.withColumn("matched", F.lit(True))
    base = lambda c: F.lower(F.element_at(F.split(c, r"[/\\]"), -1))
    exact = requested.select(F.col("path").alias("file"), F.lit(True).alias("_exact")).distinct()
    by_name = requested.groupBy(base("path").alias("_base")).agg(F.min("path").alias("_named"))
    both = rows.withColumn("_base", base("file")).join(exact, "file", "left").join(by_name, "_base", "left")
    file = F.when(F.col("_exact"), F.col("file")).otherwise(F.coalesce("_named", "file"))
    matched = (F.col("file") == "") | F.coalesce("_exact", F.lit(False)) | F.col("_named").isNotNull()
    return both.select(key, "line", "severity", file.alias("file"), "at_line", "at_column", "code", "message", "raw", matched.alias("matched"))
