"""Cross-table findings on the data dictionary and the source facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators.tabular import unknown
from ferrule.sources.embedded_sql import SYSTEM_COLUMNS


def _found(df: DataFrame, rule: str, severity: str, subject: str, detail: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"), F.col(detail).cast("string").alias("detail"))


def referential(fields: DataFrame, triggers: DataFrame, params: DataFrame, prompts: DataFrame, param_use: DataFrame, prompt_use: DataFrame, lookups: DataFrame, units: DataFrame, tables: DataFrame, restricted: DataFrame) -> DataFrame:
    """SX-001 to SX-011 as anti-joins and predicates: (rule_id, severity, subject, detail).

    fields: (table_code, field, validation, init, required, lookup, custom); triggers: (source, target, kind, seek); params:
    (name, custom); prompts: (grp); param_use: (name); prompt_use: (grp); lookups: (alias); units: (name); tables:
    (code, mode); restricted: (name).
    """
    up = lambda c: F.upper(F.trim(F.col(c)))
    called = fields.select("field", F.explode(F.regexp_extract_all(F.upper("validation"), F.lit(r"\bU_(\w+)\s*\("), F.lit(1))).alias("name"))
    sx1 = called.join(units.select(up("name").alias("name")).distinct(), "name", "left_anti").groupBy("field").agg(F.min("name").alias("name"))
    sx2 = triggers.select("source", up("target").alias("field")).join(fields.select(up("field").alias("field")).distinct(), "field", "left_anti")
    sx3 = params.where("custom").select(up("name").alias("name")).join(param_use.select(up("name").alias("name")).distinct(), "name", "left_anti")
    sx4 = prompts.select(up("grp").alias("grp")).distinct().join(prompt_use.select(up("grp").alias("grp")).distinct(), "grp", "left_anti")
    sx6 = fields.where(F.col("validation").rlike(r"(?i)\b(SELECT\s.+\sFROM|TCQuery|BeginSql)\b"))
    any_call = fields.select("field", F.explode(F.regexp_extract_all(F.upper("validation"), F.lit(r"\b(\w+)\s*\("), F.lit(1))).alias("name"))
    sx7 = any_call.join(restricted.select(up("name").alias("name")).distinct(), "name", "left_semi").groupBy("field").agg(F.min("name").alias("name"))
    sx8 = fields.join(tables.where("upper(mode) = 'C'").select(F.col("code").alias("table_code")), "table_code", "left_semi").where(F.col("validation").rlike(r"(?i)\bxFilial\b"))
    sx9 = fields.where("required and trim(coalesce(init, '')) = ''")
    sx10 = triggers.where("upper(kind) = 'P' and upper(coalesce(seek, '')) <> 'S'")
    used = fields.where("trim(coalesce(lookup, '')) <> ''").select("field", up("lookup").alias("alias"))
    sx11 = unknown(used, lookups.select(up("alias").alias("alias")), ["alias"])
    parts = [
        _found(sx1, "SX-001", "warning", "field", "name"), _found(sx2, "SX-002", "error", "source", "field"), _found(sx3, "SX-003", "warning", "name", "name"), _found(sx4, "SX-004", "warning", "grp", "grp"),
        _found(sx6, "SX-006", "warning", "field", "validation"), _found(sx7, "SX-007", "critical", "field", "name"), _found(sx8, "SX-008", "warning", "field", "validation"), _found(sx9, "SX-009", "warning", "field", "table_code"),
        _found(sx10, "SX-010", "error", "source", "target"), _found(sx11, "SX-011", "error", "field", "alias"),
    ]
    return reduce(DataFrame.unionByName, parts)


def unreferenced(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """SX-005: custom fields that no text holds as an identifier. texts: (text); an equi-join on distinct identifiers."""
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"\b([A-Z][A-Z0-9]+_\w+)\b"), F.lit(1)))).alias("field")).distinct()
    return _found(fields.where("custom").select(F.upper(F.trim("field")).alias("field")).join(words, "field", "left_anti"), "SX-005", "warning", "field", "field")


def unindexed(sql_columns: DataFrame, indexes: DataFrame, excluded: tuple[str, ...] = SYSTEM_COLUMNS) -> DataFrame:
    """PERF-006: columns that queries filter or sort by and no index of their table holds; branch columns excluded.

    sql_columns: (path, line, table_code, column); indexes: (table_code, key: columns joined by +).
    """
    keys = indexes.select("table_code", F.explode(F.split(F.upper("key"), r"\+")).alias("c")).select("table_code", F.regexp_extract("c", r"([A-Z][A-Z0-9]+_\w+)", 1).alias("column")).distinct()
    used = sql_columns.select("path", "line", "table_code", F.upper("column").alias("column")).where(~F.col("column").isin(*excluded) & ~F.col("column").endswith("_FILIAL"))
    known = indexes.select("table_code").distinct()
    return used.join(known, "table_code", "left_semi").join(keys, ["table_code", "column"], "left_anti")
