"""Embedded SQL: operation, tables, filter, and the columns of each clause with the table that their alias stands for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.sources.arguments import calls_in, holding, in_unit

#: Statements, words that begin a clause, words that are neither a column nor an alias, columns of every table.
STATEMENTS = ("select", "update", "insert", "delete")
CLAUSES = {"select": "select", "from": "from", "join": "from", "into": "into", "update": "update", "set": "set", "on": "on", "where": "where", "group": "group", "having": "having", "order": "order", "values": "values"}
PLAIN_WORDS = frozenset(
    "all and any as asc between by case cross delete desc distinct else end escape exists fetch first full in inner insert is left like limit natural next not null nolock offset only or outer over partition right rows some then top using when with".split()
)
SYSTEM_COLUMNS = ("D_E_L_E_T_", "R_E_C_N_O_", "R_E_C_D_E_L_")
#: Calls whose first argument is a statement.
SQL_CALLS = ("TCQuery", "TCSqlExec")
_SIGN = re.compile(r"'[^']*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|%[ \t]*(\w+)[ \t]*(?::([^%]*))?%|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?|[(),]", re.S)
_COLUMN = re.compile(r"([A-Z][A-Z0-9]{1,2})_[A-Z][A-Z0-9_]*|[DR]_E_[A-Z_]+")
_PHYSICAL = re.compile(r"[A-Z][A-Z0-9]{2}\d{3}")
_PIECE = re.compile(r"\"([^\"]*)\"|'([^']*)'|\bRetSqlName\s*\(\s*[\"'](\w+)[\"']\s*\)|\w[\w:]*\s*\([^()]*\)|\w+|[^\s\w+\"']+", re.I)


@dataclass
class _Select:
    """One select (or the statement): its tables by alias, and columns met in it as (clause, alias, column)."""

    outer: _Select | None = None
    depth: int = 0
    clause: str = ""
    tables: dict[str, str] = field(default_factory=dict)
    columns: list[tuple[str, str, str]] = field(default_factory=list)
    wants_table: bool = False
    last_table: str = ""
    filtered: bool = False

    def table(self, name: str) -> None:
        code = name[:3] if _PHYSICAL.fullmatch(name) else name
        self.tables[name] = self.tables[code] = self.last_table = code
        self.wants_table = False

    def owner(self, alias: str, prefix: str) -> str:
        """The table of a column: by its alias, else by its prefix, from the inside out; the only table if there is one."""
        at: _Select | None = self
        while at:
            for name, code in at.tables.items():
                if (name == alias) if alias else code[-len(prefix) :] == prefix:
                    return code
            at = at.outer
        only = {*self.tables.values()}
        return "" if alias or len(only) != 1 else only.pop()


def read_sql(sql: str | None) -> dict | None:
    """operation, tables (sorted codes), filtered (the statement itself has WHERE) and columns (clause, table_code, column).

    Table macros and physical names count by their code. Subqueries see the aliases of what is around them. Columns in
    strings, comments and macros don't count; a column whose table is not to be told has the code ''. Text that begins no
    statement anywhere has the operation ''.
    """
    if sql is None:
        return None
    statement = at = _Select()
    selects, brackets, operation, before = [at], [], "", ""
    for m in _SIGN.finditer(sql):
        word = m[0]
        low = word.lower()
        if m[1]:
            if m[1].lower() == "table" and at.wants_table:
                at.table((m[2] or "").strip().upper())
        elif word == "(":
            at.wants_table = False
            brackets.append(at)
        elif word == ")":
            if brackets:
                at = brackets.pop()
                at.last_table = ""
        elif word == ",":
            if at.clause in ("from", "on") and len(brackets) == at.depth:  # not a comma of a function or a list
                at.clause, at.wants_table = "from", True
            at.last_table = ""
        elif word[0] in "'\"-/":
            pass
        elif low in ("union", "except", "intersect", "minus"):
            at = _Select(at.outer, at.depth)
            selects.append(at)
        elif low in CLAUSES or low in STATEMENTS:
            if low == "select" and before == "(":
                at = _Select(at, len(brackets))
                selects.append(at)
            operation = operation or (low if low in STATEMENTS else "")
            at.clause = CLAUSES.get(low, at.clause)
            at.wants_table, at.last_table = at.clause in ("from", "into", "update"), ""
            at.filtered |= low == "where"
        elif low in PLAIN_WORDS:
            pass
        elif at.wants_table:
            at.table(word.upper())
        elif at.last_table:
            at.tables[word.upper()], at.last_table = at.last_table, ""
        elif not sql.startswith("(", m.end()):
            alias, _, column = word.upper().rpartition(".")
            if _COLUMN.fullmatch(column):
                at.columns.append((at.clause, alias, column))
        before = word
    found = [{"clause": c, "table_code": s.owner(alias, name.partition("_")[0]), "column": name} for s in selects for c, alias, name in s.columns]
    return {"operation": operation, "tables": sorted({t for s in selects for t in s.tables.values()}), "filtered": statement.filtered, "columns": found}


def literal_sql(arg: str) -> str:
    """The text of an argument that joins strings and table names by plus; other parts are a question mark; '' without a string."""
    out, strings = [], False
    for m in _PIECE.finditer(arg):
        if m[1] is not None or m[2] is not None:
            out.append(m[1] if m[1] is not None else m[2])
            strings = True
        elif m[3]:
            out.append(f" {m[3].upper()} ")
        elif m[0].strip():
            out.append(" ? ")
    return "".join(out) if strings else ""


_READ = T.StructType(
    [
        T.StructField("operation", T.StringType()),
        T.StructField("tables", T.ArrayType(T.StringType())),
        T.StructField("filtered", T.BooleanType()),
        T.StructField("columns", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("clause", "table_code", "column")]))),
    ]
)


@F.pandas_udf(_READ)
def _read_all(sql: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_sql(s) or dict.fromkeys(_READ.names) for s in sql], columns=_READ.names)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("via", T.StringType()), T.StructField("sql", T.StringType())])))
def _called(texts: pd.Series) -> pd.Series:
    """The literal statements that calls are given, in one step: a step of its own for the literals ran twice, once to filter by them."""
    wanted = frozenset(n.lower() for n in SQL_CALLS)
    return pd.Series([None if t is None else [{"line": c["line"], "via": c["name"].lower(), "sql": s} for c in calls_in(t, wanted) if (s := literal_sql("".join(c["args"][:1])))] for t in texts])


def statements(files: DataFrame, key: str = "path") -> DataFrame:
    """files (key, text) -> (key, unit, line, via, sql): SQL blocks and the literal statements that calls are given.

    ``via`` is ``block`` or the call's name in lower case. A statement that is only a variable gives no row; null texts give none.
    """
    from ferrule.rules.static import sql_blocks
    from ferrule.sources.code import bare_text, declared_units, source_lines

    block = sql_blocks(source_lines(files.where(F.col("text").rlike("(?i)BeginSql")), key), key)
    # the words between the opening word and the first statement are the block's alias and options
    inside = F.regexp_replace("sql", r"(?is)^.*?\bBeginSql\b|\bEndSql\b.*$", "")
    block = block.select(key, "line", F.lit("block").alias("via"), F.trim(inside).alias("sql"))
    called = holding(files, SQL_CALLS).select(key, F.explode(_called(bare_text(files))).alias("c")).select(key, "c.*")
    return in_unit(block.unionByName(called), declared_units(files, key), key).select(key, "unit", "line", "via", "sql")


def embedded_sql(files: DataFrame, key: str = "path") -> DataFrame:
    """files (key, text) -> (key, unit, line, via, operation, tables, filtered, columns, sql)."""
    return statements(files, key).withColumn("r", _read_all(F.col("sql"))).select(key, "unit", "line", "via", "r.*", "sql")


def sql_columns(read: DataFrame, clauses: tuple[str, ...] = ("where", "order"), key: str = "path") -> DataFrame:
    """Rows of ``embedded_sql`` -> (key, unit, line, clause, table_code, column): what the statements filter and sort by, once a line."""
    # outer: else Spark filters by the size of the list below, for which the statements are read a second time
    rows = read.select(key, "unit", "line", F.explode_outer("columns").alias("c")).select(key, "unit", "line", "c.*")
    return rows.where(F.col("clause").isin(*clauses)).distinct()


def unfiltered(read: DataFrame, key: str = "path") -> DataFrame:
    """SQL-002: statements that update or delete without WHERE, wherever in the statement it could stand."""
    snippet = F.substring(F.trim(F.regexp_replace("sql", r"\s+", " ")), 1, 200)
    bad = read.where(F.col("operation").isin("update", "delete") & ~F.col("filtered") & F.col("via").isin("block", "tcsqlexec"))
    return bad.select(key, "line", F.lit("SQL-002").alias("rule_id"), F.lit("critical").alias("severity"), snippet.alias("snippet")).distinct()
