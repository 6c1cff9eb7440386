"""Findings on source text, rule by rule, as joins, windows and conditions over a table of lines."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(docs: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """A row for each line: key, line from 1, text."""
    return docs.select(*key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line_text")).select(*key, (F.col("pos") + 1).cast("long").alias("line"), F.col("line_text").alias("text"))


#: Names of screens of the time before model-view-controller.
LEGACY_SCREENS = ("AxCadastro", "Modelo2", "Modelo3", "MsNewGetDados")
#: Findings that one line shows by itself: rule, severity, what fires, what excuses it. Patterns are for stripped lines.
LINE_RULES = (
    ("MOD-001", "warning", r"(?i)\bConOut\s*\(", None),
    ("MOD-002", "warning", r"(?i)^\s*Public\s+\w", None),
    ("MOD-004", "info", r"(?i)(?<![:.\w])(" + "|".join(LEGACY_SCREENS) + r")\s*\(", None),
    ("PERF-001", "warning", r"(?i)\bSELECT\s+\*", None),
    ("PERF-005", "warning", r"(?i)\b(RecCount|LastRec)\s*\(\s*\)\s*(>|<>|!=)\s*0", None),
    ("SEC-004", "warning", r"(?i)\b\w*(password|senha|token|secret|api_?key)\w*\s*:?=\s*[\"'][^\"']{4,}[\"']", None),
    ("BP-002b", "warning", r"(?i)^\s*Private\s+\w", r"(?i)^\s*Private\s+(MV_PAR\w*|lMsErroAuto|lMsHelpAuto|aRotina|cCadastro)\b"),
    ("BP-008", "critical", r"(?i)^\s*(Local|Private|Static|Public)\s+(cFilAnt|cEmpAnt|cUserName|dDataBase|cModulo|nModulo|oMainWnd)\b", None),
    ("WS-005", "warning", r"(?i)^\s*Return\s+\.F\.", None),
)
#: Findings that look around: rule, severity, trigger, excuse, lines after, lines before.
NEAR_RULES = (
    ("BP-003", "error", r"(?i)\bMsExecAuto\s*\(", r"(?i)\blMsErroAuto\b", 10, 0),
    ("BP-004", "warning", r"(?i)\bPergunte\s*\([^)]*,\s*\.F\.", r"(?i)\bMV_PAR\d\d\b", 5, 0),
    ("WS-002", "warning", r"(?i)\bGetContent\s*\(", r"(?i)\bDecodeUTF8\s*\(", 10, 0),
    ("BP-007", "info", r"(?i)^\s*User\s+Function\s+\w+", r"(?i)\{[^}]*Doc\}", 0, 30),
)
#: Pairs that must close in their unit: rule, severity, open, close.
PAIR_RULES = (("BP-001", "critical", r"(?i)\bRecLock\s*\(", r"(?i)\bMsUnlock\b"), ("BP-002", "critical", r"(?i)^\s*BEGIN\s+TRANSACTION", r"(?i)^\s*END\s+TRANSACTION"))


def line_findings(rows: DataFrame, key: str, rules=LINE_RULES) -> DataFrame:
    """rows (key, line, text) -> (key, line, rule_id, severity, snippet): every rule that fires on a line, in one pass."""
    fired = F.array_compact(
        F.array(*[F.when(F.col("text").rlike(p) & (~F.col("text").rlike(x) if x else F.lit(True)), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, p, x in rules])
    )
    return rows.select(key, "line", F.substring(F.trim("text"), 1, 200).alias("snippet"), F.explode(fired).alias("f")).select(key, "line", "f.rule_id", "f.severity", "snippet")


def near_findings(rows: DataFrame, key: str, rules=NEAR_RULES) -> DataFrame:
    """Findings of the rules that look at the lines around; the windows share one sort by file and line."""
    from pyspark.sql import Window

    out = rows
    for k, (_, _, p, x, after, before) in enumerate(rules):
        w = Window.partitionBy(key).orderBy("line").rowsBetween(-before, after)
        out = out.withColumn(f"_{k}", F.max(F.when(F.col("text").rlike(x), 1).otherwise(0)).over(w))
    fired = F.array_compact(F.array(*[F.when(F.col("text").rlike(p) & (F.col(f"_{k}") == 0), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for k, (r, s, p, *_) in enumerate(rules)]))
    return out.select(key, "line", F.substring(F.trim("text"), 1, 200).alias("snippet"), F.explode(fired).alias("f")).select(key, "line", "f.rule_id", "f.severity", "snippet")


def pair_findings(rows: DataFrame, key: str, rules=PAIR_RULES) -> DataFrame:
    """rows (key, unit, line, text): opens that no close of their unit is left for."""
    from functools import reduce

    from ferrule.operators.tabular import unmatched_opens

    parts = []
    for r, s, opens, closes in rules:
        marks = rows.select(key, F.coalesce("unit", F.lit("")).alias("unit"), "line", F.col("text").rlike(opens).alias("is_open"), F.col("text").rlike(closes).alias("is_close")).where("is_open or is_close")
        parts.append(unmatched_opens(marks.drop("is_close"), [key, "unit"]).select(key, "line", F.lit(r).alias("rule_id"), F.lit(s).alias("severity")))
    return reduce(DataFrame.unionByName, parts).withColumn("snippet", F.lit(""))


def mixed_access(rows: DataFrame, key: str) -> DataFrame:
    """BP-006: units that lock records both by RecLock and by the raw calls; rows (key, unit, line, text) without comments.

    The line is that of the first DbRLock, else of the first dbAppend. Lines outside units are not judged; the same unit
    name twice in a file is one unit.
    """
    at = F.struct("line", F.substring(F.trim("text"), 1, 200).alias("snippet"))
    first = lambda pattern: F.min(F.when(F.col("text").rlike(pattern), at))
    by_unit = rows.where("unit is not null").groupBy(key, "unit").agg(first(r"(?i)\bRecLock\s*\(").alias("high"), F.coalesce(first(r"(?i)\bDbRLock\s*\("), first(r"(?i)\bdbAppend\s*\(\s*\)")).alias("raw"))
    return by_unit.where("high is not null and raw is not null").select(key, "raw.line", F.lit("BP-006").alias("rule_id"), F.lit("error").alias("severity"), "raw.snippet")


def encoding_findings(files: DataFrame, key: str = "path") -> DataFrame:
    """ENC-001: sources for the older compiler that are stored as UTF-8. files: (key, encoding, text); null encodings don't fire."""
    old = F.lower(key).rlike(r"[.]pr[wx]$") & (F.lower("encoding") == "utf-8")
    snippet = F.substring(F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^\r\n]*)", 1), 1, 200).alias("snippet")
    return files.where(old).select(key, F.lit(1).cast("long").alias("line"), F.lit("ENC-001").alias("rule_id"), F.lit("error").alias("severity"), snippet)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut(args: pd.Series) -> pd.Series:
    from ferrule.sources.arguments import cut

    return args.map(cut)


#: Parameters that a unit may have before BP-005 fires.
MOST_PARAMETERS = 6


def unit_findings(units: DataFrame, key: str) -> DataFrame:
    """units (key, line, kind, name, args) -> naming and parameter count (SEC-002, BP-005); null args count as none.

    ``args`` is an array, or an argument list as text.
    """
    if dict(units.dtypes)["args"] == "string":
        units = units.withColumn("args", _cut(F.col("args")))
    n = F.coalesce(F.size("args"), F.lit(0))
    entry = F.col("name").rlike(r"^[A-Z]{2,3}[0-9]{2,4}[A-Z]{2,}$|^[A-Z]{1,3}_|^[A-Z][0-9A-Z]{2}[A-Z0-9]+$")
    rules = [("BP-005", n > MOST_PARAMETERS), ("SEC-002", (F.col("kind") == "user_function") & ~entry)]
    fired = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit("warning").alias("severity"))) for r, c in rules]))
    return units.select(key, "line", F.col("name").alias("snippet"), F.explode(fired).alias("f")).select(key, "line", "f.rule_id", "f.severity", "snippet")


def findings(files: DataFrame, key: str = "path") -> DataFrame:
    """All findings of source files (key, text, and encoding where it is known) that need no catalog, by line and rule."""
    from ferrule.sources.arguments import signatures
    from ferrule.sources.code import source_lines, units, with_unit
    from ferrule.sources.embedded_sql import embedded_sql, unfiltered

    rows = with_unit(source_lines(files, key), key)
    raw = lines(files.select(key, "text"), [key])  # doc blocks are comments
    near = [r for r in NEAR_RULES if r[0] != "BP-007"]
    doc = [r for r in NEAR_RULES if r[0] == "BP-007"]
    found = line_findings(rows, key).unionByName(near_findings(rows, key, near)).unionByName(near_findings(raw, key, doc)).unionByName(pair_findings(rows, key))
    found = found.unionByName(context_findings(rows.drop("unit"), key)).unionByName(sql_findings(rows.drop("unit"), key)).unionByName(service_findings(rows, key))
    found = found.unionByName(mixed_access(rows, key))
    declared = units(rows.drop("unit"), key).join(signatures(files, key), [key, "line", "name"], "left")
    found = found.unionByName(unit_findings(declared, key)).unionByName(unfiltered(embedded_sql(files, key), key))
    if "encoding" in files.columns:
        found = found.unionByName(encoding_findings(files, key))
    return found.orderBy(key, "line", "rule_id")


#: Methods of the injected REST object, and names that mark personal data.
REST_METHODS = ("getheader", "getbodyrequest", "getpathparamrequest", "getqueryrequest", "setresponse", "setkeyheaderresponse", "setstatuscode", "setfault", "getheaderrequest", "setcontenttype")
PERSONAL = r"(?i)\b\w*(cpf|cnpj|cgc|rg|email|senha|telefone|endereco|nascimento)\w*\b"
_REST = r"(?i)^\s*(WSRESTFUL\b|@(Get|Post|Put|Delete|Patch)\s*\()"
_OPENER = r"(?i)\b(RpcSetEnv\s*\(|PREPARE\s+ENVIRONMENT)"


def in_span(rows: DataFrame, key: str, opens: str, closes: str, name: str) -> DataFrame:
    """Lines with the number of open spans they lie in; a line that closes still lies inside."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("line")
    up = F.sum(F.when(F.col("text").rlike(opens), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.coalesce(F.sum(F.when(F.col("text").rlike(closes), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, up - down)


def context_findings(rows: DataFrame, key: str) -> DataFrame:
    """Findings that depend on where a line stands: SQL-001, PERF-004, SEC-001, SEC-003, WS-003, WS-004.

    rows (key, line, text) without comments; REST files are those that declare a service or an annotated end point.
    """
    from pyspark.sql import Window

    out = in_span(rows, key, r"(?i)\bBeginSql\b", r"(?i)\bEndSql\b", "_sql")
    out = in_span(out, key, r"(?i)^\s*(For|While|Do\s+While)\b", r"(?i)^\s*(Next|EndDo)\b", "_loop")
    out = out.withColumn("_rest", F.max(F.when(F.col("text").rlike(_REST), 1).otherwise(0)).over(Window.partitionBy(key)))
    bare = F.regexp_replace("text", r"'[^']*'", "''")
    method = F.lower(F.regexp_extract("text", r"(?i)\boRest:(\w+)\s*\(", 1))
    rules = [
        ("SQL-001", "critical", (F.col("_sql") > 0) & bare.rlike("--")),
        ("PERF-004", "warning", (F.col("_loop") > 0) & F.col("text").rlike(r"(?i)\b(\w+)\s*(\+=\s*[\"']|:=\s*\1\s*\+\s*[\"'])")),
        ("SEC-001", "critical", (F.col("_rest") == 1) & F.col("text").rlike(_OPENER)),
        ("SEC-003", "warning", F.col("text").rlike(r"(?i)\b(ConOut|FwLogMsg|LogMsg)\s*\(") & F.regexp_replace("text", r"(?i)\b(ConOut|FwLogMsg|LogMsg)\b", "").rlike(PERSONAL)),
        ("WS-003", "warning", (F.col("_rest") == 1) & F.col("text").rlike(r"(?i):SetResponse\s*\(") & ~F.col("text").rlike(r"(?i)EncodeUTF8")),
        ("WS-004", "error", (method != "") & ~method.isin(*REST_METHODS)),
    ]
    fired = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, c in rules]))
    return out.select(key, "line", F.substring(F.trim("text"), 1, 200).alias("snippet"), F.explode(fired).alias("f")).select(key, "line", "f.rule_id", "f.severity", "snippet")


def sql_blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, line, text) -> (key, line, sql): the text of each embedded SQL block, from its first line."""
    from pyspark.sql import Window

    inside = in_span(rows, key, r"(?i)\bBeginSql\b", r"(?i)\bEndSql\b", "_sql").where("_sql > 0")
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_block", F.sum(F.when(F.col("text").rlike(r"(?i)\bBeginSql\b"), 1).otherwise(0)).over(w))
    parts = inside.groupBy(key, "_block").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return parts.select(key, F.element_at("l", 1)["line"].alias("line"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("sql"))


def sql_findings(rows: DataFrame, key: str) -> DataFrame:
    """PERF-002 and PERF-003: blocks on ERP tables without a filter for deleted rows, or for the branch."""
    erp = F.col("sql").rlike(r"(?i)%table:\w+%|RetSqlName|\b[SZ][A-Z0-9]{2}\d{3}\b")
    fired = F.array_compact(F.array(F.when(erp & ~F.col("sql").rlike(r"(?i)%notdel%|D_E_L_E_T_"), F.struct(F.lit("PERF-002").alias("rule_id"), F.lit("error").alias("severity"))), F.when(erp & ~F.col("sql").rlike(r"(?i)%xfilial|_FILIAL\b"), F.struct(F.lit("PERF-003").alias("rule_id"), F.lit("error").alias("severity")))))
    return sql_blocks(rows, key).select(key, "line", F.substring(F.trim(F.regexp_replace("sql", r"\s+", " ")), 1, 200).alias("snippet"), F.explode(fired).alias("f")).select(key, "line", "f.rule_id", "f.severity", "snippet")


def restricted_calls(rows: DataFrame, key: str, restricted: DataFrame) -> DataFrame:
    """SEC-005: calls of functions that a catalog (name) restricts."""
    called = rows.select(key, "line", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\w+)\s*\("), F.lit(1))).alias("snippet"))
    names = restricted.select(F.upper("name").alias("_n")).distinct()
    return called.join(names, F.upper("snippet") == F.col("_n"), "left_semi").select(key, "line", F.lit("SEC-005").alias("rule_id"), F.lit("critical").alias("severity"), "snippet")


def service_findings(rows: DataFrame, key: str) -> DataFrame:
    """WS-001: service methods whose service no file declares."""
    p = r"(?i)^\s*WSMETHOD\s+(?:(?:GET|POST|PUT|DELETE|PATCH)\s+)?\w+.*\bWSSERVICE\s+(\w+)"
    used = rows.where(F.col("text").rlike(p)).select(key, "line", F.regexp_extract("text", p, 1).alias("snippet"))
    d = r"(?i)^\s*(?:WSSERVICE|WSRESTFUL)\s+(\w+)"
    declared = rows.where(F.col("text").rlike(d)).select(F.upper(F.regexp_extract("text", d, 1)).alias("_s")).distinct()
    return used.join(declared, F.upper("snippet") == F.col("_s"), "left_anti").select(key, "line", F.lit("WS-001").alias("rule_id"), F.lit("error").alias("severity"), "snippet")


def branch_findings(rows: DataFrame, key: str, tables: DataFrame) -> DataFrame:
    """XF-001: branch-dependent seeks on exclusive tables in REST files or jobs, before any environment is opened.

    tables: (code, mode); mode E is exclusive.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_open", F.max(F.when(F.col("text").rlike(_OPENER), 1).otherwise(0)).over(w)).withColumn("_rest", F.max(F.when(F.col("text").rlike(_REST + r"|(?i)^\s*Main\s+Function"), 1).otherwise(0)).over(Window.partitionBy(key)))
    seeks = marked.where("_open = 0 and _rest = 1").select(key, "line", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)xFilial\s*\(\s*[\"'](\w{2,3})[\"']"), F.lit(1))).alias("snippet"))
    own = tables.where("upper(mode) = 'E'").select(F.upper("code").alias("_c")).distinct()
    return seeks.join(own, F.upper("snippet") == F.col("_c"), "left_semi").select(key, "line", F.lit("XF-001").alias("rule_id"), F.lit("error").alias("severity"), "snippet")
