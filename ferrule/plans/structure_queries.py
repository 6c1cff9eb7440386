"""Extractors that read structure (arguments, embedded SQL, conditions, object literals, classes, nested columns), on sources derived from the tables.

Each part is a source file; its text is built from the part's columns, so the SQL can say what must be found in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import frontend
from ferrule.functions.masking import EMAIL, Masking
from ferrule.plans.store_queries import kept, spread
from ferrule.registry import query
from ferrule.rules import conditions, dictionary, static
from ferrule.sources import arguments, code, embedded_sql


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _sources(t):
    """(path, text): brackets and commas in strings, nested calls, a call and a statement over two lines, a comment with a call."""
    k, s = F.col("p_partkey"), F.col("p_size")
    wide, more = F.when(k % 3 == 0, ", cD, cE, cF, cG").otherwise(""), F.when(k % 2 == 0, '" + ;\n    " WHERE ZA_Y = 1').otherwise("")
    text = _text(
        "User Function ABC_P", k, "(cA, aB := {1, 2, F({", s, ', 4})}, cC := "x,y)"', wide, ")\n",
        '  RpcSetEnv("', s % 10, '", Iif(lX, "a,b", U_F(1, {2, 3})), "u)", \'p(\',\n     "ENV', s, '", "MOD', k % 7, '") // RpcSetEnv("no")\n',
        "  MsExecAuto({|x, y, z| MATA", 400 + k % 5, '(x, G(y, "1,2"), z)}, aCab, {{"C5_NUM", "00,1", Nil}}, ', 3 + s % 3, ")\n",
        '  TCQuery("SELECT A1_COD FROM " + RetSqlName("SA1") + " C WHERE C.A1_EST = \'SP, (\' AND EXISTS (SELECT 1 FROM SB', s % 10, "010 B WHERE B.B", s % 10, "_COD = C.A1_NOME) ORDER BY A1_F", s % 4, '")\n',
        '  TCSqlExec("UPDATE ZA', k % 10, "010 SET ZA_X = 1", more, '")\n',
        '  x := SuperGetMV("MV_P', s, '", .F., F("a,b", {', k, "}))\n",
        "  oJ := JsonObject():New()\n  oJ:Method", k % 4, "()\nReturn\n",
    )
    return kept(t, spread(t, _text("src/", k, ".prw")).select("path", text.alias("text")))


_OF = "'src/' || p_partkey || '.prw' AS path, 'ABC_P' || p_partkey AS unit"
_LATE = "CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END"


@query(f"SELECT {_OF}, 2::BIGINT AS line, (p_size % 10)::VARCHAR AS company, '' AS branch, 'ENV' || p_size AS environment, 'MOD' || (p_partkey % 7) AS module FROM part")
def environment_calls(t):
    """Arguments of environment openers, nested and over lines (EXT-09)."""
    return code.environment_openers(_sources(t))


@query(f"""
SELECT {_OF}, 4::BIGINT AS line, 'MATA' || (400 + p_partkey % 5) AS routine, n_name AS module, (3 + p_size % 3)::INT AS op_code, ['insert', 'update', 'delete'][p_size % 3 + 1] AS op_label, false AS dynamic, 3 AS arg_count
FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 5 AND n_nationkey < 3""")
def routine_operations(t):
    """Calls of standard routines: routine in the code block, operation, catalog (EXT-11)."""
    catalog = t.nation.where("n_nationkey < 3").select(_text("MATA", 400 + F.col("n_nationkey")).alias("routine"), F.col("n_name").alias("module"), F.array().cast("array<string>").alias("tables"))
    return code.routine_calls(_sources(t), catalog).drop("tables")


@query("SELECT 'src/' || p_partkey || '.prw' AS path, 1::BIGINT AS line, 'BP-005' AS rule_id, 'warning' AS severity, 'ABC_P' || p_partkey AS snippet FROM part WHERE p_partkey % 3 = 0")
def wide_signatures(t):
    """Units with more than six parameters; defaults hold commas and brackets (BP-005)."""
    files = _sources(t)
    declared = code.units(code.source_lines(files), "path").join(arguments.signatures(files), ["path", "line", "name"], "left")
    return static.unit_findings(declared, "path")


@query(f"""SELECT {_OF}, 7 + {_LATE}::BIGINT AS line, 'MV_P' || p_size AS name, 'F("a,b", {{' || p_partkey || '}})' AS "default" FROM part""")
def parameter_defaults(t):
    """Parameters read with the default that the call gives (EXT-03)."""
    return code.parameter_reads(_sources(t))


@query(f"""
SELECT {_OF}, 5::BIGINT AS line, 'tcquery' AS via, 'select' AS operation, 'SA1 SB' || (p_size % 10) AS tables, true AS filtered FROM part
UNION ALL SELECT {_OF}, 6, 'tcsqlexec', 'update', 'ZA' || (p_partkey % 10), p_partkey % 2 = 0 FROM part""")
def embedded_statements(t):
    """Embedded SQL: operation, tables, whether it filters (EXT-12)."""
    return embedded_sql.embedded_sql(_sources(t)).select("path", "unit", "line", "via", "operation", F.array_join("tables", " ").alias("tables"), "filtered")


@query("""
WITH p AS (SELECT 'src/' || p_partkey || '.prw' AS path, 5::BIGINT AS line, p_size FROM part)
SELECT path, line, 'SA1' AS table_code, 'A1_NOME' AS "column" FROM p UNION ALL SELECT path, line, 'SA1', 'A1_F' || (p_size % 4) FROM p WHERE p_size % 4 <> 1
UNION ALL SELECT path, line, 'SB' || (p_size % 10), 'B' || (p_size % 10) || '_COD' FROM p WHERE p_size % 10 % 2 = 1""")
def unindexed_columns(t):
    """Columns that statements filter or sort by and no index holds, from source text (PERF-006)."""
    n = F.col("n_nationkey")
    key = F.when(n % 2 == 0, _text("B", n, "_FILIAL+B", n, "_COD")).otherwise(_text("B", n, "_FILIAL"))
    indexes = t.nation.where("n_nationkey < 10").select(_text("SB", n).alias("table_code"), key.alias("key"))
    own = t.region.where("r_regionkey = 0").select(F.lit("SA1").alias("table_code"), F.lit("A1_FILIAL+A1_EST+A1_F1").alias("key"))
    return dictionary.unindexed(embedded_sql.sql_columns(embedded_sql.embedded_sql(_sources(t))), indexes.unionByName(own)).select("path", "line", "table_code", "column")


@query("""
SELECT 'src/' || p_partkey || '.prw' AS path, 6::BIGINT AS line, 'SQL-002' AS rule_id, 'critical' AS severity, 'UPDATE ZA' || (p_partkey % 10) || '010 SET ZA_X = 1' AS snippet FROM part WHERE p_partkey % 2 = 1""")
def unfiltered_statements(t):
    """Statements that change a whole table; a WHERE on the next line counts (SQL-002)."""
    return embedded_sql.unfiltered(embedded_sql.embedded_sql(_sources(t)))


@query(f"""
SELECT {_OF}, 9 + {_LATE}::BIGINT AS line, 'JsonObject' AS "class", 'Method' || (p_partkey % 4) AS method, 'oJ' AS var, n_name AS note FROM part JOIN nation ON n_nationkey = p_partkey % 4 WHERE p_partkey % 4 > 0""")
def build_check(t):
    """Methods that the target build lacks, by the class that the variable holds there (EXT-23, BUILD-001)."""
    n = F.col("n_nationkey")
    catalog = t.nation.where("n_nationkey < 4").select(F.lit("jsonobject").alias("low"), F.lit("JsonObject").alias("class"), _text("Method", n).alias("method"), _text("24.3.0.", n).alias("build_min"), F.lit("").alias("build_max"), F.col("n_name").alias("note"))
    return code.build_findings(_sources(t), catalog.drop("low"), "24.3.0")


@query("""
SELECT c_custkey, CASE n_nationkey % 3 WHEN 0 THEN c_acctbal > n_nationkey * 100 AND (c_mktsegment = 'BUILDING' OR NULL)
  WHEN 1 THEN NOT (c_acctbal <= 0) OR contains('MACHINERY,AUTOMOBILE', c_mktsegment)
  ELSE (c_acctbal + 10) * 2 >= c_custkey AND NULL END AS outcome, [3, 2, 2][n_nationkey % 3 + 1] AS n_explained
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def conditions_judged(t):
    """Conditions that stand in a table, evaluated on the records of another with three truth values (EXT-24, EXT-25)."""
    n = F.col("n_nationkey")
    text = F.when(n % 3 == 0, _text("C_ACCTBAL > ", n * 100, " .And. (C_MKTSEGMENT == 'BUILDING' .Or. SC1->C_NONE = 1)")).when(n % 3 == 1, ".Not. (C_ACCTBAL <= 0) .Or. C_MKTSEGMENT $ 'MACHINERY,AUTOMOBILE'")
    rules = t.nation.select("n_nationkey", text.otherwise("(C_ACCTBAL + 10) * 2 >= C_CUSTKEY .And. C_NONE == 'x, ('").alias("condition"))
    records = t.customer.select("c_custkey", "c_nationkey", conditions.record_map("c_custkey", "c_acctbal", "c_mktsegment").alias("record"))
    rows = records.join(rules, F.col("c_nationkey") == n)
    return conditions.judged(rows, financial=("C_ACCTBAL",)).select("c_custkey", "outcome", F.size("explained").alias("n_explained"))


@query("""
SELECT 'ui/' || p_partkey || '.ts' AS path, 2::BIGINT AS line, 'PoColumn' AS component, CASE WHEN p_partkey % 3 = 0 THEN 'field' ELSE 'type' END AS binding,
  CASE WHEN p_partkey % 3 = 0 THEN 'interface' ELSE 'value' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'T' || (p_partkey % 4) END AS value
FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 > 1""")
def interface_lint(t):
    """Unknown keys and values outside their list, in typed object literals (POUI-IFACE)."""
    k = F.col("p_partkey")
    last = F.when(k % 3 == 0, "field: 'y'").otherwise(_text("type: 'T", k % 4, "'"))
    text = _text("const a: PoColumn[] = [ // type: 'no'\n  { property: 'p', detail: { field: f(x ? y : z), type: 'T9' }, ", last, " }\n];\nconst b: Other = { field: 1 };\n")
    files = spread(t, _text("ui/", k, ".ts")).select("path", text.alias("text"))
    known = [("property", []), ("detail", []), ("type", ["T0", "T1"])]
    row = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.array(*map(F.lit, v)).cast("array<string>").alias("values")) for p, v in known]))
    catalog = t.region.where("r_regionkey = 0").select(F.lit("PoColumn").alias("interface"), row.alias("r")).select("interface", "r.*")
    return frontend.interface_findings(frontend.interface_use(files), catalog)


@query(f"SELECT conv_id, turn, 3 * len(regexp_extract_all(text, '{EMAIL}')) AS n_emails, regexp_replace(text, '{EMAIL}', '', 'g') AS rest FROM conversations")
def nested_masks(t):
    """Texts in structs, arrays and maps masked, and what was replaced counted (PRV-05, PRV-08)."""
    text = F.col("text")
    rows = t.conversations.select("conv_id", "turn", F.struct(text, F.array(F.struct(text)).alias("parts")).alias("s"), F.create_map(F.lit("k"), text).alias("m"))
    masked = Masking(b"key", ("EMAIL",), secrets=False).apply(rows, "replaced")
    same = (F.col("s.text") == F.col("s.parts")[0]["text"]) & (F.col("s.text") == F.col("m")["k"])
    rest = F.when(same, F.regexp_replace("s.text", "<EMAIL_[0-9A-F]{10}>", ""))
    return masked.select("conv_id", "turn", F.col("replaced.EMAIL").cast("long").alias("n_emails"), rest.alias("rest"))
