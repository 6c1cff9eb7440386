"""Look-ups and diagnostics on sources, output and dictionaries that are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import frontend
from ferrule.operators import lookups
from ferrule.plans.store_queries import kept, spread
from ferrule.registry import query
from ferrule.rules.capabilities import capabilities
from ferrule.sources import code, diagnostics
from ferrule.sources.facts import fact_tables


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(k, values):
    return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


@query("""
SELECT o_orderkey AS line, ['error', 'warning', 'error', 'warning', 'error', 'error', 'unknown'][o_orderkey % 9 + 1] AS severity,
  CASE o_orderkey % 9 WHEN 5 THEN 'APPRE41.PRW' WHEN 6 THEN '' ELSE CASE WHEN o_custkey % 3 = 0 THEN 'src/F0.prw' ELSE 'f' || (o_custkey % 3) || '.PRW' END END AS file,
  CASE o_orderkey % 9 WHEN 4 THEN 0 WHEN 6 THEN 0 ELSE o_custkey END::BIGINT AS at_line, CASE WHEN o_orderkey % 9 = 0 THEN 7 ELSE 0 END::BIGINT AS at_column, CASE WHEN o_orderkey % 9 = 5 THEN 'C2090' ELSE '' END AS code,
  ['bad psw=***REDACTED***', 'so so', 'no', 'hm', 'x.ch', 'lost', 'free text'][o_orderkey % 9 + 1] AS message, o_orderkey % 9 = 6 OR (o_orderkey % 9 <> 5 AND o_custkey % 3 = 0) AS matched FROM orders WHERE o_orderkey % 9 < 7""")
def compiler_output(t):
    """Compiler output: the first shape that fits, unknown lines kept, files told by their base names, secrets redacted (EXT-26)."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    file = _text("f", n % 3, ".PRW")
    said = [_text(file, "(", n, ",7) error: bad psw=1"), _text(file, "(", n, ") aviso: so so"), _text("Erro ao compilar ", file, ": linha ", n, " - no"), _text("Aviso em ", file, ": linha ", n, " - hm"), _text("Include 'x.ch' not found in ", file),
            _text("APPRE41.PRW(", n, ") Error C2090 lost"), F.lit("  free text "), F.lit("2024-01-01 10:00:00.1 ( 1) x"), F.lit("   ")]
    output = t.orders.select(F.lit("out").alias("path"), k.alias("line"), _pick(k, said).alias("text"))
    requested = t.region.where("r_regionkey = 0").select(F.lit("src/F0.prw").alias("path"))
    return diagnostics.diagnostics(output, requested).drop("path", "raw")


@query("""
SELECT 'T' || (p_size % 5) AS table_code, 'F' || p_partkey AS field, ['C(1)', 'C(3)', 'N(9,2)', ''][p_partkey % 4 + 1] AS type, p_name AS title, CASE WHEN p_size % 2 = 0 THEN '1=Yes, 2=No=x, odd' ELSE '' END AS values, p_partkey % 4 = 0 AND p_size % 2 = 0 AS discriminator FROM part WHERE p_size % 5 = 3""")
def table_fields(t):
    """Fields of a table with types, listed values and discriminators (LKP-07)."""
    k = F.col("p_partkey")
    fields = t.part.select(_text("T", F.col("p_size") % 5).alias("table_code"), _text("F", k).alias("field"), _pick(k, ("C", "C", "N", "")).alias("type"), _pick(k, (F.lit(1), F.lit(3), F.lit(9), F.lit(0))).alias("size"),
                           F.when(k % 4 == 2, 2).otherwise(0).alias("decimals"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, " 1 = Yes; 2=No=x;;odd ").alias("box"))
    return lookups.table_catalog(fields, "t3")


def _programs(t):
    """(path, text): reads, a lock, a model that writes or only shows, a hook, calls of a standard routine, with and without an operation."""
    k, s = F.col("p_partkey"), F.col("p_size")
    shows = F.when(k % 2 == 0, "  oV:SetOnlyView(.T.)\n").otherwise("")
    op = _pick(k, (", 3", ", 4", ", 5", ", nOp"))
    text = _text(
        '#include "p.ch"\nUser Function X', k, '()\n  DbSelectArea("SA', s % 10, '")\n  RecLock("SB1", .T.)\n  FWFormStruct(1, "SC5")\n  oM:bCommit := {|| F()}\n  c := "bLoad := 1"\n', shows,
        "  MsExecAuto({|x, y| MATA", 400 + s % 3, "(x, y)}, aCab", op, ")\nReturn\nStatic Function Y()\nReturn",
    )
    return kept(t, spread(t, _text("src/", k, ".prw")).select("path", text.alias("text")))


def _routines(t):
    n = F.col("n_nationkey")
    return t.nation.where("n_nationkey < 3").select(_text("MATA", 400 + n).alias("routine"), _text("MOD", n).alias("module"), F.array(_text("SC", n), F.lit("SA1")).alias("tables"))


@query("""
SELECT 'src/' || p_partkey || '.prw' AS path, 'mvc' AS source_type, 'EXEC_AUTO_CALLER MVC' AS tags, 11::BIGINT + (p_partkey % 2 = 0)::INT AS lines_of_code, 'X' || p_partkey || ' Y' AS units, 'X' || p_partkey AS user_units, '' AS entry_points,
  'SA' || (p_size % 10) AS read_tables, 'SC5' AS write_tables, 'SB1' AS lock_tables, 'p.ch' AS includes, 'SA1 SC' || (p_size % 3) AS routine_tables, true AS via_routines FROM part""")
def source_architecture(t):
    """One row a source: kind, tags, units, tables by use and through standard routines, includes (LKP-10)."""
    files = _programs(t)
    facts = fact_tables(files, _routines(t))
    found = lookups.architecture(files, capabilities(files, facts), facts, code.entry_points(files))
    shown = ("tags", "units", "user_units", "entry_points", "read_tables", "write_tables", "lock_tables", "includes", "routine_tables")
    return found.select("path", "source_type", "lines_of_code", *[F.array_join(c, " ").alias(c) for c in shown], "via_routines")


@query("""
SELECT 'src/' || p_partkey || '.prw' AS path, 'alter' AS asked, 'MATA401' AS routine FROM part WHERE p_size % 3 = 1 AND p_partkey % 4 = 1
UNION ALL SELECT 'src/' || p_partkey || '.prw', 'dynamic', 'MATA401' FROM part WHERE p_size % 3 = 1 AND p_partkey % 4 = 3""")
def routine_call_filters(t):
    """Calls of a routine by module and operation word, and those whose operation isn't told (LKP-13)."""
    calls = code.routine_calls(_programs(t), _routines(t))
    asked = [("alter", {"op": "ALTER", "dynamic": False}), ("dynamic", {"op_dynamic": True}), ("odd", {"op": "odd"})]
    parts = [lookups.find_routine_calls(calls, routine="mata401", module="mod1", **f).select("path", F.lit(n).alias("asked"), "routine") for n, f in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
SELECT 'src/' || p_partkey || '.prw' AS path, 'SC5' AS name, 'model' AS modes FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT 'src/' || p_partkey || '.prw', 'bCommit', 'hook 6 X' || p_partkey FROM part""")
def models_and_hooks(t):
    """Tables that a model writes, unless it only shows, and the hooks that it runs (EXT-05)."""
    files = _programs(t)
    written = code.table_modes(files).where(F.array_contains("modes", "model")).select("path", "name", F.array_join("modes", " ").alias("modes"))
    hooks = code.model_hooks(files).select("path", F.col("callee").alias("name"), F.concat_ws(" ", F.lit("hook"), F.col("line").cast("string"), "unit").alias("modes"))
    return written.unionByName(hooks)


@query("""
WITH u AS (SELECT 'app' || (p_size % 4) || '/' || CASE WHEN p_size % 8 > 3 THEN 'lib/' ELSE '' END AS folder, p_partkey, p_size, 'po-c' || (p_partkey % 6) AS component, p_partkey % 3 AS pkg FROM part WHERE p_size % 4 < 3)
SELECT min(folder || p_partkey || '.html') AS path, 1::BIGINT AS line, component, '@po/' || pkg AS package, CASE WHEN p_size % 4 = 1 AND p_size % 8 > 3 THEN folder ELSE 'app' || (p_size % 4) || '/' END AS project
FROM u WHERE p_partkey % 6 < 5 AND pkg <> p_size % 4 GROUP BY ALL""")
def missing_imports(t):
    """Components whose package their project imports nowhere; projects lie in each other (JOI-15, POUI-IMPORT)."""
    k, s, n = F.col("p_partkey"), F.col("p_size"), F.col("n_nationkey")
    folder = F.concat(_text("app", s % 4, "/"), F.when(s % 8 > 3, "lib/").otherwise(""))
    files = t.part.select(F.concat(folder, _text(k, ".html")).alias("path"), F.lit(1).cast("long").alias("line"), _text("po-c", k % 6).alias("component"))
    catalog = t.nation.where("n_nationkey < 5").select(_text("po-c", n).alias("component"), _text("@po/", n % 3).alias("package"))
    projects = t.nation.where("n_nationkey < 4").select(F.when(n < 3, _text("app", n, "/package.json")).otherwise("app1/lib/package.json").alias("path"))
    imported = t.nation.where("n_nationkey < 4").select(F.when(n < 3, _text("app", n, "/a.ts")).otherwise("app1/lib/a.ts").alias("path"), F.when(n < 3, _text("@po/", n)).otherwise("@po/1").alias("package"))
    return frontend.import_findings(files, imported, catalog, projects)
