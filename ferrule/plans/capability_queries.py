"""Capabilities, counts and documentation of derived sources; database sources of derived configuration files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.plans.store_queries import spread
from ferrule.registry import query
from ferrule.rules import capabilities as C
from ferrule.rules import config_audit, config_kinds
from ferrule.sources import code, config

_BODIES = (
    '  oDlg := MsDialog():New()\n  MemoRead("x")\n',
    '  Begin Transaction\n  RpcSetEnv("01")\n',
    '  MsExecAuto({|x| MATA410(x)}, a, 3)\n  // TReport():New()\n  HttpGet("u")\n',
    '  x := xFilial("SA1") + PARAMIXB[1]\n',
)


def _sources(t):
    """(path, text): one of four bodies; every fifth file holds a function in a comment, every second a doc block."""
    k = F.col("p_partkey")
    body = F.element_at(F.array(*map(F.lit, _BODIES)), (k % 4 + 1).cast("int"))
    doc = F.when(k % 2 == 0, F.concat(F.lit("/*/{Protheus.doc} x_p"), k.cast("string"), F.lit("\nsays\n@author me\n/*/\n"))).otherwise("")
    old = F.when(k % 5 == 0, "/*\nStatic Function Old()\n*/\n").otherwise("")
    text = F.concat(doc, F.lit("User Function X_P"), k.cast("string"), F.lit("()\n"), body, F.lit("Return\n"), old)
    return spread(t, F.concat(F.lit("src/"), k.cast("string"), F.lit(".prw"))).select("path", text.alias("text"))


@query("""
SELECT 'src/' || p_partkey || '.prw' AS path, ['DIALOG FILE_IO TELA_CLASSICA', 'ENV_OPENER RPC TRANSACTION', 'EXEC_AUTO_CALLER REST_CLIENT', 'MULTI_FILIAL PE'][p_partkey % 4 + 1] AS tags,
  CASE WHEN p_partkey % 4 = 3 THEN 'pe' ELSE 'user_function' END AS source_type FROM part""")
def source_capabilities(t):
    """Tags of what sources can do, and their kind (EXT-14, EXT-15)."""
    return C.capabilities(_sources(t)).withColumn("tags", F.array_join("tags", " "))


@query("""
SELECT 'src/' || p_partkey || '.prw' AS path, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END::INT AS raw, 1 AS code, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END::INT AS parser,
  CASE WHEN p_partkey % 7 = 0 THEN 'real_bug' ELSE 'commented_out' END AS "class" FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0""")
def unit_counts(t):
    """Functions counted in the text, outside comments and in a fact table that lacks some (AGG-09)."""
    files = _sources(t)
    units = code.units(code.source_lines(files), "path").where(F.regexp_extract("name", r"(\d+)$", 1).cast("long") % 7 != 0)
    return C.unit_count_check(files, units)


@query("SELECT 'X_P' || p_partkey AS name, p_partkey % 2 = 0 AS has_doc FROM part")
def documented_flags(t):
    """Whether a doc block names a unit (JOI-11)."""
    files = _sources(t)
    return C.documented(code.units(code.source_lines(files), "path"), code.doc_blocks(files)).select("name", "has_doc")


@query("""
SELECT n_name AS path, CASE n_nationkey % 4 WHEN 0 THEN 'topconnect' WHEN 1 THEN 'dbaccess environment' WHEN 2 THEN 'environment' ELSE '' END AS sources,
  CASE n_nationkey % 4 WHEN 0 THEN 'dbaccess' WHEN 1 THEN 'topconnect' WHEN 2 THEN 'topconnect dbaccess' ELSE '' END AS redundant, n_nationkey % 4 = 1 AND n_regionkey <> 0 AS conflict FROM nation""")
def database_sections(t):
    """Where configuration files define their database, redundant sections, conflicts (INI-06, JOI-17)."""
    kind = F.col("n_nationkey") % 4
    row = lambda s, k: F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"))
    given = F.when(kind == 0, F.array(row("TopConnect", "Server"), row("DBAccess", "Other"))).when(kind == 1, F.array(row("DBACCESS", "Port"), row("p12", "DbAlias"))).when(kind == 2, F.array(row("p12", "DBServer"))).otherwise(F.array(row("General", "Server")))
    keys = t.nation.select(F.col("n_name").alias("path"), F.explode(given).alias("r")).select("path", "r.*")
    files = t.nation.select(F.col("n_name").alias("path"), F.when(F.col("n_regionkey") == 0, "broker_http").otherwise("standalone").alias("role"))
    found = config_audit.database_sources(keys, files, ("broker_http",))
    return found.select("path", F.array_join("sources", " ").alias("sources"), F.array_join("redundant", " ").alias("redundant"), "conflict")


@query("""
SELECT 'c' || p_partkey || '/' || CASE p_size % 4 WHEN 0 THEN 'dbaccess' WHEN 1 THEN 'broker_rest' ELSE 'server' END || '.ini' AS path,
  CASE p_size % 4 WHEN 0 THEN 'dbaccess' WHEN 1 THEN 'broker' WHEN 2 THEN 'appserver' ELSE 'custom' END AS type,
  CASE p_size % 4 WHEN 0 THEN ['dbaccess_master', 'dbaccess_slave', 'dbaccess_standalone'][p_partkey % 3 + 1] WHEN 1 THEN 'broker_rest' WHEN 2 THEN CASE WHEN p_partkey % 5 >= 3 THEN 'standalone_multi_env' ELSE 'standalone' END ELSE 'rest_server' END AS role FROM part""")
def config_roles(t):
    """Type and role of configuration files, read from their text (INI-01, INI-02)."""
    k, s = F.col("p_partkey"), F.col("p_size") % 4
    mode = F.element_at(F.array(*map(F.lit, ("Master", "slave", "other"))), (k % 3 + 1).cast("int"))
    many = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < k % 5), lambda i: F.concat(F.lit("[env"), i.cast("string"), F.lit("]\nSourcePath=/x\n"))), "")
    text = F.when(s == 0, F.concat(F.lit("[General]\nMode="), mode, F.lit("\n"))).when(s == 1, "[Balance_Web_Services]\nport=1\n").when(s == 2, F.concat(F.lit("[General]\na=1\n[Drivers]\nb=1\n"), many)).otherwise("[HttpRest]\na=1\n[HttpJob]\nb=1\n;[oracle]\nc=1\n")
    name = F.when(s == 0, "dbaccess").when(s == 1, "broker_rest").otherwise("server")
    files = spread(t, F.concat(F.lit("c"), k.cast("string"), F.lit("/"), name, F.lit(".ini"))).select("path", text.alias("text"))
    return config_kinds.config_kinds(files, *config_kinds.of_parsed(config.parse(files)))
