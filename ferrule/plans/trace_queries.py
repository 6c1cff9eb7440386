"""Traces over sources that are derived from the parts: each part is a source file of one unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators.lineage import impact, lineage
from ferrule.plans.store_queries import stored
from ferrule.registry import query

_UNIT = "'P' || p_partkey AS unit, 'src/' || p_partkey || '.prw' AS path"


def _sources(t):
    """The stored facts of the derived sources: each source is read and stripped once."""
    return stored(t).tables()


@query(f"""
SELECT 1 AS layer, 'defined_in' AS edge, path, unit, 1::BIGINT AS line, unit AS target, 'user_function' AS detail FROM (SELECT {_UNIT} FROM part WHERE p_partkey = 7)
UNION ALL SELECT * FROM (SELECT 1, 'called_by', path, unit, 2::BIGINT, unit || '@' || path, 'user_func' FROM (SELECT {_UNIT} FROM part WHERE p_size = 7) ORDER BY path LIMIT 20)
UNION ALL SELECT 1, 'calls', '', 'P7', 0::BIGINT, 'P' || p_size, 'user_func' FROM part WHERE p_partkey = 7""")
def trace_function(t):
    """Where a unit is defined, who calls it, what it calls (GRF-11)."""
    return lineage(_sources(t), "function", "U_P7")


@query(f"""
SELECT * FROM (SELECT 1 AS layer, 'reclock' AS edge, path, unit, 3::BIGINT AS line, 'SA7' AS target, 'lock' AS detail FROM (SELECT {_UNIT} FROM part WHERE p_size % 10 = 7) ORDER BY path LIMIT 20)""")
def trace_table(t):
    """Which sources use a table, and how (GRF-12)."""
    return lineage(_sources(t), "table", "SA7")


@query(f"""
SELECT * FROM (SELECT 1 AS layer, 'used_read' AS edge, path, unit, 4::BIGINT AS line, 'MV_S7' AS target, '1' AS detail FROM (SELECT {_UNIT} FROM part WHERE p_size = 7) ORDER BY path LIMIT 20)""")
def trace_parameter(t):
    """Uses of a parameter, counted by place (GRF-15, AGG-13)."""
    return lineage(_sources(t), "parameter", "MV_S7")


@query("""
SELECT 1 AS layer, 'defines_function' AS edge, 'src/7.prw' AS path, 'P7' AS unit, 1::BIGINT AS line, 'P7' AS target, 'user_function' AS detail FROM part WHERE p_partkey = 7
UNION ALL SELECT 1, 'arch_summary', 'src/7.prw', '', 0::BIGINT, w, '1' FROM part, (VALUES ('call'), ('table'), ('parameter')) v(w) WHERE p_partkey = 7""")
def trace_file(t):
    """What a file holds (GRF-14)."""
    return lineage(_sources(t), "file", "7.prw")


@query("""
SELECT * FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'critical' ELSE 'warning' END AS severity, 'source' AS kind, 'src/' || p_partkey || '.prw:1' AS location, 'P' || p_partkey AS detail
  FROM part WHERE p_size = 3 ORDER BY severity, location LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'critical', 'trigger', 'F' || p_partkey || '#1 -> F' || p_size AS location, 'depth=1' FROM part WHERE p_partkey = 3 OR p_partkey % 5 = 3 ORDER BY location LIMIT 50)""")
def impact_report(t):
    """Sources and triggers that a change of a field touches (GRF-03, 04, 06)."""
    name = lambda c: F.concat(F.lit("F"), F.col(c).cast("string"))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(name("p_size"), F.lit(" := 1"))).otherwise(F.concat(F.lit("x("), name("p_size"), F.lit(")")))
    path = F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".prw"))
    rows = t.part.select(path.alias("path"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("unit"), F.lit(1).cast("long").alias("line"), text.alias("text"))
    rule = F.concat(F.lit("F"), (F.col("p_partkey") % 5).cast("string"))
    triggers = t.part.select(name("p_partkey").alias("source"), F.lit("1").alias("seq"), name("p_size").alias("target"), rule.alias("rule"), F.lit("").alias("condition"))
    return impact(rows, {"sx7": triggers}, "F3")
