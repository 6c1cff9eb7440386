"""Call graph, lineage and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import graph as G
from ferrule.registry import query


def _calls(t):
    unit = lambda c: F.concat(F.lit("U_F"), F.col(c).cast("string"))
    return t.lineitem.select(F.concat(F.lit("src/F"), F.col("l_suppkey").cast("string"), F.lit(".prw")).alias("file"), unit("l_linenumber").alias("caller"), F.col("l_orderkey").alias("line"), unit("l_partkey").alias("callee"))


@query("""
SELECT 'src/F' || l_suppkey || '.prw' AS file, 'U_F' || l_linenumber AS caller, l_orderkey AS line, 'U_F' || l_partkey AS callee, l_linenumber = 7 OR l_suppkey = 7 AS is_self_call
FROM lineitem WHERE l_partkey = 7""")
def callers(t):
    """Who calls a unit (GRF-01)."""
    return G.callers(_calls(t), "u_f7")


@query("""
SELECT 'src/F' || l_suppkey || '.prw' AS file, 'U_F' || l_linenumber AS caller, l_orderkey AS line, 'U_F' || l_partkey AS callee FROM lineitem WHERE l_suppkey = 7""")
def callees(t):
    """What a file calls (GRF-02)."""
    return G.callees(_calls(t), "src/f7.prw")


_EDGES = """SELECT p_partkey AS src, (p_partkey * 7 + p_size) % (SELECT count(*) FROM part) AS dst FROM part WHERE p_size > 10
UNION ALL SELECT p_partkey, (p_partkey * 3 + 1) % (SELECT count(*) FROM part) FROM part"""


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_name = 'red widget' AND p_size = 28 UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.node WHERE level < 3)
SELECT node, min(level) AS level FROM r GROUP BY 1""")
def trigger_chain(t):
    """Triggers reached from a field within three steps (GRF-06)."""
    return G.reach(_edges(t), t.part.where("p_name = 'red widget' and p_size = 28").select(F.col("p_partkey").alias("node")), 3)


@query(f"""
WITH RECURSIVE d AS ({_EDGES}), e AS (SELECT * FROM d UNION SELECT dst, src FROM d), r AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_name = 'red widget' AND p_size = 28 UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.node WHERE level < 3)
SELECT node, min(level) AS level FROM r GROUP BY 1""")
def trigger_network(t):
    """Triggers around a field in both directions (GRF-08)."""
    return G.reach(_edges(t), t.part.where("p_name = 'red widget' and p_size = 28").select(F.col("p_partkey").alias("node")), 3, both_ways=True)


def _edges(t):
    n = t.part.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))  # one row
    key = F.col("p_partkey")
    ends = F.array_compact(F.array(F.when(F.col("p_size") > 10, (key * 7 + F.col("p_size")) % F.col("n")), (key * 3 + 1) % F.col("n")))
    return t.part.withColumn("one", F.lit(1)).join(F.broadcast(n), "one").select(key.alias("src"), F.explode(ends).alias("dst"))


@query("""
SELECT * FROM (SELECT 1 AS layer, 'has_customer' AS edge, CAST(c_custkey AS VARCHAR) AS target, c_mktsegment AS detail FROM customer WHERE c_nationkey = 3 ORDER BY target, detail LIMIT 20)
UNION ALL SELECT * FROM (SELECT 2, 'has_supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE s_nationkey = 3 ORDER BY 3, 4 LIMIT 20)
UNION ALL SELECT * FROM (SELECT 2, 'in_region', r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 3)
UNION ALL SELECT * FROM (SELECT 3, 'orders', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 ORDER BY 3, 4 LIMIT 20)""")
def trace_entity(t):
    """Lineage of one entity over several kinds of edges, each capped (GRF-09..16, SRT-02)."""
    own = t.customer.where("c_nationkey = 3")
    edges = {
        "has_customer": own.select(F.col("c_custkey").cast("string").alias("target"), F.col("c_mktsegment").alias("detail")),
        "has_supplier": t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").cast("string").alias("target"), F.col("s_name").alias("detail")),
        "in_region": t.nation.where("n_nationkey = 3").join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("target"), F.col("n_name").alias("detail")),
        "orders": t.orders.join(own, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("target"), F.col("o_orderstatus").alias("detail")),
    }
    return G.trace(edges, 20, {"has_customer": 1, "has_supplier": 2, "in_region": 2, "orders": 3})


@query("""
SELECT CASE WHEN EXISTS (SELECT 1 FROM region WHERE r_name = 'NATION_3') THEN 'region' WHEN EXISTS (SELECT 1 FROM part WHERE p_name = 'no such part') THEN 'part'
  WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3) THEN 'nation' WHEN EXISTS (SELECT 1 FROM customer) THEN 'customer' ELSE 'unknown' END AS kind""")
def entity_kind(t):
    """What kind of thing a name is: the first table that knows it (GRF-10)."""
    return G.entity_kind({"region": t.region.where("r_name = 'NATION_3'"), "part": t.part.where("p_name = 'no such part'"), "nation": t.nation.where("n_nationkey = 3"), "customer": t.customer}, "unknown")


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9_])red([^A-Za-z0-9_]|$)') THEN 'p_name' END, CASE WHEN regexp_matches(p_type, '(?i)(^|[^A-Za-z0-9_])red([^A-Za-z0-9_]|$)') THEN 'p_type' END], lambda x: x IS NOT NULL), ',') AS slots
FROM part WHERE regexp_matches(p_name || ' ' || p_type, '(?i)(^|[^A-Za-z0-9_])red([^A-Za-z0-9_]|$)')""")
def impact_slots(t):
    """Dictionary rows that mention a field, and where (GRF-05, GRF-07)."""
    return G.impact_in_slots(t.part, ["p_partkey"], ["p_name", "p_type"], "RED")


@query("""
WITH c AS (SELECT user_id, event_type, event_id FROM events WHERE value > 90),
a AS (SELECT user_id, event_type, min(event_id) AS hit FROM c GROUP BY 1, 2), b AS (SELECT user_id, min(event_id) AS hit FROM c GROUP BY 1)
SELECT e.event_id, CASE WHEN a.hit IS NOT NULL THEN 'both' WHEN b.hit IS NOT NULL THEN 'thread' ELSE 'none' END AS match, coalesce(a.hit, b.hit) AS hit
FROM events e LEFT JOIN a USING (user_id, event_type) LEFT JOIN b USING (user_id)""")
def correlate(t):
    """Events matched to findings by the best key that agrees (JOI-18, LOG-11)."""
    found = t.events.where("value > 90").select("user_id", "event_type", F.col("event_id").alias("hit"))
    rows = t.events.select("event_id", "user_id", "event_type")
    return G.priority_match(rows, found, [("both", ["user_id", "event_type"]), ("thread", ["user_id"])], ["hit"], F.col("hit")).select("event_id", "match", "hit")
