"""Catalogs of rows with arbitrary columns, held as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.registry import query


@query("""
SELECT event_type AS grp, count(*) AS n FROM events WHERE CAST(props->>'$.k' AS DOUBLE) > 50 AND event_type LIKE '%i%' GROUP BY 1 ORDER BY n DESC, grp""")
def catalog_group(t):
    """Catalog rows filtered by the safe language, grouped and counted (CAT-01, CAT-02, AGG-10)."""
    from ferrule.rules.decisions import parse_filter

    rows = t.events.select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return rows.where(parse_filter("k > 50 and event_type like %I%")).groupBy(F.col("event_type").alias("grp")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grp")


@query("""
SELECT coalesce(nullif(CASE props->>'$.k' WHEN '1' THEN 'one' WHEN '2' THEN 'two' ELSE props->>'$.k' END, ''), '(empty)') AS label, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, label""")
def catalog_decode(t):
    """Counts by a decoded field (AGG-10)."""
    from ferrule.operators.tabular import decode_enum

    k = decode_enum(F.lit("1=one;2=two"), F.get_json_object("props", "$.k"))
    return t.events.groupBy(F.coalesce(F.nullif(k, F.lit("")), F.lit("(empty)")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query("""
SELECT u AS unit, n, p_brand AS file FROM (SELECT CAST(regexp_extract(p_name || '(' || l_partkey || ')', '[(]([0-9]+)[)]', 1) AS BIGINT) AS u, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) LEFT JOIN part ON p_partkey = u""")
def catalog_callers(t):
    """Call expressions resolved to the file that defines the unit (AGG-11)."""
    expr = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat("p_name", F.lit("("), F.col("l_partkey").cast("string"), F.lit(")")).alias("e"))
    n = expr.groupBy(F.regexp_extract("e", "[(]([0-9]+)[)]", 1).cast("long").alias("unit")).agg(F.count("*").alias("n"))
    return n.join(t.part, F.col("p_partkey") == F.col("unit"), "left").select("unit", "n", F.col("p_brand").alias("file"))


@query("""SELECT event_type AS alias, count(*) AS n_rows, min(ts) AS first_row FROM events GROUP BY 1""")
def catalog_list(t):
    """Catalogs with their sizes (LKP-22, SRC-14)."""
    return t.events.groupBy(F.col("event_type").alias("alias")).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_row"))
