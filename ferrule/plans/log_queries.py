"""Log triage and configuration scoring on events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.operators import tabular as O
from ferrule.registry import query


@query("""
SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'R1' WHEN event_type = 'error' THEN 'R2' WHEN value > 80 THEN 'R3' END AS rule_id,
  CASE WHEN event_type = 'error' AND value > 50 THEN 'critical' WHEN event_type = 'error' THEN 'warning' WHEN value > 80 THEN 'warning' END AS severity
FROM events WHERE event_type = 'error' OR value > 80""")
def first_match_rules(t):
    """The first rule that fires on each event (LOG-06, WIN-02, EXT-26)."""
    error = F.col("event_type") == "error"
    return O.first_match(t.events, [("R1", "critical", error & (F.col("value") > 50)), ("R2", "warning", error), ("R3", "warning", F.col("value") > 80)], ["event_id"])


@query("""
SELECT event_id, (SELECT min({'priority': priority, 'rule_id': rule_id}).rule_id FROM (VALUES (1, 'K9', '"k": 9[0-9]'), (2, 'K5', '"k": 5'), (3, 'ANY9', '9')) r(priority, rule_id, pattern) WHERE regexp_matches(props, pattern)) AS rule_id
FROM events WHERE rule_id IS NOT NULL""")
def rule_table_match(t):
    """As first_match_rules, with the rules in a small table (LOG-06, LOG-10)."""
    rules = t.spark.createDataFrame([(1, "K9", '"k": 9[0-9]'), (2, "K5", '"k": 5'), (3, "ANY9", "9")], "priority int, rule_id string, pattern string")
    return O.first_match_table(t.events, rules, "props", ["event_id"])


@query("""
SELECT e.event_id, coalesce(p.tip, f.tip) AS tip FROM events e
LEFT JOIN (VALUES ('error', 'look at the log'), ('purchase', 'check the payment')) f(category, tip) ON f.category = e.event_type
LEFT JOIN (VALUES ('error', 'restart', 95.0)) p(category, tip, least) ON p.category = e.event_type AND e.value >= p.least WHERE e.event_type IN ('error', 'purchase')""")
def tip_lookup(t):
    """The first tip whose pattern fits, else the tip of the category (LOG-07)."""
    fallback = F.create_map(F.lit("error"), F.lit("look at the log"), F.lit("purchase"), F.lit("check the payment"))
    own = F.when((F.col("event_type") == "error") & (F.col("value") >= 95), "restart")
    return t.events.where(F.col("event_type").isin("error", "purchase")).select("event_id", F.coalesce(own, fallback[F.col("event_type")]).alias("tip"))


@query("""
SELECT event_id, event_type FROM (SELECT *, max(ts) OVER (PARTITION BY event_type) AS last FROM events) WHERE ts IS NULL OR ts >= last - INTERVAL 24 HOUR""")
def since_window(t):
    """Events within a day of the last of their kind (LOG-05, T6)."""
    return O.since(t.events.select("event_id", "event_type", "ts"), "event_type", "ts", 86400).select("event_id", "event_type")


@query("""
SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM events""")
def log_sessions(t):
    """Lines numbered by the headers before them (LOG-02, WIN-05)."""
    return O.sessions(t.events.select("event_id", "user_id", "event_type", "ts"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "user_id", "session_no")


@query("""
SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'error') WHERE k <= 3""")
def newest_findings(t):
    """The newest findings of each file, a given number (LOG-09)."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = t.events.where("event_type = 'error'").withColumn("k", F.row_number().over(newest))
    return rows.where("k <= 3").select("event_id", "user_id", "ts")


@query("""
SELECT user_id, round(100.0::DOUBLE * greatest(0, least(1, sum(CASE WHEN value <= 90 THEN w ELSE 0 END) / sum(w))), 1) AS score,
  CASE WHEN sum(CASE WHEN value <= 90 THEN w ELSE 0 END) / sum(w) >= 0.85 THEN 'compliant' WHEN sum(CASE WHEN value <= 90 THEN w ELSE 0 END) / sum(w) >= 0.6 THEN 'partial' ELSE 'poor' END AS label
FROM (SELECT user_id, value, CASE event_type WHEN 'error' THEN 3.0::DOUBLE WHEN 'purchase' THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS w FROM events) GROUP BY 1""")
def config_score(t):
    """Weighted conformity score and label (INI-05, INI-07, INI-09, INI-10)."""
    from ferrule.rules.config_audit import score

    rows = t.events.select("user_id", (F.col("value") <= 90).alias("ok"), F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info").alias("severity"))
    return score(rows, ["user_id"])


@query("""
SELECT event_id, CASE WHEN value BETWEEN 10 AND 50 THEN 'ok' WHEN value IS NULL THEN 'missing' ELSE 'out_of_range' END AS state,
  event_type IN ('view', 'click') AS listed, json_extract_string(props, '$.k') = '7' AS is_seven FROM events""")
def value_checks(t):
    """Range, list and equality checks of values (INI-05)."""
    from ferrule.rules.config_audit import value_ok

    in_range = value_ok(F.lit("range_check"), F.col("value").cast("string"), F.lit("10..50"))
    state = F.when(F.col("value").isNull(), "missing").when(in_range, "ok").otherwise("out_of_range")
    return t.events.select("event_id", state.alias("state"), value_ok(F.lit("value_in"), F.col("event_type"), F.lit("view|click")).alias("listed"), value_ok(F.lit("value_eq"), F.get_json_object("props", "$.k"), F.lit("7")).alias("is_seven"))


@query("""
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 2) AS total, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_high FROM events GROUP BY 1, 2""")
def findings_summary(t):
    """Findings by category and hour (AGG-12, LOG-10)."""
    return t.events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("n_high"))


@query("""
SELECT event_id FROM events WHERE NOT regexp_matches(event_type || props, 'view|"k": 1[0-9]')""")
def noise_filter(t):
    """Events that no noise pattern fits (LOG-04)."""
    return t.events.where(~F.concat("event_type", "props").rlike('view|"k": 1[0-9]')).select("event_id")
