"""Look-ups, counts, joins and windows on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.operators import tabular as O
from ferrule.registry import query


@query("""
SELECT CAST(l_partkey AS BIGINT) AS callee, count(*) AS n_calls, count(DISTINCT l_suppkey) AS n_files,
       count(DISTINCT concat(l_suppkey, '::', l_linenumber)) AS n_units
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 5)
GROUP BY 1 ORDER BY n_calls DESC, callee LIMIT 20""")
def hotspots(t):
    """Most called units, natives excluded (AGG-01, JOI-09)."""
    calls = t.lineitem.select(F.col("l_partkey").alias("callee"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("caller"))
    return O.hotspots(calls, t.part.where("p_size <= 5").select(F.col("p_partkey").alias("callee")))


@query("""
SELECT coalesce(nullif(source, ''), '(none)') AS grp, count(*) AS total,
       CAST(sum(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS covered,
       round(CAST(100.0 AS DOUBLE) * sum(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) / count(*), 1) AS pct
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def doc_coverage(t):
    """Documentation coverage by source, worst first (AGG-02, JOI-04)."""
    rows = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return O.coverage(rows, F.col("source"), F.col("has").isNotNull())


@query("""
SELECT p_name AS name, count(DISTINCT p_brand) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS members
FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2""")
def duplicate_targets(t):
    """Targets that two or more files share (AGG-04)."""
    return O.duplicated_targets(t.part.withColumnRenamed("p_name", "name"), "name", "p_brand")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, kind LIMIT 3")
def top_modules(t):
    """Most frequent groups (AGG-05)."""
    return O.top_groups(t.events.withColumnRenamed("event_type", "kind"), "kind", 3)


@query("""
SELECT 'part' AS table_name, count(*) AS n_rows FROM part UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region""")
def dictionary_status(t):
    """Row counts of the dictionary tables (AGG-06, AGG-07)."""
    return O.row_counts({n: getattr(t, n) for n in ("part", "customer", "supplier", "orders", "nation", "region")})


@query("""
SELECT 'orphan_orders' AS check_name, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'unlabelled_documents', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'empty_documents', count(*) FROM documents WHERE length(trim(coalesce(text, ''))) = 0
UNION ALL SELECT 'duplicate_urls', count(*) FROM (SELECT url FROM pages GROUP BY url HAVING count(*) > 1)
UNION ALL SELECT 'unused_parts', count(*) FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)""")
def health_checks(t):
    """Health checks as one-row aggregates (AGG-08, JOI-07)."""
    checks = {
        "orphan_orders": t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "unlabelled_documents": t.documents.join(t.labels, "doc_id", "left_anti"),
        "empty_documents": t.documents.where(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0),
        "duplicate_urls": t.pages.groupBy("url").count().where("count > 1"),
        "unused_parts": t.part.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"), "left_anti"),
    }
    return O.row_counts(checks).toDF("check_name", "n")


@query("""
WITH s AS (SELECT DISTINCT p_brand AS brand, lower(p_name) AS nm FROM part),
f AS (SELECT brand, k AS len, substr(nm, 1, k) AS prefix, count(*) AS n FROM s, (SELECT unnest([6, 5, 4, 3]) AS k) WHERE length(nm) >= k GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT brand, prefix, n FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.brand = f.brand AND g.len > f.len AND starts_with(g.prefix, f.prefix))""")
def prefix_groups(t):
    """Names of a file that share a prefix, longest first (AGG-14, MOD-003)."""
    return O.prefix_groups(t.part.withColumnRenamed("p_brand", "brand"), "brand", "p_name")


@query("""
SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, turn) AS end_line FROM conversations""")
def unit_ranges(t):
    """Ranges of units: each ends before the next begins (WIN-03)."""
    return O.ranges(t.conversations.select("conv_id", "turn"), "conv_id", "turn", F.col("turn"))


@query("""
WITH c AS (SELECT c_custkey, c_nationkey, c_nationkey * 500.0 AS low, c_nationkey * 500.0 + 20000 + c_custkey % 97 * 100 AS high FROM customer)
SELECT o_orderkey AS point, (SELECT min({'size': CAST(high AS BIGINT) - CAST(low AS BIGINT), 'span': c_custkey}).span FROM c WHERE CAST(o_totalprice AS BIGINT) BETWEEN CAST(low AS BIGINT) AND CAST(high AS BIGINT)) AS span
FROM orders WHERE span IS NOT NULL""")
def innermost_owner(t):
    """The smallest enclosing range of each point (JOI-13)."""
    low = (F.col("c_nationkey") * 500).cast("long")
    spans = t.customer.select(F.col("c_custkey").alias("span"), low.alias("low"), (low + 20000 + F.col("c_custkey") % 97 * 100).alias("high"))
    return O.innermost(t.orders.select(F.col("o_orderkey").alias("point"), F.round("o_totalprice", 0).cast("long").alias("at")), spans, 10000)


@query("""
SELECT doc_id, CASE WHEN l IS NULL THEN 'deleted' WHEN d IS NULL THEN 'new' WHEN l > d THEN 'stale' ELSE 'fresh' END AS state
FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.n AS d, b.n AS l
      FROM (SELECT doc_id, n_chars % 3 AS n FROM documents) a
      FULL JOIN (SELECT doc_id, quality + toxic AS n FROM labels) b USING (doc_id))""")
def stale_check(t):
    """Stored against listed: deleted, new, stale, fresh (LKP-21, JOI-19, SRC-07)."""
    return O.compare_listing(t.documents.select("doc_id", (F.col("n_chars") % 3).alias("n")), t.labels.select("doc_id", (F.col("quality") + F.col("toxic")).alias("n")), "doc_id", "n")


@query("""
SELECT user_id, event_type, event_id, value, n_rows FROM (
  SELECT user_id, event_type, event_id, value, count(*) OVER (PARTITION BY user_id, event_type) AS n_rows,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_dedup(t):
    """The last row of each key wins, lost rows counted (SRC-09, T11)."""
    return O.last_of_key(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""
SELECT a.p_partkey AS left_id, b.s AS right_id
FROM part a JOIN (SELECT p_partkey AS s, split_part(p_name, ' ', 2) || CASE WHEN p_size % 2 = 0 THEN '/' || p_brand ELSE '' END AS path FROM part) b
ON ('/' || p_type || '/' || split_part(p_name, ' ', 2) || '/' || p_brand) LIKE '%/' || b.path OR ('/' || b.path) LIKE '%/' || p_type || '/' || split_part(p_name, ' ', 2) || '/' || p_brand""")
def bridge_suffix(t):
    """Paths of which one ends with the other (JOI-06)."""
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    left = t.part.select(F.col("p_partkey").alias("left_id"), F.concat_ws("/", "p_type", word, "p_brand").alias("left_path"))
    right = t.part.select(F.col("p_partkey").alias("right_id"), F.concat(word, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/"), "p_brand")).otherwise("")).alias("right_path"))
    return O.suffix_bridge(left, right)


@query("""
SELECT c_custkey, c_name, CASE WHEN c_acctbal IS NULL THEN NULL ELSE CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END ||
  CASE WHEN abs(c_acctbal) < 1e3 THEN '<1k' WHEN abs(c_acctbal) < 1e4 THEN '1k-10k' WHEN abs(c_acctbal) < 1e5 THEN '10k-100k' WHEN abs(c_acctbal) < 1e6 THEN '100k-1M' WHEN abs(c_acctbal) < 1e7 THEN '1M-10M' WHEN abs(c_acctbal) < 1e8 THEN '10M-100M' ELSE '>=100M' END END AS amount_class
FROM customer""")
def bucket_amount(t):
    """Amounts as signed ranges (PRV-06)."""
    return t.customer.select("c_custkey", "c_name", X.amount_class(F.col("c_acctbal")).alias("amount_class"))


@query("""
SELECT file, tables FROM (SELECT n_name AS file, CASE WHEN len(l) = 0 THEN '' ELSE array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ', +' || CAST(len(l) - 3 AS VARCHAR) ELSE '' END END AS tables
FROM (SELECT n_name, coalesce((SELECT list(nm ORDER BY r, nm) FROM (SELECT c_mktsegment AS nm, -max(CASE WHEN c_acctbal > 9000 THEN 2 WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS r FROM customer WHERE c_nationkey = n_nationkey GROUP BY 1)), []) AS l FROM nation)) WHERE upper(file) LIKE 'N%'""")
def family_top_tables(t):
    """Files of a family with their most relevant tables (LKP-05)."""
    refs = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("file"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_acctbal") > 9000, 2).when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("relevance"))
    return O.family(t.nation.select(F.col("n_name").alias("file")), refs, "N")


@query("""
SELECT p_partkey AS id, 'unused' AS finding FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)
UNION ALL SELECT l_suppkey, 'target_missing' FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0))
UNION ALL SELECT DISTINCT o_custkey, 'value_not_listed' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus NOT IN ('F', 'O') AND c_mktsegment = 'BUILDING'""")
def referential_lints(t):
    """Cross-table findings: unused, dangling, not in the list (SX-002, SX-003, SX-011, JOI-10, JOI-14)."""
    unused = t.part.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.col("p_partkey").alias("id"), F.lit("unused").alias("finding"))
    known = t.supplier.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    dangling = O.unknown(t.lineitem.select("l_suppkey").distinct(), known, ["l_suppkey"]).select(F.col("l_suppkey").alias("id"), F.lit("target_missing").alias("finding"))
    odd = t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).where(~F.array_contains(F.array(F.lit("F"), F.lit("O")), F.col("o_orderstatus"))).select(F.col("o_custkey").alias("id"), F.lit("value_not_listed").alias("finding")).distinct()
    return unused.unionByName(dangling).unionByName(odd)


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1)""")
def mixed_api_units(t):
    """Rows of scopes in which two exclusive conditions occur (BP-006)."""
    both = O.conflicts(t.lineitem, ["l_orderkey"], F.col("l_linestatus") == "O", F.col("l_linestatus") == "F")
    return t.lineitem.where("l_returnflag = 'R'").join(both, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""
WITH o AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT l_orderkey, l_linenumber AS line FROM (SELECT o.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM o) JOIN c USING (l_orderkey) WHERE k > n""")
def unmatched_locks(t):
    """Opens that no close is left for (BP-001, BP-002)."""
    marks = t.lineitem.where("l_returnflag <> 'R'").select("l_orderkey", F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "A").alias("is_open"))
    return O.unmatched_opens(marks, ["l_orderkey"])


@query("""
SELECT conv_id, turn FROM conversations a WHERE role = 'user' AND NOT EXISTS (
  SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn BETWEEN a.turn AND a.turn + 2 AND b.role = 'assistant' AND length(b.text) > 200)""")
def call_without_check(t):
    """Calls without a check in the next lines (BP-003, BP-004, WS-002)."""
    lines = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("n"))
    return O.near_miss(lines, "conv_id", "turn", F.col("role") == "user", (F.col("role") == "assistant") & (F.col("n") > 200), 2).select("conv_id", "turn")


@query("""
SELECT p_type AS kind, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, CAST(max(p_size) AS INT) AS most FROM part
WHERE p_size >= 10 GROUP BY 1 ORDER BY total DESC, kind""")
def metrics_by_kind(t):
    """Metrics above thresholds, summed and sorted (AGG-03, AGG-12)."""
    return t.part.where("p_size >= 10").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total"), F.max("p_size").alias("most")).orderBy(F.desc("total"), "kind")


@query("""
SELECT n_name AS name, r_name AS grp, coalesce(n, 0) AS n_fields, coalesce(balance, 0) AS balance
FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def group_field_counts(t):
    """Counts by group joined back to the groups (SRC-12, SRC-13, JOI-12)."""
    n = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(n, "n_nationkey", "left").select(F.col("n_name").alias("name"), F.col("r_name").alias("grp"), F.coalesce("n", F.lit(0)).alias("n_fields"), F.coalesce("balance", F.lit(0.0)).alias("balance"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'C(' || p_size || ')' WHEN p_size % 2 = 0 THEN 'N(' || p_size || ',2)' ELSE 'D(8)' END AS type_text,
  CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'PROMO' THEN 'offer' WHEN 'LARGE' THEN 'big=xl' ELSE p_type END AS meaning FROM part""")
def field_catalog(t):
    """Fields with formatted types and decoded enumerations (LKP-07, LKP-20)."""
    size = F.col("p_size").cast("string")
    kind = F.when(F.col("p_size") > 40, F.concat(F.lit("C("), size, F.lit(")"))).when(F.col("p_size") % 2 == 0, F.concat(F.lit("N("), size, F.lit(",2)"))).otherwise("D(8)")
    return t.part.select("p_partkey", kind.alias("type_text"), O.decode_enum(F.lit("ECONOMY=low;PROMO=offer;LARGE=big=xl"), F.col("p_type")).alias("meaning"))


@query("""
SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%widget%' AND regexp_matches(p_brand, '^Brand#1[^/]*$') ORDER BY p_name, p_partkey LIMIT 200""")
def find_file(t):
    """Files by substring and glob, filtered before the limit (LKP-02, SRC-02, T4)."""
    return t.part.where(X.contains_ci(F.col("p_name"), "WIDGET") & F.col("p_brand").rlike(X.glob_regex("Brand#1*"))).orderBy("p_name", "p_partkey").limit(200).select("p_partkey", "p_name")


@query("""
SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS name FROM supplier WHERE s_name LIKE '%00001%'""")
def find_any(t):
    """Cascade: the first kind that has a hit (LKP-03, LKP-04)."""
    parts = t.part.where(X.contains_ci(F.col("p_name"), "nosuchword")).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    suppliers = t.supplier.where(F.col("s_name").contains("00001")).select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    customers = t.customer.where(F.col("c_name").contains("00001")).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return O.first_found(parts, suppliers, customers)


@query("""
SELECT o_orderkey, o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning' ELSE 'info' END AS severity, c_mktsegment AS title
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 2 END, o_orderkey LIMIT 500""")
def findings_listed(t):
    """Findings joined to their rules, most severe first (LKP-11, LKP-17, JOI-02, JOI-03, SRT-01)."""
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "warning").otherwise("info")
    found = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return found.select("o_orderkey", "o_orderstatus", severity.alias("severity"), F.col("c_mktsegment").alias("title")).orderBy(X.severity_rank(F.col("severity")), "o_orderkey").limit(500)


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag AS mode FROM lineitem WHERE l_suppkey = 7 AND l_returnflag IN ('A', 'R')""")
def tables_by_mode(t):
    """References to a table by mode; ``write`` stands for several (LKP-06, LKP-08, LKP-12, LKP-13)."""
    modes = {"write": ["A", "R"], "read": ["N"]}
    return t.lineitem.where((F.col("l_suppkey") == 7) & F.col("l_returnflag").isin(modes["write"])).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("mode"))


@query("""
SELECT p_partkey, p_brand, p_size FROM (SELECT *, CAST(replace(p_brand, 'Brand#', '') AS INT) * 1000 + p_size AS v FROM part) WHERE v BETWEEN 5010 AND 12003""")
def version_window(t):
    """Dotted versions within a window (EXT-23, BUILD-001)."""
    key = X.version_key(F.concat(F.regexp_replace("p_brand", "Brand#", ""), F.lit("."), F.col("p_size").cast("string")))
    return t.part.where((key >= F.array(F.lit(5), F.lit(10))) & (key <= F.array(F.lit(12), F.lit(3)))).select("p_partkey", "p_brand", "p_size")


@query("""
SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus = 'F' AS taken,
  CASE WHEN o_totalprice > 100000 THEN 'above' WHEN o_totalprice = 100000 THEN 'equal' ELSE 'below' END || ':' || o_orderstatus AS why FROM orders""")
def decision_eval(t):
    """Comparisons of a condition evaluated on records, with what decided (EXT-24, EXT-25)."""
    from ferrule.rules.decisions import evaluate

    return evaluate(t.orders, [("o_totalprice", ">", 100000.0), ("o_orderstatus", "=", "F")]).select("o_orderkey", "taken", F.concat(F.when(F.col("o_totalprice") > 100000, "above").when(F.col("o_totalprice") == 100000, "equal").otherwise("below"), F.lit(":"), "o_orderstatus").alias("why"))


@query("""
SELECT path, root FROM (SELECT path, CASE WHEN starts_with(path, 'STANDARD/Brand#1/') THEN 'STANDARD/Brand#1/' WHEN starts_with(path, 'STANDARD/') THEN 'STANDARD/' WHEN starts_with(path, 'PROMO/') THEN 'PROMO/' END AS root
FROM (SELECT p_type || '/' || p_brand || '/' || p_partkey AS path FROM part))""")
def project_of_file(t):
    """The longest project folder that holds each file (JOI-15, EXT-21)."""
    roots = t.part.where("p_brand = 'Brand#1' and p_type = 'STANDARD'").select(F.explode(F.array(F.lit("STANDARD/Brand#1/"), F.lit("STANDARD/"), F.lit("PROMO/"))).alias("root"))
    return O.longest_prefix(t.part.select(F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")).alias("path")), roots)


@query("""
SELECT c_custkey AS id, CASE WHEN n.n_nationkey IS NULL THEN 'unknown' ELSE 'known' END AS state, count(*) OVER (PARTITION BY c_mktsegment) AS n_rule
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n.n_nationkey""")
def counted_findings(t):
    """Findings with the number of their rule (WIN-01, JOI-01)."""
    known = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("known"))
    rows = t.customer.join(known, "c_nationkey", "left").select(F.col("c_custkey").alias("id"), F.when(F.col("known"), "known").otherwise("unknown").alias("state"), "c_mktsegment")
    return O.counted(rows, ["c_mktsegment"], "n_rule").select("id", "state", "n_rule")
