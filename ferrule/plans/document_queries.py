"""Text search, extraction, metrics, masking and single-document findings, on documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.operators import search as S
from ferrule.operators import tabular as O
from ferrule.registry import query

_SPACED = "' ' || regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g') || ' '"
_FLAT = "' ' || regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g') || ' '"


@query("""
SELECT doc_id, source, substr(text, greatest(1, instr(lower(text), 'thing') - 30), 200) AS snippet FROM documents WHERE contains(lower(text), 'thing')""")
def grep_literal(t):
    """Literal search, regardless of case (TXT-02)."""
    return S.grep_literal(t.documents.select("doc_id", "source", "text"), "Thing").drop("text")


@query(f"""
SELECT doc_id, substr(text, greatest(1, instr({_FLAT}, ' idiot ') - 30), 200) AS snippet
FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])idiot([^A-Za-z0-9_]|$)')""")
def grep_identifier(t):
    """Whole identifiers (TXT-03, TXT-04)."""
    return S.grep_identifier(t.documents.select("doc_id", "text"), "U_IDIOT").drop("text")


@query(f"""
SELECT doc_id, substr(text, greatest(1, instr({_FLAT}, ' the ') - 30), 200) AS snippet FROM documents
WHERE (contains({_SPACED}, ' the ') AND contains({_SPACED}, ' of the ')) OR contains({_SPACED}, ' moron ')""")
def grep_words(t):
    """Words, phrases and OR (TXT-01)."""
    return S.grep_words(t.documents.select("doc_id", "text"), 'the "of the" OR moron').drop("text")


@query(f"""
SELECT doc_id, CASE WHEN regexp_matches(s, '(?i)worthless|pathetic') THEN 'critical' WHEN regexp_matches(s, '(?i)trash') THEN 'warning' ELSE 'info' END AS severity, s AS snippet
FROM (SELECT doc_id, substr(text, greatest(1, instr({_FLAT}, ' with ') - 30), 160) AS s FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])with([^A-Za-z0-9_]|$)'))""")
def impact_text(t):
    """Where a field occurs in code, severity by what stands around it (GRF-03, GRF-04)."""
    from ferrule.operators.graph import impact_in_text

    return impact_in_text(t.documents.select("doc_id", "text"), "with", [("critical", r"(?i)worthless|pathetic"), ("warning", r"(?i)trash")])


@query("""
WITH t AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, 1 + len(list_filter(w, lambda x: x IN ('if', 'for', 'while', 'the', 'of'))) AS complexity, len(string_split(text, chr(10))) AS n_lines,
  len(regexp_extract_all(text, ',')) + 1 AS n_params FROM t""")
def unit_metrics(t):
    """Complexity, lines and parameters of units (EXT-22, AGG-03)."""
    from ferrule.functions.metrics import complexity

    return t.documents.select("doc_id", complexity(F.col("text"), ["if", "for", "while", "the", "of"]).cast("long").alias("complexity"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), (F.regexp_count("text", F.lit(",")) + 1).cast("long").alias("n_params"))


@query("""
SELECT page_id, list_reduce(list_prepend({'d': 0, 'm': 0}, list_transform(regexp_extract_all(html, '</?(?:ul|li|p|b|article|body)>'), lambda g: {'d': CASE WHEN g[2] = '/' THEN -1 ELSE 1 END, 'm': 0})),
  lambda a, x: {'d': greatest(0, a.d + x.d), 'm': greatest(a.m, a.d + x.d)}).m AS depth FROM pages""")
def max_nesting(t):
    """Deepest nesting, a fold over opens and closes (WIN-04)."""
    tags = F.regexp_extract_all("html", F.lit("</?(?:ul|li|p|b|article|body)>"), F.lit(0))
    return t.pages.select("page_id", O.nesting(F.transform(tags, lambda g: F.when(g.substr(2, 1) == "/", -1).otherwise(1))).alias("depth"))


@query("""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(bearer )[A-Za-z0-9._~+/-]{16,}=*', '\\1<secret>', 'g'),
  '(?i)((?:password|passwd|senha|token|api_?key|secret)[ ]*[=:][ ]*)[^\\s,;]+', '\\1<secret>', 'g'), '([a-z][a-z0-9+.-]*://)[^/\\s:@]+:[^/\\s:@]+@', '\\1<secret>@', 'g'),
  '\\b[0-9a-fA-F]{40,}\\b', '<hex>', 'g') AS text FROM documents""")
def redact_secrets(t):
    """Secrets replaced, pattern after pattern (PRV-04, EXT-28)."""
    return t.documents.select("doc_id", X.redact(F.col("text")).alias("text"))


@query(f"""
SELECT c_custkey, 'T_' || substr(sha256(unhex('{bytes(b ^ 0x5C for b in b'demo-key'.ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in b'demo-key'.ljust(64, bytes(1))).hex()}') || encode(c_name)))), 1, 10) AS token FROM customer""")
def mask_ids(t):
    """Identifiers as keyed tokens (PRV-02)."""
    return t.customer.select("c_custkey", F.concat(F.lit("T_"), F.substring(X.hmac_sha256(F.col("c_name"), b"demo-key"), 1, 10)).alias("token"))


@query("""
SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) AS emails,
  list_sort(list_distinct(list_filter(regexp_extract_all(text, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b'), lambda a: list_bool_and(list_transform(string_split(a, '.'), lambda o: CAST(o AS INT) <= 255))))) AS addresses
FROM documents WHERE regexp_matches(text, '@|\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.')""")
def recognise_ids(t):
    """E-mail and network addresses, octets checked (PRV-01)."""
    from ferrule.functions.masking import emails, ipv4

    rows = t.documents.where(F.col("text").rlike(r"@|\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\."))
    return rows.select("doc_id", F.array_sort(F.array_distinct(emails(F.col("text")))).alias("emails"), F.array_sort(F.array_distinct(ipv4(F.col("text")))).alias("addresses"))


@query("""
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)idiot|moron') THEN 'insult' END, CASE WHEN regexp_matches(text, '(?i)^the ') THEN 'start' END, CASE WHEN contains(text, '?') THEN 'question' END], lambda x: x IS NOT NULL), ',') AS hits
FROM conversations WHERE regexp_matches(text, '(?i)idiot|moron') OR regexp_matches(text, '(?i)^the ') OR contains(text, '?')""")
def injection_scan(t):
    """Patterns that a text holds, by name (PRV-07)."""
    hits = X.injection_hits(F.col("text"), {"insult": "(?i)idiot|moron", "start": "(?i)^the ", "question": r"[?]"})
    return t.conversations.select("conv_id", "turn", hits.alias("h")).where(F.size("h") > 0).select("conv_id", "turn", F.array_join("h", ",").alias("hits"))


@query("""
SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9-]*)', 1)) AS tag FROM pages)
WHERE tag NOT IN ('p', 'li', 'a', 'b', 'br', 'ul', 'div', 'html', 'head', 'body', 'title', 'meta') GROUP BY ALL""")
def ui_unknown_tag(t):
    """Elements used on pages that a catalog lacks (EXT-27, JOI-08)."""
    used = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9-]*)"), F.lit(1))).alias("tag"))
    known = F.split(F.lit("p li a b br ul div html head body title meta"), " ")
    return used.where(~F.array_contains(known, F.col("tag"))).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+(\\.html)?$') THEN '{id}' ELSE lower(s) END), '/') AS path FROM pages""")
def url_path_norm(t):
    """End points as normalised paths (EXT-07, EXT-27)."""
    from ferrule.functions.frontend import normal_path

    return t.pages.select("page_id", F.lower(F.regexp_extract("url", "^([a-z]+)://", 1)).alias("scheme"), normal_path(F.col("url")).alias("path"))


@query("""
SELECT page_id, lower(a) AS attr, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '([a-z]+)="[^"]*"', 1)) AS a FROM pages) GROUP BY ALL""")
def template_bindings(t):
    """Attributes bound in templates (EXT-27, SRC-17)."""
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('([a-z]+)="[^"]*"'), F.lit(1))).alias("a")).groupBy("page_id", F.lower("a").alias("attr")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, n_line AS line, substr(l, 1, 200) AS snippet FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n_line FROM documents)
WHERE regexp_matches(l, '(?i)(password|token|secret)[ ]*[=:]')""")
def hardcoded_secrets(t):
    """Lines that assign credentials (SEC-004)."""
    from ferrule.rules.static import lines

    return lines(t.documents.select("doc_id", "text"), ["doc_id"]).where(F.col("text").rlike("(?i)(password|token|secret)[ ]*[=:]")).select("doc_id", "line", F.substring("text", 1, 200).alias("snippet"))


@query("""
SELECT doc_id, line FROM (SELECT doc_id, line, max(CASE WHEN regexp_matches(l, '(?i)\\bthe\\b') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS doc, l
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)) WHERE regexp_matches(l, '^(On|In) ') AND coalesce(doc, 0) = 0""")
def undocumented_units(t):
    """Declarations without a header in the lines above (BP-007, LKP-15)."""
    from pyspark.sql import Window

    from ferrule.rules.static import lines

    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(-3, -1)
    rows = lines(t.documents.select("doc_id", "text"), ["doc_id"])
    return rows.withColumn("doc", F.max(F.when(F.col("text").rlike(r"(?i)\bthe\b"), 1).otherwise(0)).over(w)).where(F.col("text").rlike("^(On|In) ") & (F.coalesce("doc", F.lit(0)) == 0)).select("doc_id", "line")


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'utf-8' ELSE 'ascii' END AS encoding, lang, CASE WHEN lang = 'en' AND regexp_matches(text, '[^\\x00-\\x7F]') THEN 1 ELSE 0 END AS fired FROM documents""")
def encoding_check(t):
    """Encoding evidence and the finding that depends on it (ENC-001, INI-12, SRC-04)."""
    wide = F.col("text").rlike(r"[^\x00-\x7F]")
    return t.documents.select("doc_id", F.when(wide, "utf-8").otherwise("ascii").alias("encoding"), "lang", F.when((F.col("lang") == "en") & wide, 1).otherwise(0).alias("fired"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(text, '@') THEN 'MAIL' END, CASE WHEN regexp_matches(text, 'https?://') THEN 'HTTP' END, CASE WHEN regexp_matches(text, '(?i)\\btoken\\b') THEN 'AUTH' END, CASE WHEN length(text) > 5000 THEN 'LONG' END], lambda x: x IS NOT NULL)), ',') AS capabilities,
  CASE WHEN regexp_matches(text, 'https?://') THEN 'client' WHEN regexp_matches(text, '@') THEN 'mail' WHEN length(text) > 5000 THEN 'library' ELSE 'plain' END AS source_type FROM documents""")
def capabilities(t):
    """Capability tags and the first source type that fits (EXT-14, EXT-15)."""
    from ferrule.functions.metrics import tags

    c = F.col("text")
    found = {"MAIL": c.rlike("@"), "HTTP": c.rlike("https?://"), "AUTH": c.rlike(r"(?i)\btoken\b"), "LONG": F.length(c) > 5000}
    kind = F.when(found["HTTP"], "client").when(found["MAIL"], "mail").when(found["LONG"], "library").otherwise("plain")
    return t.documents.select("doc_id", F.array_join(tags(found), ",").alias("capabilities"), kind.alias("source_type"))
