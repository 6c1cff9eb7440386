"""Extractors of source, configuration and log texts, run on the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.registry import query
from ferrule.rules import static
from ferrule.sources import code

_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
#: In the documents a line that starts so stands for a unit's declaration.
_HEADS = (("start", r"^(The|Of|In|On|And) (\w+)", 2, 1), ("other", r"^(Er\w*) (\w+)", 2, 1))


def _rows(t):
    return static.lines(t.documents.select("doc_id", "text"), ["doc_id"])


@query(f"""
SELECT doc_id, line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, last) AS end_line, kind, name, class FROM (
  SELECT doc_id, line, max(line) OVER (PARTITION BY doc_id) AS last, CASE WHEN regexp_matches(l, '^(The|Of|In|On|And) ([0-9A-Za-z_]+)') THEN 'start' WHEN regexp_matches(l, '^(Er[0-9A-Za-z_]*) ([0-9A-Za-z_]+)') THEN 'other' END AS kind,
    CASE WHEN regexp_matches(l, '^(The|Of|In|On|And) ([0-9A-Za-z_]+)') THEN regexp_extract(l, '^(The|Of|In|On|And) ([0-9A-Za-z_]+)', 2) ELSE regexp_extract(l, '^(Er[0-9A-Za-z_]*) ([0-9A-Za-z_]+)', 2) END AS name,
    CASE WHEN regexp_matches(l, '^(The|Of|In|On|And) ([0-9A-Za-z_]+)') THEN regexp_extract(l, '^(The|Of|In|On|And) ([0-9A-Za-z_]+)', 1) ELSE regexp_extract(l, '^(Er[0-9A-Za-z_]*) ([0-9A-Za-z_]+)', 1) END AS class
  FROM {_LINES}) WHERE kind IS NOT NULL""")
def source_units(t):
    """Declared units with their ranges (EXT-01, WIN-03)."""
    return code.units(_rows(t), "doc_id", _HEADS)


@query(f"""
SELECT doc_id, line, kind, value FROM (
  SELECT doc_id, line, 'mail' AS kind, unnest(regexp_extract_all(l, '([A-Za-z0-9._-]+)@[A-Za-z]', 1)) AS value FROM {_LINES}
  UNION ALL SELECT doc_id, line, 'number', unnest(regexp_extract_all(l, '[(]([0-9]+)[)]', 1)) FROM {_LINES}
  UNION ALL SELECT doc_id, line, 'assign', unnest(regexp_extract_all(l, '([a-z_]+) ?= ?', 1)) FROM {_LINES})""")
def source_calls(t):
    """Facts of lines by pattern: references, parameters, calls (EXT-02..08, EXT-10, EXT-12, EXT-17)."""
    return code.facts(_rows(t), "doc_id", {"mail": r"([A-Za-z0-9._-]+)@[A-Za-z]", "number": r"[(]([0-9]+)[)]", "assign": r"([a-z_]+) ?= ?"})


@query(f"""
SELECT doc_id, unit, count(*) AS n_lines FROM (SELECT doc_id, last_value(u IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS unit FROM (
  SELECT doc_id, line, CASE WHEN regexp_matches(l, '^(The|Of|In|On|And) ([0-9A-Za-z_]+)') THEN regexp_extract(l, '^(The|Of|In|On|And) ([0-9A-Za-z_]+)', 2) WHEN regexp_matches(l, '^(Er[0-9A-Za-z_]*) ([0-9A-Za-z_]+)') THEN regexp_extract(l, '^(Er[0-9A-Za-z_]*) ([0-9A-Za-z_]+)', 2) END AS u FROM {_LINES}))
WHERE unit IS NOT NULL GROUP BY ALL""")
def unit_sizes(t):
    """Lines of each unit (EXT-22, AGG-09)."""
    return code.with_unit(_rows(t), "doc_id", _HEADS).where("unit is not null").groupBy("doc_id", "unit").agg(F.count("*").alias("n_lines"))


@query(f"""
SELECT doc_id, line, rule_id, severity, snippet FROM (
  SELECT doc_id, line, substr(trim(l, ' '), 1, 200) AS snippet, unnest(list_filter([CASE WHEN regexp_matches(l, '(?i)idiot|moron') THEN {{'rule_id': 'R1', 'severity': 'warning'}} END, CASE WHEN regexp_matches(l, '=') AND NOT regexp_matches(l, 'token') THEN {{'rule_id': 'R2', 'severity': 'info'}} END], lambda x: x IS NOT NULL), recursive := true) FROM {_LINES})""")
def line_findings(t):
    """Every rule that fires on a line (MOD-001, MOD-002, PERF-001, SQL-002, ...)."""
    return static.line_findings(_rows(t), "doc_id", (("R1", "warning", "(?i)idiot|moron", None), ("R2", "info", "=", "token")))
