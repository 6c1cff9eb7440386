"""Lineage of one entity over the fact tables of sources and the data dictionary: a filter for each edge, and one union.

Tables come by name in a dict: those of ``sources.facts.fact_tables`` and the exports of ``sources.dictionary``, and ``findings``.
An edge whose table isn't there is left out. Every function gives rows (layer, edge, path, unit, line, target, detail); a place
that an edge doesn't have is empty, its line 0. Nulls in a table's columns count as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import severity_rank, word_match
from ferrule.operators.graph import reach

Tables = dict[str, DataFrame]
#: Edges by the mode in which a source uses a table.
TABLE_EDGES = {"read": "reads", "write": "writes", "lock": "reclock", "model": "writes", "alias": "touches"}
#: Texts of a dictionary field that may call a function.
FIELD_SLOTS = ("validation", "init", "when_expr", "user_validation")


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "^U_", "")


def _edge(layer: int, edge: str | Column, rows: DataFrame, target: str | Column, detail: str | Column = "", line: Column | None = None) -> DataFrame:
    """One edge's rows; places are those columns of path, unit and line that the rows have."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    place = [text(F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in ("path", "unit")]
    at = F.col("line") if "line" in rows.columns else F.lit(0)
    return rows.select(F.lit(layer).alias("layer"), as_column(edge).alias("edge"), *place, F.coalesce(at if line is None else line, F.lit(0)).cast("long").alias("line"), text(as_column(target)).alias("target"), text(as_column(detail)).alias("detail"))


def _uses(refs: DataFrame, what: str, name: str) -> DataFrame:
    """Uses of a parameter or prompt by place and mode, with the first line and the number."""
    own = refs.where((F.col("what") == what) & (F.upper("value") == name))
    return own.groupBy("path", "unit", "kind").agg(F.min("line").alias("line"), F.count("*").alias("n"))


def _function(t: Tables, name: str) -> Iterator[DataFrame]:
    bare = name.removeprefix("U_")
    if "units" in t:
        own = t["units"].where(_bare(F.col("name")) == bare)
        of = F.when(F.col("class") != "", F.concat(F.lit(" of "), F.col("class"))).otherwise("")
        yield _edge(1, "defined_in", own.withColumn("unit", F.col("name")), F.col("name"), F.concat(F.col("kind"), of))
    if "refs" in t:
        calls = t["refs"].where("what = 'call'")
        caller = F.concat_ws("@", F.nullif("unit", F.lit("")), "path")
        yield _edge(1, "called_by", calls.where(_bare(F.col("value")) == bare), caller, F.col("kind"))
        yield _edge(1, "calls", calls.where(_bare(F.col("unit")) == bare).select("unit", "value", "kind").distinct(), F.col("value"), F.col("kind"))
    if "sx3" in t:
        slots = F.array(*[F.when(word_match(F.col(c), name), F.lit(c)) for c in FIELD_SLOTS if c in t["sx3"].columns])
        hits = t["sx3"].select("table_code", "field", F.explode(F.array_compact(slots)).alias("slot"))
        yield _edge(2, "validates_field", hits, F.concat_ws(".", "table_code", "field"), F.col("slot"))
    if "routine_calls" in t:
        yield _edge(3, "via_execauto", t["routine_calls"].where(_bare(F.col("routine")) == bare), name, F.concat_ws(" ", "module", "op_label"))
    if "triggers" in t:
        yield _edge(3, F.concat(F.lit("triggered_by_"), F.col("kind")), t["triggers"].where(_bare(F.col("value")) == bare), name, F.col("kind"))
    if "docs" in t:
        old = F.when(F.col("deprecated"), "deprecated")
        yield _edge(3, "documented_in", t["docs"].where(_bare(F.col("unit")) == bare), name, F.concat_ws(" ", F.nullif("author", F.lit("")), F.nullif("since", F.lit("")), old))


def _table(t: Tables, name: str) -> Iterator[DataFrame]:
    if "refs" in t:
        own = t["refs"].where((F.col("what") == "table") & (F.upper("value") == name))
        names = F.create_map(*[F.lit(x) for pair in TABLE_EDGES.items() for x in pair])
        yield _edge(1, names[F.col("kind")], own.groupBy("path", "unit", "kind").agg(F.min("line").alias("line")), name, F.col("kind"))
    if "sx2" in t:
        yield _edge(2, "table_definition", t["sx2"].where(F.upper("code") == name), name, F.col("name"))
    if "sx3" in t:
        counted = t["sx3"].where(F.upper("table_code") == name).agg(F.count("*").alias("n")).where("n > 0")
        yield _edge(2, "n_fields", counted, name, F.col("n"))
    if "six" in t:
        yield _edge(2, "indexed_by", t["six"].where(F.upper("table_code") == name), F.concat_ws(".", "table_code", "ord"), F.col("key"))
    if "sx9" in t:
        own = t["sx9"].where((F.upper("source") == name) | (F.upper("target") == name))
        yield _edge(2, "in_relationship", own, F.when(F.upper("source") == name, F.col("target")).otherwise(F.col("source")), F.concat_ws(" = ", "source_expr", "target_expr"))
    if "sx7" in t:
        yield _edge(2, "trigger_on_table", t["sx7"].where(F.upper("alias") == name), F.concat_ws("#", "source", "seq"), F.col("target"))
    if "routine_calls" in t:
        yield _edge(3, "touched_via_execauto", t["routine_calls"].where(F.array_contains("tables", name)), F.col("routine"), F.col("op_label"))
    if "docs" in t and "tables" in t["docs"].columns:
        yield _edge(3, "documented_in", t["docs"].where(F.array_contains("tables", name)), name, F.lit("@table"))


def _field(t: Tables, name: str) -> Iterator[DataFrame]:
    if "refs" in t:
        own = t["refs"].where((F.col("what") == "field") & (F.upper("value") == name))
        yield _edge(1, "references_field", own.groupBy("path", "unit").agg(F.min("line").alias("line"), F.count("*").alias("n")), name, F.col("n"))
    if "sx3" in t:
        own = t["sx3"].where(F.upper("field") == name)
        yield _edge(2, "field_definition", own, F.concat_ws(".", "table_code", "field"), F.concat_ws(" ", "type", "size"))
        if "field_group" in own.columns:
            yield _edge(2, "in_grupo_sxg", own.where("field_group <> ''"), F.col("field_group"), F.col("field"))
        if "sxb" in t:
            used = t["sxb"].select(F.upper("alias").alias("_alias")).distinct()
            yield _edge(2, "in_consulta", own.join(used, F.upper("lookup") == F.col("_alias"), "left_semi"), F.col("lookup"), F.col("field"))
    if "sx7" in t:
        yield _edge(2, "trigger_origin", t["sx7"].where(F.upper("source") == name), F.col("target"), F.col("rule"))
        yield _edge(2, "trigger_target", t["sx7"].where(F.upper("target") == name), F.col("source"), F.col("rule"))
    if "sx1" in t:
        hit = word_match(F.col("validation"), name) | (F.upper("lookup") == name)
        yield _edge(2, "in_pergunte", t["sx1"].where(hit), F.concat_ws(".", "grp", "ord"), F.col("prompt"))
    if "sx9" in t:
        hit = word_match(F.col("source_expr"), name) | word_match(F.col("target_expr"), name)
        yield _edge(2, "in_relationship", t["sx9"].where(hit), F.concat_ws("-", "source", "target"), F.concat_ws(" = ", "source_expr", "target_expr"))


def _file(t: Tables, name: str) -> Iterator[DataFrame]:
    own = {k: t[k].where(F.upper(F.element_at(F.split("path", "/"), -1)) == name.rsplit("/", 1)[-1]) for k in ("units", "refs", "findings", "routine_calls", "triggers", "docs") if k in t}
    if "units" in own:
        yield _edge(1, "defines_function", own["units"].withColumn("unit", F.col("name")), F.col("name"), F.col("kind"))
    if "refs" in own:
        counted = own["refs"].groupBy("path", "what").agg(F.count("*").alias("n"))
        yield _edge(1, "arch_summary", counted, F.col("what"), F.col("n"))
    if "findings" in own:
        yield _edge(1, "lint_finding", own["findings"], F.col("rule_id"), F.col("severity"))
    if "routine_calls" in own:
        yield _edge(3, "calls_execauto", own["routine_calls"], F.col("routine"), F.col("op_label"))
    if "triggers" in own:
        yield _edge(3, "has_trigger", own["triggers"], F.col("value"), F.col("kind"))
    if "docs" in own:
        yield _edge(3, "has_doc", own["docs"], F.col("unit"), F.col("summary"))


def _parameter(t: Tables, name: str) -> Iterator[DataFrame]:
    if "refs" in t:
        yield _edge(1, F.concat(F.lit("used_"), F.col("kind")), _uses(t["refs"], "parameter", name), name, F.col("n"))
    if "sx6" in t:
        yield _edge(2, "param_definition", t["sx6"].where(F.upper("name") == name), name, F.col("description"))
    if "sx1" in t:
        yield _edge(2, "in_pergunte_default", t["sx1"].where(word_match(F.col("preset"), name)), F.concat_ws(".", "grp", "ord"), F.col("prompt"))


def _prompt(t: Tables, name: str) -> Iterator[DataFrame]:
    if "refs" in t:
        yield _edge(1, "uses_pergunte", _uses(t["refs"], "prompt", name), name, F.col("n"))
    if "sx1" in t:
        yield _edge(2, "pergunta_definition", t["sx1"].where(F.upper("grp") == name), F.concat_ws(".", "grp", "ord"), F.col("prompt"))
    if "schedules" in t:
        yield _edge(3, "scheduled_with_pergunte", t["schedules"].where(F.upper("prompt") == name), name, F.concat(F.lit("sched_type="), F.col("sched_type")))


COLLECTORS = {"function": _function, "table": _table, "field": _field, "file": _file, "parameter": _parameter, "prompt": _prompt}


def lineage(tables: Tables, kind: str, name: str, max_per_edge: int = 20, layers: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """All edges of an entity of a kind in ``COLLECTORS``, by layer.

    ``max_per_edge`` is a feature of the trace: each collector's rows in order of place, target and detail, the first so many,
    taken before the union. A name without any edge gives no row.
    """
    order = ("edge", "path", "unit", "line", "target", "detail")
    parts = [p.where(F.col("layer").isin(*layers)).orderBy(*order).limit(max_per_edge) for p in COLLECTORS[kind](tables, name.strip().upper())]
    if not parts:
        raise ValueError(f"none of the tables of a {kind} trace is given")
    return reduce(DataFrame.unionByName, parts)


def trigger_hits(triggers: DataFrame, field: str, depth: int = 1) -> DataFrame:
    """Triggers that a field sets off, within so many steps: the triggers' rows with ``level`` and ``via``.

    A trigger is met by its source field or by a whole word of its rule or condition; the field that it fills leads to the next
    step. It comes once, at its first level, by the smallest name that leads to it; ``via`` is empty at level one. Words are
    spread into keys, so that each step is an equi-join.
    """
    words = F.regexp_extract_all(F.concat_ws(" ", "rule", "condition"), F.lit(r"(\w+)"), F.lit(1))
    met_by = F.array_distinct(F.transform(F.concat(F.array("source"), words), lambda w: F.upper(w)))
    hops = triggers.select("source", "seq", F.upper("target").alias("dst"), F.explode(met_by).alias("src")).where("src <> ''")
    nodes = reach(hops.where("dst <> ''").select("src", "dst").distinct(), triggers.sparkSession.createDataFrame([(field.strip().upper(),)], "node string"), depth - 1)
    first = hops.join(nodes, F.col("src") == F.col("node")).groupBy("source", "seq").agg(F.min(F.struct("level", "node")).alias("m"))
    via = F.when(F.col("m.level") > 0, F.col("m.node")).otherwise("")
    return triggers.join(first.select("source", "seq", (F.col("m.level") + 1).alias("level"), via.alias("via")), ["source", "seq"])


def impact(rows: DataFrame, tables: Tables, field: str, depth: int = 1, max_per_kind: int = 50) -> DataFrame:
    """What a change of a field touches: (severity, kind, location, detail), most severe first, then by kind and place.

    rows: (path, unit, line, text) of sources without comments; tables: ``sx3``, ``sx7``, ``sx1``, as far as they are there. A unit
    counts once, critical if a line of it assigns the field. ``depth`` is held within 1 to 3, and each kind's first
    ``max_per_kind`` rows are taken: features of the report.
    """
    name = field.strip().upper()
    assigns = F.col("text").rlike(rf"(?i)\b{re.escape(name)}\s*:=|\breplace\s+{re.escape(name)}\b")
    used = rows.where(word_match(F.col("text"), name)).groupBy("path", "unit").agg(F.min("line").alias("line"), F.max(assigns).alias("writes"))
    hit = lambda severity, kind, location, detail: (F.lit(severity) if isinstance(severity, str) else severity, F.lit(kind), location, detail)
    found = [(used, hit(F.when(F.col("writes"), "critical").otherwise("warning"), "source", F.concat_ws(":", "path", F.col("line").cast("string")), F.coalesce("unit", F.lit(""))))]
    if "sx3" in tables:
        fields = tables["sx3"]
        slots = [c for c in FIELD_SLOTS if c in fields.columns]
        texts = F.array_join(F.array_compact(F.array(*[F.when(word_match(F.col(c), name), F.lit(c)) for c in slots])), ",")
        place = F.concat_ws(".", "table_code", "field")
        found.append((fields.where(F.upper("field") == name), hit("warning", "definition", place, F.lit(""))))
        found.append((fields.withColumn("_texts", texts).where("_texts <> ''"), hit("warning", "dictionary", place, F.col("_texts"))))
    if "sx7" in tables:
        place = F.concat(F.concat_ws("#", "source", "seq"), F.lit(" -> "), F.coalesce("target", F.lit("")))
        found.append((trigger_hits(tables["sx7"], name, min(max(depth, 1), 3)), hit("critical", "trigger", place, F.concat_ws(" ", F.concat(F.lit("depth="), "level"), F.nullif("via", F.lit(""))))))
    if "sx1" in tables:
        met = word_match(F.col("validation"), name) | (F.upper("lookup") == name)
        found.append((tables["sx1"].where(met), hit("warning", "prompt", F.concat_ws("/", "grp", "ord"), F.coalesce("prompt", F.lit("")))))
    names = ("severity", "kind", "location", "detail")
    parts = [df.select(*[c.alias(n) for c, n in zip(cols, names)]).orderBy(severity_rank(F.col("severity")), "location", "detail").limit(max_per_kind) for df, cols in found]
    return reduce(DataFrame.unionByName, parts).orderBy(severity_rank(F.col("severity")), "kind", "location")
