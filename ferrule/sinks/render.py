"""Results as JSON, Markdown, HTML or plain text. Only the shown rows reach the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import severity_rank

LIMIT = 20


def shown(df: DataFrame, limit: int | None = LIMIT, offset: int = 0, masks: dict[str, Column] | None = None) -> DataFrame:
    """The rows to show: offset, then limit, then masks (columns by name that replace those of the frame)."""
    df = df.offset(offset) if offset else df
    df = df if limit is None else df.limit(limit)
    return df.withColumns({c: m for c, m in (masks or {}).items() if c in df.columns})


def _text(value) -> str:
    return "" if value is None else json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (list, dict, tuple)) else str(value)


def to_json(df: DataFrame, limit: int | None = None, offset: int = 0) -> str:
    """{rows, total, shown, truncated}; without a limit all rows, which the caller must know to be few."""
    total = df.count()
    rows = [r.asDict(True) for r in shown(df, limit, offset).collect()]
    return json.dumps({"rows": rows, "total": total, "shown": len(rows), "truncated": len(rows) < max(0, total - offset)}, ensure_ascii=False, default=str)


def to_markdown(df: DataFrame, limit: int = LIMIT, offset: int = 0) -> str:
    cell = lambda v: _text(v).replace("|", "\\|").replace("\r", "").replace("\n", "<br>")
    lines = ["| " + " | ".join(map(cell, df.columns)) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in shown(df, limit, offset).collect()])


def to_html(df: DataFrame, limit: int = LIMIT, offset: int = 0, title: str = "") -> str:
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(_text(v))}</{tag}>" for v in values) + "</tr>"
    body = "".join(row("td", r) for r in shown(df, limit, offset).collect())
    return f"<h1>{html.escape(title)}</h1>" * bool(title) + f"<table><thead>{row('th', df.columns)}</thead><tbody>{body}</tbody></table>"


def to_text(df: DataFrame, limit: int = LIMIT, offset: int = 0, width: int = 40) -> str:
    rows = [df.columns, *[[_text(v).replace("\n", " ")[:width] for v in r] for r in shown(df, limit, offset).collect()]]
    sizes = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(s) for v, s in zip(r, sizes)).rstrip() for r in rows)


def score_report(scores: DataFrame, findings: DataFrame, title: str) -> str:
    """HTML report: a card for each score, then the findings."""
    cards = "".join(f"<div class='card'><b>{html.escape(_text(r[0]))}</b> {html.escape(_text(r[1]))} {html.escape(_text(r[2]))}</div>" for r in shown(scores, 200).collect())
    return f"<h1>{html.escape(title)}</h1>{cards}{to_html(findings, 1000)}"


def config_lines(rows: DataFrame) -> DataFrame:
    """Suggested keys (path, section, key, value, change) -> (path, text): a file each, sections and keys in order."""
    line = F.concat("key", F.lit("="), F.coalesce("value", F.lit("")), F.when(F.col("change") != "kept", F.concat(F.lit(" ; "), "change")).otherwise(""))
    part = rows.groupBy("path", "section").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    block = F.concat(F.lit("["), "section", F.lit("]\n"), "t")
    return part.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n\n").alias("text"))


#: Rows and tips that a log report shows at most; counts are of all findings.
REPORT_ROWS, REPORT_TIPS = 500, 40


def log_report(findings: DataFrame, label: str, events: int, metrics: dict[str, str] | None = None) -> str:
    """HTML of a log diagnosis: counts by severity and category, the gravest findings in order, a tip for each message.

    findings: (severity, category, at, line, message, tip, snippet, ref); nulls are shown as nothing. Counting is done in
    Spark; only the rows that the report shows come to the driver.
    """
    of = lambda c: {r[0] or "": r[1] for r in findings.groupBy(c).count().orderBy(F.desc("count"), c).collect()}  # noqa: E731  catalogs of severities and categories
    by_severity, by_category = of("severity"), of("category")
    shown = findings.orderBy(severity_rank(F.col("severity")), "at", "line").limit(REPORT_ROWS).collect()
    tips = findings.where("coalesce(tip, '') <> ''").groupBy("message").agg(F.min(F.struct(severity_rank(F.col("severity")).alias("r"), "category", "tip")).alias("t")).orderBy("t.r", "message").limit(REPORT_TIPS).collect()
    cell = lambda x: f"<td>{html.escape('' if x is None else str(x))}</td>"
    rows = "".join(f"<tr>{cell(k)}{''.join(cell(r[c]) for c in ('severity', 'category', 'at', 'line', 'message', 'snippet', 'ref'))}</tr>" for k, r in enumerate(shown, 1))
    cards = "".join(f"<div>{html.escape(k)}: {by_severity.get(k, 0)}</div>" for k in ("critical", "warning", "info"))
    cards += "".join(f"<div>{html.escape(k)}: {html.escape(v)}</div>" for k, v in (metrics or {}).items())
    groups = "".join(f"<tr>{cell(k)}{cell(n)}</tr>" for k, n in by_category.items())
    advice = "".join(f"<p><b>[{html.escape(r.t.category or '')}] {html.escape(r.message or '')}</b><br>{html.escape(r.t.tip)}</p>" for r in tips)
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(label)}</title></head><body><h1>{html.escape(label)}</h1>"
        f"<div>{sum(by_severity.values())} findings, {events} events</div>{cards}<h2>Categories</h2><table>{groups}</table><h2>Findings</h2><table>{rows}</table><h2>Tips</h2>{advice}</body></html>"
    )
