"""Server logs: events from lines, header facts, triage by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.tabular import sessions, since, small
from ferrule.rules.static import lines

#: Levels that may open a line in square brackets, and the opening words of an error report of a thread.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL")
REPORT = "THREAD ERROR"
_DAY_AND_TIME = r"\d\d/\d\d/\d{4}\s+\d\d:\d\d:\d\d"


def _outline(text: Column) -> Column:
    """The text with every digit as 0, so that shapes of dates and times are compared as plain text."""
    return F.translate(text, "123456789", "000000000")


def _machine(text: Column) -> Column:
    """A time in ISO form and a thread number before the first bar."""
    outline = _outline(text)
    return outline.startswith("0000-00-00T00:00:00") & text.contains("|") & F.split_part(outline, F.lit("|"), F.lit(1)).rlike(r"^\S+\s+0+$")


def _report(text: Column) -> Column:
    """An error report of a thread: its number, then a day and a time."""
    return text.startswith(REPORT) & text.rlike(r"\[\d+\]") & text.rlike(_DAY_AND_TIME)


def _dated(text: Column) -> Column:
    return _outline(text).startswith("[00/00/0000") & F.split_part(_outline(text), F.lit("]"), F.lit(1)).endswith(" 00:00:00") & text.contains("]")


def is_header(text: Column) -> Column:
    """Whether a line begins an event: one of three forms with a time, or a level in square brackets. Null: null."""
    return _machine(text) | _report(text) | _dated(text) | F.regexp_extract(text, r"^\[([A-Z]+)\b", 1).isin(*LEVELS)


def stamp(text: Column) -> Column:
    """The time of a header line, without zone; null where it has none or a broken one."""
    iso = F.regexp_replace(F.regexp_extract(text, r"^\S+", 0), r"[+-]\d\d:\d\d$", "")
    day = F.regexp_replace(F.regexp_extract(text, _DAY_AND_TIME, 0), r"\s+", " ")
    local = F.try_to_timestamp(day, F.lit("dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz")
    return F.when(_machine(text), iso.try_cast("timestamp_ntz")).when(_report(text) | _dated(text), local)


def thread(text: Column) -> Column:
    number = F.when(_machine(text), F.regexp_extract(F.split_part(text, F.lit("|"), F.lit(1)), r"\d+$", 0))
    return number.when(_report(text), F.regexp_extract(text, r"\[(\d+)\]", 1))


def events(files: DataFrame, key: str = "path") -> DataFrame:
    """files (key, text) -> (key, line, ts, thread, header, body): lines from each header to the next; lines before the first go."""
    rows = sessions(lines(files.select(key, "text"), [key]), key, ["line"], is_header(F.col("text"))).where("session_no > 0")
    parts = rows.groupBy(key, "session_no").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    first = F.element_at("l", 1)
    body = F.array_join(F.transform(F.slice("l", 2, F.size("l")), lambda x: x["text"]), "\n")
    return parts.select(key, first["line"].alias("line"), stamp(first["text"]).alias("ts"), thread(first["text"]).alias("thread"), first["text"].alias("header"), body.alias("body"))


def diagnose(rows: DataFrame, rules: DataFrame, key: str = "path", severities: tuple[str, ...] = (), window_seconds: int | None = None, most: int | None = None, noise: str | None = None) -> DataFrame:
    """Events triaged by a small table of rules (rule_id, priority, severity, category, pattern, message).

    Rules are filtered by severity first; an event has the first rule that fits by priority, then id. The window counts
    back from each file's last time; ``most`` keeps the newest findings of each file. {1} and so on in a message stand for
    the pattern's groups.
    """
    if noise:
        rows = rows.where(~F.col("header").rlike(noise))
    if window_seconds is not None:
        rows = since(rows, key, "ts", window_seconds)
    if severities:
        rules = rules.where(F.col("severity").isin(*severities))
    text = F.concat_ws("\n", "header", "body")
    hit = rows.withColumn("_text", text).join(small(rules), F.expr("_text rlike pattern"))
    best = hit.groupBy(key, "line").agg(F.min(F.struct("priority", "rule_id", "severity", "category", "pattern", "message", "ts", "thread", "header", "_text")).alias("m")).select(key, "line", "m.*")
    message = F.col("message")
    for k in range(1, 5):
        group = F.expr(f"case when regexp_count(pattern, '[(](?![?])') >= {k} then regexp_extract(_text, pattern, {k}) else '' end")
        message = F.replace(message, F.lit(f"{{{k}}}"), group)
    out = best.select(key, "line", "ts", "thread", "rule_id", "severity", "category", F.substring(message, 1, 200).alias("message"), F.regexp_extract("_text", r"\b(ORA-\d{5})\b", 1).alias("db_code"), F.substring("header", 1, 200).alias("snippet"))
    if most is not None:
        newest = Window.partitionBy(key).orderBy(F.desc("line"))
        out = out.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= most).drop("_place")
    return out


def header_facts(files: DataFrame, patterns: dict[str, str], scan: int = 200, key: str = "path") -> DataFrame:
    """The first value of each pattern within the first lines of a file, and the first and last time stamps of all."""
    rows = lines(files.select(key, "text"), [key])
    aggs = [F.min(F.when((F.col("line") <= scan) & F.col("text").rlike(p), F.struct("line", F.regexp_extract("text", p, 1).alias("v"))))["v"].alias(n) for n, p in patterns.items()]
    return rows.groupBy(key).agg(*aggs, F.min(stamp(F.col("text"))).alias("first_ts"), F.max(stamp(F.col("text"))).alias("last_ts"), F.sum(F.when(is_header(F.col("text")), 1).otherwise(0)).alias("n_events"))
