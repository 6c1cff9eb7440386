"""What starts code otherwise than by a call, with its details: workflows, schedules, stand-alone jobs, mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.scratch import written
from ferrule.sources.code import source_lines, with_unit

#: The calls and words of each kind.
_PROCESS = r"(?i)\bTWFProcess\s*\(\s*\)\s*:\s*New\s*\(\s*[\"']([^\"']*)[\"'](?:\s*,\s*[\"']([^\"']*)[\"'])?"
_CALL_BACK = r"(?i):\s*b{}\s*:=\s*\{{\s*\|[^|]*\|\s*([A-Za-z_]\w*)\s*\("
_TEMPLATE = r"(?i):\s*NewTask\s*\(\s*[\"'][^\"']*[\"']\s*,\s*[\"']([^\"']*)[\"']"
_PROPERTY = r"(?i):\s*{}\s*:=\s*[\"']([^\"']*)[\"']"
_SCHEDULE = r"(?i)^\s*Static\s+Function\s+SchedDef\s*\(\s*\)"
_SCHEDULED = r"(?is)\{\s*[\"']([PR])[\"']\s*,\s*[\"']([^\"']*)[\"']\s*,\s*[\"']([^\"']*)[\"']\s*,\s*\{([^}]*)\}\s*,\s*[\"']([^\"']*)[\"']\s*\}"
_MAIN = r"(?i)^\s*Main\s+Function\s+(\w+)\s*\("
_PAUSE = r"(?i)\bSleep\s*\(\s*(\d+)(?:\s*\*\s*(\d+))?\s*\)"
_FREE = r"(?i)\bRpcSetType\s*\(\s*3\s*\)"
_FLAG = r"(?i)\bFile\s*\(\s*[\"']([^\"']*)[\"']\s*\)"
_MAIL = {"MailAuto": r"(?i)\bMailAuto\s*\(", "UDC": r"(?i)^\s*SEND\s+MAIL\b", "TMailManager": r"(?i)\bTMailMessage\s*\("}


def _first(pattern: str, group: int = 1) -> Column:
    """The first line's match in a group of rows; empty if no line matches."""
    hit = F.when(F.col("text").rlike(pattern), F.struct("line", F.regexp_extract("text", pattern, group).alias("v")))
    return F.coalesce(F.min(hit)["v"], F.lit(""))


def _last(pattern: str) -> Column:
    hit = F.when(F.col("text").rlike(pattern), F.struct("line", F.regexp_extract("text", pattern, 1).alias("v")))
    return F.coalesce(F.max(hit)["v"], F.lit(""))


def _scopes(rows: DataFrame, key: str, start: str) -> DataFrame:
    """Rows from each line that fits ``start`` up to the next such line of the file, numbered by ``_scope``."""
    number = F.sum(F.when(F.col("text").rlike(start), 1).otherwise(0)).over(Window.partitionBy(key).orderBy("line"))
    return rows.withColumn("_scope", number).where("_scope > 0")


def workflows(rows: DataFrame, key: str = "path") -> DataFrame:
    """rows (key, unit, line, text) -> (key, unit, line, process, description, template, to, subject, on_return, on_timeout).

    A workflow's properties are those that follow it, before the next one. Of a template, receiver and subject the first counts, of a
    call-back the last; what isn't given is empty.
    """
    kept = rows.where(F.col("text").rlike(r"(?i)TWFProcess|:\s*(b(Return|TimeOut)|NewTask|cTo|cSubject)\b"))
    found = _scopes(kept, key, _PROCESS).groupBy(key, "_scope").agg(
        F.min_by("unit", "line").alias("unit"), F.min("line").alias("at"), _first(_PROCESS).alias("process"), _first(_PROCESS, 2).alias("description"), _first(_TEMPLATE).alias("template"),
        _first(_PROPERTY.format("cTo")).alias("to"), _first(_PROPERTY.format("cSubject")).alias("subject"), _last(_CALL_BACK.format("Return")).alias("on_return"), _last(_CALL_BACK.format("TimeOut")).alias("on_timeout"),
    )
    return found.drop("_scope").withColumnRenamed("at", "line")


def schedules(rows: DataFrame, key: str = "path") -> DataFrame:
    """rows (key, unit, line, text) -> (key, unit, line, sched_type, prompt, alias, orders, title): schedule definitions.

    What is scheduled is the first literal of its shape in the unit; a definition without one has empty texts and no orders.
    """
    own = rows.where(F.lower("unit") == "scheddef")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    found = _scopes(own, key, _SCHEDULE).groupBy(key, "_scope").agg(F.first("unit").alias("unit"), F.min("line").alias("at"), body.alias("body"))
    part = lambda k: F.regexp_extract("body", _SCHEDULED, k)
    orders = F.transform(F.filter(F.transform(F.split(part(4), ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))
    return found.select(key, "unit", F.col("at").alias("line"), F.upper(part(1)).alias("sched_type"), part(2).alias("prompt"), part(3).alias("alias"), orders.alias("orders"), part(5).alias("title"))


def jobs(rows: DataFrame, openers: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit, line, company, branch, module, sleep_seconds, stop_flag, no_license): main functions that open an environment.

    rows: (key, unit, line, text); openers: (key, line, company, branch, environment), as of ``code.environment_openers``. A main function
    reaches to the next one. Without an opener and without a session type of 3 it is no job. A pause below one second counts as given.
    """
    kept = rows.where(F.col("text").rlike(f"{_MAIN}|{_PAUSE}|{_FREE}|{_FLAG}"))
    body = _scopes(kept.withColumns({"_is": F.lit("line"), "company": F.lit(None).cast("string"), "branch": F.lit(None).cast("string"), "module": F.lit(None).cast("string")}).unionByName(
        openers.select(key, F.lit(None).cast("string").alias("unit"), "line", F.lit("").alias("text"), F.lit("opener").alias("_is"), "company", "branch", F.col("environment").alias("module"))
    ), key, _MAIN)
    opened = F.min(F.when(F.col("_is") == "opener", F.struct("line", "company", "branch", "module")))
    free = F.max(F.col("text").rlike(_FREE))
    found = body.groupBy(key, "_scope").agg(
        _first(_MAIN).alias("unit"), F.min("line").alias("at"), opened.alias("o"), free.alias("no_license"), _first(_PAUSE).alias("p"), _first(_PAUSE, 2).alias("times"), _first(_FLAG).alias("stop_flag")
    )
    total = F.coalesce(F.col("p").try_cast("long"), F.lit(0)) * F.coalesce(F.col("times").try_cast("long"), F.lit(1))
    seconds = F.when(total >= 1000, F.floor(total / 1000)).otherwise(total).cast("long")
    text = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit("")).alias(c)
    return found.where("o is not null or no_license").select(key, "unit", F.col("at").alias("line"), text("company"), text("branch"), text("module"), seconds.alias("sleep_seconds"), "stop_flag", "no_license")


def mails(rows: DataFrame, key: str = "path") -> DataFrame:
    """rows (key, unit, line, text) -> (key, unit, line, variant, has_attachment, uses_parameters): places that send mail, one a line.

    A file that opens a mail server, sends through it and makes no message object has one row, at the server's first line.
    """
    text = F.col("text")
    variant = F.coalesce(*[F.when(text.rlike(p), F.lit(v)) for v, p in _MAIL.items()])
    server, sends = text.rlike(r"(?i)\bTMailManager\s*\("), text.rlike(r"(?i):\s*(SendMail|SmtpConnect|Send)\s*\(")
    marked = rows.select(key, "unit", "line", variant.alias("variant"), server.alias("server"), sends.alias("sends"), text.rlike(r"(?i)\bATTACHMENT\b|:\s*AttachFile\s*\(").alias("a"), text.rlike(r"(?i)\bMV_REL[A-Z]+\b").alias("p"))
    marked = marked.where(F.col("variant").isNotNull() | F.col("server") | F.col("sends") | F.col("a") | F.col("p"))
    # flags of a file are one row a file, so they are joined back
    of_file = marked.groupBy(key).agg(
        F.max("a").alias("has_attachment"), F.max("p").alias("uses_parameters"), F.max("sends").alias("_sends"), F.max(F.coalesce(F.col("variant") == "TMailManager", F.lit(False))).alias("_message"), F.min(F.when(F.col("server"), F.col("line"))).alias("_server")
    )
    both = marked.join(of_file, key)
    alone = (F.col("line") == F.col("_server")) & F.col("_sends") & ~F.col("_message") & F.col("variant").isNull()
    return both.withColumn("variant", F.when(alone, "TMailManager").otherwise(F.col("variant"))).where("variant is not null").select(key, "unit", "line", "variant", "has_attachment", "uses_parameters")


def trigger_details(files: DataFrame, openers: DataFrame, key: str = "path") -> DataFrame:
    """files (key, text) -> (key, unit, line, kind, target, details): all of the above in one table, details as a map of texts.

    The target is a workflow's return call-back or else its process, a schedule's prompt group, a job's main function, a mail's variant;
    calls of the old workflow engine and of a workflow's environment count too, without details. Comments don't count. The lines with their
    units are written first, so that each kind takes its few lines from there and none sorts them all again.
    """
    rows = written(with_unit(source_lines(files, key), key), "lines")

    def shaped(found: DataFrame, kind: str, target: Column) -> DataFrame:
        names = [c for c in found.columns if c not in (key, "unit", "line")]
        texts = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",") if c == "orders" else F.col(c).cast("string") for c in names]
        return found.select(key, "unit", "line", F.lit(kind).alias("kind"), target.alias("target"), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*texts)).alias("details"))

    plain = F.when(F.col("text").rlike(r"(?i)\bMsWorkflow\s*\("), "workflow").when(F.col("text").rlike(r"(?i)\bWFPrepEnv\s*\("), "wf_callback")
    old = rows.select(key, "unit", "line", plain.alias("kind")).where("kind is not null")
    old = old.select(key, "unit", "line", "kind", F.when(F.col("kind") == "workflow", "").otherwise(F.col("kind")).alias("target"), F.create_map().cast("map<string,string>").alias("details"))
    out = old
    for part in (
        shaped(workflows(rows, key), "workflow", F.coalesce(F.nullif("on_return", F.lit("")), "process")),
        shaped(schedules(rows, key), "schedule", F.coalesce(F.nullif("prompt", F.lit("")), "unit")),
        shaped(jobs(rows, openers, key), "job_standalone", F.col("unit")),
        shaped(mails(rows, key), "mail_send", F.col("variant")),
    ):
        out = out.unionByName(part)
    return out


def find_triggers(triggers: DataFrame, kind: str | None = None, target: str | None = None, file: str | None = None, key: str = "path") -> DataFrame:
    """Triggers that meet all given conditions, by file and line; case doesn't count. An unknown kind has no rows."""
    if kind is not None:
        triggers = triggers.where(F.lower("kind") == kind.lower())
    if target is not None:
        triggers = triggers.where(F.lower("target") == target.lower())
    if file is not None:
        triggers = triggers.where(F.lower(F.element_at(F.split(key, r"[/\\]"), -1)) == file.lower())
    return triggers.orderBy(key, "line")
