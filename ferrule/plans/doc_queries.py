"""Doc blocks, schedules, workflows, jobs and mail of sources that are derived from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators.lineage import lineage
from ferrule.plans.store_queries import kept, spread
from ferrule.registry import query
from ferrule.sources import code, docs, triggers


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _documented(t):
    """(path, text): a block with its tags, then a function at once, after 44 lines, or after 89, too far away."""
    k, s = F.col("p_partkey"), F.col("p_size")
    old = F.when(k % 4 == 0, "@deprecated use other\n").otherwise("")
    text = _text(
        "#include 'x.ch'\n/*/{Any.doc} ID_P", k, "\nSays ", s, "\nand more\n@type Function\n@author Ann A", s % 5, "\n@since 1.", s, '\n@param cA, array(x,', s, '), "the, text"\n@param [nB], number\n@return logical, ok\n',
        "@history 2024-01-02, bob, 'made, it'\n@table SA", s % 10, "\n@team red\n", old, "/*/\n", F.repeat(F.lit("\n"), (k % 3 * 44).cast("int")), "User Function P", k, "()\nReturn\n",
    )
    return spread(t, _text("src/sigafat/", k, ".prw")).select("path", text.alias("text"))


_LATE = "(p_partkey % 4 = 0)::INT"


@query(f"""
SELECT 'src/sigafat/' || p_partkey || '.prw' AS path, 2::BIGINT AS line, 14::BIGINT + {_LATE} AS end_line, CASE WHEN p_partkey % 3 < 2 THEN 'P' || p_partkey END AS unit, CASE WHEN p_partkey % 3 < 2 THEN 15 + {_LATE} + p_partkey % 3 * 44 END::BIGINT AS unit_line,
  'SIGAFAT' AS module, 'Says ' || p_size || chr(10) || 'and more' AS summary, 'function' AS kind, 'Ann A' || (p_size % 5) AS author, p_partkey % 4 = 0 AS deprecated,
  'cA:array(x,' || p_size || '):the, text:false nB:number::true' AS params, 'logical:ok' AS returns, '2024-01-02 bob made, it' AS history, 'SA' || (p_size % 10) AS tables, 'team=red' AS other FROM part""")
def doc_tags(t):
    """Doc blocks with their tags and the declaration that follows within 80 lines (EXT-20)."""
    found = docs.doc_details(_documented(t))
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    params = F.array_join(F.transform("params", lambda p: F.concat(none(p["name"]), F.lit(":"), none(p["type"]), F.lit(":"), none(p["desc"]), F.lit(":"), none(p["optional"]))), " ")
    returns = F.array_join(F.transform("returns", lambda r: F.concat_ws(":", r["type"], r["desc"])), " ")
    history = F.array_join(F.transform("history", lambda h: F.concat_ws(" ", h["date"], h["user"], h["desc"])), ";")
    other = F.array_join(F.transform("other", lambda x: F.concat_ws("=", x["tag"], x["value"])), ";")
    return found.select("path", "line", "end_line", "unit", "unit_line", "module", "summary", "kind", "author", "deprecated", params.alias("params"), returns.alias("returns"), history.alias("history"), F.array_join("tables", ",").alias("tables"), other.alias("other"))


@query("""
SELECT 'src/sigafat/' || p_partkey || '.prw' AS path, 'ID_P' || p_partkey AS id FROM part WHERE p_size % 5 = 3 AND p_partkey % 4 <> 0""")
def docs_by_author(t):
    """Doc blocks that aren't deprecated, of an author met by a part of the name, of a module and a kind (LKP-14)."""
    return docs.find_docs(docs.doc_details(_documented(t)), module="sigafat", author="ann a3", deprecated=False, kind="FUNCTION").select("path", "id")


@query("""SELECT * FROM (SELECT 3 AS layer, 'documented_in' AS edge, 'src/sigafat/' || p_partkey || '.prw' AS path, 'ID_P' || p_partkey AS unit, 0::BIGINT AS line, 'SA3' AS target, '@table' AS detail FROM part WHERE p_size % 10 = 3 ORDER BY path LIMIT 20)""")
def trace_documented_table(t):
    """Doc blocks that name a table (GRF-12)."""
    return lineage({"docs": code.doc_blocks(_documented(t))}, "table", "SA3")


def _started(t):
    """(path, text): a workflow with its properties, a schedule over two lines, a job, mail; a comment and a string that start nothing."""
    k, s = F.col("p_partkey"), F.col("p_size")
    back = F.when(k % 2 == 0, '  oW:bReturn := {|o| RET("x")}\n').otherwise("\n")
    text = _text(
        'User Function A()\n  oW := TWFProcess():New("WF', s, '", "Approve")\n  oW:NewTask("t", "/w/', s, '.htm")\n  oW:cTo := "a@b"\n', back,
        "  // oX := TWFProcess():New(\"NO\")\n  MailAuto(\"x\")\n  oM:AttachFile(\"f\")\nReturn\nStatic Function SchedDef()\n  aRet := { \"P\", \"GRP", k % 7, '", "SF2",\n    {1, 2}, "Title" }\nReturn aRet\n',
        "Main Function JOB", k, '()\n  RpcSetEnv("', s, '", "01",,, "FAT")\n  Sleep(', k % 3, ' * 1000)\n  While !File("stop.flg")\n  End\nReturn\n',
    )
    return spread(t, _text("src/", k, ".prw")).select("path", text.alias("text"))


@query("""
SELECT 'src/' || p_partkey || '.prw' AS path, u.unit, u.line, u.kind, u.target, u.details FROM part, LATERAL (
  SELECT 'A' AS unit, 2::BIGINT AS line, 'workflow' AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'RET' ELSE 'WF' || p_size END AS target, 'description=Approve on_return=' || CASE WHEN p_partkey % 2 = 0 THEN 'RET' ELSE '' END || ' on_timeout= process=WF' || p_size || ' subject= template=/w/' || p_size || '.htm to=a@b' AS details
  UNION ALL SELECT 'A', 7, 'mail_send', 'MailAuto', 'has_attachment=true uses_parameters=false variant=MailAuto'
  UNION ALL SELECT 'SchedDef', 10, 'schedule', 'GRP' || (p_partkey % 7), 'alias=SF2 orders=1,2 prompt=GRP' || (p_partkey % 7) || ' sched_type=P title=Title'
  UNION ALL SELECT 'JOB' || p_partkey, 14, 'job_standalone', 'JOB' || p_partkey, 'branch=01 company=' || p_size || ' module=FAT no_license=false sleep_seconds=' || (p_partkey % 3) || ' stop_flag=stop.flg') u""")
def trigger_metadata(t):
    """Workflows, schedules, jobs and mail with their details (EXT-19)."""
    files = kept(t, _started(t))
    found = triggers.trigger_details(files, code.environment_openers(files))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return found.select("path", "unit", "line", "kind", "target", shown.alias("details"))


@query("""
SELECT * FROM (SELECT 3 AS layer, 'scheduled_with_pergunte' AS edge, 'src/' || p_partkey || '.prw' AS path, 'SchedDef' AS unit, 10::BIGINT AS line, 'GRP4' AS target, 'sched_type=P' AS detail FROM part WHERE p_partkey % 7 = 4 ORDER BY path LIMIT 20)""")
def trace_prompt_schedules(t):
    """Schedules that run with a prompt group (GRF-16)."""
    files = _started(t)
    rows = code.with_unit(code.source_lines(files), "path")
    return lineage({"schedules": triggers.schedules(rows)}, "prompt", "grp4")
