"""Facts of source texts: units, calls, references, end points. Lines and column expressions; one small stripper in Python."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.text import padded_version
from ferrule.operators.tabular import ranges
from ferrule.rules.static import lines
from ferrule.sources.arguments import argument, call_arguments, in_unit, literal

#: Lines of a block comment after which it counts as left open by mistake.
LONGEST_COMMENT = 200
_PARTS = re.compile(r"\"[^\"\n]*\"?|'[^'\n]*'?|//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*(?:\*|&&)[^\n]*", re.S | re.M)


def blanked(text: str, strings: bool = True) -> str:
    """Comments, and the insides of strings, as spaces: same length, same lines."""
    out, at = [], 0
    while m := _PARTS.search(text, at):
        part, end = m[0], m.end()
        out.append(text[at : m.start()])
        if part[0] in "\"'":
            closed = len(part) > 1 and part[-1] == part[0]
            out.append(part[0] + " " * (len(part) - 1 - closed) + part[0] * closed if strings else part)
        else:
            if part.startswith("/*") and part.count("\n") > LONGEST_COMMENT:
                cut = len("\n".join(part.split("\n")[: LONGEST_COMMENT + 1]))
                part, end = part[:cut], m.start() + cut
            out.append(re.sub(r"[^\n]", " ", part))
        at = end
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def strip_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else blanked(t))


@F.pandas_udf(T.StringType())
def strip_comments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else blanked(t, strings=False))


#: Words that may stand before Function, verbs of service methods, words before the name of a service.
FUNCTION_KINDS = ("user", "static", "main")
SERVICE_WORDS = ("wsreceive", "wssend", "wsservice")
#: Functions that name something by a literal argument: what it is, how it is used, place of the argument, functions.
NAMED_BY = (
    ("table", "read", 1, "ChkFile DbSelectArea DbSetOrder FwxFilial GetAdvFVal MsSeek Posicione RetSqlDel RetSqlFil RetSqlName RetSqlTab xFilial"),
    ("table", "lock", 1, "RecLock"),
    ("parameter", "read", 1, "FWMVPar GetMv GetMVDef GetNewPar SuperGetMV"),
    ("parameter", "write", 1, "PutMv PutMvFil"),
    ("prompt", "prompt", 1, "FWGetSX1 Pergunte"),
    ("call", "execblock", 1, "ExecBlock ExistBlock"),
    ("call", "loadmodel", 1, "FWLoadModel"),
    ("call", "execview", 2, "FWExecView"),
    ("http", "http", 1, "HttpGet HttpPost HttpsGet HttpsPost"),
)
#: Calls that write to the log, verbs of end points, words that open a work environment or embedded SQL.
LOGGERS = ("conout", "fwlogmsg", "logmsg")
VERBS = ("get", "post", "put", "delete", "patch")
OPENING_WORDS = {"environment": ("RpcSetEnv", "PREPARE ENVIRONMENT"), "sql": ("BeginSql", "TCQuery", "TCSqlExec")}
DIRECTIVES = {"#include": "include", "#define": "define", "namespace": "namespace"}
#: A call: its name, then, looked ahead at so that calls inside it are met too, its arguments up to the first bracket.
_CALL = r"([\w:]+)\s*\((?=([^()]*))"
#: An arrow: the work area on its left, and the first word on its right, whether or not a bracket opens before it.
_ARROW = r"(\w+)\s*->(?=\s*\(?\s*(\w+))"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _declared(text: Column) -> Column:
    """(kind, name, class) of a line that declares a unit, read word by word; null for others."""
    word = F.split(F.trim(F.regexp_replace(text, r"[(),\s]+", " ")), " ")
    low = F.transform(word, F.lower)
    at = lambda words, k: F.coalesce(F.get(words, k if isinstance(k, Column) else F.lit(k)), F.lit(""))
    after = lambda names: F.coalesce(*[F.when(F.array_contains(low, n), F.get(word, F.array_position(low, n).cast("int"))) for n in names], F.lit(""))
    kinds = [(at(low, 0).isin(*FUNCTION_KINDS) & (at(low, 1) == "function"), F.concat(at(low, 0), F.lit("_function")), at(word, 2), F.lit(""))]
    kinds.append((at(low, 0) == "function", F.lit("function"), at(word, 1), F.lit("")))
    service = F.size(F.array_intersect(low, F.array(*map(F.lit, SERVICE_WORDS)))) > 0
    kinds.append(((at(low, 0) == "wsmethod") & service, F.lit("ws_method"), F.when(at(low, 1).isin(*VERBS), at(word, 2)).otherwise(at(word, 1)), after(reversed(SERVICE_WORDS))))
    kinds.append(((at(low, 0) == "method") & F.array_contains(low, "class"), F.lit("method"), at(word, 1), after(["class"])))
    found = F.coalesce(*[F.when(c, F.struct(k.alias("kind"), n.alias("name"), o.alias("class"))) for c, k, n, o in kinds])
    # one inside the other: of "and" Spark works out both sides for every line, to share what they have in common
    return F.when(text.rlike(r"(?i)^\s*(user|static|main|function|ws|method)"), F.when(found["name"].rlike(r"^\w+$"), found))


def _by_patterns(text: Column, patterns: Sequence[tuple[str, str, int, int]]) -> Column:
    found = [F.when(text.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(text, p, g).alias("name"), (F.regexp_extract(text, p, c) if c else F.lit("")).alias("class"))) for k, p, g, c in patterns]
    return F.coalesce(*found)


def _item(what: str, kind: str, value: Column) -> Column:
    return F.struct(F.lit(what).alias("what"), F.lit(kind).alias("kind"), value.alias("value"))


def _literal(args: Column, place: int) -> Column:
    """The string literal at a place of an argument list; empty where something else stands there."""
    return F.regexp_extract(F.trim(F.get(F.split(args, ","), F.lit(place - 1))), r"^[\"']([^\"']*)[\"']?", 1)


def _of_call(name: Column, args: Column) -> Column:
    low = F.lower(name)
    cases = [(low.isin(*names.lower().split()), _item(what, kind, _literal(args, place))) for what, kind, place, names in NAMED_BY]
    cases.append((low == "fwformstruct", _item("table", "model", F.when(F.trim(F.split_part(args, F.lit(","), F.lit(1))) == "1", _literal(args, 2)).otherwise(""))))
    cases.append((low == "msexecauto", _item("call", "execauto", F.regexp_extract(args, r"\|\s*(\w+)\s*$", 1))))
    cases.append((low.startswith("u_"), _item("call", "user_func", F.regexp_replace(name, "^..", ""))))
    cases.append((low.isin(*LOGGERS), _item("log", "log", name)))
    cases.append((name.rlike(r"^(\w+|:):[A-Za-z_]"), _item("call", "method", name)))
    return F.coalesce(*[F.when(c, v) for c, v in cases])


def _of_arrow(area: Column, member: Column) -> Column:
    low = F.lower(member)
    use = F.when(low.isin("dbappend", "dbdelete"), "write").when(low == "reclock", "lock").otherwise("alias")
    field = F.when(member.rlike("(?i)^[a-z][a-z0-9]_"), member).otherwise("")
    return F.array(F.struct(F.lit("table").alias("what"), use.alias("kind"), area.alias("value")), _item("field", "field", field))


def references(text: Column) -> Column:
    """All that the calls and arrows of a line name, as an array of (what, kind, value): one scan for calls, one for arrows."""
    by_call = F.zip_with(_all(text, _CALL, 1), _all(text, _CALL, 2), _of_call)
    by_arrow = F.flatten(F.zip_with(_all(text, _ARROW, 1), _all(text, _ARROW, 2), _of_arrow))
    return F.filter(F.concat(by_call, by_arrow), lambda x: x["value"] != "")


def _words(text: Column) -> Column:
    """Directives and opening words of a line, as references."""
    second = F.regexp_extract(text, r"^\s*\S+\s+[\"']?([^\s\"']+)", 1)
    first = F.lower(F.regexp_extract(text, r"^\s*(\S+)", 1))
    found = [F.when(first == w, _item(kind, kind, second)) for w, kind in DIRECTIVES.items()]
    for kind, words in OPENING_WORDS.items():
        pattern = r"(?i)\b(" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b"
        found.append(F.when(text.rlike(pattern), _item(kind, kind, F.regexp_extract(text, pattern, 1))))
    return F.array_compact(F.array(*found))


def named(rows: DataFrame, key: str, what: Sequence[str] = ()) -> DataFrame:
    """rows (key, line, text, ...) -> (key, line, ..., what, kind, value): references of the given sorts, or of all.

    Null and empty lines give no row; a line that names a thing twice gives two.
    """
    carried = [c for c in rows.columns if c != "text"]
    found = rows.select(*carried, F.explode(F.concat(references(F.col("text")), _words(F.col("text")))).alias("r")).select(*carried, "r.*")
    return found.where(F.col("what").isin(*what)) if what else found


def endpoints(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit, line, style, verb, route, service): annotated end points, and methods of declared services (style ``classic``)."""
    rows = with_unit(source_lines(files, key), key)
    word = F.split(F.trim("text"), r"\s+")
    at = lambda k: F.coalesce(F.get(word, F.lit(k)), F.lit(""))
    mark = F.lower(F.regexp_extract("text", r"^\s*@(\w+)", 1))
    given = F.nullif(F.regexp_extract("text", r"(?i)\bendpoint\s*=\s*[\"']([^\"']*)", 1), F.lit(""))
    path = F.coalesce(given, F.regexp_extract("text", r"[\"']([^\"']*)", 1))
    annotated = F.when(mark.isin(*VERBS) & (path != ""), F.struct(F.lit("annotation").alias("style"), F.upper(mark).alias("verb"), path.alias("route"), F.lit("").alias("service")))
    place = F.array_position(F.transform(word, lambda w: F.upper(w)), "WSSERVICE").cast("int")
    classic = F.when((F.upper(at(0)) == "WSMETHOD") & F.lower(at(1)).isin(*VERBS) & (place > 3), F.struct(F.lit("classic").alias("style"), F.upper(at(1)).alias("verb"), at(2).alias("route"), F.coalesce(F.get(word, place), F.lit("")).alias("service")))
    return rows.select(key, "unit", "line", F.coalesce(annotated, classic).alias("e")).where("e is not null").select(key, "unit", "line", "e.*")


def units(rows: DataFrame, key: str, patterns: Sequence[tuple[str, str, int, int]] = ()) -> DataFrame:
    """rows (key, line, text) of stripped lines -> (key, line, end_line, kind, name, class): declared units with their ranges.

    A unit ends before the next one begins, the last at the last line. A line declares one unit at most. Declarations are
    those of the source language, or lines that fit given patterns: (kind, pattern, group of the name, group of the class).
    """
    unit = _by_patterns(F.col("text"), patterns) if patterns else _declared(F.col("text"))
    last = rows.groupBy(key).agg(F.max("line").alias("_last"))
    found = rows.select(key, "line", unit.alias("u")).where("u is not null").select(key, "line", "u.*").join(last, key)
    return ranges(found, key, "line", F.col("_last")).select(key, "line", "end_line", "kind", "name", "class")


def _matches(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def facts(rows: DataFrame, key: str, patterns: dict[str, str]) -> DataFrame:
    """rows (key, line, text) -> (key, line, kind, value): every match of every pattern, its first group."""
    hits = F.flatten(F.array(*[_matches(k, p) for k, p in patterns.items()]))
    return rows.select(key, "line", F.explode(hits).alias("h")).select(key, "line", "h.kind", "h.value")


def with_unit(rows: DataFrame, key: str, patterns: Sequence[tuple[str, str, int, int]] = ()) -> DataFrame:
    """Lines with the unit that they belong to: the last declared one before or at the line, null before the first."""
    unit = _by_patterns(F.col("text"), patterns) if patterns else _declared(F.col("text"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("unit", F.last(unit["name"], ignorenulls=True).over(w))


def bare_text(files: DataFrame) -> Column:
    """The texts without comments: the column ``bare`` where files have it already, else stripped here."""
    return F.col("bare") if "bare" in files.columns else strip_comments(F.col("text"))


def with_bare(files: DataFrame) -> DataFrame:
    """Files with their texts without comments beside them. What is read from it afterwards strips nothing again, if it is written."""
    return files.withColumn("bare", bare_text(files))


def source_lines(files: DataFrame, key: str = "path", strings: bool = False) -> DataFrame:
    """(key, line, text): lines without comments; with ``strings`` also without what stands in string literals."""
    text = strip_all(F.col("text")) if strings else bare_text(files)
    return lines(files.select(key, text.alias("text")), [key])


#: Code blocks that a model runs by itself.
HOOKS = ("bCommit", "bCancel", "bTudoOk", "bLineOk", "bPosVld", "bPreVld", "bWhen", "bValid", "bLoad")


def model_hooks(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit, line, kind, callee, callee_norm): hooks of a model that a file assigns, as call edges; names in strings don't count."""
    pattern = r"(?i)\b(" + "|".join(HOOKS) + r")\s*:?=\s*"
    some = files.where(F.col("text").rlike(pattern))
    rows = with_unit(source_lines(some, key, strings=True), key)
    hit = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
    canonical = F.create_map(*[F.lit(x) for h in HOOKS for x in (h.lower(), h)])
    found = rows.select(key, "unit", "line", F.lit("mvc_hook").alias("kind"), hit.alias("callee")).withColumn("callee", canonical[F.lower("callee")])
    return found.withColumn("callee_norm", F.upper("callee"))


def calls(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit, line, kind, callee, callee_norm): call edges; those to a model's hooks are of ``model_hooks``."""
    found = named(with_unit(source_lines(files, key), key), key, ("call",))
    return found.select(key, "unit", "line", "kind", F.col("value").alias("callee"), F.regexp_replace(F.upper("value"), "^U_", "").alias("callee_norm"))


def table_modes(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, modes): tables of each file and how they are used; valid codes only. A model that only shows writes nothing."""
    text = bare_text(files)
    rows = lines(files.select(key, text.alias("text"), text.rlike(r"(?i)SetOnlyView\s*\(\s*\.T\.").alias("_shows")), [key, "_shows"])
    found = named(rows, key, ("table",)).where(F.upper("value").rlike("^[SZQND][A-Z][0-9A-Z]$") & ~(F.col("_shows") & (F.col("kind") == "model")))
    return found.groupBy(key, F.upper("value").alias("name")).agg(F.array_sort(F.collect_set("kind")).alias("modes"))


def parameter_modes(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, mode): parameters read, written or both; names of three characters or more that begin with a letter."""
    found = named(source_lines(files, key), key, ("parameter",)).where(F.col("value").rlike(r"^[A-Za-z]\w{2,}$"))
    both = F.size(F.collect_set("kind")) == 2
    return found.groupBy(key, F.upper("value").alias("name")).agg(F.when(both, "read_write").otherwise(F.min("kind")).alias("mode"))


def header_labels(text: Column, labels: Sequence[str]) -> Column:
    """Labelled lines of a comment block (label, dots or colon, value) as a map; fewer than two labels: empty."""
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.trim(F.regexp_extract(text, rf"(?im)^[ \t|*/]*{re.escape(n)}[ .]*:[ \t]*([^\r\n|]*)", 1)).alias("v")) for n in labels])
    found = F.filter(pairs, lambda p: p["v"] != "")
    return F.when(F.size(found) >= 2, F.map_from_entries(found)).otherwise(F.create_map().cast("map<string,string>"))


def doc_blocks(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit, summary, author, since, params, returns, deprecated, tables): doc blocks with the unit name they open with; tables that they name."""
    block = r"(?is)/\*/?\{[^}]*Doc\}[ \t]*(\w+)(.*?)\*/"
    rows = files.select(key, F.explode(F.regexp_extract_all("text", F.lit(block), F.lit(0))).alias("b")).select(key, F.regexp_extract("b", block, 1).alias("unit"), F.regexp_extract("b", block, 2).alias("b"))
    tag = lambda n: F.trim(F.regexp_extract("b", rf"(?im)^[ \t*]*@{n}[ \t]+([^\r\n]*)", 1))
    params = F.regexp_extract_all("b", F.lit(r"(?im)^[ \t*]*@param[ \t]+([^\r\n]*)"), F.lit(1))
    named_tables = F.transform(F.regexp_extract_all("b", F.lit(r"(?im)^[ \t*]*@table[ \t]+([^\r\n]*)"), F.lit(1)), lambda x: F.upper(F.trim(x)))
    return rows.select(key, "unit", F.trim(F.regexp_extract("b", r"^\s*([^\r\n@]*)", 1)).alias("summary"), tag("author").alias("author"), tag("since").alias("since"), params.alias("params"), tag("return").alias("returns"), F.col("b").rlike(r"(?i)@deprecated").alias("deprecated"), named_tables.alias("tables"))


#: Labels of the operation codes of routine calls, and what starts code outside a direct call.
OPERATIONS = {3: "insert", 4: "update", 5: "delete"}
TRIGGERS = {
    "workflow": r"(?i)TWFProcess\s*\(\s*\)\s*:\s*New\s*\(\s*[\"']([^\"']+)[\"']",
    "callback": r"(?i):\s*b(?:Return|TimeOut)\s*:=\s*\{\s*\|[^|]*\|\s*(\w+)\s*\(",
    "job": r"(?i)\bStartJob\s*\(\s*[\"']([^\"']+)[\"']",
    "schedule": r"(?i)\bFunction\s+(SchedDef)\b",
    "mail": r"(?i)\b(TMailManager|TMailMessage|MailSend|SendMail)\b",
}


def declared_units(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, name) of the units that files declare."""
    rows = source_lines(files, key).select(key, "line", _declared(F.col("text"))["name"].alias("name"))
    return rows.where("name is not null")


def routine_calls(files: DataFrame, routines: DataFrame, key: str = "path") -> DataFrame:
    """Calls of standard routines: (key, unit, line, routine, module, op_code, op_label, dynamic, tables, arg_count).

    routines: (routine, module, tables array), a small catalog. The routine is what the code block calls, the operation the
    last argument that is a number. ``dynamic``: the routine isn't named, or arguments follow and none is a number.
    ``arg_count``: parameters of the code block. A first argument that is no code block gives no row.
    """
    block = r"(?s)^\{\s*\|([^|]*)\|(.*)\}$"
    found = in_unit(call_arguments(files, ("MsExecAuto",), key), declared_units(files, key), key)
    found = found.withColumn("first", argument(F.col("args"), 0)).where(F.col("first").rlike(block))
    body = F.ltrim(F.regexp_extract("first", block, 2))
    more = F.slice("args", F.lit(2), F.greatest(F.size("args") - 1, F.lit(0)))
    number = F.filter(more, lambda a: a.rlike(r"^[0-9]+$"))
    op = F.get(number, F.size(number) - 1).try_cast("int")
    routine = F.when(body.startswith("&"), F.lit("&")).otherwise(F.upper(F.regexp_extract(body, r"([A-Za-z_]\w*)\s*\(", 1)))
    passed = F.regexp_extract("first", block, 1)
    label = F.create_map(*[F.lit(x) for p in OPERATIONS.items() for x in p])[F.col("op_code")]
    out = found.select(
        key, "unit", "line", routine.alias("routine"), op.alias("op_code"), F.exists(more, lambda a: a != "").alias("more"), F.size(F.filter(F.split(passed, ","), lambda a: F.trim(a) != "")).alias("arg_count")
    )
    out = out.withColumns({"op_label": label, "dynamic": F.col("routine").isin("", "&") | (F.col("op_code").isNull() & F.col("more"))})
    known = routines.select(F.upper("routine").alias("routine"), "module", "tables")
    return out.join(known, "routine", "left").select(key, "unit", "line", "routine", "module", "op_code", "op_label", "dynamic", "tables", "arg_count")


#: An assignment, with the class if it makes a new object; or a call of a variable's method.
_OBJECT_USE = r"(\w+)\s*:=(?:\s*([A-Za-z_]\w*)\s*\(\s*\)\s*:\s*New\b)?|(\w+):([A-Za-z_]\w*)\s*\("


def method_calls(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit, line, var, method, class): calls of methods of variables whose class is known where they stand.

    An as-of join: the class is that of the last assignment to the variable before the call, in its unit, if that made a new
    object; names regardless of case. A variable that was assigned something else since gives no row.
    """
    use = F.posexplode(F.regexp_extract_all("text", F.lit(_OBJECT_USE), F.lit(0))).alias("pos", "use")
    rows = with_unit(source_lines(files, key, strings=True), key).select(key, "unit", "line", use)
    part = lambda k: F.regexp_extract("use", _OBJECT_USE, k)
    rows = rows.select(key, F.coalesce("unit", F.lit("")).alias("unit"), "line", "pos", part(1).alias("set"), part(2).alias("new"), part(3).alias("called"), part(4).alias("method"))
    # only variables that a unit ever makes a new object of go to the window
    var = F.lower(F.when(F.col("set") != "", F.col("set")).otherwise(F.col("called")))
    rows = rows.withColumn("_var", var)
    made = rows.where("new <> ''").select(key, "unit", "_var").distinct()
    w = Window.partitionBy(key, "unit", "_var").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col("set") != "", F.struct("new")), ignorenulls=True).over(w)
    found = rows.join(made, [key, "unit", "_var"], "left_semi").withColumn("held", held["new"]).where("called <> '' and held <> ''")
    return found.select(key, "unit", "line", F.col("called").alias("var"), "method", F.col("held").alias("class"))


def build_findings(files: DataFrame, catalog: DataFrame, build: str, key: str = "path") -> DataFrame:
    """BUILD-001: method calls outside the builds that have them: (key, unit, line, class, method, var, note).

    catalog: (class, method, build_min, build_max, note); a null or empty bound is none. Builds compare number by number, and
    missing numbers are 0. Variables of unknown class and methods outside the catalog are not judged.
    """
    known = catalog.select(F.col("class").alias("_class"), F.col("method").alias("_method"), "build_min", "build_max", F.coalesce("note", F.lit("")).alias("note"))
    target = padded_version(F.lit(build))
    bound = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", padded_version(F.col(c)))
    outside = F.coalesce(target < bound("build_min"), F.lit(False)) | F.coalesce(target > bound("build_max"), F.lit(False))
    same = (F.lower("class") == F.lower("_class")) & (F.lower("method") == F.lower("_method"))
    found = method_calls(files, key).join(known.where(outside), same)
    return found.select(key, "unit", "line", F.col("_class").alias("class"), F.col("_method").alias("method"), "var", "note")


def execution_triggers(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, kind, value): what starts code otherwise: workflows, call-backs, jobs, schedules, mail."""
    return facts(source_lines(files, key), key, TRIGGERS)


def entry_points(files: DataFrame, key: str = "path") -> DataFrame:
    """Units that are entry points: by the shape of their name, or because they read the entry-point parameter array."""
    rows = with_unit(source_lines(files, key), key).where("unit is not null")
    uses = F.max(F.when(F.col("text").rlike(r"(?i)\bPARAMIXB\b"), 1).otherwise(0)) == 1
    found = rows.groupBy(key, "unit").agg(uses.alias("uses"))
    shape = F.upper("unit").rlike(r"^[A-Z]{2,4}\d{2,4}[A-Z]{2,}\w*$")
    return found.where(F.col("uses") | shape).select(key, "unit", F.when(F.col("uses"), "parameter").otherwise("name").alias("evidence"))


def environment_openers(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit, line, company, branch, environment, module): arguments of environment openers; what is no literal counts as empty."""
    words = r"(?i)PREPARE\s+ENVIRONMENT\s+(.*)$"
    by_call = in_unit(call_arguments(files, ("RpcSetEnv",), key), declared_units(files, key), key)
    pick = lambda k: literal(argument(F.col("args"), k))
    by_call = by_call.select(key, "unit", "line", pick(0).alias("company"), pick(1).alias("branch"), pick(4).alias("environment"), pick(5).alias("module"))
    of = lambda w: F.regexp_extract("text", rf"(?i)\b{w}\s+[\"']([^\"']*)[\"']", 1)
    # comments become spaces, so a file that lacks one of the words has no such line
    some = files.where(F.col("text").rlike(r"(?is)PREPARE.*ENVIRONMENT"))
    by_words = with_unit(source_lines(some, key), key).where(F.col("text").rlike(words))
    return by_call.unionByName(by_words.select(key, "unit", "line", of("EMPRESA").alias("company"), of("FILIAL").alias("branch"), of("ENVIRONMENT\\s+ENVIRONMENT").alias("environment"), of("MODULO").alias("module")))


def parameter_reads(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, unit, line, name, default): reads of parameters with the default that the call gives, as text; empty if none."""
    readers = next(names for what, kind, _, names in NAMED_BY if (what, kind) == ("parameter", "read")).split()
    found = in_unit(call_arguments(files, readers, key), declared_units(files, key), key)
    place = F.when(F.lower("name").isin("getmv", "getnewpar", "getmvdef"), argument(F.col("args"), 1)).otherwise(argument(F.col("args"), 2))
    return found.select(key, "unit", "line", F.upper(literal(argument(F.col("args"), 0))).alias("name"), place.alias("default")).where("name <> ''")


def service_structures(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, kind, name, fields): declared service structures with their data members in order."""
    head, member = r"(?i)^\s*(WSSTRUCT|WSSERVICE|WSRESTFUL)\s+(\w+)", r"(?i)^\s*WSDATA\s+(\w+)\s+AS\s+(.+?)\s*$"
    rows = source_lines(files, key)
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("text").rlike(head), F.col("line")), ignorenulls=True).over(w)
    parts = rows.withColumn("_at", start).where(F.col("_at").isNotNull() & F.col("text").rlike(f"{head}|{member}"))
    item = F.struct("line", F.regexp_extract("text", member, 1).alias("name"), F.regexp_extract("text", member, 2).alias("type"))
    first = F.max(F.when(F.col("text").rlike(head), F.struct(F.lower(F.regexp_extract("text", head, 1)).alias("kind"), F.regexp_extract("text", head, 2).alias("name"))))
    found = parts.groupBy(key, "_at").agg(first.alias("h"), F.array_sort(F.collect_list(F.when(F.col("text").rlike(member), item))).alias("m"))
    return found.select(key, F.col("_at").alias("line"), "h.kind", "h.name", F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))).alias("fields"))
