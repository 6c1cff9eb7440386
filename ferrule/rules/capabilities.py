"""What a source can do (tags) and what kind of source it is, from its words and its facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.metrics import tags
from ferrule.sources.code import bare_text, entry_points
from ferrule.sources.facts import fact_tables

#: Words that give a tag wherever they stand.
BY_WORD = {
    "BROWSE": "FWFormBrowse FWBrowse",
    "DIALOG": "MsDialog TDialog FwDialogModal",
    "SCHEDULE": "FWSchedule StartSchedTask",
    "WORKFLOW": "WFPrepEnv MsWorkflow MailAuto",
    "WEBVIEW": "TWebEngine TWebChannel",
    "MULTI_FILIAL": "xFilial FwxFilial cFilAnt cEmpAnt",
    "COMPATIBILIZADOR": "__cUpdName",
    "JSON_AWARE": "FWJsonSerialize FWJsonDeserialize",
    "TRANSACTION": "DisarmTransaction MsBeginTran",
    "MVC": "MODELDEF VIEWDEF bCommit bTudoOk bLineOk",
}
#: Functions whose call gives a tag; objects whose making does; words in a row.
BY_CALL = {"SEQUENCER": "GetSXENum GetSXVNum ConfirmSX8", "FILE_IO": "MemoWrite MemoRead FErase FCreate FWrite", "PARAMBOX": "ParamBox"}
BY_OBJECT = {"REPORT_TR": "TReport", "JSON_AWARE": "JsonObject"}
BY_PHRASE = {"TRANSACTION": ("Begin", "Transaction"), "REPORT_TR": ("oReport", ":", "Print"), "TESTE_UNITARIO": ("tlpp", "[.]", "unit")}
UNIT_KINDS = ("main_function", "user_function", "static_function")


def _words_of(text: Column) -> dict[str, Column]:
    """For each tag, whether the words of a text give it."""
    found: dict[str, Column] = {}

    def also(tag: str, pattern: str) -> None:
        found[tag] = found.get(tag, F.lit(False)) | text.rlike(f"(?i){pattern}")

    for tag, words in BY_WORD.items():
        also(tag, rf"\b({words.replace(' ', '|')})\b")
    for tag, words in BY_CALL.items():
        also(tag, rf"\b({words.replace(' ', '|')})\s*\(")
    for tag, name in BY_OBJECT.items():
        also(tag, rf"\b{name}\s*\(\s*\)\s*:\s*New\b")
    for tag, parts in BY_PHRASE.items():
        also(tag, r"\b" + (r"\s+" if all(p.isalpha() for p in parts) else r"\s*").join(parts) + r"\b")
    also("TESTE_UNITARIO", r"@Test\b")
    return found


def _has(df: DataFrame, key: str, **conditions: str) -> DataFrame:
    """A row for each file with rows: whether some row of it meets each condition."""
    return df.groupBy(key).agg(*[F.max(F.expr(c)).alias(n) for n, c in conditions.items()])


def capabilities(files: DataFrame, facts: dict[str, DataFrame] | None = None, key: str = "path") -> DataFrame:
    """files (key, text) -> (key, tags, source_type): sorted tags, and the most special kind that fits.

    Words in comments don't count. ``facts`` are the tables of ``fact_tables`` or of a store; without them they are derived here.
    Files without any tag have an empty list; null texts are files without words.
    """
    t = facts or fact_tables(files, key=key)
    words = _words_of(F.coalesce(bare_text(files), F.lit("")))
    rows = files.select(key, *[c.alias(f"w_{n}") for n, c in words.items()])
    kinds = {k: f"kind = '{k}'" for k in (*UNIT_KINDS, "method")}
    parts = [
        _has(t["units"], key, **kinds, update="upper(name) like 'U\\_UPD%'", model="upper(name) in ('MODELDEF', 'VIEWDEF')"),
        _has(t["endpoints"], key, rest="style = 'annotation'", soap="style = 'classic'"),
        _has(t["structures"], key, services="kind = 'wsservice'", restful="kind = 'wsrestful'"),
        _has(t["openers"], key, opener="true"),
        _has(t["refs"], key, http="what = 'http'", execauto="what = 'call' and kind = 'execauto'"),
        entry_points(files, key).select(key, F.lit(True).alias("entry")).distinct(),
    ]
    for p in parts:
        rows = rows.join(p, key, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    word = lambda n: F.col(f"w_{n}")
    mvc, served = word("MVC") | yes("model"), yes("rest") | yes("soap")
    found = {n: word(n) for n in words} | {
        "MVC": mvc,
        "TELA_CLASSICA": word("DIALOG") & ~mvc,
        "ENV_OPENER": yes("opener"),
        "RPC": yes("opener"),
        "JOB": yes("opener") & yes("main_function"),
        "WS-REST": yes("rest") | yes("restful"),
        "WS-SOAP": yes("soap") | yes("services"),
        "PE": yes("entry"),
        "COMPATIBILIZADOR": word("COMPATIBILIZADOR") | yes("update"),
        "REST_CLIENT": yes("http") & ~served,
        "EXEC_AUTO_CALLER": yes("execauto"),
    }
    kind = F.when(served | yes("services") | yes("restful"), "webservice").when(mvc, "mvc").when(yes("entry"), "pe")
    for k in UNIT_KINDS:
        kind = kind.when(yes(k), k)
    return rows.select(key, tags(found).alias("tags"), kind.when(yes("method"), "class").otherwise("outro").alias("source_type"))


def unit_count_check(files: DataFrame, units: DataFrame, key: str = "path") -> DataFrame:
    """(key, raw, code, parser, class) of files whose counts of functions differ: in the text, outside comments, and in the fact table.

    ``real_bug``: the table lacks or invents a function that stands in code; ``commented_out``: only comments hold more.
    """
    pattern = F.lit(r"(?im)^[ \t]*((user|static|main)[ \t]+)?function[ \t]+\w+")
    seen = files.select(key, F.regexp_count(F.coalesce("text", F.lit("")), pattern).alias("raw"), F.regexp_count(F.coalesce(bare_text(files), F.lit("")), pattern).alias("code"))
    stored = units.where(F.col("kind").isin("function", *UNIT_KINDS)).groupBy(key).agg(F.count("*").cast("int").alias("parser"))
    both = seen.join(stored, key, "left").withColumn("parser", F.coalesce("parser", F.lit(0)))
    kind = F.when(F.col("code") != F.col("parser"), "real_bug").when(F.col("raw") != F.col("parser"), "commented_out")
    return both.withColumn("class", kind).where("class is not null")


def documented(units: DataFrame, docs: DataFrame, key: str = "path") -> DataFrame:
    """Units with ``has_doc``: whether a doc block of their file names them, whatever its case."""
    own = docs.select(F.col(key), F.upper("unit").alias("_u")).distinct().withColumn("_d", F.lit(True))
    return units.withColumn("_u", F.upper("name")).join(own, [key, "_u"], "left").withColumn("has_doc", F.coalesce("_d", F.lit(False))).drop("_u", "_d")


def with_path(rows: DataFrame, files: DataFrame, name: str = "file") -> DataFrame:
    """Rows that carry a base name, with the ``path`` of that file; the smallest of several, empty where none has the name."""
    known = files.groupBy(F.element_at(F.split("path", r"[/\\]"), -1).alias(name)).agg(F.min("path").alias("path"))
    return rows.join(known, name, "left").withColumn("path", F.coalesce("path", F.lit("")))
