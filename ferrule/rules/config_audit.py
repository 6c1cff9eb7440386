"""Audit of configuration files against a table of rules: applicability, value checks, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.tabular import small

#: Weight of a rule by severity, and the least score of each label.
WEIGHTS = {"critical": 3.0, "warning": 1.5, "info": 0.5}
LABELS = ((85.0, "compliant"), (60.0, "partial"))
TRUE, FALSE = ("1", "true", "yes", "on", ".t.", "sim"), ("0", "false", "no", "off", ".f.", "nao")


def _boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*TRUE), "true").when(low.isin(*FALSE), "false").otherwise(low)


def value_ok(kind: Column, value: Column, expected: Column) -> Column:
    """Whether a present value passes a rule of one of the seven kinds; an unknown kind passes."""
    number = F.trim(value).try_cast("double")
    low, high = F.nullif(F.trim(F.split_part(expected, F.lit(".."), F.lit(1))), F.lit("")), F.nullif(F.trim(F.split_part(expected, F.lit(".."), F.lit(2))), F.lit(""))
    in_range = number.isNotNull() & F.coalesce(number >= low.try_cast("double"), F.lit(True)) & F.coalesce(number <= high.try_cast("double"), F.lit(True))
    listed = F.array_contains(F.transform(F.split(expected, r"\|"), lambda x: F.lower(F.trim(x))), F.lower(F.trim(value)))
    return (
        F.when(kind == "key_missing", False)
        .when(kind == "value_eq", _boolean(value) == _boolean(expected))
        .when(kind == "value_neq", _boolean(value) != _boolean(expected))
        .when(kind == "value_in", listed)
        .when(kind == "range_check", in_range)
        .when(kind == "regex", F.regexp_like(value, expected))
        .otherwise(True)
    )


def score(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """rows (scope.., ok, severity) -> score 0 to 100 with a label; a partial aggregate. Scores are rounded to one place, halves up."""
    w = F.lit(WEIGHTS["info"])
    for s, x in WEIGHTS.items():
        w = F.when(F.col("severity") == s, x).otherwise(w)
    part = rows.groupBy(*scope).agg(F.sum(F.when(F.col("ok"), w).otherwise(0.0)).alias("good"), F.sum(w).alias("all"))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("good") / F.col("all"))) * 100.0
    label = F.lit("poor")
    for least, name in reversed(LABELS):
        label = F.when(raw >= least, name).otherwise(label)
    return part.select(*scope, (F.round(raw * 10.0) / 10.0).alias("score"), label.alias("label"))


def applicable(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that apply to each file: type equal or empty, role listed or empty. files: (path, type, role)."""
    roles = rules.withColumn("_role", F.explode(F.when(F.coalesce("roles", F.lit("")) == "", F.array(F.lit(None).cast("string"))).otherwise(F.split("roles", r"\|"))))
    cond = (F.coalesce("file_type", F.lit("")) == "") | (F.col("file_type") == F.col("type"))
    return files.join(small(roles), cond & (F.col("_role").isNull() | (F.trim("_role") == F.col("role")))).drop("_role").distinct()


#: Keys that make a section an environment; keys that define a database, in a section of its own or in an environment.
ENVIRONMENT_KEYS = ("rootpath", "sourcepath", "rpodb", "rpoversion", "startpath")
CONNECTION_KEYS = ("database", "server", "port", "alias")
ENVIRONMENT_DB_KEYS = ("dbdatabase", "dbserver", "dbalias", "dbport")
DATABASE_SECTIONS = ("topconnect", "dbaccess")


def environments(keys: DataFrame) -> DataFrame:
    """(path, section) of the sections that a key marks as environments, whatever their name."""
    return keys.where(F.lower("key").isin(*ENVIRONMENT_KEYS)).select("path", "section").distinct()


def database_sources(keys: DataFrame, files: DataFrame, without_db: Sequence[str] = ()) -> DataFrame:
    """(path, sources, redundant, conflict): where each file defines its database, which database sections that makes redundant.

    keys: (path, section, key) that aren't commented; files: (path, role). A source is a database section with a key of a
    connection, or such a key of an environment. With any source, the database sections that are none are redundant; two sources are
    a conflict unless the role connects to no database itself (``without_db``). Files without keys have no source.
    """
    section, name = F.lower("section"), F.lower("key")
    found = F.when(section.isin(*DATABASE_SECTIONS) & name.isin(*CONNECTION_KEYS), section).when(name.isin(*ENVIRONMENT_DB_KEYS), "environment")
    own = keys.withColumn("source", found).where("source is not null").groupBy("path").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    both = files.join(own, "path", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    some = F.size("sources") > 0
    redundant = F.when(some, F.array_except(F.array(*map(F.lit, DATABASE_SECTIONS)), "sources")).otherwise(F.array().cast("array<string>"))
    role = F.coalesce("role", F.lit(""))
    return both.select("path", "sources", redundant.alias("redundant"), ((F.size("sources") > 1) & ~role.isin(*without_db) if without_db else F.size("sources") > 1).alias("conflict"))


def audit(keys: DataFrame, sections: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of all rules on all files, in one join pipeline.

    keys: (path, section, key, value, note); sections: (path, section); files: (path, type, role); rules: (rule_id, key,
    section, kind, expected, severity, file_type, roles, conditional), a catalog that is broadcast if small. A rule's section
    is ``*``, a name, a prefix ending in ``/``, or ``environment``, which also means all sections with an environment's key. Rules
    on a database section that another source makes redundant end as ``ok_with_note``. A missing key counts only for a critical or warning rule that is not
    conditional; only a critical one lowers the score, and doubly. A note that says a value is meant turns a finding
    into ``ok_with_note``.
    """
    own = F.lower("section")
    sections = sections.join(environments(keys).withColumn("_env", F.lit(True)), ["path", "section"], "left")
    cond = (F.col("r_section") == "*") | (own == F.lower("r_section")) | ((F.lower("r_section") == "environment") & F.coalesce("_env", F.lit(False))) | (F.col("r_section").endswith("/") & own.startswith(F.lower("r_section")))
    todo = applicable(files, rules.withColumnsRenamed({"section": "r_section", "key": "r_key"})).join(sections, "path").where(cond)
    at = keys.select("path", "section", F.lower("key").alias("_key"), "value", "note")
    found = todo.withColumn("_key", F.lower("r_key")).join(at, ["path", "section", "_key"], "left")
    spare = database_sources(keys, files).select("path", "redundant")
    found = found.join(spare, "path", "left").withColumn("_spare", F.coalesce(F.array_contains("redundant", F.lower("section")), F.lit(False)))
    missing = F.col("value").isNull()
    meant = F.coalesce(F.col("note"), F.lit("")).rlike(r"(?i)\b(on purpose|intentional|intencional|proposital)\b")
    counts = F.col("severity").isin("critical", "warning") & ~F.coalesce("conditional", F.lit(False)) & F.col("kind").isin("key_present", "value_eq", "value_in", "range_check")
    status = (
        F.when(F.col("_spare"), "ok_with_note").when(missing & (F.col("kind") == "key_missing"), "ok").when(missing & ~counts, "skipped").when(missing, "missing")
        .when(value_ok(F.col("kind"), F.col("value"), F.col("expected")), "ok").when(meant, "ok_with_note").otherwise("wrong")
    )
    return found.select("path", "section", F.col("r_key").alias("key"), "value", "rule_id", "severity", "expected", status.alias("status"))


def audit_score(findings: DataFrame) -> DataFrame:
    """Score of each file from its findings; a missing critical key weighs twice, a missing warning key not at all."""
    counted = findings.where("status <> 'skipped' and not (status = 'missing' and severity <> 'critical')")
    twice = counted.withColumn("n", F.explode(F.sequence(F.lit(1), F.when((F.col("status") == "missing"), 2).otherwise(1))))
    return score(twice.select("path", F.col("status").isin("ok", "ok_with_note").alias("ok"), "severity"), ["path"])


def unknown_keys(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Keys that no catalog row names for their section or for all sections. known: (section, key)."""
    low = keys.withColumns({"_s": F.lower("section"), "_k": F.lower("key")})
    one = known.where("section <> '*'").select(F.lower("section").alias("_s"), F.lower("key").alias("_k")).distinct()
    any_ = known.where("section = '*'").select(F.lower("key").alias("_k")).distinct()
    return low.join(one, ["_s", "_k"], "left_anti").join(any_, "_k", "left_anti").select(*keys.columns)


def suggest(keys: DataFrame, findings: DataFrame) -> DataFrame:
    """Lines of a corrected file: wrong values replaced, missing critical keys added: (path, section, key, value, change)."""
    wrong = findings.where("status = 'wrong'").select("path", "section", F.lower("key").alias("_k"), F.split_part("expected", F.lit("|"), F.lit(1)).alias("_new")).distinct()
    fixed = keys.withColumn("_k", F.lower("key")).join(wrong, ["path", "section", "_k"], "left")
    shown = fixed.select("path", "section", "key", F.coalesce("_new", "value").alias("value"), F.when(F.col("_new").isNotNull(), "corrected").otherwise("kept").alias("change"))
    added = findings.where("status = 'missing' and severity = 'critical'").select("path", "section", "key", F.split_part("expected", F.lit("|"), F.lit(1)).alias("value"), F.lit("added").alias("change")).distinct()
    return shown.unionByName(added)
