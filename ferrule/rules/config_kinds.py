"""What a configuration file is: its type and the role of the server that it configures, from sections, keys and its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.rules.config_audit import ENVIRONMENT_KEYS

#: Sections that only a fiscal service has; keys that show one beside its job section.
FISCAL_SECTIONS = ("tsstaskproc", "ipc_distmail", "tssoffline", "ipc_smtp")
FISCAL_KEYS = ("sped_savewsdl", "tsssecurity")
#: Types that a file's name tells, in the order of trial; sections of a database's configuration.
NAMED_TYPES = ("appserver", "dbaccess", "smartclient")
DATABASE_SECTIONS = ("dbaccess", "mssql", "oracle")
#: Names of jobs of web services; a server with other jobs only works through jobs.
SERVICE_JOBS = ("job_ws", "job_http", "httpjob")
#: A slave has at most so many environments; from so many on, a server stands for several.
SLAVE_ENVIRONMENTS, SEVERAL_ENVIRONMENTS = 2, 3


def _evidence(files: DataFrame, sections: DataFrame, keys: DataFrame) -> DataFrame:
    """One row a file: its lower-case name, the sets of its section and key names, how many environments it has, and three values."""
    shown = sections.groupBy("path").agg(F.collect_set(F.when(~F.coalesce("commented", F.lit(False)), F.lower("section"))).alias("sections"))
    marked = keys.where(F.lower("key").isin(*ENVIRONMENT_KEYS)).select("path", F.lower("section").alias("_s")).distinct()
    # headers that occur twice count twice
    environments = sections.join(marked, (sections.path == marked.path) & (F.lower("section") == F.col("_s"))).groupBy(sections.path).agg(F.count("*").alias("n_environments"))
    first = lambda section, key: F.min(F.when((F.lower("section") == section) & (F.lower("key") == key), F.struct("line", F.lower(F.coalesce("value", F.lit(""))).alias("v"))))["v"]
    values = keys.groupBy("path").agg(F.collect_set(F.lower("key")).alias("keys"), F.trim(first("general", "mode")).alias("mode"), first("onstart", "jobs").alias("jobs"))
    name = F.lower(F.element_at(F.split("path", r"[/\\]"), -1))
    both = files.select("path", name.alias("name")).join(shown, "path", "left").join(environments, "path", "left").join(values, "path", "left")
    none = F.array().cast("array<string>")
    return both.select("path", "name", F.coalesce("sections", none).alias("sections"), F.coalesce("keys", none).alias("keys"), F.coalesce("n_environments", F.lit(0)).alias("n_environments"), "mode", F.coalesce("jobs", F.lit("")).alias("jobs"))


def _any(names: str, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.col(names), F.array(*map(F.lit, wanted)))


def config_kinds(files: DataFrame, sections: DataFrame, keys: DataFrame) -> DataFrame:
    """(path, type, role) of each file: six types, fourteen roles.

    files: (path); sections: (path, section, commented); keys: (path, section, key, value, line). Names are compared regardless of case.
    A section whose header is commented out has no name here, but counts as an environment if its keys make it one. What the contents
    show comes before what the file's name says, but for the order of ``NAMED_TYPES``. Files without sections and keys are ``custom`` by
    content and stand alone. One row a file comes of partial aggregates; a file's names are one row.
    """
    seen = _evidence(files, sections, keys)
    has = lambda name: F.array_contains("sections", name)
    some = lambda test: F.exists("sections", test)
    balances = some(lambda s: s.startswith("balance_")) & (F.col("n_environments") == 0)
    kind = F.when(_any("sections", FISCAL_SECTIONS) | (has("job_ws") & _any("keys", FISCAL_KEYS)), "tss").when(balances, "broker")
    for name in NAMED_TYPES:
        kind = kind.when(F.col("name").contains(name), name)
    kind = kind.when(_any("sections", DATABASE_SECTIONS), "dbaccess").when(has("general") & (has("drivers") | has("licenseserver")), "appserver").when(has("config") & has("drivers"), "smartclient").otherwise("custom")

    jobs = F.filter(F.transform(F.split("jobs", ","), lambda j: F.trim(j)), lambda j: j != "")
    only_jobs = has("onstart") & ~has("httprest") & (F.size(jobs) > 0) & ~F.arrays_overlap(jobs, F.array(*map(F.lit, SERVICE_JOBS)))
    rest = has("httprest") & has("httpjob") & ~has("job_ws")
    serves = some(lambda s: s.startswith("job_") & s.contains("ws")) & some(lambda s: s.contains(":"))
    in_name = lambda yes, no: F.when(F.col("name").contains("rest"), yes).otherwise(no)
    role = (
        F.when(F.col("type") == "tss", "tss")
        .when((F.col("type") == "dbaccess") & F.col("mode").isin("master", "slave"), F.concat(F.lit("dbaccess_"), "mode"))
        .when(F.col("type") == "dbaccess", "dbaccess_standalone")
        .when(balances & has("balance_web_services") & ~has("balance_http"), in_name("broker_rest", "broker_soap"))
        .when(balances, "broker_http")
        .when(only_jobs, "job_server")
        .when(rest & has("licenseclient"), "slave_rest")
        .when(rest, "rest_server")
        .when(serves, "slave_ws")
        .when(has("licenseclient") & has("webapp") & (F.col("n_environments") <= SLAVE_ENVIRONMENTS), "slave")
        .when(F.col("n_environments") >= SEVERAL_ENVIRONMENTS, "standalone_multi_env")
        .otherwise("standalone")
    )
    return seen.withColumn("type", kind).select("path", "type", role.alias("role"))


def of_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, keys) of ``sources.config.parse`` for ``config_kinds``; only sections with a key or an odd line are known there."""
    sections = parsed.where("section <> ''").groupBy("path", "section").agg((F.max(F.when(F.col("kind") == "commented", 0).otherwise(1)) == 0).alias("commented"))
    return sections, parsed.where("kind = 'key'").select("path", "section", F.col("key_name").alias("key"), "value", "line")
