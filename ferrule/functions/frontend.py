"""Front-end artefacts: templates, imports, HTTP calls and paths, as columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.operators.tabular import longest_prefix


def normal_path(url: Column) -> Column:
    """Path of an end point: no scheme, host, query or fragment; lower case; numeric segments and ${..} as {id}."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    shown = F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9]+(\.html)?$|^\$\{.*\}$|^:"), "{id}").otherwise(F.lower(s)))
    return F.concat(F.lit("/"), F.array_join(shown, "/"))


_IMPORT = r"import\s*\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]"
_CALL = r"\.(get|post|put|delete|patch)\s*(?:<[^>]*>)?\s*\(\s*[`'\"]([^`'\"]+)[`'\"]"
_TAG = r"<([a-z]+(?:-[a-z0-9]+)+)((?:\s[^<>]*)?)/?>"
_BINDING = r"[\[\(]*([a-zA-Z][a-zA-Z0-9-]*)[\]\)]*\s*="


def imports(files: DataFrame) -> DataFrame:
    """files (path, text) -> (path, package, symbol)."""
    hits = F.explode(F.regexp_extract_all("text", F.lit(_IMPORT), F.lit(0))).alias("hit")
    names = F.explode(F.split(F.regexp_extract("hit", _IMPORT, 1), ",")).alias("n")
    rows = files.select("path", hits).select("path", F.regexp_extract("hit", _IMPORT, 2).alias("package"), names)
    return rows.select("path", "package", F.regexp_replace(F.trim("n"), r"\s+as\s+.*$", "").alias("symbol")).where("symbol <> ''")


def http_calls(files: DataFrame) -> DataFrame:
    """files (path, text) -> (path, verb, url, norm)."""
    hits = F.explode(F.regexp_extract_all("text", F.lit(_CALL), F.lit(0))).alias("hit")
    rows = files.select("path", hits).select("path", F.upper(F.regexp_extract("hit", _CALL, 1)).alias("verb"), F.regexp_extract("hit", _CALL, 2).alias("url"))
    return rows.withColumn("norm", normal_path(F.col("url")))


def template_use(files: DataFrame) -> DataFrame:
    """files (path, text) -> (path, component, binding); binding null where a component has none."""
    hits = F.explode(F.regexp_extract_all("text", F.lit(_TAG), F.lit(0))).alias("hit")
    names = F.regexp_extract_all(F.regexp_replace(F.regexp_extract("hit", _TAG, 2), r"\"[^\"]*\"|'[^']*'", "x"), F.lit(_BINDING), F.lit(1))
    return files.select("path", hits).select("path", F.regexp_extract("hit", _TAG, 1).alias("component"), F.explode_outer(names).alias("binding"))


def packages(files: DataFrame) -> DataFrame:
    """package.json files (path, text) -> (path, name, version): dependencies of all kinds; broken JSON has none."""
    deps = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    entries = F.concat(*[F.map_entries(F.coalesce(deps[k], empty)) for k in ("dependencies", "devDependencies", "peerDependencies")])
    return files.select("path", F.explode(entries).alias("e")).select("path", F.col("e.key").alias("name"), F.regexp_replace("e.value", r"^[^0-9]*", "").alias("version"))


def version_mismatch(projects: DataFrame, catalog_major: int, name_prefix: str) -> DataFrame:
    """Projects whose dependency has another major version than the catalog. projects: (path, name, version)."""
    major = F.split_part("version", F.lit("."), F.lit(1)).try_cast("int")
    return projects.where(F.col("name").startswith(name_prefix) & (major != catalog_major)).withColumn("major", major)


#: A declared type before a literal, as ``: Name =``, ``: Name[] =`` or ``: Array<Name> =``.
_TYPED = re.compile(r":\s*(?:Array\s*<\s*([A-Za-z_]\w*)\s*>|([A-Za-z_]\w*)(?:\s*\[\s*\])?)\s*=\s*(?=[\[{])")
#: A string, a comment, a bracket, or a key with its value where that is a string.
_IN_LITERAL = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?<![\w.$])([A-Za-z_]\w*)\s*:(?!:)(?:\s*(?:'((?:[^'\\\n]|\\.)*)'|\"((?:[^\"\\\n]|\\.)*)\"))?|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`|([\[{(])|([\]})])|,", re.S)
_USE = T.ArrayType(T.StructType([T.StructField("interface", T.StringType()), T.StructField("key_path", T.StringType()), T.StructField("property", T.StringType()), T.StructField("value", T.StringType()), T.StructField("line", T.LongType()), T.StructField("direct", T.BooleanType())]))


def literal_keys(text: str | None) -> Iterator[dict]:
    """Every key of every object literal of a declared type: interface, path of keys down to it, value if a string, line.

    A walk with a stack: each brace opens a level of keys under the key that it stands after; a key is direct if it belongs to
    the literal itself or to an object of its array. What stands before a colon elsewhere (arguments, conditions) is no key.
    """
    for m in _TYPED.finditer(text or ""):
        start = text[m.end()]
        levels: list[tuple[str, str]] = []  # bracket, key that it stands after
        last, direct, begins = "", 2 if start == "[" else 1, False
        for t in _IN_LITERAL.finditer(text, m.end()):
            if t[4]:
                levels.append((t[4], last))
                last = ""
            elif t[5]:
                last = levels.pop()[1] if levels else ""
                if not levels:
                    break
            elif t[1] and begins and levels[-1][0] == "{":
                last = t[1]
                path = ".".join([k for _, k in levels if k] + [last])
                yield {"interface": m[1] or m[2], "key_path": path, "property": last, "value": t[2] or t[3] or "", "line": text.count("\n", 0, t.start()) + 1, "direct": len(levels) == direct}
            if t[0][:2] not in ("//", "/*"):
                begins = t[0] in ("{", ",")  # a key stands at the beginning of an object, or after a comma


@F.pandas_udf(_USE)
def _literals(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: list(literal_keys(t)))


def interface_use(files: DataFrame) -> DataFrame:
    """files (path, text) -> (path, interface, key_path, property, value, line, direct): keys of typed object literals, nested ones too.

    ``value`` is empty where the value is no string. Null texts give none; keys that a line repeats count once.
    """
    typed = files.where(F.col("text").rlike(r":\s*[A-Za-z_][\w<>\s\[\]]*=\s*[\[{]"))
    return typed.select("path", F.explode(_literals(F.col("text"))).alias("u")).select("path", "u.*").distinct()


def interface_findings(use: DataFrame, catalog: DataFrame) -> DataFrame:
    """POUI-IFACE: (path, line, component, binding, kind, value) of direct keys that their interface lacks, and of values outside a list.

    catalog: (interface, property, values array; empty: any value). Interfaces that it doesn't know are not judged.
    """
    own = use.where("direct").select("path", "line", F.col("interface").alias("component"), F.col("property").alias("binding"), "value")
    known = catalog.select(F.col("interface").alias("component"), F.col("property").alias("binding"), F.col("values").alias("allowed"))
    lacking = own.join(known.select("component").distinct(), "component", "left_semi").join(known, ["component", "binding"], "left_anti")
    outside = own.join(known, ["component", "binding"]).where("value <> '' and size(allowed) > 0 and not array_contains(allowed, value)")
    columns = ["path", "line", "component", "binding"]
    return lacking.select(*columns, F.lit("interface").alias("kind"), F.lit("").alias("value")).unionByName(outside.select(*columns, F.lit("value").alias("kind"), "value")).distinct()


def import_findings(use: DataFrame, imported: DataFrame, catalog: DataFrame, projects: DataFrame) -> DataFrame:
    """POUI-IMPORT: (path, line, component, package, project): components whose package their project imports nowhere.

    use: (path, line, component); imported: (path, package); catalog: (component, package); projects: (path) of the projects' package.json
    files. A file belongs to the longest project folder that holds it. Components that the catalog doesn't know, or gives no package, and files
    outside all projects are not judged. A component comes once a project, at its first file and line.
    """
    folders = projects.where(F.col("path").endswith("package.json")).select(F.regexp_replace("path", r"package\.json$", "").alias("root"))
    top = folders.agg(F.max(F.when(F.col("root") == "", "")).alias("_top"))  # one row

    def placed(rows: DataFrame) -> DataFrame:
        held = longest_prefix(rows.select("path").distinct(), folders.where("root <> ''")).crossJoin(F.broadcast(top))
        return rows.join(held.select("path", F.coalesce("root", "_top").alias("project")), "path").where("project is not null")

    known = catalog.where("package <> ''").select("component", "package").distinct()
    first = placed(use.join(known, "component")).groupBy("project", "component", "package").agg(F.min(F.struct("path", "line")).alias("at"))
    return first.join(placed(imported).select("project", "package").distinct(), ["project", "package"], "left_anti").select("at.path", "at.line", "component", "package", "project")
