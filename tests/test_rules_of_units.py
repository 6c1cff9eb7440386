"""Rules that judge whole units and files, and names that follow fixed ranges."""

from pyspark.sql import functions as F

from ferrule.operators import tabular
from ferrule.rules import static
from ferrule.sources import dictionary

MIXED = 'User Function A()\n  RecLock("SA1", .T.)\n  // DbRLock(1)\n  SA1->(dbAppend())\nReturn\nUser Function B()\n  dbAppend()\nReturn\nStatic Function C()\n  RecLock("SA1", .F.)\n  DbAppend()\n  DbRLock(2)\nReturn'


def test_mixed_access_and_encoding(spark):
    files = spark.createDataFrame([("a.prw", MIXED, "utf-8"), ("b.tlpp", "x", "utf-8"), ("c.PRX", "first\nsecond", "UTF-8"), ("d.prw", "x", "cp1252"), ("e.prw", None, None)], "path string, text string, encoding string")
    got = [(r.path, r.line, r.rule_id) for r in static.findings(files).collect()]
    assert [x for x in got if x[2] == "BP-006"] == [("a.prw", 4, "BP-006"), ("a.prw", 12, "BP-006")]
    assert [x for x in got if x[2] == "ENC-001"] == [("a.prw", 1, "ENC-001"), ("c.PRX", 1, "ENC-001")]


def test_legacy_screens(spark):
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(["AxCadastro('SA1')", "o:Modelo3(1)", "x := modelo2 (1)", "MsNewGetDados():New()", "AxInclui('SA1')", "MyModelo2()"])], "path string, line long, text string")
    assert sorted(r.line for r in static.line_findings(rows, "path").where("rule_id = 'MOD-004'").collect()) == [0, 2, 3]


def test_custom_tables(spark):
    codes = ["SZ1", "SZA", "QA1", "Q10", "Z1", "ZA", "ZA1", "SA1", "ZZZZ", "Z"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r.c for r in df.where(dictionary.custom_table(F.col("c"))).collect()] == ["SZ1", "SZA", "QA1", "Z1", "ZA", "ZA1"]


def test_counts_are_joined_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, k string")
    assert sorted((r.id, r.n) for r in tabular.counted(df, ["k"], "n").collect()) == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 1)]


def test_prefixes_ignore_case(spark):
    df = spark.createDataFrame([("s", x) for x in ("ABCx", "abcy", "AbCz", "abd")], "scope string, name string")
    assert sorted((r.prefix, r.n) for r in tabular.prefix_groups(df, "scope", "name").collect()) == [("abc", 3)]
