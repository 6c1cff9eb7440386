import pytest
from pyspark.sql import functions as F

from ferrule.operators.lineage import impact, lineage, trigger_hits
from ferrule.sources.facts import fact_tables

A = """/*/{X.doc} FATA1
Sums. @author x
@author Ana
@since 2024
/*/
User Function FATA1()
  SA1->A1_COD := SuperGetMV("MV_A") + SuperGetMV("MV_A")
  PutMV("MV_A", 1)
  Pergunte("GRP1")
  U_FATA2()
  MsExecAuto({|x,y| MATA410(x,y)}, aA, 3)
Return
"""
B = """User Function FATA2()
  U_FATA1()
  SA1->(dbAppend())
  StartJob("U_FATA1", "env")
Return
"""


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame([("s/a.prw", A), ("s/b.prw", B), ("s/n.prw", None), ("s/e.prw", "")], "path string, text string")
    routines = spark.createDataFrame([("MATA410", "FAT", ["SA1", "SC5"])], "routine string, module string, tables array<string>")
    t = fact_tables(files, routines)
    t["sx2"] = spark.createDataFrame([("SA1", "Clients")], "code string, name string")
    t["sx3"] = spark.createDataFrame([("SA1", "A1_COD", "C", 6, "U_FATA1()", None, "CLI", "001"), ("SA1", "A1_X", "C", 1, "XFATA1()", "", "", None)], "table_code string, field string, type string, size int, validation string, when_expr string, lookup string, field_group string")
    t["six"] = spark.createDataFrame([("SA1", "1", "A1_COD")], "table_code string, ord string, key string")
    t["sx6"] = spark.createDataFrame([("MV_A", "a parameter")], "name string, description string")
    t["sx7"] = spark.createDataFrame([("A1_COD", "001", "A1_X", "SA1->A1_Y", "SA1")], "source string, seq string, target string, rule string, alias string")
    t["sx1"] = spark.createDataFrame([("GRP1", "01", "From?", "", "MV_A", "A1_COD")], "grp string, ord string, prompt string, lookup string, preset string, validation string")
    t["sx9"] = spark.createDataFrame([("SA1", "SC5", "A1_COD", "C5_CLI")], "source string, target string, source_expr string, target_expr string")
    t["sxb"] = spark.createDataFrame([("CLI",), ("CLI",)], "alias string")
    return t


def edges(t, kind, name, **more):
    return sorted((r.edge, r.path, r.line, r.target, r.detail) for r in lineage(t, kind, name, **more).collect())


def test_function_and_file(tables):
    assert edges(tables, "function", "u_fata1") == [
        ("called_by", "s/b.prw", 2, "FATA2@s/b.prw", "user_func"),
        ("calls", "", 0, "FATA2", "user_func"),
        ("calls", "", 0, "MATA410", "execauto"),
        ("defined_in", "s/a.prw", 6, "FATA1", "user_function"),
        ("documented_in", "s/a.prw", 0, "U_FATA1", "Ana 2024"),
        ("triggered_by_job", "s/b.prw", 4, "U_FATA1", "job"),
        ("validates_field", "", 0, "SA1.A1_COD", "validation"),
    ]
    got = edges(tables, "file", "a.prw")
    assert ("defines_function", "s/a.prw", 6, "FATA1", "user_function") in got and ("calls_execauto", "s/a.prw", 11, "MATA410", "insert") in got
    assert ("arch_summary", "s/a.prw", 0, "parameter", "3") in got and all(e[1] == "s/a.prw" for e in got)


def test_table_field_parameter_prompt(tables):
    table = edges(tables, "table", "sa1")
    assert ("writes", "s/b.prw", 3, "SA1", "write") in table and ("touches", "s/a.prw", 7, "SA1", "alias") in table
    assert {e[0] for e in table} == {"writes", "touches", "table_definition", "n_fields", "indexed_by", "in_relationship", "trigger_on_table", "touched_via_execauto"}
    field = edges(tables, "field", "A1_COD")
    assert {(e[0], e[3]) for e in field} == {("references_field", "A1_COD"), ("field_definition", "SA1.A1_COD"), ("in_consulta", "CLI"), ("in_grupo_sxg", "001"), ("trigger_origin", "A1_X"), ("in_pergunte", "GRP1.01"), ("in_relationship", "SA1-SC5")}
    assert edges(tables, "parameter", "MV_A") == [("in_pergunte_default", "", 0, "GRP1.01", "From?"), ("param_definition", "", 0, "MV_A", "a parameter"), ("used_read", "s/a.prw", 7, "MV_A", "2"), ("used_write", "s/a.prw", 8, "MV_A", "1")]
    assert [e[0] for e in edges(tables, "prompt", "GRP1")] == ["pergunta_definition", "uses_pergunte"]


def test_bounds_and_nothing_found(tables):
    assert edges(tables, "function", "NOBODY") == [] and edges(tables, "table", "ZZ9") == []
    assert {e[0] for e in edges(tables, "table", "SA1", layers=(2,))} == {"table_definition", "n_fields", "indexed_by", "in_relationship", "trigger_on_table"}
    assert len(edges(tables, "table", "SA1", max_per_edge=1, layers=(1,))) == 1
    with pytest.raises(ValueError):
        lineage({}, "table", "SA1")
    assert lineage({"refs": tables["refs"]}, "field", "A1_COD").agg(F.count("*")).first()[0] == 1


TRIGGERS = [("A_1", "1", "A_2", "x", None), ("A_2", "1", "A_3", "f(a_1)", ""), ("A_3", "1", "A_1", "", ""), ("B_1", "1", "B_2", "A_12", None), ("B_3", "1", None, "", "A_3 == 1"), (None, "9", "A_9", "", "")]


def test_trigger_hits(spark):
    df = spark.createDataFrame(TRIGGERS, "source string, seq string, target string, rule string, condition string")
    got = lambda depth: sorted((r.source, r.level, r.via) for r in trigger_hits(df, "a_1", depth).collect())
    assert got(1) == [("A_1", 1, ""), ("A_2", 1, "")]
    assert got(2) == [("A_1", 1, ""), ("A_2", 1, ""), ("A_3", 2, "A_3"), ("B_3", 2, "A_3")]
    assert got(3) == got(2) and trigger_hits(df.limit(0), "A_1", 2).count() == 0


def test_impact(spark):
    rows = spark.createDataFrame([("a", "F", 3, "x := SA1->A_1"), ("a", "F", 5, "A_1 := 2"), ("b", None, 1, "y(A_1)"), ("c", "G", 1, "A_12 := 1"), ("d", "H", 1, None)], "path string, unit string, line int, text string")
    t = {"sx7": spark.createDataFrame(TRIGGERS, "source string, seq string, target string, rule string, condition string")}
    t["sx3"] = spark.createDataFrame([("SA", "A_1", "A_1 > 0", None), ("SA", "A_7", "", "a_1"), ("SA", "A_8", "A_12", None)], "table_code string, field string, validation string, init string")
    t["sx1"] = spark.createDataFrame([("G", "1", "p", "A_1"), ("G", "2", "q", None)], "grp string, ord string, prompt string, validation string").withColumn("lookup", F.lit(""))
    got = [tuple(r) for r in impact(rows, t, "a_1", depth=2).collect()]
    want = [("critical", "source", "a:3", "F"), ("critical", "trigger", "A_1#1 -> A_2", "depth=1"), ("critical", "trigger", "A_2#1 -> A_3", "depth=1"), ("critical", "trigger", "A_3#1 -> A_1", "depth=2 A_3"), ("critical", "trigger", "B_3#1 -> ", "depth=2 A_3")]
    want += [("warning", "definition", "SA.A_1", ""), ("warning", "dictionary", "SA.A_1", "validation"), ("warning", "dictionary", "SA.A_7", "init"), ("warning", "prompt", "G/1", "p"), ("warning", "source", "b:1", "")]
    assert got == want
    assert impact(rows.limit(0), {}, "A_1").count() == 0
