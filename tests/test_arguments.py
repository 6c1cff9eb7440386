"""Argument lists and embedded SQL: brackets, quotes, lines, scopes."""

from ferrule.rules import dictionary, static
from ferrule.sources import arguments, code
from ferrule.sources import embedded_sql as sql

TEXT = """User Function ABC_Wide(cA, aB := {1, 2, F({3, 4})}, cC := "x,y)", cD, cE, cF, cG)
  RpcSetEnv("01", Iif(lX, "a,b", U_F(1, {2, 3})), "u)", 'p(',
     "ENV", "FAT") // RpcSetEnv("no")
  x := "RpcSetEnv('99')"
  MsExecAuto({|x, y, z| MATA410(x, G(y, "1,2"), z)}, aCab, {{"C5_NUM", "00,1", Nil}}, 3)
  MsExecAuto({|x| &cRot.(x)}, aCab, nOp)
  MsExecAuto(bBlock, 3)
  MsExecAuto({|| Fina050()})
  RpcSetEnv("open",
Return
Method Two(a, b) Class Thing
  RpcSetEnv(cA)
Return SuperGetMV("MV_X", .F., "a,b(") + GetNewPar("MV_Y", {1, 2})
"""


def files(spark, *texts):
    return spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)] + [("null", None), ("empty", "")], "path string, text string")


def test_cut():
    assert arguments.cut('a, f(b, "c,d"), {1, {2, 3}}, \'x)y\', [4, 5]') == ["a", 'f(b, "c,d")', "{1, {2, 3}}", "'x)y'", "[4, 5]"]
    assert arguments.cut("") == arguments.cut(None) == [] and arguments.cut("a,") == ["a", ""] and arguments.cut(" ,") == ["", ""]
    assert [x[1:] for x in arguments.bracketed("F(a, G(b, c), (d))")] == [("G", ["b", "c"]), ("", ["d"]), ("F", ["a", "G(b, c)", "(d)"])]


def test_calls_go_over_lines(spark):
    got = arguments.call_arguments(files(spark, TEXT), ("rpcsetenv",)).collect()
    assert [(r.line, len(r.args)) for r in got] == [(2, 6), (12, 1)] and got[0].args[1] == 'Iif(lX, "a,b", U_F(1, {2, 3}))'
    assert [(r.line, r.name, len(r.args)) for r in arguments.signatures(files(spark, TEXT)).collect()] == [(1, "ABC_Wide", 7), (11, "Two", 2)]


def test_openers_routines_parameters(spark):
    df = files(spark, TEXT)
    assert [(r.unit, r.line, r.company, r.branch, r.environment, r.module) for r in code.environment_openers(df).orderBy("line").collect()] == [("ABC_Wide", 2, "01", "", "ENV", "FAT"), ("Two", 12, "", "", "", "")]
    routines = spark.createDataFrame([("MATA410", "FAT", ["SC5"])], "routine string, module string, tables array<string>")
    got = code.routine_calls(df, routines).orderBy("line").collect()
    assert [(r.line, r.routine, r.op_code, r.op_label, r.dynamic, r.arg_count) for r in got] == [(5, "MATA410", 3, "insert", False, 3), (6, "&", None, None, True, 1), (8, "FINA050", None, None, False, 0)]
    assert [(r.name, r.default) for r in code.parameter_reads(df).orderBy("name").collect()] == [("MV_X", '"a,b("'), ("MV_Y", "{1, 2}")]
    assert [(r.line, r.rule_id) for r in static.findings(df).where("rule_id in ('BP-005', 'SEC-002')").collect()] == [(1, "BP-005")]


def columns(text, *clauses):
    return [(c["clause"], c["table_code"], c["column"]) for c in sql.read_sql(text)["columns"] if not clauses or c["clause"] in clauses]


def test_scopes_of_statements():
    text = """SELECT A1_COD, (SELECT MAX(E1_VALOR) FROM SE1010 E1 WHERE E1.E1_CLIENTE = C.A1_COD) FROM %table:SA1% C
      LEFT JOIN SB1010 AS B1 ON B1.B1_COD = C.A1_COD, ZZ9 WHERE C.A1_EST = 'B1_X, (' AND ZZ9_FLAG = %exp:A1_NO% -- A1_NOT
      AND EXISTS (SELECT 1 FROM SA2 WHERE A2_COD = A1_LOJA) GROUP BY A1_COD ORDER BY B1.B1_DESC, C.D_E_L_E_T_"""
    got = sql.read_sql(text)
    assert got["operation"] == "select" and got["tables"] == ["SA1", "SA2", "SB1", "SE1", "ZZ9"] and got["filtered"]
    assert sorted(columns(text, "where", "order")) == sorted(
        [("where", "SE1", "E1_CLIENTE"), ("where", "SA1", "A1_COD"), ("where", "SA1", "A1_EST"), ("where", "ZZ9", "ZZ9_FLAG"), ("where", "SA2", "A2_COD"), ("where", "SA1", "A1_LOJA"), ("order", "SB1", "B1_DESC"), ("order", "SA1", "D_E_L_E_T_")]
    )
    assert columns(text, "on") == [("on", "SB1", "B1_COD"), ("on", "SA1", "A1_COD")]


def test_other_statements():
    assert [(lambda r: (r["operation"], r["tables"], r["filtered"]))(sql.read_sql(t)) for t in ("UPDATE SA1010 SET A1_X = 1", "delete from SB1 where B1_COD = ''", "INSERT INTO ZA1 (ZA1_A) SELECT A1_COD FROM SA1 WHERE A1_COD = '1'", "nothing", "")] == [
        ("update", ["SA1"], False),
        ("delete", ["SB1"], True),
        ("insert", ["SA1", "ZA1"], True),
        ("", [], False),
        ("", [], False),
    ]
    assert columns("SELECT 1 FROM SA1 WHERE A1_A = 1 UNION SELECT 1 FROM SB1 X WHERE X.B1_B = 2", "where") == [("where", "SA1", "A1_A"), ("where", "SB1", "B1_B")]
    assert columns("SELECT 1 FROM (SELECT A1_COD FROM SA1 WHERE A1_D = 1) T WHERE T.A1_COD = 1", "where") == [("where", "", "A1_COD"), ("where", "SA1", "A1_D")]
    assert sql.literal_sql('"SELECT A1_COD FROM " + RetSqlName("SA1") + " WHERE A1_X = " + cX') == "SELECT A1_COD FROM  SA1  WHERE A1_X =  ? " and sql.literal_sql("cQuery") == ""


SOURCE = """User Function ABC_Q()
  BeginSql alias "T"
    SELECT A1_COD FROM %table:SA1% SA1
    WHERE SA1.A1_NOME = 'x' AND A1_COD = '1' AND %notDel%
    ORDER BY A1_EST
  EndSql
  TCSqlExec("UPDATE " + RetSqlName("SB1") + " SET B1_X = 1")
  TCSqlExec("UPDATE SB1010 SET B1_X = 1" + ;
    " WHERE B1_COD = '1'")
  TCQuery(cSql)
Return
"""


def test_perf_006_and_sql_002_from_source(spark):
    df = files(spark, SOURCE)
    read = sql.embedded_sql(df)
    assert [(r.unit, r.line, r.via, r.operation, r.tables) for r in read.orderBy("line").collect()] == [("ABC_Q", 2, "block", "select", ["SA1"]), ("ABC_Q", 7, "tcsqlexec", "update", ["SB1"]), ("ABC_Q", 8, "tcsqlexec", "update", ["SB1"])]
    indexes = spark.createDataFrame([("SA1", "A1_FILIAL+A1_COD"), ("SA1", "A1_FILIAL+A1_EST")], "table_code string, key string")
    assert [(r.line, r.table_code, r.column) for r in dictionary.unindexed(sql.sql_columns(read), indexes).collect()] == [(2, "SA1", "A1_NOME")]
    assert [r.line for r in static.findings(df).where("rule_id = 'SQL-002'").collect()] == [7]
