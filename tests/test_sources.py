from pyspark.sql import functions as F

from ferrule.functions import frontend, masking, metrics
from ferrule.functions import text as X
from ferrule.operators import graph as G
from ferrule.operators import tabular as O
from ferrule.rules import config_audit, decisions, dictionary as rules, static
from ferrule.sinks import render
from ferrule.sources import code, config, dictionary, files, logs

SOURCE = """#Include "prelude.ch"
/*/{Acme.doc} FATA050
Writes orders. @author x
@author Ana
@since 2024-01-01
@param cA, character, first
@param nB
@return logical
/*/
User Function FATA050(cA, nB)
    Local cX := "U_NOT(1) // kept"   // U_HIDDEN(
    DbSelectArea("SA1")
    RecLock("SA1", .F.)
    SA1->A1_NOME := SuperGetMV("MV_ABC", .F., "x")
    U_Other(cX)
    MsExecAuto({|x,y| MATA410(x,y)}, aA, 3)
    PutMV("MV_ABC", 1)
    If nB > 10 .And. cA == "S"
        ConOut("hi")
    EndIf
Return
* User Function Old()
Static Function Helper()
    RecLock("ZA1", .T.)
    MsUnlock()
    oObj:Run()
    BeginSql
Return .F.
METHOD New(a, b) CLASS Thing
Return
"""


def test_blanked_keeps_shape():
    for t in (SOURCE, "", "'", '"a', "/* open\n\n x", "&& c\nx", "a /* b */ c // d"):
        out = code.blanked(t)
        assert len(out) == len(t) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(t) if c == "\n"]
        assert code.blanked(out) == out
    assert "HIDDEN" not in code.blanked(SOURCE) and "U_NOT" not in code.blanked(SOURCE) and "U_NOT" in code.blanked(SOURCE, strings=False)
    assert "Function Old" not in code.blanked(SOURCE)
    long = "/*" + "\n" * 300 + "Function Late()"
    assert "Function Late" in code.blanked(long)


def test_source_facts(spark):
    df = spark.createDataFrame([("a.prw", SOURCE), ("b.prw", None), ("c.prw", "")], "path string, text string")
    rows = code.source_lines(df)
    units = {r.name: r for r in code.units(rows, "path").collect()}
    assert {n: u.kind for n, u in units.items()} == {"FATA050": "user_function", "Helper": "static_function", "New": "method"}
    assert units["New"]["class"] == "Thing" and units["FATA050"].end_line == units["Helper"].line - 1
    calls = {(r.kind, r.callee, r.unit) for r in code.calls(df).collect()}
    assert {("user_func", "Other", "FATA050"), ("execauto", "MATA410", "FATA050"), ("method", "oObj:Run", "Helper")} <= calls
    assert not any(c == "HIDDEN" for _, c, _ in calls)
    assert {r.name: r.modes for r in code.table_modes(df).collect()} == {"SA1": ["alias", "lock", "read"], "ZA1": ["lock"]}
    assert [(r.name, r["mode"]) for r in code.parameter_modes(df).collect()] == [("MV_ABC", "read_write")]
    doc = code.doc_blocks(df).first()
    assert (doc.unit, doc.author, doc.since, doc.returns, len(doc.params), doc.deprecated) == ("FATA050", "Ana", "2024-01-01", "logical", 2, False)
    kinds = {(r.kind, r.value) for r in code.named(rows, "path").collect()}
    assert {("include", "prelude.ch"), ("field", "A1_NOME"), ("log", "ConOut"), ("sql", "BeginSql")} <= kinds
    label = spark.createDataFrame([("| Programa....: X\n| Autor : Ana B |", 1), ("Autor: x", 2)], "t string, k int")
    got = [r[0] for r in label.orderBy("k").select(code.header_labels(F.col("t"), ["Programa", "Autor"])).collect()]
    assert got == [{"Programa": "X", "Autor": "Ana B"}, {}]


def test_references_of_lines(spark):
    lines = [
        'Posicione("SA1", 1, xFilial("SB1") + cX)',
        'x := RetSqlTab("SC5") + GetMVDef("MV_AAA", "d") + FWMVPar(\'MV_BBB\')',
        'ZA1->(dbAppend()) ; SC6 -> (RecLock("SC6"))',
        'FWFormStruct(1, "SA2") ; FWFormStruct(2, "SA3") ; FWFormStruct(nX, "SA4")',
        'FWExecView("t", "VIEWX") ; FWLoadModel("MODX") ; ExistBlock("PEX")',
        '::Run(1) ; oA:Go() ; U_abc () ; 9:x()',
        'RecLock(cAlias) ; DbSelectArea()',
        "",
        None,
    ]
    df = spark.createDataFrame([("a", k, t) for k, t in enumerate(lines)], "path string, line int, text string")
    got = sorted((r.line, r.what, r.kind, r.value) for r in code.named(df, "path").collect())
    want = [(0, "table", "read", "SA1"), (0, "table", "read", "SB1"), (1, "table", "read", "SC5"), (1, "parameter", "read", "MV_AAA"), (1, "parameter", "read", "MV_BBB")]
    want += [(2, "table", "write", "ZA1"), (2, "table", "lock", "SC6"), (2, "table", "lock", "SC6"), (3, "table", "model", "SA2")]
    want += [(4, "call", "execview", "VIEWX"), (4, "call", "loadmodel", "MODX"), (4, "call", "execblock", "PEX"), (5, "call", "method", "::Run"), (5, "call", "method", "oA:Go"), (5, "call", "user_func", "abc"), (5, "call", "method", "9:x")]
    assert got == sorted(want)


def test_endpoints(spark):
    text = '@Get("/a/b")\n@Post(endpoint = "/c", x="y")\n@Other("/z")\nWSMETHOD GET orders WSSERVICE Sales\nWSMETHOD orders WSSERVICE Sales\nWSMETHOD PUT one WSRECEIVE id WSSERVICE Sales\n'
    got = [(r.line, r.style, r.verb, r.route, r.service) for r in code.endpoints(spark.createDataFrame([("a", text), ("n", None)], "path string, text string")).orderBy("line").collect()]
    assert got == [(1, "annotation", "GET", "/a/b", ""), (2, "annotation", "POST", "/c", ""), (4, "classic", "GET", "orders", "Sales"), (6, "classic", "PUT", "one", "Sales")]


def test_findings(spark):
    df = spark.createDataFrame([("a.prw", SOURCE + "Public cZ\ncSenha := 'abcdef'\nPrivate lMsErroAuto\nPrivate zz\n"), ("b.prw", "BEGIN TRANSACTION\nx\n")], "path string, text string")
    got = {(r.path, r.rule_id, r.line) for r in static.findings(df).collect()}
    fired = {(p, r) for p, r, _ in got}
    assert {("a.prw", "MOD-001"), ("a.prw", "BP-001"), ("a.prw", "BP-003"), ("a.prw", "MOD-002"), ("a.prw", "SEC-004"), ("a.prw", "BP-002b"), ("b.prw", "BP-002")} <= fired
    assert ("a.prw", "BP-007") not in fired and sum(r == "BP-001" for _, r, _ in got) == 1 and sum(r == "BP-002b" for _, r, _ in got) == 1
    units = spark.createDataFrame([("a", 1, "user_function", "lower", "a,b,c,d,e,f,g"), ("a", 2, "user_function", "ABC_X", "")], "path string, line int, kind string, name string, args string")
    assert {(r.line, r.rule_id) for r in static.unit_findings(units, "path").collect()} == {(1, "BP-005"), (1, "SEC-002")}


REST = """WSRESTFUL Orders
RpcSetEnv("01")
For i := 1
  cX += "a"
Next
cY += "b"
ConOut("x " + cCpf)
self:SetResponse(cJson)
self:SetResponse(EncodeUTF8(cJson))
oRest:Frobnicate(1)
BeginSql alias 'x'
  SELECT A1_COD FROM %table:SA1% SA1 -- why
  WHERE A1_COD = '--'
EndSql
BeginSql
  SELECT A1_COD FROM SA1010 WHERE A1_FILIAL = '01' AND D_E_L_E_T_ = ' '
EndSql
WSMETHOD GET list WSSERVICE Orders
WSMETHOD GET other WSSERVICE Nowhere
StaticCall(x, y)
"""


def test_context_findings(spark):
    df = spark.createDataFrame([("r.prw", REST), ("j.prw", 'Main Function Job()\nDbSeek(xFilial("SA1"))\nRpcSetEnv("1")\nDbSeek(xFilial("SA1")+xFilial("SB1"))\n')], "path string, text string")
    got = {(r.rule_id, r.line) for r in static.findings(df).where("path = 'r.prw'").collect()}
    want = {("SEC-001", 2), ("PERF-004", 4), ("SEC-003", 7), ("WS-003", 8), ("WS-004", 10), ("PERF-003", 11), ("PERF-002", 11), ("SQL-001", 12), ("WS-001", 19)}
    assert want <= got and not {("PERF-004", 6), ("WS-003", 9), ("SQL-001", 13), ("PERF-002", 15), ("PERF-003", 15), ("WS-001", 18)} & got
    rows = code.source_lines(df)
    assert [(r.line, r.snippet) for r in static.restricted_calls(rows, "path", spark.createDataFrame([("STATICCALL",)], "name string")).collect()] == [(20, "StaticCall")]
    found = static.branch_findings(rows, "path", spark.createDataFrame([("SA1", "E"), ("SB1", "C")], "code string, mode string"))
    assert [(r.path, r.line, r.snippet) for r in found.collect()] == [("j.prw", 2, "SA1")]


def test_metrics(spark):
    t = spark.createDataFrame([("If a\nElse\nEndIf\nDo Case\nCase x\nOtherWise\nEndCase\nFor i\nNext\n\n",)], "t string")
    assert t.select(metrics.complexity(F.col("t")), metrics.loc(F.col("t")), metrics.parameters(F.lit("a, b")), metrics.parameters(F.lit(" "))).first()[:] == (4, 9, 2, 0)


def test_decisions(spark):
    rows = spark.createDataFrame([(1, 'If nB > 10 .And. cA == "S"'), (2, "x := 3"), (3, "  While lOk = .T.")], "line int, text string")
    got = [(r.line, r.left, r.op, r.right, r.kind) for r in decisions.comparisons(rows).collect()]
    assert got == [(1, "nB", ">", "10", "number"), (1, "cA", "==", '"S"', "text"), (3, "lOk", "=", ".T.", "logical")]
    rec = spark.createDataFrame([(5, "x"), (20, "x"), (None, "x")], "n int, s string")
    assert [(r.taken, r.decided_by) for r in decisions.evaluate(rec, [("n", ">", 10), ("s", "=", "x")]).collect()] == [(False, "n > 10"), (True, None), (False, "n > 10")]
    cat = spark.createDataFrame([("9", "Foo"), ("10", "bar"), ("x", "baz")], "n string, s string")
    assert [r.s for r in cat.where(decisions.parse_filter("n > 9 and s like %A%")).collect()] == ["bar", "baz"]
    assert [r.s for r in cat.where(decisions.parse_filter("n = 9 OR s = baz")).collect()] == ["Foo", "baz"]


def test_configuration(spark):
    ini = "top=1\n; note one\n; intentional\n[General]\nMaxLines=10 ; on purpose\n# above\nName = x=y\n\njunk\n;[Off]\nk=1\n[dbaccess/x]\r\nPort=99999\r\n[GENERAL]\nFlag=Sim\n"
    keys = config.parse(spark.createDataFrame([("a.ini", ini)], "path string, text string"))
    got = {(r.section, r.key_name): r for r in keys.collect()}
    assert got["", "top"].value == "1" and got["General", "MaxLines"].note == "on purpose" and got["General", "Name"].value == "x=y" and got["General", "Name"].note == "above"
    assert got["Off", "k"].kind == "commented" and got["dbaccess/x", "Port"].value == "99999" and [r.value for r in keys.where("kind = 'dirty'").collect()] == ["junk"]
    rule = "rule_id string, key string, section string, kind string, expected string, severity string, file_type string, roles string, conditional boolean"
    table = spark.createDataFrame([("R1", "maxlines", "general", "range_check", "50..", "critical", "", "", False), ("R2", "port", "dbaccess/", "range_check", "1..65535", "critical", "srv", "a|b", False), ("R3", "flag", "*", "value_eq", "1", "warning", "", "", False), ("R4", "gone", "general", "key_present", "v|w", "critical", "other", "", False), ("R5", "gone", "general", "key_present", "v|w", "critical", "", "b", False)], rule)
    live = keys.where("kind = 'key'").select("path", "section", F.col("key_name").alias("key"), "value", "note")
    sections = spark.createDataFrame([("a.ini", "General"), ("a.ini", "dbaccess/x")], "path string, section string")
    found = config_audit.audit(live, sections, spark.createDataFrame([("a.ini", "srv", "b")], "path string, type string, role string"), table)
    status = {(r.rule_id, r.section): r.status for r in found.collect()}
    assert status["R1", "General"] == "ok_with_note" and status["R2", "dbaccess/x"] == "wrong" and status["R5", "General"] == "missing" and ("R4", "General") not in status
    score = config_audit.audit_score(found).first()
    assert 0 < score.score < 60 and score.label == "poor"
    fixed = {(r.section, r.key): (r.value, r.change) for r in config_audit.suggest(live, found).collect()}
    assert fixed["General", "gone"] == ("v", "added") and fixed["dbaccess/x", "Port"][1] == "corrected"
    assert "[General]" in render.config_lines(config_audit.suggest(live, found)).first().text
    known = spark.createDataFrame([("*", "top"), ("general", "MAXLINES"), ("general", "name")], "section string, key string")
    assert {r.key for r in config_audit.unknown_keys(live, known).collect()} == {"Port", "Flag"}
    kinds = config.classify(live, {"db": F.col("section").startswith("dbaccess"), "app": F.col("section") == "General"}, "other")
    # parse() names the column key_name; classify reads any columns
    assert kinds.first()["class"] == "db"


def test_value_checks(spark):
    rows = [("value_eq", "sim", "1", True), ("value_eq", "No", "off", True), ("value_neq", "a", "b", True), ("value_in", "B", "a|b", True), ("range_check", "5", "..4", False), ("range_check", "x", "1..4", False), ("regex", "ab12", "^[a-z]+[0-9]+$", True), ("key_missing", "x", "", False), ("key_present", "x", "", True)]
    df = spark.createDataFrame(rows, "kind string, value string, expected string, want boolean")
    assert df.where(config_audit.value_ok(F.col("kind"), F.col("value"), F.col("expected")) != F.col("want")).count() == 0


def test_log_triage(spark):
    text = "orphan\n2024-01-02T03:04:05.5-03:00 77|start\nbody ORA-00942 here\n\n[03/01/2024 10:00:00] disk full on sda\n[ERROR] plain\nTHREAD ERROR ([12], a, b) 04/01/2024 10:00:00 boom\n"
    rows = logs.events(spark.createDataFrame([("x.log", text)], "path string, text string")).orderBy("line")
    got = rows.collect()
    assert [(r.line, str(r.ts), r.thread) for r in got] == [(2, "2024-01-02 03:04:05.500000", "77"), (5, "2024-01-03 10:00:00", None), (6, "None", None), (7, "2024-01-04 10:00:00", "12")]
    assert got[0].body == "body ORA-00942 here\n"
    rules = spark.createDataFrame([("D1", 5, "critical", "db", r"ORA-(\d+)", "database error {1}"), ("D2", 1, "warning", "disk", r"disk full on (\w+)", "{1} is full"), ("Z", 9, "info", "any", ".", "any")], "rule_id string, priority int, severity string, category string, pattern string, message string")
    out = {r.line: (r.rule_id, r.message) for r in logs.diagnose(rows, rules).collect()}
    assert out == {2: ("D1", "database error 00942"), 5: ("D2", "sda is full"), 6: ("Z", "any"), 7: ("Z", "any")}
    assert {r.line for r in logs.diagnose(rows, rules, severities=("critical", "warning")).collect()} == {2, 5}
    assert {r.line for r in logs.diagnose(rows, rules, window_seconds=86400).collect()} == {5, 6, 7}
    assert {r.line for r in logs.diagnose(rows, rules, most=2, noise="boom").collect()} == {5, 6}
    facts = logs.header_facts(spark.createDataFrame([("x.log", text)], "path string, text string"), {"first": r"\|(\w+)"}).first()
    assert facts.first == "start" and facts.n_events == 4


def test_dictionary(spark, tmp_path):
    (tmp_path / "sx3.csv").write_text("﻿X3_ARQUIVO,X3_CAMPO,X3_TAMANHO,X3_OBRIGAT,X3_VALID,X3_F3,X3_PROPRI,D_E_L_E_T_\nSA1,A1_COD,6,X,U_Known(),SA1,, \nSA1,A1_XNEW,abc,,\"U_Gone(1), x\",ZZ9,U,\nSA1,A1_COD,7,X,U_Known(),,,\nSA1,A1_OLD,1,,,,,*\n")
    (tmp_path / "sx7.csv").write_text("X7_CAMPO;X7_SEQUENC;X7_CDOMIN;X7_TIPO;X7_SEEK\nA1_COD;001;A1_NONE;P;N\n")
    got = dictionary.load(spark, str(tmp_path))
    fields = {r.field: r for r in got["sx3"].collect()}
    assert set(fields) == {"A1_COD", "A1_XNEW"} and fields["A1_COD"].size == 7 and fields["A1_XNEW"].size == 0 and fields["A1_COD"].required is True
    raw = dictionary.normalised(dictionary.read_csv(spark, str(tmp_path / "sx3.csv")), next(e for e in dictionary.EXPORTS if e.stem == "sx3"))
    assert dictionary.last_wins(raw, ("table_code", "field"))[1].first()[:] == (3, 2, 1)
    f = got["sx3"].withColumn("custom", dictionary.custom_field(F.col("field"), F.col("owner")))
    empty = lambda s: spark.createDataFrame([], s)
    found = rules.referential(f, got["sx7"], spark.createDataFrame([("MV_X", True), ("MV_Y", True)], "name string, custom boolean"), spark.createDataFrame([("G1",), ("G1",)], "grp string"), spark.createDataFrame([("mv_y",)], "name string"), empty("grp string"), spark.createDataFrame([("SA1",)], "alias string"), spark.createDataFrame([("KNOWN",)], "name string"), spark.createDataFrame([("SA1", "C")], "code string, mode string"), empty("name string"))
    assert {(r.rule_id, r.subject) for r in found.collect()} == {("SX-001", "A1_XNEW"), ("SX-002", "A1_COD"), ("SX-003", "MV_X"), ("SX-004", "G1"), ("SX-009", "A1_COD"), ("SX-010", "A1_COD"), ("SX-011", "A1_XNEW")}
    assert [r.subject for r in rules.unreferenced(f, spark.createDataFrame([("uses A1_COD only",)], "text string")).collect()] == ["A1_XNEW"]
    assert spark.createDataFrame([("ZA1",), ("SZ9",), ("QAB",), ("SA1",)], "c string").where(dictionary.custom_table(F.col("c"))).count() == 3
    counts = spark.createDataFrame([("SA1010", "5"), ("SA1020", "7"), ("TOP_X", "9")], "TABLE_NAME string, NUM_ROWS string")
    assert [(r.code, r.num_rows) for r in dictionary.physical_counts(spark.createDataFrame([("SA1",), ("SB1",)], "code string"), counts).orderBy("code").collect()] == [("SA1", 12), ("SB1", 0)]
    (tmp_path / "c.tsv").write_text("a\tb\n1\t2\n\t\n3\n")
    assert [r.row for r in dictionary.catalog(spark, str(tmp_path / "c.tsv"), "c").orderBy("row_id").collect()] == [{"a": "1", "b": "2"}, {"a": "3", "b": ""}]
    used = spark.createDataFrame([("p", 1, "SA1", "A1_NOME"), ("p", 2, "SA1", "a1_cod"), ("p", 3, "SA1", "A1_FILIAL"), ("p", 4, "SB1", "B1_X")], "path string, line int, table_code string, column string")
    assert [r.line for r in rules.unindexed(used, spark.createDataFrame([("SA1", "A1_FILIAL+A1_COD+DTOS(A1_DATA)")], "table_code string, key string")).collect()] == [1]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.prw").write_bytes("olá €".encode("cp1252"))
    (tmp_path / "sub/A.PRW").write_bytes(b"\xef\xbb\xbf" + "olá".encode())
    (tmp_path / "sub/b.prw.bak").write_text("x")
    (tmp_path / "c.prw").write_text("")
    (tmp_path / "d.prw").write_text("plain")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_texts(spark, str(tmp_path), [".prw"], ["**/d.prw"]).collect()}
    assert {k: (v.encoding, v.text) for k, v in rows.items()} == {"a.prw": ("cp1252", "olá €"), "A.PRW": ("utf-8-bom", "olá")}
    found = files.read_texts(spark, str(tmp_path), [".prw"]).drop("text", "encoding")
    assert files.collisions(found).first().n == 2 and files.first_of_name(found).count() == 2
    state = found.select("path", F.col("modificationTime").alias("mtime"))
    assert files.changed(found, state).count() == 0 and files.changed(found, state.limit(0)).count() == 3
    assert files.replaced(state, state.limit(1)).count() == 3


def test_frontend(spark):
    ts = "import { TableModule, PageModule as P } from '@ui/components';\nthis.http.get<X>(`/api/v1/Orders/${id}`); http.post('http://h/api/x?y=1', b)"
    f = spark.createDataFrame([("a.ts", ts)], "path string, text string")
    assert {(r.package, r.symbol) for r in frontend.imports(f).collect()} == {("@ui/components", "TableModule"), ("@ui/components", "PageModule")}
    assert {(r.verb, r.norm) for r in frontend.http_calls(f).collect()} == {("GET", "/api/v1/orders/{id}"), ("POST", "/api/x")}
    t = spark.createDataFrame([("a.html", '<ui-table [p-items]="a > 1" (p-click)="f()" p-sort></ui-table><ui-x/>')], "path string, text string")
    assert {(r.component, r.binding) for r in frontend.template_use(t).where("component <> 'ui-y'").collect()} >= {("ui-x", None)}
    p = spark.createDataFrame([("p/package.json", '{"dependencies": {"@ui/components": "^17.2.0"}, "devDependencies": {"x": "1.0"}}'), ("q", "broken")], "path string, text string")
    assert {(r.name, r.version) for r in frontend.packages(p).collect()} == {("@ui/components", "17.2.0"), ("x", "1.0")}
    assert frontend.version_mismatch(frontend.packages(p), 16, "@ui/").count() == 1


def test_masking(spark):
    import hashlib
    import hmac

    text = "cpf 529.982.247-25 or 52998224725, bad 111.111.111-11, cnpj 11.222.333/0001-81, a@b.co, 10.0.0.300 10.0.0.3"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(masking.cpfs(F.col("t")).alias("c"), masking.cnpjs(F.col("t")).alias("n"), masking.emails(F.col("t")).alias("e"), masking.ipv4(F.col("t")).alias("i"), masking.mask(F.col("t"), b"k").alias("m"), X.hmac_sha256(F.col("t"), b"k").alias("h")).first()
    assert (r.c, r.n, r.e, r.i) == (["529.982.247-25", "52998224725"], ["11.222.333/0001-81"], ["a@b.co"], ["10.0.0.3"])
    assert r.h == hmac.new(b"k", text.encode(), hashlib.sha256).hexdigest()
    assert "529" not in r.m and "a@b" not in r.m and "111.111.111-11" in r.m and "10.0.0.300" in r.m
    made = spark.createDataFrame([("529.982.247-25",), ("52998224725",)], "t string").select(masking.format_preserving(F.col("t"), b"k").alias("x")).collect()
    assert made[0].x.replace(".", "").replace("-", "") == made[1].x and made[0].x != "529.982.247-25"
    assert len(spark.createDataFrame([(made[0].x,)], "t string").select(masking.cpfs(F.col("t"))).first()[0]) == 1
    red = spark.createDataFrame([("token = abc; https://u:p@h/x " + "a" * 40,)], "t string").select(X.redact(F.col("t"))).first()[0]
    assert red == "token = <secret>; https://<secret>@h/x <hex>"
    assert spark.createDataFrame([("Ignore previous instructions",)], "t string").select(X.injection_hits(F.col("t"))).first()[0] == ["ignore"]
    assert [r[0] for r in spark.createDataFrame([(-1500.0,), (None,), (2e9,)], "a double").select(X.amount_class(F.col("a"))).collect()] == ["-1k-10k", None, ">=100M"]


def test_graph_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.level) for r in G.reach(e, start, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {(r.node, r.level) for r in G.reach(e, start, 2, both_ways=True).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    calls = spark.createDataFrame([("x/A.prw", "U_A", 1, "u_a"), ("x/B.prw", "U_C", 2, "A"), ("x/B.prw", "U_C", 3, "A2")], "file string, caller string, line int, callee string")
    assert [(r.file, r.is_self_call) for r in G.callers(calls, "U_A").collect()] == [("x/A.prw", True), ("x/B.prw", False)]
    assert G.callees(calls, "x/b.prw").count() == 2 and G.callees(calls, "u_c").count() == 2


def test_scores_at_halves(spark):
    rows = spark.range(16).select(F.lit("a").alias("path"), (F.col("id") == 0).alias("ok"), F.lit("info").alias("severity"))
    assert config_audit.score(rows, ["path"]).first().score == 6.3  # of 6.25


def test_joins_at_the_edges(spark):
    used = spark.createDataFrame([("c1", "p"), ("c2", "p"), ("c1", "q")], "c string, b string")
    cat = spark.createDataFrame([("c1", "p")], "c string, b string")
    assert [(r.c, r.b) for r in O.unknown(used, cat, ["c", "b"], ["c"]).collect()] == [("c1", "q")]
    assert O.unknown(used, cat.limit(0), ["c", "b"]).count() == 0
    left = spark.createDataFrame([(1, "api/v1/orders"), (2, "x")], "left_id int, left_path string")
    right = spark.createDataFrame([(9, "v1/orders"), (8, "full/api/v1/orders"), (7, "rders")], "right_id int, right_path string")
    assert {(r.left_id, r.right_id) for r in O.suffix_bridge(left, right).collect()} == {(1, 9), (1, 8)}
    same = spark.range(0, 1200, 1, 1).select(F.lit("b/c").alias("p"), "id")
    many = O.suffix_bridge(same.toDF("left_path", "left_id"), same.toDF("right_path", "right_id"))
    parts = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 1200**2 and many.distinct().count() == 1200**2 and max(parts) < sum(parts)
    assert "keys=[left_id" not in many._jdf.queryExecution().executedPlan().toString()  # pairs are dealt out once, in groups
    assert O.find_units(spark.createDataFrame([("f", 1, "Abc")], "file string, line int, name string"), "ABC").count() == 1
    for glob, path, want in (("src/", "src/a/b.x", True), ("*.bak", "x/y.bak", True), ("a/*.p", "a/b/c.p", False), ("a/**.p", "a/b/c.p", True)):
        assert spark.createDataFrame([(path,)], "p string").where(F.col("p").rlike(X.glob_regex(glob))).count() == want


def test_rendering(spark):
    df = spark.createDataFrame([(i, f"a|{i}\n<b>") for i in range(30)], "id int, t string").orderBy("id")
    import json

    out = json.loads(render.to_json(df, 5, 2))
    assert (out["total"], out["shown"], out["truncated"], out["rows"][0]["id"]) == (30, 5, True, 2)
    assert "a\\|0<br><b>" in render.to_markdown(df) and render.to_markdown(df).count("\n") == 21
    assert "&lt;b&gt;" in render.to_html(df, 2) and len(render.to_text(df, 3).split("\n")) == 4
    assert render.shown(df, 1, masks={"t": F.lit("x")}).first().t == "x"
    assert "<table>" in render.score_report(spark.createDataFrame([("f", 90.0, "compliant")], "p string, s double, l string"), df, "R")


MORE = """User Function MT410INC()
  x := PARAMIXB[1]
  MsExecAuto({|x,y| MATA410(x,y)}, aA, 3)
  MsExecAuto({|x| FINA050(x)}, nOp)
  RpcSetEnv("01", cFil,,, "ENV", "FAT")
  PREPARE ENVIRONMENT EMPRESA "99" FILIAL "02"
  oP := TWFProcess():New("WF01", "x")
  StartJob("U_NIGHT", "env")
Return
User Function helper()
Return
WSSTRUCT Item
  WSDATA code AS String
  WSDATA price AS Float
ENDWSSTRUCT
"""


def test_more_source_facts(spark):
    df = spark.createDataFrame([("a.prw", MORE)], "path string, text string")
    catalog = spark.createDataFrame([("MATA410", "FAT", ["SC5", "SC6"])], "routine string, module string, tables array<string>")
    got = [(r.routine, r.module, r.op_code, r.op_label, r.dynamic, r.tables) for r in code.routine_calls(df, catalog).orderBy("line").collect()]
    assert got == [("MATA410", "FAT", 3, "insert", False, ["SC5", "SC6"]), ("FINA050", None, None, None, True, None)]
    assert {(r.kind, r.value) for r in code.execution_triggers(df).collect()} == {("workflow", "WF01"), ("job", "U_NIGHT")}
    assert [(r.unit, r.evidence) for r in code.entry_points(df).collect()] == [("MT410INC", "parameter")]
    assert [(r.company, r.branch, r.module) for r in code.environment_openers(df).orderBy("line").collect()] == [("01", "", "FAT"), ("99", "02", "")]
    s = code.service_structures(df).first()
    assert (s.kind, s.name, [tuple(f) for f in s.fields]) == ("wsstruct", "Item", [("code", "String"), ("price", "Float")])


def test_masking_settings(spark):
    df = spark.createDataFrame([("a@b.co token=abc", 1500.0, 7)], "t string, amount double, n int")
    r = masking.Masking.of({"key": "k", "recognisers": "email", "amounts": "amount"}).apply(df).first()
    assert r.amount == "1k-10k" and r.n == 7 and r.t.startswith("<EMAIL_") and r.t.endswith("token=<secret>")
    import pytest

    with pytest.raises(ValueError):
        masking.Masking.of({"key": "k", "recognisers": "nothing"})
