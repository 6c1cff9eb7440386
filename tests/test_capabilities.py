"""Tags and kinds of sources, redundant database sections, the report of a log diagnosis, paths of base names."""

from ferrule.rules import capabilities, config_audit
from ferrule.sinks import render

SOURCES = {
    "rest.tlpp": '@Get("/a")\nUser Function Svc()\n  o := JsonObject():New()\nReturn\n',
    "soap.prw": "WSSERVICE Sales\nENDWSSERVICE\n",
    "mvc.prw": "Static Function ModelDef()\nReturn\n",
    "class.tlpp": "Method One() Class Two\n  oReport:Print()\nReturn\n",
    "job.prw": 'Main Function Night()\n  RpcSetEnv("01")\nReturn\n',
    "upd.prw": "User Function U_UPD01()\n  GetSXENum('SA1')\nReturn\n",
    "test.tlpp": "Static Function T()\n  x := 'ParamBox'\n  // FWBrowse\nReturn\nNamespace tlpp.unit\n",
    "null.prw": None,
}


def test_capabilities(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "path string, text string")
    got = {r.path: (r.tags, r.source_type) for r in capabilities.capabilities(files).collect()}
    assert got == {
        "rest.tlpp": (["JSON_AWARE", "WS-REST"], "webservice"),
        "soap.prw": (["WS-SOAP"], "webservice"),
        "mvc.prw": (["MVC"], "mvc"),
        "class.tlpp": (["REPORT_TR"], "class"),
        "job.prw": (["ENV_OPENER", "JOB", "RPC"], "main_function"),
        "upd.prw": (["COMPATIBILIZADOR", "SEQUENCER"], "user_function"),
        "test.tlpp": (["TESTE_UNITARIO"], "static_function"),
        "null.prw": ([], "outro"),
    }


def test_redundant_sections_and_environments(spark):
    keys = spark.createDataFrame([("a", "TopConnect", "Server", "x", ""), ("a", "p12", "RootPath", "/r", ""), ("a", "DBAccess", "Trace", "0", "")], "path string, section string, key string, value string, note string")
    sections, files = keys.select("path", "section").distinct(), spark.createDataFrame([("a", "appserver", "standalone")], "path string, type string, role string")
    rules = [("R1", "Trace", "DBAccess", "value_eq", "1", "critical"), ("R2", "Server", "TopConnect", "value_eq", "y", "warning"), ("R3", "RootPath", "environment", "value_eq", "/r", "info"), ("R4", "StartPath", "environment", "key_present", "", "warning")]
    rules = spark.createDataFrame([(*r, "", "", False) for r in rules], "rule_id string, key string, section string, kind string, expected string, severity string, file_type string, roles string, conditional boolean")
    got = sorted((r.rule_id, r.section, r.status) for r in config_audit.audit(keys, sections, files, rules).collect())
    assert got == [("R1", "DBAccess", "ok_with_note"), ("R2", "TopConnect", "wrong"), ("R3", "p12", "ok"), ("R4", "p12", "missing")]
    two = config_audit.database_sources(keys.selectExpr("path", "section", "case when section = 'DBAccess' then 'Alias' else key end as key"), files).first()
    assert two.sources == ["dbaccess", "topconnect"] and two.redundant == [] and two.conflict


def test_log_report(spark):
    rows = [("info", "net", "10:00", 4, "slow <b>", "wait", "raw"), ("critical", "db", "10:01", 9, "lost", None, None), ("critical", "db", "10:00", 2, "lost", "call", None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "severity string, category string, at string, line int, message string, tip string, snippet string, ref string")
    text = render.log_report(df, "console.log", 12, {"peak": "1 MB"})
    assert "4 findings, 12 events" in text and "critical: 2" in text and "warning: 0" in text and "slow &lt;b&gt;" in text and "peak: 1 MB" in text
    assert text.index("10:00</td><td>2<") < text.index("10:01</td><td>9<") < text.index("10:00</td><td>4<") and text.index("call") < text.index("wait")
    assert "0 findings" in render.log_report(df.limit(0), "x", 0)


def test_paths_of_base_names(spark):
    files = spark.createDataFrame([("b/x.prw",), ("a/x.prw",), ("y.prw",)], "path string")
    rows = spark.createDataFrame([("x.prw", 1), ("y.prw", 2), ("z.prw", 3)], "file string, n int")
    assert sorted((r.n, r.path) for r in capabilities.with_path(rows, files).collect()) == [(1, "a/x.prw"), (2, "y.prw"), (3, "")]
