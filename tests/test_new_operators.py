"""Conditions as data, object literals, classes of variables, nested masking, innermost ranges."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.functions import frontend
from ferrule.functions.masking import Masking
from ferrule.operators import tabular
from ferrule.rules import conditions
from ferrule.sources import code

RECORD = {"A1_LC": "120", "A1_SALDO": "100", "A1_EST": "SP ", "LOK": ".T.", "MV_X": "5", "A1_BR": "1.234,50"}
CASES = [
    ("A1_LC > A1_SALDO", True, ["A1_LC ~120% de A1_SALDO -> VERDADEIRO"]),
    ("SA1->A1_EST == 'SP' .And. .Not. lOk", False, ["A1_EST=SP == SP -> VERDADEIRO"]),
    ("A1_NONE = 1 .Or. lOk", True, ["A1_NONE = 1 -> (nao avaliavel)"]),
    ("A1_NONE = 1 .And. lOk", None, ["A1_NONE = 1 -> (nao avaliavel)"]),
    ("A1_NONE = 1 .And. !lOk", False, ["A1_NONE = 1 -> (nao avaliavel)"]),
    ("(A1_LC - 20) * 2 == A1_SALDO + A1_SALDO", True, None),
    ("A1_EST $ 'RJ,SP' .and. (A1_LC <> 1 .or. A1_LC = 2)", True, None),
    ("SuperGetMV('MV_X', .F., 9) >= 5 .And. Empty(A1_EST)", None, ["SuperGetMV('MV_X', .F., 9)=5 >= 5 -> VERDADEIRO"]),
    ("A1_BR > 1234.4", True, None),
    ("A1_EST < 'ZZ'", None, ["A1_EST=SP < ZZ -> (nao avaliavel)"]),
    ("A1_LC / 0 = 1", None, None),
    ("lOk", True, []),
    ("-A1_LC < 0 .And. '(.or.' = \"(.or.\"", True, None),
    ("A1_LC >", None, None),
    ("(A1_LC", None, None),
    ("", None, None),
    (None, None, None),
    ("A1_LC = 120 // why", True, None),
]


def test_conditions(spark):
    df = spark.createDataFrame([(k, c, RECORD) for k, (c, _, _) in enumerate(CASES)] + [(99, "lOk", None)], "k int, condition string, record map<string,string>")
    got = {r.k: r for r in conditions.judged(df, financial=("A1_LC", "A1_SALDO")).collect()}
    for k, (text, outcome, explained) in enumerate(CASES):
        assert got[k].outcome is outcome, text
        assert explained is None or got[k].explained == explained, text
    assert got[99].outcome is None


def test_condition_hides_amounts(spark):
    df = spark.createDataFrame([("A1_LC = 7 .And. A1_LC > 0", RECORD)], "condition string, record map<string,string>")
    said = conditions.judged(df, financial=("A1_LC",)).first().explained
    assert "120" not in said[0] and said[1] == "A1_LC > 0(zero) -> VERDADEIRO"
    rec = spark.createDataFrame([(1, True, "x")], "n int, ok boolean, s string").select(conditions.record_map("n", "ok", "s").alias("r")).first().r
    assert rec == {"N": "1", "OK": ".T.", "S": "x"}


LITERALS = """const a: PoTableColumn[] = [
  { property: 'x', type: 'money', // label: 'no'
    detail: { columns: [{ label: "d", property: `t` }], note: f(a ? b : c) } },
  { 'quoted': 1, field: 'y', re: a ? b : c, label: 'it\\'s: {' }
];
let b: Array<PoMenuItem> = [{ label: 'z', action: () => { other: 1; } }];
const c: Custom = { anything: 1, s: PoX.field };
function f(): PoTableColumn[] { return x; }
"""


def test_object_literals(spark):
    files = spark.createDataFrame([("a.ts", LITERALS), ("n.ts", None), ("e.ts", "")], "path string, text string")
    use = frontend.interface_use(files)
    got = {(r.interface, r.key_path, r.value, r.line) for r in use.collect()}
    assert {("PoTableColumn", "property", "x", 2), ("PoTableColumn", "type", "money", 2), ("PoTableColumn", "detail.columns.label", "d", 3), ("PoTableColumn", "detail.note", "", 3), ("PoTableColumn", "label", "it\\'s: {", 4), ("PoMenuItem", "label", "z", 6), ("Custom", "anything", "", 7)} <= got
    assert {r.property for r in use.where("direct and interface = 'PoTableColumn'").collect()} == {"property", "type", "detail", "field", "re", "label"}
    catalog = spark.createDataFrame([("PoTableColumn", p, v) for p, v in [("property", []), ("type", ["currency"]), ("detail", []), ("label", []), ("re", [])]] + [("PoMenuItem", "label", ["z"]), ("PoMenuItem", "action", [])], "interface string, property string, values array<string>")
    assert sorted((r.line, r.component, r.binding, r.kind, r.value) for r in frontend.interface_findings(use, catalog).collect()) == [(2, "PoTableColumn", "type", "value", "money"), (4, "PoTableColumn", "field", "interface", "")]


BUILDS = """User Function A()
  oJ:Early()
  oJ := JsonObject():New()
  oJ:ToJson("x") ; oJ:toJson()
  oJ := oOther
  oJ:ToJson()
  oJ := Rest():New() ; oj:GET("oJ := JsonObject():New()") ; oX:Get()
Return
User Function B()
  oJ:ToJson()
  // oJ := JsonObject():New()
  oJ:ToJson()
Return
"""


def test_classes_of_variables(spark):
    files = spark.createDataFrame([("a.prw", BUILDS), ("n.prw", None)], "path string, text string")
    got = sorted((r.unit, r.line, r.var, r.method, r["class"]) for r in code.method_calls(files).collect())
    assert got == [("A", 4, "oJ", "ToJson", "JsonObject"), ("A", 4, "oJ", "toJson", "JsonObject"), ("A", 7, "oj", "GET", "Rest")]
    catalog = spark.createDataFrame([("JSONObject", "ToJson", "24.3.0.5", None, "new"), ("Rest", "Get", "", "20.0", None), ("Rest", "Other", "99", None, None)], "class string, method string, build_min string, build_max string, note string")
    found = lambda b: sorted((r.line, r.method, r.note) for r in code.build_findings(files, catalog, b).collect())
    assert found("24.3") == [(4, "ToJson", "new"), (4, "ToJson", "new"), (7, "Get", "")] and found("20") == [(4, "ToJson", "new")] * 2 and found("24.3.0.5.0") == [(7, "Get", "")] and found("24.10") == [(7, "Get", "")]


def test_nested_masking(spark):
    schema = "id int, s struct<a:string,n:int,l:array<struct<m:string>>>, m map<string,array<string>>, t string, x array<int>, v double"
    rows = [(1, ("to a@b.co", 3, [("ip 10.0.0.1 and c@d.io",), None]), {"k@e.co": ["f@g.co", None]}, "no", [1], 1500.0), (2, None, None, None, None, None), (3, (None, None, []), {}, "a@b.co", [], None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in Masking(b"key", ("EMAIL", "IP"), amounts=("v",)).apply(df, "replaced").collect()}
    text = str(got)
    assert all(x not in text for x in ("a@b.co", "c@d.io", "f@g.co", "10.0.0.1")) and "k@e.co" in text
    assert got[1].s.a.split(" ")[1] == got[3].t and got[1].s.n == 3 and got[1].s.l[1] is None and got[1].m["k@e.co"][1] is None and got[1].x == [1]
    assert got[2].s is None and got[2].m is None and got[3].s.l == [] and got[3].m == {}
    assert [tuple(got[k].replaced) for k in (1, 2, 3)] == [(3, 1, 1), (0, 0, 0), (1, 0, 0)]
    assert Masking(b"key", ("EMAIL", "IP")).apply(df).schema == df.schema


@pytest.mark.parametrize("ends", [4, 50, 20_000])
def test_innermost_as_brute_force(spark, monkeypatch, ends):
    monkeypatch.setattr(tabular, "CELL_ENDS", ends)
    monkeypatch.setattr(tabular, "CELL_POINTS", 30)
    rng = random.Random(ends)
    spans = [(k, lo := rng.randrange(1000), lo + int(rng.expovariate(1 / 60)) * rng.choice([1, 1, 8])) for k in range(300)] + [(1000, 0, 990), (1001, 0, 990), (1002, 5, 4), (5, 500, 500)] + [(2000 + k, 300, 300 + k % 40) for k in range(120)]
    points = [(k, rng.randrange(-5, 1100)) for k in range(400)] + [(900 + k, 310) for k in range(100)] + [(5000, None)]
    want = {}
    for p, at in points:
        held = [(h - lo, s) for s, lo, h in spans if at is not None and lo <= at <= h]
        if held:
            want[p] = min(held)[1]
    got = tabular.innermost(spark.createDataFrame(points, "point int, at int"), spark.createDataFrame(spans, "span int, low int, high int"))
    assert {r.point: r.span for r in got.collect()} == want


def test_innermost_of_nothing(spark):
    points, spans = spark.createDataFrame([(1, 2)], "point int, at int"), spark.createDataFrame([], "span string, low int, high int")
    assert tabular.innermost(points, spans).collect() == [] == tabular.innermost(points.limit(0), spark.createDataFrame([("a", 1, 3)], spans.schema)).collect()


def test_large_tables_of_rules_are_not_broadcast(spark, monkeypatch):
    rules = spark.createDataFrame([("r1", 2, "a+"), ("r2", 1, "b"), ("r3", 1, "zz")], "rule_id string, priority int, pattern string")
    rows = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "c"), (4, None)], "id int, text string")
    want = {1: "r1", 2: "r2"}
    for most, hinted in ((20_000, True), (2, False)):
        monkeypatch.setattr(tabular, "SMALL", most)
        assert ("ResolvedHint" in tabular.small(rules)._jdf.queryExecution().analyzed().toString()) is hinted
        assert {r.id: r.rule_id for r in tabular.first_match_table(rows, rules, "text", ["id"]).collect()} == want


def test_files_that_are_too_large_are_listed(spark):
    from ferrule.sources import files

    df = spark.createDataFrame([("a.prw", 10), ("b.prw", 5_000_001), ("c.txt", 9_000_000), ("d.prw", 5_000_000), ("e.prw", 0)], "path string, length long")
    assert sorted(r.path for r in files.kept_files(df, [".prw"]).collect()) == ["a.prw", "d.prw"]
    assert [tuple(r) for r in files.too_large(df, [".prw"]).collect()] == [("b.prw", 5_000_001)]
    assert files.kept_files(df, [".prw"], most_bytes=9).count() == 0
