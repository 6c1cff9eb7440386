"""Look-ups, diagnostics, hooks and import findings on small tables."""

from ferrule.functions import frontend
from ferrule.operators import lookups
from ferrule.rules.capabilities import capabilities
from ferrule.sources import code, diagnostics
from ferrule.sources.facts import fact_tables


def sources(spark, *texts):
    return spark.createDataFrame([(f"d/p{k}.prw", t) for k, t in enumerate(texts)], "path string, text string")


def test_fields(spark):
    rows = [("T", "A", "C", 2, 0, "t", "1=a"), ("T", "B", "C", 3, 0, None, "1=a"), ("T", "D", "N", 1, 0, "", "1=a"), ("T", "E", None, None, None, None, None), ("T", "F", "C", 1, None, "", " ; "), ("U", "G", "C", 1, 0, "", "")]
    got = lookups.table_catalog(spark.createDataFrame(rows, "table_code string, field string, type string, size int, decimals int, title string, box string"), "t").collect()
    assert {(r.field, r.type, r["values"], r.discriminator) for r in got} == {("A", "C(2)", "1=a", True), ("B", "C(3)", "1=a", False), ("D", "N(1)", "1=a", False), ("E", "", "", False), ("F", "C(1)", "", False)}


def test_architecture_edges(spark):
    files = sources(spark, "", None, "namespace a.b\n#include 'x.ch'\n#include 'x.ch'\nUser Function A()\n  RecLock('SA1')\n  RecLock('SA1')\n  RecLock('BAD')\n  x := 'SA2'->A2_COD\nReturn", "// User Function No()\n")
    facts = fact_tables(files)
    got = {r.path: r for r in lookups.architecture(files, capabilities(files, facts), facts, code.entry_points(files)).collect()}
    assert len(got) == 4
    a = got["d/p2.prw"]
    assert (a.lines_of_code, a.units, a.lock_tables, a.includes, a.namespace, a.via_routines) == (9, ["A"], ["SA1"], ["x.ch"], "a.b", False)
    assert [got[f"d/p{k}.prw"].lines_of_code for k in (0, 1, 3)] == [0, 0, 1] and got["d/p1.prw"].units == [] and got["d/p3.prw"].units == []


def test_routine_filters(spark):
    rows = [("d/a.prw", 1, "MATA1", "M", 3, False), ("d/b.prw", 1, "MATA1", None, None, True), ("d/c.prw", 1, "&", None, 5, True)]
    calls = spark.createDataFrame(rows, "path string, line long, routine string, module string, op_code int, dynamic boolean")
    names = lambda **f: [r.path[2] for r in lookups.find_routine_calls(calls, **f).collect()]
    assert names() == ["a", "b", "c"] and names(op="INC") == ["a"] and names(op="what") == [] and names(op="delete") == ["c"]
    assert names(dynamic=True) == ["b", "c"] and names(op_dynamic=True) == ["b"] and names(op_dynamic=False) == ["a", "c"]
    assert names(routine="mata1", module="m") == ["a"] and names(file="B.PRW") == ["b"]


def test_diagnostics(spark):
    said = ["a/x.prw(3) error: bad\r", "X.PRW(4,5) Info: i", "y.prw(1) Aviso: no", "Include \"q.ch\" not found in z.prw:9", "appre41(7) Error C1 m", "  what ", "", None, "senha=1 odd", "connection_manager.cc x has no valid content after precompiled y"]
    output = spark.createDataFrame([("o", k, t) for k, t in enumerate(said)], "path string, line int, text string")
    wanted = spark.createDataFrame([("a/x.prw",), ("b/x.prw",), ("z.prw",), ("z.prw",)], "path string")
    got = {r.line: r for r in diagnostics.diagnostics(output, wanted).collect()}
    shown = {k: (r.severity, r.file, r.at_line, r.at_column, r.code, r.message, r.matched) for k, r in got.items()}
    assert shown == {
        0: ("error", "a/x.prw", 3, 0, "", "bad", True), 3: ("error", "z.prw", 9, 0, "", "q.ch", True), 4: ("error", "appre41", 7, 0, "C1", "m", False),
        1: ("unknown", "", 0, 0, "", "X.PRW(4,5) Info: i", True), 2: ("unknown", "", 0, 0, "", "y.prw(1) Aviso: no", True), 5: ("unknown", "", 0, 0, "", "what", True), 8: ("unknown", "", 0, 0, "", "senha=***REDACTED*** odd", True),
    }
    assert all(r.matched for r in diagnostics.diagnostics(output).collect())


def test_hooks(spark):
    files = sources(spark, "User Function A()\n  o:BCOMMIT := {|| x}\n  bWhen = 1\n  c := 'bLoad := 1'\n// bLoad := 1\n  x:bLoadX := 1\nReturn", None)
    assert {(r.unit, r.line, r.callee) for r in code.model_hooks(files).collect()} == {("A", 2, "bCommit"), ("A", 3, "bWhen")}


def test_imports(spark):
    use = spark.createDataFrame([("a.html", 2, "po-x"), ("p/b.html", 3, "po-x"), ("p/a.html", 9, "po-x"), ("p/a.html", 4, "po-x"), ("p/a.html", 1, "own"), ("p/a.html", 1, "po-free")], "path string, line long, component string")
    catalog = spark.createDataFrame([("po-x", "@po/x"), ("po-x", "@po/x"), ("po-free", "")], "component string, package string")
    imported = spark.createDataFrame([("z.ts", "@po/x"), (None, "@po/x")], "path string, package string")
    roots = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = lambda r: {tuple(x) for x in frontend.import_findings(use, imported, catalog, r).collect()}
    assert got(roots("package.json", "p/package.json")) == {("p/a.html", 4, "po-x", "@po/x", "p/")}
    assert got(roots("p/package.json")) == {("p/a.html", 4, "po-x", "@po/x", "p/")} and got(roots("package.json")) == set() and got(roots("q/other.json")) == set()
