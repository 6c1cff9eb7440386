"""Python steps of a plan: each takes a worker for every core, so none may stand twice for one thing."""

from ferrule.registry import Tables  # isort: skip (it imports the plans)
from ferrule.plans import doc_queries, lookup_queries, store_queries, structure_queries
from ferrule.sources import code, embedded_sql, triggers

ROOT = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statements_are_read_once(spark):
    """the literals were taken twice, and the statements read twice, each time once for a filter."""
    files = spark.createDataFrame([("a.prw", 'User Function A()\n  TCQuery("SELECT A1_X FROM SA1010 WHERE A1_Y = 1")\n  TCSqlExec(cVar)\n  tcquery()\nReturn')], "path string, text string")
    read = embedded_sql.embedded_sql(code.with_bare(files))
    columns = embedded_sql.sql_columns(read)
    assert _plan(columns).count("ArrowEvalPython [_read_all") == 1
    assert "_literals" not in _plan(columns)
    assert [(r.unit, r.line, r.via, r.operation) for r in read.collect()] == [("A", 2, "tcquery", "select")]
    assert [(r.line, r.clause, r.table_code, r.column) for r in columns.collect()] == [(2, "where", "SA1", "A1_Y")]


def test_written_sources_are_not_stripped_again(spark):
    """every part of a query stripped the sources anew."""
    t = Tables(spark, ROOT)
    for name in ("unindexed_columns", "embedded_statements"):
        assert "strip_comments" not in _plan(getattr(structure_queries, name)(t))
    assert "strip_comments" not in _plan(lookup_queries.source_architecture(t))


def test_partitions_grow_with_the_sources(spark, monkeypatch):
    """there were as many partitions as cores, however many sources; lines were dealt out again by path."""
    monkeypatch.setattr(store_queries, "SOURCES", 10)
    t = Tables(spark, ROOT)
    files = store_queries.kept(t, doc_queries._started(t))
    assert files.rdd.getNumPartitions() >= t.part.count() / 10
    assert _plan(code.with_unit(code.source_lines(files), "path")).count("Exchange hashpartitioning") == 1


def test_kinds_of_triggers_share_the_lines(spark):
    """each kind sorted all lines of all files by itself."""
    openers = spark.createDataFrame([], "path string, line long, company string, branch string, environment string")
    plan = _plan(triggers.trigger_details(doc_queries._started(Tables(spark, ROOT)), openers))
    assert "posexplode" not in plan and "ArrowEvalPython" not in plan


def test_a_pair_of_words_over_comments_still_opens(spark):
    """Files are left out by words that a comment may part."""
    files = spark.createDataFrame([("a.prw", 'User Function A()\n  Prepare /* x */ Environment Empresa "01" Filial "02" Modulo "FAT"\nReturn'), ("b.prw", "PREPARE\nx")], "path string, text string")
    assert [(r.path, r.unit, r.line, r.company, r.branch, r.module) for r in code.environment_openers(files).collect()] == [("a.prw", "A", 2, "01", "02", "FAT")]
