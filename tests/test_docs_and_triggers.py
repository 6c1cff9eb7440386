"""Doc blocks, schedules, workflows, jobs and mail on small texts."""

import pytest

from ferrule.sources import code, docs, triggers


@pytest.fixture(scope="module")
def rows_of(spark):
    return lambda *texts: spark.createDataFrame([(f"p{k}.prw", t) for k, t in enumerate(texts)], "path string, text string")


def test_doc_edges(rows_of):
    near = "/*/{X.doc} A\r\nfirst\r\n@param a, b(1, 2), c, d\r\n@param\r\n@return\r\n@author x\r\n@author y\r\n@foo one\r\n two\r\n/*/\r\nMethod M() Class K\r\n"
    inner = "/*/{X.doc}\n/*/{X.doc} B\n@example\n x /*/ y\n/*/\n" + "\n" * 80 + "Function F()\n"
    far = "/*/{X.doc} C\n/*/\n" + "\n" * 80 + "Function F()\n"
    got = docs.doc_details(rows_of(near, inner, far, None, "", "/*/{X.doc} open\n@author z", "/*/{X.doc} D\n/*/\nWSRESTFUL S\n" * 2)).collect()
    by = {(r.path, r.line): r for r in got}
    assert set(by) == {("p0.prw", 1), ("p1.prw", 1), ("p2.prw", 1), ("p6.prw", 1), ("p6.prw", 4)}
    a = by["p0.prw", 1]
    assert (a.end_line, a.unit, a.unit_line, a.summary, a.author, a.deprecated, a.module) == (10, "M", 11, "first", "y", False, None)
    assert [tuple(p) for p in a.params] == [("a", "b(1, 2)", "c, d", False), (None, None, None, False)]
    assert [tuple(p) for p in a.returns] == [(None, None)] and [tuple(o) for o in a.other] == [("foo", "one\n two")]
    b = by["p1.prw", 1]  # an opening in an open block is a part of it; the declaration is 81 lines on
    assert (b.id, b.end_line, b.unit, b.examples) == (None, 5, None, ["x /*/ y"])
    assert by["p2.prw", 1].unit is None and by["p6.prw", 4].unit == "S" and by["p6.prw", 1].unit_line == 3


def test_doc_at_the_limit_and_prefixes(rows_of):
    r = docs.doc_details(rows_of("/*/{X.doc} C\n/*/\n" + "\n" * 79 + "Function F()\n"), prefixes={"Q": "NO", "p0": "YES", "p": "LATER"}).first()
    assert (r.unit, r.unit_line, r.module) == ("F", 82, "YES")


def test_doc_details_send_no_side_of_a_join_to_the_driver(rows_of):
    plan = docs.doc_details(rows_of("/*/{X.doc} A\n/*/\n"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_look_ups_of_docs(rows_of):
    one = "/*/{X.doc} A\n@author Ann Lee\n/*/\nFunction F()\n"
    found = docs.doc_details(rows_of(one, one, "/*/{X.doc} f\n@deprecated\n/*/\n"))
    assert [r.path for r in docs.homonyms(found, "F").collect()] == ["p0.prw", "p1.prw", "p2.prw"]
    assert docs.show_doc(found, "f").first().path == "p0.prw" and docs.show_doc(found, "f", "P1.PRW").first().path == "p1.prw"
    assert docs.find_docs(found, author="LEE", file="p1.prw").count() == 1 and docs.find_docs(found, deprecated=True).first().path == "p2.prw"
    assert docs.show_doc(found, "nobody").count() == 0


def found(files):
    return {(r.path, r.line, r.kind, r.target): r.details for r in triggers.trigger_details(files, code.environment_openers(files)).collect()}


def test_workflows_are_kept_apart(rows_of):
    two = 'Function A()\no := TWFProcess():New("W1")\no:bReturn := {|x| R1(x)}\no:bReturn := {|x| R2(x)}\no:bTimeOut := {|| T()}\np := TWFProcess():New("W2", "d")\np:cTo := "a"\np:cTo := "b"\n'
    got = found(rows_of(two, "Function B()\nMsWorkflow(1)\nWFPrepEnv()\n// MsWorkflow(1)\n", None, ""))
    assert set(got) == {("p0.prw", 2, "workflow", "R2"), ("p0.prw", 6, "workflow", "W2"), ("p1.prw", 2, "workflow", ""), ("p1.prw", 3, "wf_callback", "wf_callback")}
    assert got["p0.prw", 2, "workflow", "R2"]["on_timeout"] == "T" and got["p0.prw", 6, "workflow", "W2"]["to"] == "a" and got["p0.prw", 6, "workflow", "W2"]["on_timeout"] == ""


def test_jobs_and_schedules(rows_of):
    jobs = 'Main Function A()\nRpcSetType(3)\nSleep(500)\nMain Function B()\nReturn\nMain Function C()\nRpcSetEnv("1","2","","","F")\nSleep(2000)\n'
    got = found(rows_of(jobs, "Static Function SchedDef()\nReturn x\n"))
    assert set(got) == {("p0.prw", 1, "job_standalone", "A"), ("p0.prw", 6, "job_standalone", "C"), ("p1.prw", 1, "schedule", "SchedDef")}
    a, c = got["p0.prw", 1, "job_standalone", "A"], got["p0.prw", 6, "job_standalone", "C"]
    assert (a["no_license"], a["sleep_seconds"], a["company"]) == ("true", "500", "") and (c["no_license"], c["sleep_seconds"], c["module"]) == ("false", "2", "F")
    assert got["p1.prw", 1, "schedule", "SchedDef"] == {"sched_type": "", "prompt": "", "alias": "", "orders": "", "title": ""}


def test_mail_servers_alone(rows_of):
    got = found(rows_of("o := TMailManager():New()\no:SendMail()\no := TMailManager()\n", "o := TMailManager():New()\nm := TMailMessage():New()\nm:Send(o)\n", "o := TMailManager():New()\n", "SEND MAIL TO x\nMailAuto(GetMv('MV_RELSERV'))\n"))
    assert set(got) == {("p0.prw", 1, "mail_send", "TMailManager"), ("p1.prw", 2, "mail_send", "TMailManager"), ("p3.prw", 1, "mail_send", "UDC"), ("p3.prw", 2, "mail_send", "MailAuto")}
    assert got["p3.prw", 1, "mail_send", "UDC"]["uses_parameters"] == "true"


def test_trigger_filters(rows_of):
    files = rows_of("SEND MAIL TO x\n", "MailAuto(x)\n")
    all_ = triggers.trigger_details(files, code.environment_openers(files))
    assert [r.path for r in triggers.find_triggers(all_, kind="MAIL_SEND").collect()] == ["p0.prw", "p1.prw"]
    assert triggers.find_triggers(all_, target="mailauto", file="P1.prw").count() == 1 and triggers.find_triggers(all_, kind="other").count() == 0


def test_sorted_docs_are_read_once(rows_of):
    """the sort drew its sample from the texts, so all blocks were derived twice."""
    found = docs.find_docs(docs.doc_details(rows_of("/*/{X.doc} A\n@author Ann\n/*/\n", "/*/{X.doc} B\n@author Ann\n/*/\n")), author="ann")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    assert [r.id for r in found.collect()] == ["A", "B"]
