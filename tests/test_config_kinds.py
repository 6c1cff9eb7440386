"""Types and roles of configuration files."""

from ferrule.rules.config_kinds import config_kinds, of_parsed
from ferrule.sources.config import parse

ENV = "rootpath=/x\n"
CASES = {
    "tss.ini": ("[TSSOffline]\na=1\n", "tss", "tss"),
    "t2.ini": ("[JOB_WS]\na=1\n[x]\nTssSecurity=1\n", "tss", "tss"),
    "b/http.ini": ("[balance_http]\na=1\n", "broker", "broker_http"),
    "b/rest.ini": ("[balance_web_services]\na=1\n", "broker", "broker_rest"),
    "b/soap.ini": ("[balance_web_services]\na=1\n", "broker", "broker_soap"),
    "b/env.ini": ("[balance_http]\na=1\n[p]\n" + ENV, "custom", "standalone"),
    "dbaccess.ini": ("[General]\nMode= Master\n", "dbaccess", "dbaccess_master"),
    "d2.ini": ("[oracle]\na=1\n[general]\nmode=slave\n", "dbaccess", "dbaccess_slave"),
    "d3.ini": ("[MSSQL]\na=1\n", "dbaccess", "dbaccess_standalone"),
    "AppServer.ini": ("[OnStart]\nJobs=JOB_A, JOB_B\n", "appserver", "job_server"),
    "a2.ini": ("[general]\na=1\n[drivers]\na=1\n[onstart]\njobs=job_a,job_ws\n", "appserver", "standalone"),
    "a3.ini": ("[httprest]\na=1\n[httpjob]\na=1\n", "custom", "rest_server"),
    "a4.ini": ("[httprest]\na=1\n[httpjob]\na=1\n[licenseclient]\na=1\n", "custom", "slave_rest"),
    "a5.ini": ("[job_ws_1]\na=1\n[localhost:80/ws]\na=1\n", "custom", "slave_ws"),
    "a6.ini": ("[licenseclient]\na=1\n[webapp]\na=1\n[p]\n" + ENV, "custom", "slave"),
    "a7.ini": ("[p]\n" + ENV + "[q]\n" + ENV + "[r]\n" + ENV + "[licenseclient]\na=1\n[webapp]\na=1\n", "custom", "standalone_multi_env"),
    "smartclient.ini": ("[config]\na=1\n", "smartclient", "standalone"),
    "s2.ini": ("[config]\na=1\n[drivers]\na=1\n", "smartclient", "standalone"),
    "off.ini": (";[oracle]\na=1\n", "custom", "standalone"),
    "empty.ini": ("", "custom", "standalone"),
    "null.ini": (None, "custom", "standalone"),
}


def test_types_and_roles(spark):
    files = spark.createDataFrame([(p, t) for p, (t, _, _) in CASES.items()], "path string, text string")
    got = {r.path: (r.type, r.role) for r in config_kinds(files, *of_parsed(parse(files))).collect()}
    assert got == {p: (t, r) for p, (_, t, r) in CASES.items()}
