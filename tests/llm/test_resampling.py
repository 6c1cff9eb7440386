import hashlib
import math
import re
import zlib

import duckdb
import pytest

from ferrule.llm import resampling

ROWS = [(1, "Alpha beta, GAMMA! alpha"), (2, None), (3, ""), (4, "..."), (5, "été 12 Ünder beta"), (6, "alpha " * 30), (7, "gamma delta " * 15), (8, "beta " * 25), (9, "x"), (None, "delta " * 40)]
ROWS += [(20 + k, f"w{k % 3} alpha beta w{k % 5} " * 6) for k in range(20)]
TARGET = [("Beta gamma", 1), ("alpha beta. gamma é", 2), (None, 3)]


def brute(rows, target, order, buckets=10_000):
    lower = {a: a + 32 for a in range(65, 91)}

    def bag(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(words) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for b in bag(x)[1]:
            s[b] += 1
    for x, _ in target:
        for b in bag(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        n, f = bag(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: 10 * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("order", [1, 3])
def test_as_brute_force(spark, order):
    docs = spark.createDataFrame([(x, i, 7, "k") for i, x in ROWS], "text string, doc_id long, bucket int, row string").repartition(3)
    target = spark.createDataFrame(TARGET, "text string, n int")
    got = resampling.resample(docs, target, order=order).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS, TARGET, order)


def test_cut_texts_lose_no_run(monkeypatch):
    import pyarrow as pa

    text = pa.array(["one", "a bb ccc dd " * 50, "e a bb", None])
    whole = sorted((int(o), int(b), k) for at, bs, k in resampling.features(text, 3, 997) for o, b in zip(at, bs))
    real = resampling.pieces
    monkeypatch.setattr(resampling, "pieces", lambda t, p: real(t, p, 17))
    assert sorted((int(o), int(b), k) for at, bs, k in resampling.features(text, 3, 997) for o, b in zip(at, bs)) == whole


def test_repeated_rows_and_many_ranks(spark):
    rows = [(k // 4, "same words here " * 10) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame(TARGET, "text string, n int")
    got = resampling.resample(docs, target).collect()
    assert len(got) == 400 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41))
    assert sorted((r.score, r.id) for r in got if r["rank"]) == sorted((b[4], b[0]) for b in brute(rows, TARGET, 1) if b[5])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in resampling.resample(some, none).collect()] == brute([(1, "a b")], [], 1)


def test_sql_gives_the_same_rows(spark, tiny):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    got = resampling.op11(spark, tiny)
    want = c.sql(resampling.OP11_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
