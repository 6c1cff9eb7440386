import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from ferrule.llm import spelling
from ferrule.llm.common import Tables

LOWER = {a: a + 32 for a in range(65, 91)}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p:] == b[p + 1 :] or (len(a) == len(b) and a[p + 1 :] == b[p + 1 :])


def brute_words(rows):
    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if n >= 2 and len(w) >= 7}


def brute(words):
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_apart(v, w)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n, len(near[w]), form[w] and words[form[w]]


def misspelt(rng, n):
    out = {}
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7, 12))) for _ in range(n)]
    for s in stems:
        out[s] = rng.choice([2, 30, 500])
        for _ in range(3):
            p, c = rng.randrange(len(s) + 1), rng.choice("abcéÿ")
            out[rng.choice([s[:p] + s[p + 1 :], s[:p] + c + s[p:], s[:p] + c + s[p + 1 :]])] = rng.choice([2, 3, 40])
    return {w: n for w, n in out.items() if len(w) >= 7}


@pytest.mark.parametrize("crowded", [3, 40, 4096])
def test_near_words_as_brute_force(spark, crowded):
    words = misspelt(random.Random(crowded), 120) | {"a" * k: k for k in range(7, 30)} | {"a" * 9 + x + "a" * 9: 3 for x in "bcdé"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(df, Tables(spark), crowded).collect()}
    for w in words:
        near = [v for v in words if one_apart(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        assert got.get(w) == ((len(near), words[best], best) if near else None)


def test_wide_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 1)
    rng = random.Random(1)
    gaps = list({"".join(rng.choice("ab") for _ in range(rng.choice([7, 8]))).encode() for _ in range(300)})
    for end in (True, False):
        got = {}
        for q, found in spelling.near_in_block(gaps, np.zeros(len(gaps), int), 7, end):
            for k, row in zip(q, np.unpackbits(found.astype("<u8").view(np.uint8), axis=1, bitorder="little")):
                got[gaps[k]] = {gaps[j] for j in np.flatnonzero(row)}
        for g in gaps:
            want = {v for v in gaps if one_apart(v, g) and min(len(v), len(g)) == 7}
            assert got[g] == {v for v in want if end or v[:7] != g[:7]}


def test_variants_as_brute_force(spark):
    rng = random.Random(5)
    names = ["straßenbahn", "Elephant", "elephants", "elefant", "wonderful", "wonderfull", "ÉLÉPHANT", "a" * 3000, "a" * 3001, "short"]
    rows = [(k if k % 50 else None, " ".join(rng.choices(names, [9, 200, 3, 15, 300, 20, 4, 1, 1, 9], k=12)) + ". x1y2 " + rng.choice(names)) for k in range(300)] + [(1, None), (2, ""), (3, "...")]
    rows += rows[:40]
    docs = spark.createDataFrame([(t, i, 1, "w") for i, t in rows], "text string, doc_id long, n int, word string").repartition(4)
    assert sorted(map(tuple, spelling.variants(docs, crowded=4).collect()), key=str) == sorted(brute(brute_words(rows)), key=str)


def test_chain_of_forms(spark):
    words = {"abcdefg": 10_000, "abcdefgh": 1000, "abcdefghi": 100, "abcdefghij": 10}
    rows = [(None, w) for w in words]
    docs = spark.createDataFrame([(i, " ".join([w] * words[w])) for i, (_, w) in enumerate(rows)], "doc_id long, text string")
    got = {r.word: r for r in spelling.variants(docs, slips=1 << 40).collect()}
    assert [got[w].root for w in words] == ["abcdefg"] * 4 and got["abcdefghij"].form == "abcdefghi"


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sql_gives_the_same_rows(spark, tiny):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    got, want = spelling.op13(spark, tiny), c.sql(spelling.OP13_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
