import numpy as np
import pytest
import xxhash

from ferrule.llm import simhash
from ferrule.llm.components import components


def brute_fingerprint(text, k=4):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(rows):
    fps = [brute_fingerprint(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            ids[g] = min(ids.get(g, d), d)
    return [(d, f, ids.get(g)) for (d, _), f, g in zip(rows, fps, group)]


def got(df, **kw):
    return [(r["id"], r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(df, **kw).collect()]


ROWS = [(5, "A b c d e f g"), (2, "a B c d e f g"), (9, None), (7, ""), (8, " \t\n"), (3, "x"), (3, "x"), (4, "é É x y z"), (None, "a b c d e f g"), (6, "w " * 30000), (1, "one two three")]


def test_small_cases_against_brute_force(spark):
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in ROWS], "doc_id long, text string, fp string, component int")
    assert sorted(map(str, got(df))) == sorted(map(str, brute_groups(ROWS)))


def test_whole_table_and_tiles(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(brute_groups(rows))
    assert sorted(got(docs)) == want
    assert sorted(got(docs, tile=3)) == want


def test_every_link_is_found_in_crowded_cells(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, 4, replace=False)) for b in base for _ in range(20)]
    fps = sorted({int(np.uint64(x).astype(np.int64)) for x in [*base.tolist(), *near]})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    a = np.array(fps, np.int64).view(np.uint64)
    want = brute_components(a)
    for tile in (4, 2048):
        roots = dict((r.node, r.root) for r in components(simhash.links(df, tile=tile)).collect())
        found = [roots.get(x, x) for x in fps]
        assert len(set(found)) == len(set(want)) and len(set(zip(found, want))) == len(set(want))


def brute_components(a):
    group = list(range(len(a)))
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 4):
            old, new = group[i], group[j]
            if old != new:
                group = [new if g == old else g for g in group]
    return group


def test_components_of_a_chain_and_of_nothing(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(n + 1)}
    assert components(chain.limit(0)).count() == 0


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_keep_one_keeps_one_of_each_group(spark):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(ROWS)], "doc_id long, text string, component int")
    kept = simhash.keep_one(df).collect()
    assert df.columns == simhash.keep_one(df).columns
    named = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(named) == len(set(named))
    groups = {c for d, _, c in brute_groups([r for r in ROWS if r[0] is not None])}
    assert set(named) == groups
    assert sum(r.doc_id is None for r in kept) == 1


def test_drawn_rows_are_bounded(spark):
    from pyspark.sql import functions as F

    from ferrule.llm.common import drawn

    df = spark.range(10_000)
    assert drawn(df, F.col("id"), 10_000, 20_000).count() == 10_000
    assert 300 < drawn(df, F.col("id"), 10_000, 400).count() < 500
    assert drawn(df.select(F.lit(1).alias("id")), F.col("id"), 10_000, 400).count() in (0, 800)


def test_long_text(spark):
    text = " ".join(f"w{i % 997}" for i in range(200_000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c d", "a  b\tc\x0bd e", "\u00a0 x"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
