"""The near-dedup stage finds all pairs of its own similarity, not only what op4 is bound to."""

import numpy as np

import corpus_pipeline
from ferrule.llm import similar


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Ids that stay: the smallest of each group that pairs of Jaccard >= 0.8 link."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (d, _), g in zip(rows, group):
        low[g] = min(low.get(g, d), d)
    return sorted(low.values())


def stage(spark, rows, of):
    return {r.doc_id: r.text for r in of(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}


def test_near_dedup_equals_brute_jaccard(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    for k in range(40):  # copies of which up to a quarter of the words changes in one run: similarity 0.6 to 1
        words = [str(x) for x in rng.choice(vocabulary, int(rng.integers(60, 300)))]
        other, n = list(words), int(len(words) * rng.uniform(0, 0.25))
        other[10 : 10 + n] = rng.choice(vocabulary, n).tolist()
        rows += [(10_000 + 2 * k, " ".join(words)), (10_001 + 2 * k, "  ".join(other).upper())]
    chain = [str(x) for x in rng.choice(vocabulary, 400)]
    rows += [(20_000 - k, " ".join(chain[10 * k : 10 * k + 200])) for k in range(20)]  # each near the next only
    want = brute_kept(rows)
    assert len(want) < len({d for d, _ in rows}) - 20
    assert sorted(stage(spark, rows, corpus_pipeline.near_dedup)) == want


def test_near_dedup_takes_one_of_two_texts_of_an_id(spark):
    text = " ".join(f"a{k}" for k in range(50))
    rows = [(1, "x"), (1, text), (2, text), (2, "y"), (3, text + " b")]
    assert sorted(stage(spark, rows, corpus_pipeline.near_dedup)) == [1, 2]


def test_minhash_cells_hold_pairs_at_the_similarity():
    rng = np.random.default_rng(2)
    for _ in range(200):
        h = rng.integers(1 << 63, size=110, dtype=np.uint64)
        assert (similar.bands(h[:100]) == similar.bands(np.append(h[:90], h[100:110]))).any()  # 90 of 110: 0.82
