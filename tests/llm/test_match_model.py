import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ferrule.llm import match_model

ROWS = [(k, t) for k, t in enumerate(["abracadabra abracadabra", "The cat sat.\nThe CAT ate", "", None, "zzzz zzzz", "été à Noël", "the cat the hat", "q", "unseen 漢字 text", "  \t ", "abra cat"] * 2)]


def brute(rows, order=5, folds=7, held=2):
    lower = {a: a + 32 for a in range(65, 91)}
    texts = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % folds == held, (t or "").translate(lower)) for i, t in rows]
    seen = defaultdict(Counter)
    for _, out, t in texts:
        if not out:
            data = b"\xff" * order + t.encode() + b"\xff"
            for p in range(order, len(data)):
                for k in range(order + 1):
                    seen[data[p - k : p]][data[p]] += 1
    words = Counter(w for _, out, t in texts if not out for w in [*re.findall(r"[^\x20\x09-\x0D]+", t), ""])
    total, kinds = sum(words.values()), len(words)

    def byte(context, s):
        gone, log = set(), 0.0
        for k in range(order, -1, -1):
            after = seen.get(context[len(context) - k :])
            if not after:
                continue
            left = {b: n for b, n in after.items() if b not in gone}
            whole = sum(left.values()) + len(left)
            if s in left:
                return log + math.log10(left[s] / whole)
            if left:
                log += math.log10(len(left) / whole)
            gone |= left.keys()
        return log - math.log10(256 - len(gone))

    for i, out, t in texts:
        tokens, data = [*re.findall(r"[^\x20\x09-\x0D]+", t), ""], b"\xff" * order + t.encode() + b"\xff"
        yield i, out, len(tokens), sum(words[w] > 0 for w in tokens), total, sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in tokens), sum(byte(data[p - order : p], data[p]) for p in range(order, len(data)))


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(a == pytest.approx(b, abs=1e-9) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))


@pytest.mark.parametrize("local", [1 << 18, 3, 0])
def test_as_brute_force(spark, local):
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in [*ROWS, (None, "cat")]], "text string, doc_id long, word string, n int").repartition(3)
    same(match_model.score(docs, local_grams=local, local_words=local).collect(), brute([*ROWS, (None, "cat")]))


def test_other_orders_and_repeated_rows(spark):
    rows = ROWS + ROWS[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (1, 6):
        same(match_model.score(docs, order=order, local_grams=20, local_words=4).collect(), brute(rows, order))


def test_cut_texts_score_as_whole(spark):
    import pyarrow as pa

    texts = pa.array(["ab", "one two three four " * 20, "", "c"])
    whole = [list(x) for x in zip(*(y.tolist() for y in match_model._codes(texts, b"", True, 5)))]
    parts = [[int(o) + at, int(g)] for at, part, lead, ends in match_model.pieces(texts, match_model._SPACE, 13) for o, g in zip(*match_model._codes(part, lead, ends, 5))]
    assert parts == whole


def test_probabilities_of_a_context_sum_to_one(spark, tmp_path):
    from ferrule.llm.common import Tables

    docs = [t for _, t in ROWS if t]
    import numpy as np
    import pyarrow as pa

    codes, n = np.unique(np.concatenate([match_model._codes(pa.array([t]), b"", True, 3)[1] for t in docs]), return_counts=True)
    context = int(codes[len(codes) // 2]) >> 8
    known = dict(zip(codes.tolist(), n.tolist()))
    grams = {**{(context << 8) + s: 0 for s in range(256)}, **known}
    df = spark.createDataFrame([(g, k, k) for g, k in grams.items()], "gram long, n long, n_all long")
    p = match_model.probabilities(df, 3, Tables(spark)).where(f"shiftright(gram, 8) = {context}").collect()
    assert len(p) == 256 and sum(10**r.log_p for r in p) == pytest.approx(1)


def test_empty_table_and_no_training(spark):
    assert match_model.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    i = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    same(match_model.score(spark.createDataFrame([(i, "ab c")], "doc_id long, text string")).collect(), brute([(i, "ab c")]))


def test_tiny_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    same(match_model.op12(spark, tiny).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))
