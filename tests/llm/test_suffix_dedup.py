import hashlib
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import suffix_dedup as S


def brute(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kid string")
    if kw:
        S.repeated_spans.__defaults__ = ("doc_id", "text", kw["crowded"])
    try:
        rows = S.dedup(df).collect()
    finally:
        S.repeated_spans.__defaults__ = ("doc_id", "text", S.CROWDED)
    got = {r.id: (r.n_bytes, r.n_bytes - len(r.kept), r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows}
    want = dict(enumerate(brute(texts)))
    assert got == want


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh é"), 5)) for _ in range(n))


@pytest.mark.parametrize("crowded", [S.CROWDED, 1])
def test_planted_passages(spark, crowded):
    rng = np.random.default_rng(5)
    passage, other = words(rng, 150), words(rng, 90)
    texts = [words(rng, int(rng.integers(1, 300))) for _ in range(20)]
    texts += [words(rng, 40) + passage + words(rng, 60) for _ in range(6)] + [passage[:399], passage[:400], passage[5:600]]
    texts += [other + words(rng, 3) + other, None, "", "a" * 3000, "a" * 399, "a" * 400, "ab" * 900, texts[3], texts[3]]
    texts += [passage[:380] + "#" + passage[381:], passage[200:] + other[:350]]
    check(spark, texts, crowded=crowded)


def test_documents(spark, tiny):
    check(spark, [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()])


def test_long_document_is_cut_into_chunks(spark):
    rng = np.random.default_rng(1)
    body = "".join(map(chr, rng.integers(97, 123, 1_300_000)))
    text = body + body[700_000:700_500] + "!" + body[1_048_000:1_049_500]
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    r = S.dedup(df).first()
    assert r.n_bytes == len(text) and r.n_bytes - len(r.kept) == 2 * (500 + 1500) and r.n_spans == 4


def test_empty_table_and_null_ids(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "x" * 500), (None, "y"), (1, "x" * 450)], "doc_id long, text string")
    assert sorted(len(r.kept) for r in S.dedup(df).collect()) == [0, 0, 1]


def test_texts_keep_columns(spark):
    df = spark.createDataFrame([(1, "é" * 300 + "z", "k", 301), (2, "é" * 300, "k", 300), (3, None, "k", 0)], "doc_id long, text string, spans string, n_chars long")
    rows = {r.doc_id: r for r in S.dedup_texts(df).collect()}
    assert S.dedup_texts(df).columns == df.columns
    assert rows[1].text == "z" and rows[1].n_chars == 1 and rows[2].text == "" and rows[3].text is None and rows[1].spans == "k"


def test_difference_cover():
    assert {(a - b) % S.V for a in S.COVER for b in S.COVER} == set(range(S.V))


def test_ranks_order_suffixes():
    rng = np.random.default_rng(0)
    block = rng.integers(97, 99, 900).astype(np.uint8)
    buf = np.concatenate([block, block])
    n = np.array([501, 501])
    repeated = S.sort_block(buf, np.zeros(2, int), np.array([0, 900]), n, np.array([300, 300]))
    assert repeated.all()
    other = buf.copy()
    other[900 + 450] = 120
    half = S.sort_block(other, np.zeros(2, int), np.array([0, 900]), n, np.array([300, 300]))
    assert half[:501].sum() == 501 - 400 and (half[:501] == half[501:]).all()


def test_remove():
    assert S.remove(b"0123456789", [(2, 4), (3, 6), (6, 7), (8, 9)]) == (b"0179", 2)
    assert S.remove(b"", []) == (b"", 0)
