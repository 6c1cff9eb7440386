"""The suffix stage cuts passages of over 50 words, not only the 400 bytes that op8 is bound to."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ferrule.llm import suffix_dedup


def stage(spark, rows, of):
    return {r.doc_id: r.text for r in of(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}


def brute_words(texts, n=51):
    """Texts without 400-byte strings and n-word passages that also stand elsewhere, as sets of kept byte positions."""
    data = [t.encode() for t in texts]
    spans = []
    for b in data:
        at, out = 0, []
        for w in b.split():
            at = b.index(w, at)
            out.append((at, at + len(w)))
            at += len(w)
        spans.append(out)
    long = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    seen = Counter(tuple(b[x:y] for x, y in s[i : i + n]) for b, s in zip(data, spans) for i in range(len(s) - n + 1))
    kept = []
    for b, s in zip(data, spans):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            gone[i : i + 400] |= long[b[i : i + 400]] > 1
        for i in range(len(s) - n + 1):
            if seen[tuple(b[x:y] for x, y in s[i : i + n])] > 1:
                gone[s[i][0] : s[i + n - 1][1]] = True
        kept.append(bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore"))
    return kept


def test_suffix_stage_cuts_short_passages(spark, tiny):
    texts = [r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()]
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(str(x) for x in rng.choice([f"v{k}" for k in range(900)], n))
    passage, under = word(51), word(50)
    assert len(passage) < 400
    texts += [f"{word(30)} {passage} {word(70)}", f"{word(80)} {passage}", f"{word(9)}\n{under} {word(60)}", f"{under} {word(60)}", passage.replace(" ", "\n"), "a " * 200]
    got = stage(spark, list(enumerate(texts)), corpus_pipeline.suffix)
    want = brute_words(texts)
    assert passage not in " ".join(got.values()) and under in got[len(texts) - 4]
    assert [got[k] for k in range(len(texts))] == want


@pytest.mark.parametrize("text", [b"", b" ", b"a", b"\ta  b\n", b"x\x0by\x1cz"])
def test_word_places(text):
    h, start, end = suffix_dedup._word_hashes(text)
    assert [text[a:b] for a, b in zip(start, end)] == text.split() and len(h) == len(start)
