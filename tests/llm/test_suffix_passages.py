"""op8 finds repeated passages of over 50 words that have fewer than 400 bytes; its columns on 400 bytes stay as they are."""

import hashlib

import numpy as np

import __spark_entry__
from ferrule.llm import suffix_dedup

from .test_suffix_dedup import brute
from .test_suffix_stage import brute_words


def test_short_passages_are_reported_and_cut(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(str(x) for x in rng.choice([f"é{k}" for k in range(900)], n))
    passage, under, long = word(51), word(50), word(150)
    assert len(passage.encode()) < 400 < len(long)
    planted = [f"{word(30)} {passage} {word(70)}", f"{word(80)} {passage}", passage.replace(" ", "\n"), f"{word(5)} {long} {passage}", f"{long} {word(9)}"]
    clean = [f"{word(9)} {under} {word(60)}", f"{under} {word(60)}", word(200), "", None, "é" * 399]
    texts = planted + clean
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = __spark_entry__.queries()["op8_suffix_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)
    assert [r.text for r in rows] == brute_words([t or "" for t in texts])
    assert all(r.n_passages > 0 for r in rows[: len(planted)]) and all(r.n_passages == r.n_passage_bytes == 0 for r in rows[len(planted) :])
    assert [r.n_passage_bytes for r in rows[:3]] == [len(passage.encode())] * 3 and rows[3].n_passages == 2
    assert rows[0].n_removed == 0 and rows[0].kept_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()


def test_text_is_that_of_the_suffix_stage(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = {r.doc_id: r.text for r in suffix_dedup.op8(spark, tiny).collect()}
    assert got == {r.doc_id: r.text or "" for r in suffix_dedup.dedup_texts(docs).collect()}


def test_words_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(2)
    words = [rng.integers(33, 256, n).astype(np.uint8).tobytes() for n in range(1, 90)]
    h, start, end = suffix_dedup._word_hashes(b" ".join(words))
    back, _, _ = suffix_dedup._word_hashes(b"\n\t".join(words[::-1]) + b"\r")
    assert back[::-1].tolist() == h.tolist() and len(set(h.tolist())) == len(words)
    assert (end - start).tolist() == list(map(len, words))
