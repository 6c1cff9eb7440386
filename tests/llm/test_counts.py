"""Tokens counted without their ids."""

import pyarrow as pa
import public_tokenizers

from ferrule.llm import byte_bpe, token_rollup

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_counts_equal_encoding(spark, monkeypatch):
    """counting held the decimal ids and decoded bytes of 8 MB of text at a time; small portions give the same counts."""
    texts = ["", None, "a b  c\n\n d", "été — naïve 漢字 🙂", "x" * 500, " ", "don't 1234 \t tab"] * 3
    docs = spark.createDataFrame([(k, "s", None, t) for k, t in enumerate(texts)], "doc_id long, source string, lang string, text string").coalesce(1)
    expected = {r.id: r.n_tokens for r in byte_bpe.round_trip(docs, PATH).collect()}
    assert {r.doc_id: r.n_tokens for r in token_rollup.count_by_codec(docs, PATH, "v").collect()} == expected
    ranks = byte_bpe.read_ranks(PATH)
    codec = byte_bpe.Codec(ranks, byte_bpe.merges(ranks), public_tokenizers.PATTERN)
    monkeypatch.setattr(codec, "shown", None)
    monkeypatch.setattr(codec, "decoded", None)
    got = [n for _, some in byte_bpe._portions(pa.array(texts), 8) for n in codec.count_all(some).tolist()]
    assert got == [expected[k] for k in range(len(texts))]
    assert codec.count_all(pa.array([], pa.large_string())).tolist() == []
