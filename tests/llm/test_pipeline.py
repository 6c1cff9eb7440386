import corpus_pipeline
from ferrule.llm import packing, simhash, suffix_dedup, toxicity


def test_stages_follow_each_other(spark, tiny):
    """run() equals the brute-force version: each stage's decisions applied by hand to what the one before kept."""
    from tests.llm.test_similar import brute_kept
    from tests.llm.test_suffix_stage import brute_words

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = toxicity.train(docs, labels)
    table = model.table()
    rows = [(r.doc_id, r.text) for r in docs.collect() if toxicity.noisy_or(model.scores((r.text or "").encode(), table)[0]) < toxicity.THRESHOLD]
    near = set(brute_kept(rows))
    rows = [(d, t) for d, t in rows if d in near]
    sizes = {d: len(t.encode()) for (d, _), t in zip(rows, brute_words([t or "" for _, t in rows]))}
    out = corpus_pipeline.run(spark, tiny).toPandas()
    assert out.groupby("doc_id")["size"].sum().to_dict() == sizes
    assert out.groupby("bin_id")["size"].sum().max() <= packing.CAPACITY


def test_stages_keep_the_columns(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_dedup", "best_fit_packing"]
    assert {simhash, suffix_dedup, packing}
