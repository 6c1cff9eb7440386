"""Commits that race, compaction, and counts by op10's codec."""

import public_tokenizers as public
import tiktoken

from ferrule.llm import byte_bpe, token_rollup

SCHEMA = "doc_id long, source string, lang string, version string, n_tokens long, kind string"


def totals(rollup):
    out = {}
    for r in rollup.totals().collect():
        n, m = out.get((r.source, r.version), (0, 0))
        out[r.source, r.version] = n + r.n_docs, m + r.n_tokens
    return out


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = (token_rollup.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    rows = [spark.createDataFrame([(1, "s", "en", "v", n, "put")], SCHEMA) for n in (10, 99)]
    folder = two._write(rows[1].selectExpr("doc_id", "source", "lang", "version", "1L n_docs", "n_tokens"))  # has written, not committed
    assert one.commit("a", rows[0]) and totals(one) == {("s", "v"): (1, 10)}
    assert not two._commit_file("a", folder) and totals(two) == {("s", "v"): (1, 10)}


def test_compaction_keeps_totals_and_names(spark, tmp_path):
    r = token_rollup.Rollup(spark, str(tmp_path / "r"), parts=3)
    put = lambda *rows: spark.createDataFrame([(*x,) for x in rows], SCHEMA)
    assert not r.compact()
    r.commit("a", put(*[(k, "s", "en", "v", k, "put") for k in range(50)], (None, None, None, None, 3, "put")))
    r.commit("b", put((4, None, None, "v", None, "delete"), (5, "t", "en", "v", 7, "put")))
    want = totals(r)
    assert want == {("s", "v"): (48, 1225 - 9), ("t", "v"): (1, 7), (None, None): (1, 3)}
    assert r.compact() and totals(r) == want and r.ledger().count() == 50
    assert not r.commit("a", put((9, "s", "en", "v", 1000, "put"))) and totals(r) == want
    assert r.commit("c", put((9, None, None, "v", None, "delete"))) and totals(r)[("s", "v")] == (47, 1216 - 9)
    assert r.compact() and totals(r)[("s", "v")] == (47, 1216 - 9) and len(r._folders()) == 1


def test_counts_by_codec(spark, tiny, tmp_path):
    path = public.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert r.commit("a", token_rollup.count_by_codec(docs, path, "byte_bpe_multi_50k"))
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = {}
    for d in docs.collect():
        n, m = want.get((d.source, "byte_bpe_multi_50k"), (0, 0))
        want[d.source, "byte_bpe_multi_50k"] = n + 1, m + len(own.encode_ordinary(d.text or ""))
    assert totals(r) == want
    assert token_rollup.count_by_codec(docs.limit(0), path, "x").count() == 0


def put(spark, *rows):
    return spark.createDataFrame([(*x,) for x in rows], SCHEMA)


def test_a_writer_that_dies_leaves_the_batch_free(spark, tmp_path, monkeypatch):
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    r.commit("a", put(spark, (1, "s", "en", "v", 10, "put")))

    def dies(self, *_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(token_rollup.Rollup, "_next", dies)
        try:
            r.commit("b", put(spark, (2, "s", "en", "v", 5, "put")))
        except RuntimeError:
            pass
    (tmp_path / "r" / "log" / "000000000002.json.abc.draft").write_text("")  # what a writer leaves that dies before it renames
    assert totals(r) == {("s", "v"): (1, 10)}
    assert r.commit("b", put(spark, (2, "s", "en", "v", 5, "put"))) and totals(r) == {("s", "v"): (2, 15)}


def overtaken(monkeypatch, once):
    """The next entry that is tried is made by another writer first."""
    real, left = token_rollup.Rollup._next, [once]

    def late(self, number, content):
        if left:
            left.pop()()
        return real(self, number, content)

    monkeypatch.setattr(token_rollup.Rollup, "_next", late)


def test_two_batches_on_one_document(spark, tmp_path, monkeypatch):
    one, two = (token_rollup.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    one.commit("a", put(spark, (1, "s", "en", "v", 10, "put")))
    overtaken(monkeypatch, lambda: two.commit("c", put(spark, (1, "s", "en", "v", 20, "put"))))
    assert one.commit("b", put(spark, (1, "s", "en", "v", 30, "put")))
    assert totals(one) == {("s", "v"): (1, 30)} and one.batches() == ["a", "b", "c"]


def test_the_same_batch_twice_at_once(spark, tmp_path, monkeypatch):
    one, two = (token_rollup.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    overtaken(monkeypatch, lambda: two.commit("a", put(spark, (1, "s", "en", "v", 20, "put"))))
    assert not one.commit("a", put(spark, (1, "s", "en", "v", 20, "put"))) and totals(one) == {("s", "v"): (1, 20)}


def test_a_batch_that_commits_during_compaction(spark, tmp_path, monkeypatch):
    one, two = (token_rollup.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    one.commit("a", put(spark, (1, "s", "en", "v", 10, "put")))
    one.commit("b", put(spark, (2, "s", "en", "v", 10, "put")))
    overtaken(monkeypatch, lambda: two.commit("c", put(spark, (3, "s", "en", "v", 5, "put"))))
    assert one.compact() and totals(one) == {("s", "v"): (3, 25)} and len(one._folders()) == 1
    assert not one.commit("c", put(spark, (3, "s", "en", "v", 5, "put"))) and totals(one) == {("s", "v"): (3, 25)}


def test_names_beyond_a_megabyte(spark, tmp_path):
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    r.commit("a", put(spark, (1, "s", "en", "v", 10, "put")))
    number, state = r._state()
    assert r._next(number, {**state, "batches": [*state["batches"], *[f"batch-{k:08d}" for k in range(130_000)]]})
    r.commit("z", put(spark, (2, "s", "en", "v", 10, "put")))
    assert r.compact() and totals(r) == {("s", "v"): (2, 20)}
    for name in ("a", "batch-00129999", "z"):
        assert not r.commit(name, put(spark, (9, "s", "en", "v", 10, "put")))
    assert totals(r) == {("s", "v"): (2, 20)} and len(r.batches()) == 130_002


def test_totals_by_codec(spark, tiny):
    path = public.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    toxic = {r.doc_id for r in spark.read.parquet(f"{tiny}/labels.parquet").where("toxic = 1").collect()}
    want = {}
    for d in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        if d.doc_id not in toxic:
            n, m = want.get((d.source, d.lang), (0, 0))
            want[d.source, d.lang] = n + 1, m + len(own.encode_ordinary(d.text or ""))
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_rollup.by_codec(spark, tiny).collect()} == want
