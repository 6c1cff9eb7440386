import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import boosting, html_text, nearest, packing, token_rollup


def test_boosting_fits_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.4) | (x[:, 4] > 0.9)).astype(float)
    model = boosting.fit(x, y)
    assert ((model.predict(x) > 0.5) == (y > 0.5)).mean() > 0.97
    assert (boosting.fit(np.empty((0, 5), np.float32), np.empty(0)).predict(x) == 0.5).all()


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Head &amp; tail</h1>"
    "<p>One  two\n three, with &eacute; and more words in this long sentence of the page.<p>Second<br>line of text, which goes on for a while, too.</article>"
    '<div class="comments"><p>reader says</p></div><footer>&copy; x</footer></body></html>'
)


@pytest.fixture(scope="module")
def model(spark, tiny):
    return html_text.train(spark.read.parquet(f"{tiny}/pages.parquet"))


def test_extraction(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "u", "plain words only, no markup at all"), (5, "u", "<p>cut <a hr"), (1, "u", PAGE), (6, "u", "<div>" * 5000 + "deep" + "</div>" * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(df, model).collect()
    assert len(got) == len(rows)
    assert got[0].text == "Head & tail\n\nOne two three, with é and more words in this long sentence of the page.\n\nSecond line of text, which goes on for a while, too."
    assert got[5].text == got[0].text and got[1].text == got[2].text == "" and got[3].text.startswith("plain words")
    assert html_text.extract(df.limit(0), model).count() == 0


def test_pages_hold_their_articles(spark, tiny):
    import html
    import re

    got = {r.page_id: r.text for r in html_text.op1(spark, tiny).collect()}
    for r in spark.read.parquet(f"{tiny}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_no_kept_node_under_a_dropped_one():
    page = html_text.Page("<div><section><p>a</p></section><p>b</p></div>")
    p = np.array([0.9, 0.9, 0.01, 0.6, 0.9])
    assert page.decode(p) == "b"


def brute_nearest(rows, is_query, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in good:
        if is_query(q):
            s = sorted((-float(x @ y / np.sqrt((x @ x) * (y @ y))), i) for i, y in good if i != q)
            out[q] = s[:k]
    return out


def test_recall_on_embeddings(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 50 == 0)
    got = {}
    for r in nearest.search(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    hits = sum(len({r.vec_id for r in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, rows in got.items():
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in rows}
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(rows, rows[1:]))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [2.0, 2.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, []), (9, [float("inf"), 1.0]), (10, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in nearest.search(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 50, 10], 50: [1, 2, 0, 10]}
    assert nearest.search(df.limit(0), "vec_id % 50 = 0").count() == 0
    assert nearest.search(df.where("vec_id = 0"), "vec_id % 50 = 0").count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 256, (40, 8)).astype(np.uint8), rng.integers(0, 256, (500, 8)).astype(np.uint8)
    b[:40] = a ^ (rng.random((40, 8)) < 0.2).astype(np.uint8)
    for radius in (0, 3, 9, 20, 28, 64):
        want = set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(a[:, None] ^ b).sum(axis=2) <= radius))))
        got = [p for x, y in nearest.probe(a, b, radius) for p in zip(x.tolist(), y.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def slow_best_fit(size, source, cluster, capacity, per_source):
    bins, out = [], []
    for s, src, c in zip(size, source, cluster):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= s and b["src"].count(src) < per_source and (c < 0 or c not in b["cl"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "src": [], "cl": set()})
        bins[k]["room"] -= s
        bins[k]["src"].append(src)
        bins[k]["cl"].add(c)
        out.append(k)
    return out


@pytest.mark.parametrize("per_source", [1, 2])
def test_best_fit_is_the_tightest_compatible_bin(per_source):
    rng = np.random.default_rng(per_source)
    size = np.sort(rng.integers(0, 100, 600))[::-1]
    source, cluster = rng.integers(0, 70, 600) * (rng.random(600) < 0.7), rng.integers(-1, 90, 600)
    assert packing.best_fit(size, source, cluster, 100, per_source).tolist() == slow_best_fit(size, source, cluster, 100, per_source)


def test_packing_places_everything(spark):
    rows = [(i, "x" * (i * 37 % 900), f"s{i % 3 if i % 2 else 0}", None) for i in range(400)] + [(900, "y" * 5000, "s0", 1), (901, None, None, 2), (900, "y" * 5000, "s0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int")
    out = packing.pack(df, F.octet_length("text"), F.col("source"), F.xxhash64("text"), capacity=1000, shard=64).toPandas()
    assert out.groupby("id")["size"].sum().to_dict() == {**{i: i * 37 % 900 for i in range(400)}, 900: 10000, 901: 0}
    assert out.groupby("bin")["size"].sum().max() <= 1000
    info = {i: (s, t) for i, t, s, _ in rows}
    out["source"], out["text"] = out["id"].map(lambda i: info[i][0]), out["id"].map(lambda i: info[i][1])
    assert out.groupby(["bin", "source"]).size().max() <= packing.PER_SOURCE
    assert out[out["text"].notna()].groupby(["bin", "text"]).size().max() == 1
    assert (out.sort_values(["bin", "pos"]).groupby("bin")["pos"].apply(list).map(lambda x: x == list(range(len(x))))).all()
    assert packing.pack_texts(df.limit(0).drop("bin")).count() == 0


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_rollup_deltas(spark, tmp_path):
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    schema = "doc_id long, source string, lang string, version string, n_tokens long, kind string, n_docs string"
    put = lambda *rows: spark.createDataFrame([(*x, "z") for x in rows], schema)
    assert totals(r) == {}
    assert r.commit("a", put((1, "s", "en", "v1", 10, "put"), (2, "s", "en", "v1", 5, "put"), (2, "s", "en", "v1", 5, "put"), (None, None, "en", "v1", None, "put")))
    assert totals(r) == {("s", "en", "v1"): (2, 15), (None, "en", "v1"): (1, 0)}
    assert not r.commit("a", put((1, "s", "en", "v1", 99, "put")))
    r.commit("b", put((1, "s", "fr", "v1", 7, "put"), (2, None, None, "v1", None, "delete"), (77, None, None, "v1", None, "delete"), (1, "s", "en", "v2", 3, "put")))
    assert totals(r) == {("s", "fr", "v1"): (1, 7), ("s", "en", "v2"): (1, 3), (None, "en", "v1"): (1, 0)}
    r.commit("c", put((None, None, None, "v1", None, "delete"), (1, None, None, "v1", None, "delete"), (1, "s", "x", "v1", 4, "put")))
    assert totals(r) == {("s", "en", "v2"): (1, 3)}
    r.commit("d", put().limit(0) if False else spark.createDataFrame([], schema))
    assert r.batches() == ["a", "b", "c", "d"] and r.ledger().count() == 1


def test_rollup_recovers_a_broken_batch(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([(1, "s", "en", "v1", 10, "put")], "doc_id long, source string, lang string, version string, n_tokens long, kind string")
    rows.selectExpr("doc_id", "source", "lang", "version", "1L n_docs", "999L n_tokens").write.parquet(f"{path}/rows/a")
    r = token_rollup.Rollup(spark, path)
    assert totals(r) == {}
    assert r.commit("a", rows) and totals(r) == {("s", "en", "v1"): (1, 10)}


def test_rollup_query_matches_sql(spark, tiny):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    want = sorted(c.sql(f"SELECT source, lang, version, n_docs, n_tokens FROM ({token_rollup.OP3_SQL})").fetchall())
    assert sorted((r.source, r.lang, r.version, r.n_docs, r.n_tokens) for r in token_rollup.op3(spark, tiny).collect()) == want
