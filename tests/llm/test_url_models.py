"""Verdicts where no rule fits, against counting in dictionaries."""

import math
import random
from collections import Counter

import pytest

from ferrule.llm import url_filter
from ferrule.llm.url_filter import ORDER, SHORTER


def brute(df, rules):
    rows = url_filter.judge(df, rules=rules).select("id", "host", "path", "rule").collect()  # rules have a test of their own
    verdicts = {h + p: v for h, p, v in rules}
    from pyspark.sql import functions as F

    plain = df.select("page_id", F.coalesce("url", F.lit("")).alias("url")).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(2)))
    url = {r.page_id: (r.url, r.fold) for r in plain.collect()}
    lead, counts, contexts = b"\xff" * ORDER, Counter(), Counter()
    signs = lambda u: [((lead + u.encode() + b"\xff")[p - ORDER : p], (lead + u.encode() + b"\xff")[p]) for p in range(ORDER, ORDER + len(u.encode()) + 1)]
    for r in rows:
        if r.rule:
            u, fold = url[r.id]
            for c, s in signs(u):
                for k in range(ORDER + 1):
                    counts[verdicts[r.rule], fold, c[ORDER - k :], s] += 1
                    contexts[verdicts[r.rule], fold, c[ORDER - k :]] += 1

    def chance(label, folds, c, s):
        p = 1 / 256
        for k in range(ORDER + 1):
            own = c[ORDER - k :]
            p = (sum(counts[label, f, own, s] for f in folds) + SHORTER * p) / (sum(contexts[label, f, own] for f in folds) + SHORTER)
        return p

    def ratio(u, folds):
        return sum(math.log(chance("allow", folds, c, s) / chance("block", folds, c, s)) for c, s in signs(u)) / (len(u.encode()) + 1)

    bins = Counter()
    for r in rows:
        if r.rule:
            u, fold = url[r.id]
            held = max(-url_filter.SPAN, min(url_filter.SPAN - 1e-9, ratio(u, (1 - fold,))))
            bins[int(verdicts[r.rule] == "allow"), math.floor((held + url_filter.SPAN) * url_filter.BINS / (2 * url_filter.SPAN))] += 1
    threshold = url_filter.calibrate([(y, b, n) for (y, b), n in bins.items()])
    for r in rows:
        x = ratio(url[r.id][0], (0, 1))
        yield r.id, r.rule, verdicts[r.rule] if r.rule else "allow" if x >= threshold else "block", x


@pytest.mark.parametrize("local", [1 << 18, 5, 0])
def test_verdicts_as_brute_force(spark, tiny, local):
    df = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "http://é.net/ü"), (-3, "http://é.net/ü")], "page_id long, url string"))
    got = sorted(((r.id, r.rule, r.verdict, r.ratio) for r in url_filter.judge(df, local=local).collect()), key=str)
    want = sorted(brute(df, url_filter.RULES), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == pytest.approx(w[3], abs=1e-9) for g, w in zip(got, want))


def test_random_ids_in_urls(spark):
    rng = random.Random(3)
    rows = [(k, f"http://{'a.good' if k % 2 else 'b.bad'}/{'item' if k % 2 else 'offer'}/{rng.getrandbits(64):016x}") for k in range(5000)] + [(9000, "http://c.else/item/1"), (9001, "http://c.else/offer/2")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.id: r.verdict for r in url_filter.judge(df, rules=(("good", "/", "allow"), ("bad", "/", "block")), local=100).collect()}
    assert got[9000] == "allow" and got[9001] == "block" and all(got[k] == ("allow" if k % 2 else "block") for k in range(5000))


def test_clashing_columns_and_one_class(spark):
    df = spark.createDataFrame([(1, "http://x.net/a", "r", 1), (2, "http://y.com/", "q", 2)], "page_id long, url string, gram string, fold int")
    assert {r.id: r.verdict for r in url_filter.judge(df).collect()} == {1: "block", 2: "allow"}
