import numpy as np

from ferrule.llm import nearest


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in df.collect())


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(11)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(40)]
    schema = "vec_id long, embedding array<double>"
    want = rows_of(nearest.search(spark.createDataFrame(rows, schema), "vec_id % 10 = 0"))
    assert len(want) == 4 * 5
    for times in (2, 5):
        assert rows_of(nearest.search(spark.createDataFrame(rows * times, schema), "vec_id % 10 = 0")) == want
    near = [(1, [1.0, 0.1]), (2, [1.0, 0.2]), (0, [1.0, 0.0]), (3, [1.0, 0.3]), (3, [-1.0, 0.3]), (4, [1.0, 0.9])] + [(1, [1.0, 0.1 + k / 1e4]) for k in range(6)]
    got = rows_of(nearest.search(spark.createDataFrame(near, schema), "vec_id = 0", k=3))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_queries_are_dealt_into_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 100)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 50)
    rng = np.random.default_rng(12)
    rows = [(k, rng.standard_normal(4).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    left, right = nearest.dealt(df, df.where("vec_id < 200"), 400, 200)
    for side, size in ((left, 100), (right, 50)):
        counts = [r["count"] for r in side.groupBy("block", "part").count().collect()]
        assert len(counts) == 16 and max(counts) < 2 * size
    met = left.join(right.withColumnRenamed("vec_id", "query_id"), ["block", "part"]).groupBy("vec_id", "query_id").count()
    assert met.count() == 400 * 200 and met.where("count > 1").count() == 0
    got = rows_of(nearest.search(df.withColumnRenamed("v", "embedding"), "vec_id < 200"))
    assert len(got) == 200 * 5
