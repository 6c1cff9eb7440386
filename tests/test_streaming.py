from ferrule.streaming import logs


def test_stream_counts_and_sessions(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("2024-01-02T03:00:00 7|a\nbody\n2024-01-02T03:05:00 7|b\n2024-01-02T05:00:00 8|c\n[INFO] no time\n")
    events = logs.read(spark, str(folder))
    for name, df in (("c", logs.counts(events, "thread")), ("s", logs.thread_sessions(events.where("thread is not null")))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert sorted((str(r.start), r.thread, r.n) for r in spark.table("c").collect()) == [("2024-01-02 03:00:00", "7", 2), ("2024-01-02 05:00:00", "8", 1)]
    assert sorted((r.thread, str(r.end), r.n) for r in spark.table("s").collect()) == [("7", "2024-01-02 03:35:00", 2), ("8", "2024-01-02 05:30:00", 1)]
