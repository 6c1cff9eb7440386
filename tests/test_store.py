"""The store of facts: only changed parts are written, a broken or late ingest changes nothing."""

import json

import pytest

from ferrule import scratch
from ferrule.sources import facts
from ferrule.sources.store import FactStore


def sources(spark, texts):
    return spark.createDataFrame([(f"src/{k}.prw", t) for k, t in texts.items()], "path string, text string")


def unit(k, body=""):
    return f'User Function P{k}()\n  RecLock("SA{k % 10}", .T.)\n{body}Return\n'


def rows(store):
    return {n: sorted(map(str, df.collect())) for n, df in store.tables().items()}


def derived(spark, texts):
    return {n: sorted(map(str, df.collect())) for n, df in facts.fact_tables(sources(spark, texts)).items()}


def test_incremental_ingest(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"), parts=8)
    texts = {k: unit(k) for k in range(40)} | {40: None, 41: ""}
    assert store.ingest(sources(spark, texts)) == {"new": 42, "changed": 0, "deleted": 0, "kept": 0, "parts": 8}
    assert rows(store) == derived(spark, texts)
    assert store.ingest(sources(spark, texts)) == {"new": 0, "changed": 0, "deleted": 0, "kept": 42, "parts": 0}
    before = store._snapshot()[1]["tables"]["refs"]["parts"]
    texts |= {3: unit(3, "  U_P4()\n"), 99: unit(9)}
    del texts[7]
    done = store.ingest(sources(spark, texts))
    assert (done["new"], done["changed"], done["deleted"], done["kept"]) == (1, 1, 1, 40) and done["parts"] <= 3
    after = store._snapshot()[1]["tables"]["refs"]["parts"]
    assert sum(before[k] != after[k] for k in before) == done["parts"]
    assert rows(store) == derived(spark, texts)
    late = store.table("units")
    assert store.ingest(sources(spark, {}))["deleted"] == 42 and all(not r for r in rows(store).values())
    assert late.count() == 40  # a table stays as it was read
    assert store.vacuum(1) > 0 and len(scratch.names_in(spark, f"{store.root}/snapshots")) == 1


def test_broken_ingest_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = FactStore(spark, str(tmp_path / "s"), parts=2)
    store.ingest(sources(spark, {1: unit(1)}))
    before = rows(store)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr("ferrule.sources.store.put_once", dies)
        with pytest.raises(RuntimeError):
            store.ingest(sources(spark, {1: unit(2)}))
    assert rows(store) == before
    assert store.ingest(sources(spark, {1: unit(2)}))["changed"] == 1 and rows(store) == derived(spark, {1: unit(2)})


def test_a_faster_ingest_is_not_lost(spark, tmp_path, monkeypatch):
    store = FactStore(spark, str(tmp_path / "s"), parts=2)
    store.ingest(sources(spark, {1: unit(1)}))
    real, late = scratch.put_once, []

    def overtaken(spark_, path, text):
        if not late:
            late.append(path)
            content = json.loads(scratch.read_small(spark, f"{store.root}/snapshots/00000001.json"))
            assert real(spark, path, json.dumps(content))
        return real(spark_, path, text)

    monkeypatch.setattr("ferrule.sources.store.put_once", overtaken)
    assert store.ingest(sources(spark, {1: unit(2)}))["changed"] == 1
    assert store._snapshot()[0] == 3 and rows(store) == derived(spark, {1: unit(2)})


def test_put_once(spark, tmp_path):
    path = str(tmp_path / "x" / "a.json")
    assert scratch.put_once(spark, path, "one") and not scratch.put_once(spark, path, "two") and scratch.read_small(spark, path) == "one"
    assert scratch.names_in(spark, str(tmp_path / "x")) == ["a.json"] and scratch.names_in(spark, str(tmp_path / "none")) == []
