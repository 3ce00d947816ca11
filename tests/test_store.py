"""The keyed store against a dictionary: snapshots, lost and concurrent writers, repeated batches, numbers of files."""

import os
import random

import pytest

from evidentia.sources import store


def documents(spark, items):
    return spark.createDataFrame(list(items), "key string, value string")


def rows(df):
    out = [tuple(r) for r in df.select("key", "value").collect()]
    assert len(out) == len(dict(out))
    return dict(out)


def test_commits_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(8)
    s = store.Store(spark, f"file://{tmp_path}/s", 4)
    assert rows(s.read()) == {} and s.snapshot().version == 0
    want, past = {}, {}
    for n in range(1, 6):
        batch = [(f"k{rng.randint(0, 30)}", rng.choice([None, f"v{n}", f"w{n}", '{"a":"é\n"}'])) for _ in range(rng.choice([1, 12]))]
        assert s.commit(documents(spark, batch), "a", n) == n
        for k in {k for k, _ in batch}:
            best = max((v for x, v in batch if x == k and v is not None), default=None)
            want.pop(k, None)
            if best is not None:
                want[k] = best
        past[n] = dict(want)
        assert rows(s.read()) == want
    assert s.commit(documents(spark, [("k1", "again")]), "a", 5) == 5
    assert rows(s.read()) == want and rows(s.read(2)) == past[2]
    keys = documents(spark, [("k1", None), ("k2", None), ("no", None)])
    assert rows(s.get(keys)) == {k: v for k, v in want.items() if k in ("k1", "k2")}
    s.vacuum(1)
    assert rows(s.read()) == want and s.versions() == [5]
    assert len(os.listdir(f"{tmp_path}/s/data")) <= 4


def test_many_keys_make_few_files(spark, tmp_path):
    from pyspark.sql import functions as F

    s = store.Store(spark, f"file://{tmp_path}/s", 8)
    s.commit(spark.range(100_000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").alias("value")))
    files = [f for d, _, names in os.walk(f"{tmp_path}/s/data") for f in names if f.endswith(".parquet")]
    assert len(files) == 8 and s.read().count() == 100_000


def test_unsafe_keys_keep_nothing(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    for bad in ("a/b", "..", "", None):
        with pytest.raises(Exception, match="unsafe key"):
            s.commit(documents(spark, [("good", "x"), (bad, "y")]))
    assert s.versions() == []


def test_lost_and_concurrent_writers(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/s", 4)
    s.commit(documents(spark, [("a", "1"), ("b", "1")]))
    publish = store.Store._publish

    def dies(self, new):
        raise KeyboardInterrupt

    monkeypatch.setattr(store.Store, "_publish", dies)
    with pytest.raises(KeyboardInterrupt):
        s.commit(documents(spark, [("a", "2")]))
    monkeypatch.setattr(store.Store, "_publish", publish)
    assert rows(s.read()) == {"a": "1", "b": "1"}
    other = store.Store(spark, s.root)
    late = []

    def overtaken(self, new):
        if not late:
            late.append(1)
            publish(other, store.Snapshot(**(vars(other.snapshot()) | {"version": new.version, "batches": {"other": 1}})))
        publish(self, new)

    monkeypatch.setattr(store.Store, "_publish", overtaken)
    assert s.commit(documents(spark, [("b", "3")]), "mine", 1) == 3
    assert rows(s.read()) == {"a": "1", "b": "3"} and s.snapshot().batches == {"other": 1, "mine": 1}
    assert not [f for f in os.listdir(f"{tmp_path}/s/manifests") if f.startswith("_")]
    assert s.vacuum() >= 1 and rows(s.read()) == {"a": "1", "b": "3"}
