"""Versions of the store: readers keep theirs, failed changes leave nothing, merges equal plain dictionaries."""

import random

import pytest

from gistmill.operators.snapshots import VersionedStore
from gistmill.operators.versions import Conflict

SCHEMAS = {"nodes": "id string, label string", "edges": "src string, type string, dst string, weight long", "embeddings": "node_id string, vector array<double>"}


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, label string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def seen(snapshot, table="nodes"):
    return sorted(tuple(r) for r in snapshot[table].collect())


def test_readers_keep_their_version(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), SCHEMAS)
    assert store.snapshot().version == 0 and seen(store.snapshot()) == []
    links = spark.createDataFrame([("a", "T", "b", 1), ("b", "T", "c", 2), ("c", "T", "a", 3)], SCHEMAS["edges"])
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], SCHEMAS["embeddings"])
    made = nodes(spark, [("a", "x"), ("b", "x"), ("c", "x")])
    first = store.change().upsert("nodes", made).upsert_edges(links, made).upsert("embeddings", vectors).commit()
    change = store.change().delete_nodes(ids(spark, "b")).upsert("nodes", nodes(spark, [("a", "y"), ("d", "z")]))
    assert seen(store.snapshot()) == seen(first) == [("a", "x"), ("b", "x"), ("c", "x")]
    second = change.commit()
    assert seen(second) == [("a", "y"), ("c", "x"), ("d", "z")] and seen(second, "edges") == [("c", "T", "a", 3)] and seen(second, "embeddings") == [("a", [1.0])]
    assert len(seen(first, "edges")) == 3 and len(seen(first, "embeddings")) == 2 and seen(first)[1] == ("b", "x")
    for wrong in (lambda c: c.upsert("nodes", made).upsert_edges(spark.createDataFrame([("a", "T", "nowhere", 1)], SCHEMAS["edges"])),):
        with pytest.raises(ValueError):
            wrong(store.change()).commit()
    assert store.snapshot().version == 2 and seen(store.snapshot()) == seen(second)
    third = store.compact()
    assert seen(third) == seen(second) and seen(third, "edges") == seen(second, "edges") and seen(store.snapshot(1)) == seen(first)


def test_two_changes_of_one_base_conflict(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), SCHEMAS)
    a, b = store.change().upsert("nodes", nodes(spark, [("a", "1")])), store.change().upsert("nodes", nodes(spark, [("a", "2")]))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert seen(store.snapshot()) == [("a", "1")]


def test_merging_equals_a_dictionary(spark, tmp_path):
    rng, store, plain = random.Random(4), VersionedStore(spark, str(tmp_path), SCHEMAS), {}
    for step in range(5):
        change = store.change()
        for _ in range(2):
            put = {f"n{rng.randrange(30)}": f"s{step}{rng.random()}" for _ in range(8)}
            gone = [f"n{rng.randrange(30)}" for _ in range(4)]
            change.upsert("nodes", nodes(spark, list(put.items()))).delete("nodes", ids(spark, *gone))
            plain = {k: v for k, v in (plain | put).items() if k not in gone}
        now = change.commit()
        if step == 2:
            now = store.compact()
        assert seen(now) == sorted(plain.items())
