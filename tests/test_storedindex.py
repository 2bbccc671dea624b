"""The stored index against the scan: words, phrases, weights, deletions, merging, skipped ranges and open versions."""

import random

import pytest
from pyspark.sql import functions as F

from gistmill.operators import storedindex, textindex
from gistmill.operators.storedindex import StoredIndex

WORDS = ["straße", "мой", "がく", "한국어", "سلام", "alpha", "beta", "gamma", "of", "the"]


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, [1, 1, 1, 1, 1, 3, 3, 3, 9, 9], k=rng.randint(0, 30))), rng.choice(WORDS)) for i in range(n)]


def scan(docs, query, limit=10, **more):
    found = textindex.search(docs, query, limit=None, keep=(), **more)
    return [(r.doc_id, round(r.score, 6)) for r in found.orderBy(F.round("score", 6).desc(), "doc_id").limit(limit).collect()]


def stored(index, query, limit=10, keep=None):
    return [(r.id, round(r.score, 6)) for r in index.search(query, limit, keep).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(400, 1), "doc_id long, text string, title string")


def test_ranking_equals_the_scan(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(storedindex, "RANGE_BITS", 3)
    monkeypatch.setattr(storedindex, "RANGE", 8)
    monkeypatch.setattr(storedindex, "FIRST", 4)
    index = StoredIndex(spark, str(tmp_path), {"title": 2.0, "text": 1.0}, parts=4)
    index.add(docs.where("doc_id < 150"))
    index.add(docs.where("doc_id >= 150"))
    weights = {"title": 2.0, "text": 1.0}
    for query in ("alpha", "the мой", "Straße of", "of_the", "the_of_the alpha", "nowhere", "", "한국어_سلام"):
        assert stored(index, query) == scan(docs, query, columns=weights), query
    keep = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    assert stored(index, "beta the", 10, keep) == scan(docs, "beta the", columns=weights, where=F.col("doc_id") % 3 == 0)
    monkeypatch.setattr(storedindex, "NAMED", 3)
    assert stored(index, "of the") == scan(docs, "of the", columns=weights)


def test_changes_and_versions(spark, docs, tmp_path):
    index = StoredIndex(spark, str(tmp_path), parts=4)
    index.add(docs)
    before = StoredIndex(spark, str(tmp_path), parts=4).refresh()
    new = spark.createDataFrame([(i, f"alpha the new {i}", "") for i in range(90, 130)], docs.schema)
    index.delete(spark.range(100, 120))
    index.delete(spark.range(90, 130))
    index.add(new)
    now = docs.where("doc_id NOT BETWEEN 90 AND 129").unionByName(new)
    for query in ("alpha the", "the_new", "of"):
        assert stored(index, query) == scan(now, query)
        assert stored(before, query) == scan(docs, query)
    index.merge()
    assert [r.kind for r in index.manifest] == ["segment"] and index.live().count() == 400
    for query in ("alpha the", "the_new", "of"):
        assert stored(index, query) == scan(now, query)
    index.delete(spark.range(1000))
    assert stored(index, "alpha") == []


def test_a_query_opens_its_terms_partitions(spark, docs, tmp_path):
    index = StoredIndex(spark, str(tmp_path), parts=64)
    index.add(docs)
    plan = index._of(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,alpha)" in plan.split("PushedFilters: [")[1]


def test_ranges_end_at_documents_and_tokens_and_small_ones_merge(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(storedindex, "RANGE_BITS", 6)
    monkeypatch.setattr(storedindex, "RANGE", 64)
    monkeypatch.setattr(storedindex, "RANGE_TOKENS", 300)
    index = StoredIndex(spark, str(tmp_path), parts=4)
    for k in range(4):
        index.add(docs.where(F.col("doc_id") % 4 == k).repartition(3))
    ranges = index.docs().groupBy("segment", (F.col("doc") / 64).cast("long").alias("range")).agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
    assert ranges.count() > 12 and not ranges.where("n > 64 or tokens > 300").count()
    dead = spark.range(0, 400, 7)
    index.delete(dead)
    index.merge()
    assert ranges.count() > index.docs().select(F.shiftright("doc", 6)).distinct().count()
    assert index.docs().select("doc").distinct().count() == index.docs().count() == 342
    now = docs.where("doc_id % 7 <> 0")
    for query in ("alpha the", "of_the", "мой"):
        assert stored(index, query) == scan(now, query)


def test_small_segments_become_one_range(spark, docs, tmp_path):
    index = StoredIndex(spark, str(tmp_path), parts=4)
    index.add(docs.where("doc_id < 20").repartition(3))
    index.add(docs.where("doc_id >= 380").repartition(3))
    index.merge()
    assert index.docs().select(F.shiftright("doc", storedindex.RANGE_BITS)).distinct().count() == 1
    assert stored(index, "of the") == scan(docs.where("doc_id < 20 or doc_id >= 380"), "of the")
