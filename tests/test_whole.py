"""Queries that read all rows of their tables, on small made tables."""

from gistmill import registry


def test_components_of_every_part(spark, tmp_path):
    keys = [0, 1, 2, 3, 8, 57, 700, 4901, 50_000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    near = {}
    for k in keys:
        near.setdefault(k, set()).add(7 * k + 1)
        near.setdefault(7 * k + 1, set()).add(k)
    want = {}
    for k in sorted(near):
        stack = [k]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = k
                stack += near[x]
    got = registry.queries()["connected_components"](spark, str(tmp_path)).collect()
    assert {r.id: r.root for r in got} == want and len(got) == len(want)


def test_topics_and_contraction_of_every_order(spark, tmp_path):
    orders = {1: (2, 4), 7: (4, 6), 19: (2, 6), 20: (10, 12), 33: (12, 14), 40: (10, 14), 41: (2, 4)}
    spark.createDataFrame([(o, p) for o, parts in orders.items() for p in parts], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    queries = registry.queries()
    topics = queries["topics_communities"](spark, str(tmp_path)).collect()
    assert sorted((r.topic, r["size"]) for r in topics) == [("p000002", 3), ("p000010", 3)]
    links = queries["graph_contraction"](spark, str(tmp_path)).collect()
    want = {("p000002", "p000004"): 2, ("p000004", "p000006"): 1, ("p000002", "p000006"): 1, ("p000010", "p000012"): 1, ("p000012", "p000014"): 1, ("p000010", "p000014"): 1}
    assert {(r.a, r.b): r.weight for r in links} == want


def test_names_of_documents_of_every_language(spark, tmp_path):
    rows = [(1, "src1", "en", "Paris saw Berta"), (2, "src2", "fr", "Paris aime Lyons"), (3, "src3", None, "Paris Lyons"), (4, "src4", "de", None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = registry.queries()

    def got(name, *columns):
        return sorted(tuple(r[c] for c in columns) for r in queries[name](spark, str(tmp_path)).collect())

    assert got("entity_mentions", "key", "mentions") == [("berta", 1), ("lyon", 2), ("paris", 3)]
    assert got("entity_descriptions", "key", "descriptions")[1] == ("lyon", "seen in src2|seen in src3")
    assert got("entity_graph_build", "key", "mentions") == [("berta", 1), ("lyon", 2), ("paris", 3)]
    assert len(got("entity_graph_view", "src", "dst")) == len(got("relation_weights", "a", "b")) == 2
    assert len(got("most_mentioned_entities", "id")) == 3
