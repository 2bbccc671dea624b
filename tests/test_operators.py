import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmill.operators import ask, explore, graph, knowledge, sessions, store, textindex, vectorsearch
from gistmill.operators import topics as T
from gistmill.operators.ranks import numbered
from gistmill.operators.topics import find_topics
from gistmill.session import durable


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("a", "Entity", "Maya"), ("b", "Entity", "Lisbon"), ("c", "Chunk", "x"), ("d", "Topic", "t")], "id string, label string, name string")
    edges = spark.createDataFrame([("a", "RELATED_TO", "b"), ("b", "RELATED_TO", "a"), ("c", "MENTIONS", "a"), ("a", "IN_TOPIC", "d"), ("a", "RELATED_TO", "a")], "src string, type string, dst string")
    return nodes, edges


def test_neighbors(spark, small):
    nodes, edges = small
    got = [(r.src, r.type, r.dst) for r in store.neighbors(edges, nodes, "a", None, "both").collect()]
    assert got == sorted(got, key=lambda r: (r[1], r[2], r[0])) and len(got) == 5
    assert [r.other for r in store.neighbors(edges, nodes, "a", ["IN_TOPIC"]).collect()] == ["d"]
    asked = spark.createDataFrame([("a",), ("c",), ("zz",), ("a",)], "id string")
    many = {r.asked: len(r.links) for r in store.neighbors_many(edges, asked, None, "in").collect()}
    assert many == {"a": 3, "c": 0, "zz": 0}
    both = store.edges_many(edges, asked, None, "both").where("asked = 'a'").count()
    assert both == 5


def test_store_reads_and_checks(spark, small):
    nodes, edges = small
    assert [r.id for r in store.find_nodes(nodes, "Entity", {"name": "Maya"}).collect()] == ["a"]
    assert store.find_nodes(nodes, "Entity", {"name": None}).count() == 0
    with pytest.raises(ValueError):
        store.find_nodes(nodes, "Entity", {"name = 1 or 1": 2})
    assert {r.label: r.n for r in store.count_by_label(nodes).collect()}["Fact"] == 0
    with pytest.raises(ValueError):
        store.upsert_edges(edges, spark.createDataFrame([("a", "X", "gone")], edges.schema), nodes)
    vectors = spark.createDataFrame([("a", [1.0])], "node_id string, vector array<double>")
    n, e, v = store.delete_nodes(spark.createDataFrame([("a",)], "id string"), nodes, edges, vectors)
    assert (n.count(), e.count(), v.count()) == (3, 0, 0)
    with pytest.raises(ValueError):
        store.set_embeddings(vectors, spark.createDataFrame([("b", [1.0, 2.0])], vectors.schema), nodes, 1)
    assert store.set_embeddings(vectors, spark.createDataFrame([("b", [2.0])], vectors.schema), nodes, 1).count() == 2


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in store.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in store.insert_absent(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    batch = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "k int, v string, seq int")
    assert [tuple(r) for r in store.last_wins(batch, ["k"], "seq").collect()] == [(1, "y")]


def test_conversations_come_anew(spark):
    schema = "id string, label string, conversation_id string, message_id string"
    nodes = spark.createDataFrame([("v", "Conversation", None, None), ("m1", "Message", "v", None), ("m2", "Message", "v", None), ("c1", "Chunk", "v", "m1"), ("c2", "Chunk", "v", "m2")], schema)
    edges = spark.createDataFrame([("m2", "REPLIES_TO", "m1"), ("m1", "HAS_CHUNK", "c1"), ("m2", "HAS_CHUNK", "c2")], "src string, type string, dst string")
    vectors = spark.createDataFrame([("c1", [1.0]), ("c2", [2.0])], "node_id string, vector array<double>")
    conv = spark.createDataFrame([("v", "Conversation", None, None)], schema)
    messages = spark.createDataFrame([("m1", "Message", "v", None), ("m3", "Message", "v", None)], schema)
    fresh = spark.createDataFrame([("m3", "REPLIES_TO", "m1")], edges.schema)
    after = store.upsert_conversations({"nodes": nodes, "edges": edges, "embeddings": vectors}, conv, messages, fresh)
    assert {r.id for r in after["nodes"].collect()} == {"v", "m1", "m3", "c1"}
    assert {tuple(r) for r in after["edges"].collect()} == {("m3", "REPLIES_TO", "m1"), ("m1", "HAS_CHUNK", "c1")}
    assert [r.node_id for r in after["embeddings"].collect()] == ["c1"]
    assert store.delete_conversation(after, "v")["nodes"].count() == 0


def test_window_compares_prefixes(spark):
    rows = spark.createDataFrame([("a", "2026-01-31T10:00:00", None, "x"), ("b", None, "2026-02-01", "x"), ("c", None, None, "x")], "id string, created_at string, updated_at string, source string")
    assert [r.id for r in rows.where(store.window("2026-01", "2026-01")).collect()] == ["a"]
    assert [r.id for r in rows.where(store.window(until="2026-02")).orderBy("id").collect()] == ["a", "b"]
    assert rows.where(store.window(sources=["y"])).count() == 0


def test_trees(spark):
    chain = [("s", str(k), str(k - 1) if k else None, k % 7 == 0) for k in range(300)]
    nodes = spark.createDataFrame([*chain, ("s", "p", "q", False), ("s", "q", "p", False)], "scope string, id string, parent string, kept boolean")
    got = {r.id: r.anchor for r in graph.nearest_kept(nodes).collect()}
    assert got["299"] == "294" and got["6"] == "0" and got["7"] == "7" and got["p"] is None
    deep = {r.id: r.depth for r in graph.depths(nodes.drop("kept")).collect()}
    assert deep["299"] == 299 and deep["p"] is None
    m = nodes.select(F.col("scope").alias("conversation_id"), "id", F.col("parent").alias("parent_id"))
    assert {r.fault for r in graph.tree_faults(m).collect()} == {"cycle"}


def test_active_branch(spark):
    m = spark.createDataFrame([("v", "1", None, 0), ("v", "2", "1", 1), ("v", "3", "1", 2), ("v", "4", "3", 3), ("w", "9", None, 0)], "conversation_id string, id string, parent_id string, position long")
    leaves = spark.createDataFrame([("v", "4"), ("w", None)], "conversation_id string, leaf_id string")
    got = sorted((r.conversation_id, r.branch_position, r.id) for r in graph.active_branch(m, leaves).collect())
    assert got == [("v", 0, "1"), ("v", 1, "3"), ("v", 2, "4"), ("w", 0, "9")]


def clique(names):
    return [(a, b, 5) for i, a in enumerate(names) for b in names[i + 1 :]]


def topics(spark, links, same=(), **more):
    rows = spark.createDataFrame(links, "source string, target string, weight long")
    every = rows.select(F.col("source").alias("id")).union(rows.select("target")).distinct()
    return [r.members for r in find_topics(every, rows, spark.createDataFrame(list(same), "a string, b string"), **more).collect()]


def test_topics_of_cliques(spark):
    a, b = [f"a{k}" for k in range(5)], [f"b{k}" for k in range(4)]
    links = [*clique(a), *clique(b), ("a0", "b0", 1), ("x", "y", 3)]
    assert topics(spark, links) == [a, b]
    assert topics(spark, links, same=[("a0", "a1")]) == [a, b]


def test_large_topics_split(spark):
    ring = [e for k in range(40) for e in clique([f"t{k:02}{c}" for c in "abc"])] + [(f"t{k:02}a", f"t{(k + 1) % 40:02}b", 1) for k in range(40)]
    got = topics(spark, ring)
    assert max(map(len, got)) <= 40 and sum(map(len, got)) == 120 and got == topics(spark, ring[::-1])


def modularity(edges, group):
    degree, inside, total = Counter(), 0, 2 * sum(w for _, _, w in edges)
    for a, b, w in edges:
        degree[group[a]] += w
        degree[group[b]] += w
        inside += 2 * w * (group[a] == group[b])
    return inside / total - sum((d / total) ** 2 for d in degree.values())


def planted(parts, size, inner, outer, seed):
    rng = random.Random(seed)
    return [(i, j, rng.randint(1, 5)) for i in range(parts * size) for j in range(i + 1, parts * size) if rng.random() < (inner if i // size == j // size else outer)]


def test_communities_in_one_task_and_in_many(spark, seed=1):
    """The same planted communities whichever form does the work; modularity near that of the plant."""
    edges = planted(12, 30, 0.4, 0.01, seed)
    want = modularity(edges, {v: v // 30 for v in range(360)})
    frame = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "a long, b long, w double")
    for in_task in (T.IN_TASK, 3000):
        topic = {r.node: r.topic for r in T.communities(frame, 40, in_task).collect()}
        assert len(topic) == 360 and modularity(edges, topic) > 0.98 * want
        assert all(topic[t] == t and min(v for v in topic if topic[v] == t) == t for t in topic.values())


def test_communities_hang_together_and_split_while_they_can(spark):
    edges = planted(3, 100, 0.06, 0.002, 4)
    frame = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "a long, b long, w double")
    for in_task in (T.IN_TASK, 1200):
        topic = {r.node: r.topic for r in T.communities(frame, 40, in_task).collect()}
        near = defaultdict(set)
        for a, b, _ in edges:
            if topic[a] == topic[b]:
                near[a].add(b)
                near[b].add(a)
        for t in set(topic.values()):
            seen, todo = set(), [t]
            while todo:
                if (v := todo.pop()) not in seen:
                    seen.add(v)
                    todo += near[v]
            assert seen == {v for v in topic if topic[v] == t}
        assert max(Counter(topic.values()).values()) <= 40


def test_entities_and_facts(spark):
    m = spark.createDataFrame([("c1", 0, "Rust", "language", "a"), ("c1", 1, "rust", "tool", "b"), ("c2", 0, "rust", "tool", "a"), ("c2", 1, "Go", "tool", "")], "chunk_id string, pos long, name string, type string, description string")
    got = {r.key: r for r in knowledge.entities(m).collect()}
    assert got["rust"].name == "rust" and got["rust"].type == "tool" and got["rust"].mentions == 2 and got["rust"].descriptions == ["a", "b"]
    assert got["go"].descriptions == [] and got["rust"].text == "rust"
    items = [(f"c{k:02}", 0, f"m{k // 2}", f"2026-01-{k + 1:02}", "Rust", "We chose it." if k else "We chose it", "Go") for k in range(28)]
    f = knowledge.facts(spark.createDataFrame(items, "chunk_id string, pos long, message_id string, created_at string, subject string, statement string, object string")).first()
    assert f.said == 14 and f.statement == "We chose it." and len(f.sources) == 14 and f.first_said == "2026-01-01" and f.object == "Go"
    many = [(f"c{k:02}", 0, f"m{k}", f"2026-01-{k + 1:02}", "Rust", "Yes", "") for k in range(28)]
    f = knowledge.facts(spark.createDataFrame(many, "chunk_id string, pos long, message_id string, created_at string, subject string, statement string, object string")).first()
    assert len(f.sources) == 20 and f.sources[-1].message_id == "m27"


def test_answers_are_parsed(spark):
    answer = '{"passages":[{"passage":1,"entities":[{"name":"Maya","type":"Person"},{"name":"maya"},{"name":"Rust"}],"relationships":[{"source":"Maya","target":"rust","strength":99},{"source":"Maya","target":"Oslo"}],"facts":[{"subject":"maya","statement":"Maya chose  Rust."},{"subject":"Oslo","statement":"x"}]},{"passage":7}]}'
    got = knowledge.parse_answers(spark.createDataFrame([(answer, 2), ("not json", 2)], "answer string, count int")).collect()
    assert len(got) == 1 and [e.key for e in got[0].entities] == ["maya", "rust"] and got[0].entities[0].type == "person" and got[0].entities[1].type == "other"
    assert [(r.a, r.b, r.strength) for r in got[0].relationships] == [("maya", "rust", 10)] and [f.statement for f in got[0].facts] == ["Maya chose Rust."]


def test_caches(spark):
    cache = spark.createDataFrame([("m", "1", "h1"), ("m", "2", "h1"), ("m", "9", "h2"), ("m", "10", "h2"), ("o", "3", "h3")], "model string, prompt_version string, text_hash string")
    assert {r.text_hash: r.prompt_version for r in knowledge.latest_answers(cache, "m", "1").collect()} == {"h1": "1", "h2": "10"}
    assert knowledge.latest_answers(cache, "m", "1", earlier=False).count() == 1
    chunks = spark.createDataFrame([("b", "h3"), ("a", "h3"), ("c", "h1")], "id string, text_hash string")
    assert [(r.id, r.text_hash) for r in knowledge.pending(chunks, cache, "m", "1").collect()] == [("a", "h3")]
    asked = knowledge.ask(chunks, lambda texts: [t.upper() for t in texts], "text_hash").collect()
    assert {r.answer for r in asked} == {"H1", "H3"}
    filled = ask.embed(spark.createDataFrame([("one two",), ("one two",), ("three",)], "text string"), spark.createDataFrame([], "model string, text_hash string, vector array<float>"))
    assert filled.count() == 2 and ask.embed(spark.createDataFrame([("one two",)], "text string"), filled).count() == 2


def test_duplicate_candidates(spark):
    keys = ["postgre", "postgresql", "postgre database", "claude code", "claude code cli", "kyc", "know your customer", "my claude code", "react", "reaction", "database", "colour", "colours"]
    got = {(r.a, r.b) for r in knowledge.duplicate_candidates(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert {("postgre", "postgresql"), ("postgre", "postgre database"), ("claude code", "claude code cli"), ("claude code", "my claude code"), ("know your customer", "kyc"), ("colour", "colours")} <= got
    assert not {("database", "postgre database"), ("claude code", "react")} & got


@pytest.mark.parametrize("tile", (3, 2000))
def test_spelling_join_equals_all_pairs(spark, monkeypatch, tile):
    """Names of one block, compared pair by pair in plain Python."""
    monkeypatch.setattr(knowledge, "TILE", tile)
    rng = random.Random(tile)
    names = {"proj" + "".join(rng.choices("abcdeé ", [9, 7, 5, 3, 2, 1, 1], k=rng.randint(0, 14))).strip() for _ in range(160)} | {"abc", "", "post", "postgres", "postgras", "𝒳𝒳𝒳𝒳ab", "𝒳𝒳𝒳𝒳ba"}
    for name in sorted(names)[:60]:
        at = rng.randrange(4, len(name) + 1) if len(name) >= 4 else 0
        names.add(name[:at] + rng.choice("abz") + name[at + rng.randint(0, 1) :])
    frame = spark.createDataFrame([(n,) for n in names], "key string")
    long = sorted(n for n in names if len(n) >= 4)
    pairs = [(a, b) for k, a in enumerate(long) for b in long[k + 1 :] if a[:4] == b[:4]]
    bound = {(a, b) for a, b in pairs if 2 * sum((Counter(a) & Counter(b)).values()) >= 0.85 * (len(a) + len(b))}
    assert {(r.a, r.b) for r in knowledge.spelling_bounds(frame).collect()} == bound
    want = {(a, b) for a, b in pairs if b.startswith(a) or SequenceMatcher(None, a, b).ratio() >= 0.85}
    got = {(r.a, r.b) for r in knowledge.duplicate_candidates(frame).collect()}
    assert want <= got and got - want <= {(r.a, r.b) for r in knowledge.duplicate_blocks(frame).collect()}


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "Postgres indexing", "how do I index customer_id"), (2, "Trip", "a trip to Lisbon, café"), (3, "x", "id customer"), (4, None, None)], "doc_id long, title string, text string")
    weights = {"title": 2.0, "text": 1.0}
    assert [r.doc_id for r in textindex.search(docs, "customer_id", columns=weights).collect()] == [1]
    assert {r.doc_id for r in textindex.search(docs, "customer id", columns=weights).collect()} == {1, 3}
    assert [r.doc_id for r in textindex.search(docs, "CAFE trip", columns=weights).collect()] == [2]
    assert textindex.search(docs, "trip NOT", columns=weights).count() == 0 and textindex.search(docs, " - ").count() == 0
    assert ask.snippet_of("one " * 30 + "Café here", {"cafe"}) == "..." + "one " * 15 + "[Café]..."
    assert ask.snippet_of("short text", {"text"}) == "short [text]"


def test_vector_search(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0, 0.0], "A"), ("y", [0.0, 0.0, 1.0], "B"), ("z", [0.9, 0.1, 0.0], "A")], "node_id string, vector array<double>, label string")
    assert [r.node_id for r in vectorsearch.nearest(v, [1.0, 0.0, 0.0], "node_id", "vector", 2).collect()] == ["x", "z"]
    assert [r.node_id for r in vectorsearch.nearest(v, [1.0, 0.0, 0.0], "node_id", "vector", 1, F.col("label") == "B").collect()] == ["y"]
    with pytest.raises(ValueError):
        vectorsearch.nearest(v, [])
    with pytest.raises(Exception, match="components"):
        vectorsearch.check_dimension(v, 2, "vector").collect()


def test_fusion(spark):
    a = spark.createDataFrame([("m1", 1), ("m2", 2)], "message_id string, rank int")
    b = spark.createDataFrame([("m2", 1), ("m3", 2)], "message_id string, rank int")
    got = ask.fold_hybrid(a, b).collect()
    assert [r.message_id for r in got] == ["m2", "m1", "m3"] and got[0].by_words and got[0].by_meaning and not got[1].by_meaning


def test_question(spark):
    from gistmill.functions import ids

    names = spark.createDataFrame([("Claude Code",), ("Rust",), ("the",)], "name string")
    e = names.select("name", F.lower("name").alias("key"), ids.entity_id(F.lower("name")).alias("id"), F.lit("s").alias("summary"))
    got = ask.mentioned_entities(spark, "Is the claude-codes tool in rust?", e).orderBy("place").collect()
    assert [r.name for r in got] == ["Claude Code", "Rust"]
    mentions = spark.createDataFrame([(f"c{k}", "MENTIONS", got[k % 2].id) for k in range(10)], "src string, type string, dst string")
    chunks = spark.createDataFrame([(f"c{k}", f"m{k}", f"2026-01-0{k}") for k in range(10)], "id string, message_id string, created_at string")
    found = ask.retrieve(spark, "claude code and rust", e, mentions, chunks, limit=4).collect()
    assert [r.chunk_id for r in found] == ["c8", "c9", "c6", "c7"] and [r.number for r in found] == [1, 2, 3, 4]
    vectors = spark.createDataFrame([(f"c{k}", [float(k), 0.0]) for k in range(10)], "node_id string, vector array<double>")
    near = ask.retrieve(spark, "rust", e, mentions, chunks, vectors, [0.0, 0.0], limit=2).collect()
    assert near[0].chunk_id == "c1"
    row = spark.createDataFrame([("see [2], [9] and [1]",)], "a string").select(ask.cited(F.col("a"), F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("x")).first()
    assert row.x == [1, 2]
    facts = spark.createDataFrame([(got[0].id, 1, "f1", "claude code", "It is a tool", "2026-01-02")], "entity_id string, rank int, id string, subject_key string, statement string, last_said string")
    topics = spark.createDataFrame([("t1", "Tools", "About tools")], "id string, title string, summary string")
    inside = spark.createDataFrame([(got[0].id, "IN_TOPIC", "t1")], "src string, type string, dst string")
    notes = ask.notes(ask.mentioned_entities(spark, "claude code", e), facts, inside, topics).collect()
    assert [(n.kind, n.text) for n in notes] == [("entity", "s"), ("fact", "It is a tool (said 2026-01-02)"), ("topic", "About tools")]
    linked = ask.linked_mentions(spark.createDataFrame([("Rust `rust` and rusty Claude Code",)], "text string"), ["Rust", "Claude Code"]).first().found
    assert [x.name for x in linked] == ["Rust", "Claude Code"]


def test_explore(spark):
    conv = spark.createDataFrame([("v1", "a", "2026-01-05", None), ("v2", "b", "2026-02-05", None), ("v3", "a", None, None)], "id string, source string, created_at string, updated_at string")
    ent = spark.createDataFrame([("e1", "Maya", "person", 5), ("e2", "Rust", "tool", 3), ("e3", "Oslo", "place", 9)], "id string, name string, type string, mentions long")
    rel = spark.createDataFrame([("e1", "e2", 7), ("e3", "e1", 2)], "src string, dst string, weight long")
    counts = spark.createDataFrame([("e1", "v1", 4), ("e1", "v2", 1), ("e2", "v2", 2), ("e3", "v3", 1)], "entity_id string, conversation_id string, n long")
    topic = spark.createDataFrame([("e1", "t1"), ("e2", "t1")], "src string, dst string")
    view = explore.explore(ent, conv, rel, counts, topic, entity="e1")
    assert [r.entity_id for r in view["entities"].orderBy("place").collect()] == ["e1", "e2", "e3"]
    assert [r.conversation_id for r in view["conversations"].orderBy("place").collect()] == ["v1", "v2"]
    assert view["related"].count() == 2 and view["topics"].count() == 2
    view = explore.explore(ent, conv, rel, counts, topic, conversation="v2")
    assert [r.conversation_id for r in view["conversations"].orderBy("place").collect()] == ["v2", "v1"]
    assert view["conversations"].where("conversation_id = 'v1'").first().score == 3
    view = explore.explore(ent, conv, rel, counts, topic, admits=store.window("2026-02"))
    assert [r.entity_id for r in view["entities"].orderBy("place").collect()] == ["e2", "e1"]
    assert [r.entity_id for r in explore.explore(ent, conv, rel, counts, topic, topic="t1")["entities"].orderBy("place").collect()] == ["e1", "e2"]
    assert [(r.month, r.conversations) for r in explore.timeline(conv).collect()] == [("2026-01", 1), ("2026-02", 1)]
    assert [r.id for r in explore.suggest(ent, "o").collect()] == ["e3"]
    assert explore.top_topics(view["topics"]).first().n == 2


def test_sessions_and_limits(spark):
    t = "2026-01-01 10:{:02}:00"
    ev = spark.createDataFrame([(k, 1, t.format(m)) for k, m in enumerate((0, 10, 40, 59))] + [(9, 1, "2026-01-01 11:30:00"), (10, 2, t.format(0))], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r.user_id, r.n) for r in sessions.sessions(ev, by=("user_id",)).collect())
    assert got == [(1, 1), (1, 4), (2, 1)]
    runs = sessions.runs(spark.createDataFrame([("v", 0, "a"), ("v", 1, "a"), ("v", 2, None), ("v", 3, None), ("v", 4, "a")], "c string, p int, r string"), ["c"], ["p"], "r")
    assert [r.run for r in runs.orderBy("p").collect()] == [1, 1, 2, 2, 3]
    ok = {r.event_id: r.admitted for r in sessions.admitted(ev, per_hour=2).collect()}
    assert ok == {0: True, 1: True, 2: False, 3: False, 9: True, 10: True}
    w = knowledge.message_window(spark.createDataFrame([("v", k, "user", "x" * 10) for k in range(9)], "conversation_id string, position long, role string, text string"), spark.createDataFrame([("v", 4)], "conversation_id string, position long"), 35)
    assert sorted(r.position for r in w.collect()) == [3, 4, 5]


def test_requests(spark):
    chunks = spark.createDataFrame([("b", "two", 0), ("a", "one", 0), ("c", "three", 1)], "id string, text string, batch int")
    assert {r.batch: r.request for r in knowledge.passage_requests(chunks).collect()} == {0: "### Passage 1\none\n\n### Passage 2\ntwo", 1: "### Passage 1\nthree"}
    found = spark.createDataFrame([("e1", "a", "A", "tool", ["x", "y"], "s", 0), ("e2", "b", "B", "place", ["z"], "t", 0)], "id string, key string, name string, type string, descriptions array<string>, summary string, batch int")
    todo = knowledge.to_summarise(found, spark.createDataFrame([], "set_key string"))
    assert [r.name for r in todo.collect()] == ["A"] and knowledge.to_summarise(found, todo.select("set_key")).count() == 0
    assert knowledge.summary_requests(todo).first().request == "### Entity 1: A (tool)\n- x\n- y"
    pairs = spark.createDataFrame([("a", "b", 0)], "a string, b string, batch int")
    assert knowledge.pair_requests(pairs, found).first().request == "### Pair 1\n- A (tool): s\n- B (place): t"
    answers = spark.createDataFrame([('{"pairs": [{"pair": 1, "same": true}, {"pair": 3, "same": true}, {"pair": 2}]}', 2), ("no", 2)], "answer string, count int")
    assert [(r.number, r.value) for r in knowledge.parse_numbered(answers, "pairs", "pair", "same", "boolean").collect()] == [(1, True)]
    reports = spark.createDataFrame([('{"title": " T  t", "summary": "s", "findings": ["a", "", "b"]}',), ('{"title": "x"}',), ("[",)], "answer string")
    assert [(r.title, r.findings) for r in knowledge.parse_reports(reports).collect()] == [("T t", ["a", "b"])]
    sources, notes = spark.createDataFrame([(2, "b"), (1, "a")], "number int, text string"), spark.createDataFrame([("fact", 1, "K", "v")], "kind string, rank int, title string, text string")
    assert knowledge.answer_requests("Why?", sources, notes).first().request == "Question: Why?\n\n[1] a\n\n[2] b\n\n- K: v"


def test_report_lines(spark):
    members = spark.createDataFrame([("t", f"n{k:02}", "tool", "s", 1) for k in range(32)], "topic string, name string, type string, summary string, mentions long")
    links = spark.createDataFrame([("t", "a", "b", "d", 2), ("t", "a", "c", "d", 9)], "topic string, source string, target string, description string, weight long")
    got = [r.line for r in explore.report_lines(members, links).orderBy("kind", "rank").collect()]
    assert got[0] == "- n00 (tool): s" and got[30] == "- and 2 more" and got[31] == "- a -> c: d" and len(got) == 33


def shapes():
    rng = np.random.default_rng(11)
    path = [(k, k + 1) for k in range(2000)]
    return {
        "path": path,
        "ring": [*path, (0, 2000)],
        "star": [(0, k) for k in range(1, 2000)],
        "caterpillar": [*path[:700], *[(k, 10_000 + k) for k in range(700)]],
        "pieces": [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2000, 2))],
    }


@pytest.mark.parametrize("shape", sorted(shapes()))
@pytest.mark.parametrize("in_task", [100_000, 50])
def test_components_of_shapes_take_few_rounds(spark, monkeypatch, shape, in_task):
    edges = shapes()[shape]
    cuts = []
    monkeypatch.setattr(graph, "durable", lambda df: cuts.append(1) or durable(df))
    got = {r.id: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), in_task).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {x: k for k, x in enumerate(nodes)}
    root = list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = sorted((find(place[a]), find(place[b])))
            root[y] = x
    assert got == {x: nodes[find(place[x])] for x in nodes}
    # one cut for the edges, one for what a task settles, and in each round three and one on the way back
    assert len(cuts) <= (2 if in_task > 50 else 4 + 4 * 8)


def test_local_roots_of_a_long_path():
    i = np.arange(99_999)
    assert (graph.local_roots(100_000, i, i + 1) == 0).all() and (graph.local_roots(100_000, i[::-1] + 1, i[::-1]) == 0).all()


def window_brute(sizes, at, budget):
    low = high = at
    used, open_, side = sizes[at], {1, -1}, 1
    while open_:
        if side in open_:
            k = high + 1 if side == 1 else low - 1
            if not 0 <= k < len(sizes) or used + sizes[k] > budget:
                open_.discard(side)
            else:
                used, low, high = used + sizes[k], min(low, k), max(high, k)
        side = -side
    return list(range(low, high + 1))


def test_message_windows_equal_brute_force(spark):
    rng = random.Random(8)
    sizes = {f"c{c}": [rng.choice((0, 1, 5, 9, 30)) for _ in range(rng.randint(1, 25))] for c in range(120)}
    at = {c: rng.randrange(len(s)) for c, s in sizes.items()}
    rows = spark.createDataFrame([(c, 3 * k, "user", "x" * n if n else None) for c, s in sizes.items() for k, n in enumerate(s)], "conversation_id string, position long, role string, text string")
    centers = spark.createDataFrame([(c, 3 * k) for c, k in at.items()] + [("none", 1), ("c1", 1000)][:1], "conversation_id string, position long")
    for budget in (0, 20, 60):
        got = defaultdict(list)
        for r in knowledge.message_window(rows, centers, budget).collect():
            got[r.conversation_id].append(r.position // 3)
        assert {c: sorted(p) for c, p in got.items()} == {c: window_brute(s, at[c], budget) for c, s in sizes.items()}


def test_rows_are_numbered_over_all_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("a"), F.col("id").alias("b")).repartition(7)
    got = [(r.a, r.b, r.place) for r in numbered(rows, [F.col("a").desc(), "b"], "place").collect()]
    want = sorted(((i % 700, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert sorted(got, key=lambda r: r[2]) == [(a, b, k) for k, (a, b) in enumerate(want, 1)]
    assert numbered(rows.limit(0), ["a", "b"]).count() == 0
