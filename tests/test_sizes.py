"""Queries on tables that the smallest ones do not have: keys of seven digits, references without an end."""

import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmill import registry
from gistmill.functions import markup, text
from gistmill.operators import ask, graph, sessions, topics
from gistmill.operators.topics import find_topics, topics_small
from gistmill.plans import queries
from gistmill.sources import chats, documents


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives the rows of its SQL over tables given as {name: SQL}."""

    def run(query: str, **tables: str) -> bool:
        con = duckdb.connect()
        for name, sql in tables.items():
            con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet'")
            con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
        df = registry.queries()[query](spark, str(tmp_path))
        wanted = con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[query]})").fetchall()
        return bool(wanted) and sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in df.collect())

    return run


def test_keys_of_seven_digits_are_contracted_as_in_sql(same):
    assert same("graph_contraction", lineitem="select i // 7 as l_orderkey, 999950 + i * 37 % 149 as l_partkey from range(700) t(i)")


def test_references_without_an_end_stay_where_asked(spark, same):
    page = "<title>a &amp b &copy; &amp</title><p>x &amp; &middot; &amp"
    assert same("html_to_text", pages=f"select 1::BIGINT as page_id, '{page}' as html")
    got = spark.range(1).select(markup.html_page(F.lit("<p>&#65; &#65 &nosuch; &lt;&lt")).alias("p"), markup.html_page(F.lit("<p>&#65; &#65 &nosuch; &lt;&lt"), closed=True).alias("c")).first()
    assert got.p.text == "A A &nosuch; <<" and got.c.text == "A &#65 &nosuch; <&lt"


def test_parts_of_a_large_graph_are_scopes(spark):
    """Forty rings of cliques: the parts are settled one by one, and one that stays whole by the weight of all is split by its own."""
    clique = [(5 * k + i, 5 * k + j) for k in range(12) for i in range(5) for j in range(i)]
    ring = clique + [(5 * k, (5 * k + 5) % 60) for k in range(12)]
    links = spark.createDataFrame([(f"p{1000 * c + a}", f"p{1000 * c + b}", 1) for c in range(40) for a, b in ring], "source string, target string, weight long")
    every = links.select(F.col("source").alias("id")).union(links.select("target")).distinct()
    none = spark.createDataFrame([], "a string, b string")
    groups = [{tuple(r.members) for r in find_topics(every, links, none, max_size=10, in_task=n).collect()} for n in (10_000_000, 300)]
    for found in groups:
        assert sorted(x for m in found for x in m) == sorted(r.id for r in every.collect()) and max(map(len, found)) <= 10
        assert all(len({int(x[1:]) // 1000 for x in m}) == 1 for m in found)
    assert groups[0] == groups[1]


def test_a_part_that_stays_whole_is_split_by_its_own_weight():
    a, b = (np.array(x) for x in zip(*[(5 * k + i, 5 * k + j) for k in range(12) for i in range(5) for j in range(5) if i != j], *[(5 * k, 5 * k + 5) for k in range(11)], *[(5 * k + 5, 5 * k) for k in range(11)], strict=True))
    order = np.lexsort((b, a))
    found = topics_small(60, a[order], b[order], np.ones(len(a)), 1e6, 10)
    assert np.unique(found, return_counts=True)[1].max() <= 10


def test_links_to_few_communities_are_added_up_without_a_sort(monkeypatch):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 400, 6000), rng.integers(0, 400, 6000)
    a, b = np.r_[a, b][np.r_[a != b, a != b]], np.r_[b, a][np.r_[a != b, a != b]]
    group, w, movers = np.arange(400) % 9 * 11, rng.integers(1, 5, len(a)).astype(float), rng.random(400) < 0.5
    monkeypatch.setattr(topics, "CELLS", 0)
    sorted_ones, settled = topics._near(movers, group, a, b, w), topics.settle(group, a, b, w, np.bincount(a, w, 400), w.sum())
    monkeypatch.setattr(topics, "CELLS", 4)
    monkeypatch.setattr(topics, "_links", None)
    assert (settled == topics.settle(group, a, b, w, np.bincount(a, w, 400), w.sum())).all() and len(np.unique(settled)) > 1
    assert all((x == y).all() for x, y in zip(sorted_ones, topics._near(movers, group, a, b, w), strict=True))


def test_large_scopes_are_dealt_to_many_tasks(spark):
    sizes = spark.createDataFrame([(s, 1000 if s < 60 else 3) for s in range(500)], "scope long, n long")
    assert topics.settle_tasks(sizes, 3000) == 480 and topics.settle_tasks(sizes, 30_000) == 4
    assert sizes.repartition(480, "scope").where("n = 1000").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 3


def test_lines_without_a_part_link_nothing(spark, tmp_path):
    lines = [(o, p) for o in range(3) for p in (10, 12, 14, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in registry.queries()["topics_communities"](spark, str(tmp_path)).collect()] == [("p000010", 3)]


def test_no_window_over_all_events(spark, monkeypatch):
    """Sessions that run over many spans and blocks of time, by key and over all, with each task's sort no larger than a block."""
    monkeypatch.setattr(sessions, "BLOCK", 3)
    steps = [0, 5, 30, 31, 30, 30, 29, 30, 30, 30, 30, 1, 400, 30, 30, 45, 10, 2000, 30, 30, 30, 30, 30]
    at = [1_767_225_600 + 60 * sum(steps[: k + 1]) for k in range(len(steps))]
    events = spark.createDataFrame([(u, t) for u in (1, None) for t in at], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    wanted, low, n = [], at[0], 0
    for t, after in zip(at, [*at[1:], None], strict=True):
        n += 1
        if after is None or after - t > 1800:
            wanted.append((low, t, n))
            low, n = after, 0
    cut = [F.unix_seconds("started").alias("a"), F.unix_seconds("ended").alias("b"), "n"]
    assert sorted(tuple(r) for r in sessions.sessions(events).select(*cut).collect()) == [(a, b, 2 * n) for a, b, n in wanted]
    assert sorted(tuple(r) for r in sessions.sessions(events, by=("user_id",)).where("user_id is null").select(*cut).collect()) == wanted
    plan = sessions.sessions(events)._jdf.queryExecution().optimizedPlan().toString()
    assert "session_window" not in plan and "MergingSessions" not in plan
    record = F.to_json(F.struct(F.lit("Gemini Apps").alias("header"), F.concat(F.lit("Prompted q"), F.unix_seconds("ts").cast("string")).alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")))
    found = chats.gemini_records(events.where("user_id = 1").select(F.lit("f").alias("path"), F.unix_seconds("ts").alias("index"), record.alias("record")))
    told = [r for r in found.messages.orderBy("created_at").collect()]
    assert [r.position for r in told] == [k for _, _, n in wanted for k in range(n)]
    assert [r.parent_id for r in told] == [None if r.position == 0 else p.id for r, p in zip(told, [None, *told], strict=False)]
    assert sorted(r.message_count for r in found.conversations.collect()) == sorted(n for _, _, n in wanted)


def test_small_documents_leave_python_in_groups():
    names = [f"{k}.json" for k in range(1300)]
    files = pa.RecordBatch.from_pydict({"path": names, "relative": names, "content": [b"{" if k == 7 else b'{"a": %d}' % k for k in range(1300)]})
    got = list(documents.raw_batches(iter([files])))
    rows = [r for b in got for r in b.to_pylist()]
    assert len(got) == 3 and [r["relative"] for r in rows] == names
    assert rows[7]["reason"].startswith("it could not be read") and [r["raw"] for r in rows if not r["reason"]] == [[f"a: {k}"] for k in range(1300) if k != 7]


def test_folded_words_are_not_held_as_lists(spark):
    texts = pd.Series(["ab cé " * 2000] * 200)
    tracemalloc.start()
    text.folded_line.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * texts.str.len().sum()
    rows = spark.createDataFrame([(" Ὀδός  straße_x ",), (None,), ("_",), ("A b",)], "t string").select(text.fold_words(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [["οδοσ", "strasse", "x"], [], [], ["a", "b"]]


def test_each_word_is_hashed_once():
    ask._slot.cache_clear()
    assert ask.embed_text("one two one one") == ask.embed_text("one one two one") and ask._slot.cache_info().misses == 2


def test_weights_kept_from_round_to_round_settle_alike(monkeypatch):
    """The table of nodes and communities is brought up to date by the nodes that moved, and gives the rounds of the sums made anew."""
    rng = np.random.default_rng(3)
    i, j = np.unique(np.sort(rng.integers(0, 300, (9000, 2)), axis=1), axis=0).T
    i, j, w = *(x[i != j] for x in (i, j)), rng.integers(1, 4, len(i)).astype(float)[i != j]
    a, b, w = np.r_[i, j], np.r_[j, i], np.r_[w, w]
    order = np.argsort(a * 300 + b)
    a, b, w, moves = a[order], b[order], w[order], []
    move = topics._Table.move
    monkeypatch.setattr(topics._Table, "move", lambda table, movers: moves.append(1) or move(table, movers))
    found = []
    for cells in (0, 4, 1000):
        monkeypatch.setattr(topics, "CELLS", cells)
        found.append(topics.settle(np.arange(300), a, b, w, np.bincount(a, w, 300), w.sum()))
        assert bool(moves) == bool(cells)
    assert all((x == found[0]).all() for x in found) and 1 < len(np.unique(found[0])) < 150


def test_links_sum_alike_whatever_the_size_of_keys():
    a, c, w = np.array([3, 1, 3, 1]), np.array([5, 2, 5, 9]), np.array([1.0, 2, 4, 8])
    for far in (1, 2**28):
        got = topics._links(a * far, c * far, w)
        assert [list(x) for x in got] == [[far, far, 3 * far], [2 * far, 9 * far, 5 * far], [2, 8, 5]]


def test_trees_keep_the_components_of_many_links(spark):
    links = [(1000 * c + i, 1000 * c + j) for c in range(4) for i in range(30) for j in range(i)]
    edges = spark.createDataFrame(links, "a long, b long").repartition(3)
    trees = graph.forest(edges, 400)
    assert trees.count() * 2 < len(links)
    roots = {r.id: r.root for r in graph.connected_components(trees).collect()}
    assert roots == {1000 * c + i: 1000 * c for c in range(4) for i in range(30)}
    path = spark.createDataFrame([(k, k + 1) for k in range(1000)], "a long, b long")
    assert {r.root for r in graph.connected_components(graph.forest(path, 50), 50).collect()} == {0}


def test_links_of_topics_carry_keys(spark, tmp_path, monkeypatch):
    """Links are stored and settled by keys; only members get names, and a topic is named by the least of them."""
    lines = [(o, p) for o in range(2) for p in (999_998, 999_999, 1_000_000)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept, keep = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df: kept.append(df.dtypes) or keep(df))
    assert [tuple(r) for r in registry.queries()["topics_communities"](spark, str(tmp_path)).collect()] == [("p1000000", 3)]
    assert kept == [[("a", "bigint"), ("b", "bigint"), ("weight", "bigint")]]
    assert [tuple(r) for r in registry.queries()["topics_hold"](spark, str(tmp_path)).collect()] == [(0, 0, 0, 0)]


def test_whole_weights_are_sorted_in_one_number():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 500, 8000), rng.integers(0, 500, 8000)
    group, movers = rng.integers(0, 500, 500), rng.random(500) < 0.5
    for most in (2, 2**30):
        w = rng.integers(1, most, len(a)).astype(float)
        got, wanted = topics._near_whole(movers, group, a, b, w), topics._near(movers, group, a, b, w)
        assert all((x == y).all() for x, y in zip(got, wanted, strict=True))
    assert topics._near_whole(movers, group, a, b, w * 2.0**22) is None
    assert [len(x) for x in topics._near_whole(np.zeros(500, bool), group, a, b, w)] == [0, 0, 0]


def test_close_numbers_are_placed_as_far_ones():
    a, b = np.array([7, -3, 9]), np.array([9, 7, 0])
    for far in (1, 10**6):
        names, i, j = graph.numbered_ends(a * far, b * far)
        assert list(names) == [-3 * far, 0, 7 * far, 9 * far] and list(i) == [2, 0, 3] and list(j) == [3, 2, 1]
