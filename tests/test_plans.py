"""How often plans read their inputs, and what they hold at once."""

from gistmill.operators import knowledge, textindex
from gistmill.plans import adapt
from gistmill.sources import archive

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entities_and_relationships_read_their_items_once(spark):
    items = adapt.relation_items(spark, SMALL)
    found = plan(knowledge.relationships(items))
    assert found.count("FileScan parquet") == 1 and "Window" not in found
    # the names' count is a checkpoint; only the number of chunks reads the mentions
    assert plan(knowledge.entities(adapt.mention_items(spark, SMALL))).count("FileScan parquet") == 1


def test_each_name_meets_the_next(spark, tmp_path):
    rows = [(1, "Alpha and Betas, Gamma", "s"), (2, "Alone here", "s"), (3, None, None), (4, "Alpha Alpha", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = adapt.relation_items(spark, str(tmp_path)).orderBy("chunk_id", "pos").collect()
    assert [(r.chunk_id[-1], r.pos, r.source, r.target, r.description) for r in found] == [("1", 0, "Alpha", "Betas", "seen in s"), ("1", 1, "Betas", "Gamma", "seen in s"), ("4", 0, "Alpha", "Alpha", None)]


def test_the_index_is_read_once_for_hits_and_statistics(spark):
    docs = adapt.table(spark, SMALL, "documents").select("doc_id", "text")
    assert "FileScan parquet" not in plan(textindex.search_postings(textindex.postings(docs), textindex.doc_stats(docs), "of_the"))


def test_a_restored_graph_is_joined_from_files(spark):
    n, e = adapt.nodes(spark, SMALL), adapt.edges(spark, SMALL).select("src", "type", "dst")
    found = archive.restore(n.where("label = 'Conversation'"), e.limit(0), n.where("label = 'Message'"), e)[1]
    assert found.count() == e.count()
    assert "Window" not in plan(archive.restore(n.limit(0), e.where("false"), n, e)[1])
