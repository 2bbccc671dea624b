"""Queries of the store, the archive, the graph of entities and the views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gistmill.functions import ids
from gistmill.functions import text as X
from gistmill.operators import ask, explore, knowledge, store, textindex
from gistmill.plans.adapt import edges, mention_items, messages, nodes, relation_items, table
from gistmill.plans.queries import EDGES, ENT, KEY, MENTIONS, MESSAGES, ORACLES, TOKENS, bm25_sql, query
from gistmill.sources import archive
from gistmill.streaming import flows

# store (K*, J*, P*, S35-S37)


@query(f"SELECT src, type, dst FROM {EDGES}")
def upsert_edges(spark, sf_dir):
    e = edges(spark, sf_dir).select("src", "type", "dst")
    old, new = e.where("type = 'HAS_MESSAGE'"), e.where("type = 'REPLIES_TO' or src < 'conv_8'")
    return store.upsert_edges(old, new, nodes(spark, sf_dir))


def _last(rows: DataFrame) -> DataFrame:
    return rows.withColumn("last", F.max("turn").over(W.partitionBy("conv_id")) == F.col("turn"))


@query(f"""WITH m AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM {MESSAGES}), gone AS (SELECT id FROM m WHERE last AND position > 0 AND conv_id % 2 = 0)
SELECT type, count(*)::BIGINT AS n, count(DISTINCT src)::BIGINT AS sources FROM {EDGES} WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY type
UNION ALL SELECT label, count(*)::BIGINT, count(DISTINCT conversation_id)::BIGINT FROM (SELECT 'Message' AS label, conversation_id FROM m WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT DISTINCT 'Conversation', conversation_id FROM m) GROUP BY label""")
def conversations_again(spark, sf_dir):
    """Every second conversation comes anew without its last turn."""
    m = _last(messages(spark, sf_dir)).where("conv_id % 2 = 0 and not last").select("id", F.lit("Message").alias("label"), "text", "conversation_id")
    n = nodes(spark, sf_dir).withColumn("message_id", F.lit(None).cast("string"))
    conv = n.where("label = 'Conversation'").join(m.select(F.col("conversation_id").alias("id")).distinct(), "id", "left_semi")
    e = edges(spark, sf_dir).select("src", "type", "dst")
    fresh = store.with_both_ends(e, m.select("id").unionByName(conv.select("id")))
    after = store.upsert_conversations({"nodes": n, "edges": e, "embeddings": n.select(F.col("id").alias("node_id"))}, conv, m, fresh)
    by_label = after["nodes"].withColumn("c", F.coalesce("conversation_id", "id")).groupBy(F.col("label").alias("type")).agg(F.count("*").alias("n"), F.countDistinct("c").alias("sources"))
    return after["edges"].groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources")).unionByName(by_label)


@query(f"SELECT id, conversation_id, (SELECT count(*) FROM {EDGES} e WHERE e.dst = m.id)::BIGINT AS links FROM {MESSAGES} m WHERE conv_id <> (SELECT min(conv_id) FROM conversations)")
def delete_conversation(spark, sf_dir):
    first = messages(spark, sf_dir).orderBy("conv_id").limit(1).first().conversation_id
    n = nodes(spark, sf_dir)
    left = store.delete_conversation({"nodes": n, "edges": edges(spark, sf_dir), "embeddings": n.select(F.col("id").alias("node_id"))}, first)
    links = left["edges"].groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("links"))
    return left["nodes"].where("label = 'Message'").join(links, "id", "left").select("id", "conversation_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query("SELECT vec_id AS node_id, CASE WHEN label = 3 THEN 0.5 ELSE round(embedding[1]::DOUBLE, 5) END AS first FROM embeddings")
def set_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    old = e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    width = e.select(F.size("embedding").alias("n")).first().n
    new = e.where("label = 3").select(F.col("vec_id").alias("node_id"), F.array_repeat(F.lit(0.5).cast("float"), width).alias("vector"))
    return store.set_embeddings(old, new, e.select(F.col("vec_id").alias("id")), width).select("node_id", F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"))


@query(f"WITH gone AS (SELECT id FROM {MESSAGES} WHERE turn % 4 = 1) SELECT src, type, dst FROM {EDGES} WHERE src IN (SELECT id FROM gone) OR dst IN (SELECT id FROM gone)")
def edges_without_ends(spark, sf_dir):
    n = nodes(spark, sf_dir).join(messages(spark, sf_dir).where("turn % 4 = 1").select("id"), "id", "left_anti")
    return store.missing_ends(edges(spark, sf_dir).select("src", "type", "dst"), n)


@query(f"SELECT id, text FROM {MESSAGES} WHERE conversation_id = (SELECT min(conversation_id) FROM {MESSAGES}) ORDER BY id LIMIT 3")
def find_nodes(spark, sf_dir):
    n = nodes(spark, sf_dir)
    low = n.where("label = 'Message'").agg(F.min("conversation_id").alias("c")).first().c
    return store.find_nodes(n, "Message", {"conversation_id": low}, 3).select("id", "text")


@query(f"SELECT id, length(text)::BIGINT AS n FROM {MESSAGES} WHERE turn % 2 = 1")
def get_nodes(spark, sf_dir):
    asked = messages(spark, sf_dir).where("turn % 2 = 1").select("id")
    return store.get_nodes(nodes(spark, sf_dir), asked.unionByName(asked).unionByName(spark.createDataFrame([("none",)], "id string"))).select("id", F.length("text").cast("long").alias("n"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS created_at FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id, event_type HAVING strftime(min(ts), '%Y-%m') >= '2024-01' AND strftime(min(ts), '%Y-%m-%d') <= '2024-01-03'")
def time_and_source_window(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("source")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("created_at")).withColumn("updated_at", F.lit(None).cast("string"))
    return c.where(store.window("2024-01", "2024-01-03", ["click", "error"])).select("user_id", "created_at")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_copy_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return store.last_wins(e.withColumn("at", F.col("event_id")), ["user_id"], "at").select("user_id", "event_id", "value")


# archive (K14-K17, W14, U7)

_CHUNKS = "(SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, 'Chunk' AS label FROM documents)"
_MENTION_EDGES = f"(SELECT DISTINCT chunk_id AS src, 'MENTIONS' AS type, {ENT.format(KEY.format('name'))} AS dst FROM {MENTIONS})"


def _mentions(spark, sf_dir) -> DataFrame:
    return knowledge.mention_edges(mention_items(spark, sf_dir))


def _chunks(spark, sf_dir) -> DataFrame:
    """Chunks: the documents, each in the conversation of its source."""
    d = table(spark, sf_dir, "documents")
    chunk = F.format_string("%012d", "doc_id")
    return d.select(chunk.alias("id"), F.lit("Chunk").alias("label"), F.col("source").alias("conversation_id"), chunk.alias("message_id"), F.format_string("2024-01-%02d", F.col("doc_id") % 28 + 1).alias("created_at"), "text")


@query(f"SELECT src, type, dst FROM {_MENTION_EDGES}")
def mention_edges(spark, sf_dir):
    return _mentions(spark, sf_dir)


@query(f"SELECT type, count(*)::BIGINT AS n FROM {_MENTION_EDGES} GROUP BY type UNION ALL SELECT label, count(*)::BIGINT FROM {_CHUNKS} GROUP BY label")
def archived_graph(spark, sf_dir):
    """What an archive holds of messages and chunks: the chunks, and each edge that touches one, once."""
    n = nodes(spark, sf_dir).select("id", "label").unionByName(_chunks(spark, sf_dir).select("id", "label"))
    e = edges(spark, sf_dir).select("src", "type", "dst").unionByName(_mentions(spark, sf_dir))
    own, touched = archive.derived_graph(n, e.unionByName(e.where("type = 'MENTIONS'")))
    return touched.groupBy("type").agg(F.count("*").alias("n")).unionByName(own.groupBy(F.col("label").alias("type")).agg(F.count("*").alias("n")))


@query(f"SELECT src, type, dst FROM {EDGES} WHERE dst IN (SELECT id FROM {MESSAGES} WHERE turn % 3 <> 2) AND (src LIKE 'conv%' OR src IN (SELECT id FROM {MESSAGES} WHERE turn % 3 <> 2))")
def restored_graph(spark, sf_dir):
    """An archive whose edges have ends in neither graph, restored onto the conversations."""
    n = nodes(spark, sf_dir)
    kept = messages(spark, sf_dir).where("turn % 3 <> 2").select("id")
    e = edges(spark, sf_dir).select("src", "type", "dst")
    return archive.restore(n.where("label = 'Conversation'"), e.limit(0), n.join(kept, "id", "left_semi"), e)[1]


@query("SELECT event_type, user_id, CASE WHEN min(event_id) FILTER (user_id % 2 = 0) IS NOT NULL THEN 'kept' ELSE 'archived' END AS answer FROM events GROUP BY event_type, user_id")
def merged_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    return archive.merge_cache(e.where("user_id % 2 = 0").withColumn("answer", F.lit("kept")), e.withColumn("answer", F.lit("archived")), ["event_type", "user_id"])


@query("""WITH c AS (SELECT conv_id, 'conv' || lpad(conv_id::VARCHAR, 8, '0') AS id, '2024-01-02 T' || conv_id % 7 || '- x' AS stem FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT id, CASE WHEN row_number() OVER (PARTITION BY stem ORDER BY id) = 1 THEN stem ELSE stem || ' ' || id[-8:] END || '.md' AS name FROM c""")
def markdown_names(spark, sf_dir):
    """Notes of conversations of seven titles: the second of a name gets the end of its id."""
    m = table(spark, sf_dir, "conversations")
    key = F.format_string("conv%08d", "conv_id")
    conv = m.select("conv_id").distinct().select(key.alias("id"), F.lit("s").alias("source"), F.concat(F.lit("T"), (F.col("conv_id") % 7).cast("string"), F.lit(": x. ")).alias("title"), F.lit("2024-01-02T10:00:00").alias("created_at"), F.lit(None).cast("string").alias("updated_at"))
    branch = m.select(key.alias("conversation_id"), "role", "text", F.col("turn").alias("branch_position"))
    return archive.markdown(conv, branch).select(F.regexp_extract("body", "\nid: (conv[0-9]+)", 1).alias("id"), "name")


# entities, facts and topics (A12-A22, J5-J14, O6-O15, E*)

_COUNTS = f"(SELECT {ENT.format(KEY.format('name'))} AS entity_id, source AS conversation_id, count(DISTINCT chunk_id)::BIGINT AS n FROM {MENTIONS} GROUP BY 1, 2)"
_ENTITIES = f"({ORACLES['entity_graph_build']})"
_RELATED = f"({ORACLES['relation_weights']})"


@query(f"SELECT entity_id, conversation_id, n FROM {_COUNTS} WHERE conversation_id IS NOT NULL")
def mention_counts(spark, sf_dir):
    return explore.mention_counts(_mentions(spark, sf_dir), _chunks(spark, sf_dir))


@query(f"SELECT e.id, e.name, sum(n)::BIGINT AS mentions FROM {_COUNTS} c JOIN {_ENTITIES} e ON e.id = c.entity_id WHERE conversation_id = 'src1' GROUP BY 1, 2")
def entities_of_a_conversation(spark, sf_dir):
    e = knowledge.entities(mention_items(spark, sf_dir))
    return explore.conversation_entities(e, _mentions(spark, sf_dir), _chunks(spark, sf_dir), "src1").select("id", "name", "mentions")


_TOP = f"(SELECT id FROM {_ENTITIES} ORDER BY mentions DESC, id LIMIT 1)"


def _top(e: DataFrame) -> str:
    return e.orderBy(F.col("mentions").desc(), "id").limit(1).first().id


@query(f"SELECT r.src, r.dst, r.weight, e.name FROM {_RELATED} r, {_TOP} t JOIN {_ENTITIES} e ON e.id = CASE WHEN r.src = t.id THEN r.dst ELSE r.src END WHERE r.src = t.id OR r.dst = t.id ORDER BY r.weight DESC, r.dst, r.src LIMIT 20")
def strongest_relations(spark, sf_dir):
    e = knowledge.entities(mention_items(spark, sf_dir))
    return explore.related_entities(knowledge.relationships(relation_items(spark, sf_dir)), e, _top(e)).select("src", "dst", "weight", "name")


@query(f"SELECT id, name, mentions FROM {_ENTITIES} WHERE contains(lower(name), 'an') ORDER BY starts_with(lower(name), 'an') DESC, mentions DESC, id LIMIT 6")
def suggested_entities(spark, sf_dir):
    return explore.suggest(knowledge.entities(mention_items(spark, sf_dir)), "An").select("id", "name", "mentions")


def _view(spark, sf_dir, **focus) -> dict[str, DataFrame]:
    e = knowledge.entities(mention_items(spark, sf_dir))
    counts = explore.mention_counts(_mentions(spark, sf_dir), _chunks(spark, sf_dir))
    conv = counts.select(F.col("conversation_id").alias("id")).distinct().select("id", F.col("id").alias("source"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("updated_at"))
    if "entity" in focus:
        focus = {"entity": _top(e)}
    topics = e.select(F.col("id").alias("src"), F.concat(F.lit("t"), F.substring("key", 1, 1)).alias("dst"))
    return explore.explore(e, conv, knowledge.relationships(relation_items(spark, sf_dir)).select("src", "dst", "weight"), counts, topics, **focus)


@query(f"""WITH c AS (SELECT id, row_number() OVER (ORDER BY mentions DESC, id) AS place FROM {_ENTITIES} QUALIFY place <= 150), w AS (SELECT c.id, c.place, sum(n) AS w FROM c JOIN {_COUNTS} m ON m.entity_id = c.id GROUP BY 1, 2)
SELECT id AS entity_id, row_number() OVER (ORDER BY w DESC, place)::INT AS place FROM w QUALIFY place <= 40""")
def explore_overview(spark, sf_dir):
    return _view(spark, sf_dir)["entities"].select("entity_id", "place")


@query(f"""WITH t AS {_TOP}, c AS (SELECT id AS entity_id, 0 AS place FROM t UNION ALL
SELECT x, row_number() OVER (ORDER BY o, x) FROM (SELECT CASE WHEN r.src = t.id THEN r.dst ELSE r.src END AS x, min(struct_pack(a := -weight, b := r.dst, c := r.src)) AS o FROM {_RELATED} r, t WHERE r.src = t.id OR r.dst = t.id GROUP BY 1))
SELECT entity_id, row_number() OVER (ORDER BY place)::INT AS place FROM c QUALIFY row_number() OVER (ORDER BY place) <= 40""")
def explore_entity(spark, sf_dir):
    return _view(spark, sf_dir, entity="")["entities"].select("entity_id", "place")


@query(f"SELECT id AS entity_id, row_number() OVER (ORDER BY mentions DESC, id)::INT AS place FROM {_ENTITIES} WHERE key[1] = 'a' QUALIFY row_number() OVER (ORDER BY mentions DESC, id) <= 40")
def explore_topic(spark, sf_dir):
    return _view(spark, sf_dir, topic="ta")["entities"].select("entity_id", "place")


@query(f"SELECT 't' || key[1] AS topic_id, count(*)::BIGINT AS n FROM (SELECT key FROM {_ENTITIES} ORDER BY mentions DESC, id LIMIT 40) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def topics_in_view(spark, sf_dir):
    e = knowledge.entities(mention_items(spark, sf_dir)).orderBy(F.col("mentions").desc(), "id").limit(40)
    return explore.top_topics(e.select(F.concat(F.lit("t"), F.substring("key", 1, 1)).alias("topic_id")))


@query(f"""WITH m AS (SELECT key[1] AS topic, name, mentions, row_number() OVER (PARTITION BY key[1] ORDER BY mentions DESC, name) AS r FROM {_ENTITIES})
SELECT topic, 'entity' AS kind, r::INT AS rank, '- ' || name || ' (other): s' AS line FROM m WHERE r <= 30 UNION ALL SELECT topic, 'entity', 31, '- and ' || (max(r) - 30) || ' more' FROM m GROUP BY topic HAVING max(r) > 30""")
def topic_report_lines(spark, sf_dir):
    e = knowledge.entities(mention_items(spark, sf_dir)).select(F.substring("key", 1, 1).alias("topic"), "name", "type", "mentions", F.lit("s").alias("summary"))
    none = spark.createDataFrame([], "topic string, source string, target string, description string, weight long")
    return explore.report_lines(e, none)


@query("SELECT user_id, 'topic_' || substr(sha256(sha256('[' || string_agg('\"' || k || '\"', ',' ORDER BY k) || ']')), 1, 24) AS id FROM (SELECT DISTINCT user_id, event_type AS k FROM events) GROUP BY user_id")
def topic_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("keys"))
    return e.select("user_id", ids.topic_id(ids.keys_hash("keys")).alias("id"))


def _facts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    items = e.select(F.format_string("%012d", "event_id").alias("chunk_id"), F.lit(0).cast("long").alias("pos"), F.col("event_id").cast("string").alias("message_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), F.col("user_id").cast("string").alias("subject"), F.concat(F.col("event_type"), F.lit(" .")).alias("statement"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("to"), F.col("event_type"))).alias("object"))
    return knowledge.facts(items)


_FACT = "(SELECT 'fact_' || substr(sha256(user_id || chr(31) || event_type), 1, 24) AS id, user_id, event_type, count(*)::BIGINT AS said, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_said FROM events GROUP BY 2, 3)"


@query(f"SELECT user_id::VARCHAR AS subject_key, event_type AS statement_key, least(said, 20)::BIGINT AS kept, said, last_said FROM {_FACT}")
def latest_fact_sources(spark, sf_dir):
    return _facts(spark, sf_dir).select("subject_key", "statement_key", F.size("sources").cast("long").alias("kept"), "said", F.greatest("last_said", F.element_at("sources", -1)["created_at"]).alias("last_said"))


@query(f"SELECT {ENT.format('user_id::VARCHAR')} AS entity_id, id, row_number() OVER (PARTITION BY user_id ORDER BY last_said DESC, id)::INT AS rank FROM {_FACT} QUALIFY rank <= 2")
def newest_facts_of_entities(spark, sf_dir):
    f = _facts(spark, sf_dir)
    asked = table(spark, sf_dir, "events").select(ids.entity_id(F.col("user_id").cast("string")).alias("id")).distinct()
    return knowledge.facts_about(f, knowledge.fact_edges(f), asked, 2).select("entity_id", "id", "rank")


@query(f"SELECT 'SUBJECT' AS type, count(*)::BIGINT AS n FROM {_FACT} UNION ALL SELECT 'OBJECT', count(*)::BIGINT FROM {_FACT} WHERE user_id % 2 = 0 UNION ALL SELECT 'ASSERTED_IN', sum(least(said, 20))::BIGINT FROM {_FACT}")
def fact_edge_counts(spark, sf_dir):
    return knowledge.fact_edges(_facts(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def pending_embeddings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    cache = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(F.lit("hash").alias("model"), ids.text_hash("text").alias("text_hash"), F.lit(None).cast("array<float>").alias("vector"))
    return ask.embed(d, cache).where("vector is not null").select("text_hash")


_LEG = f"""(WITH e AS (SELECT id, row_number() OVER (ORDER BY mentions DESC, id) AS e FROM {_ENTITIES} QUALIFY e <= 3), r AS (SELECT src AS chunk_id, e, row_number() OVER (PARTITION BY e ORDER BY src) AS k FROM {_MENTION_EDGES} JOIN e ON e.id = dst)
SELECT chunk_id, row_number() OVER (ORDER BY min(struct_pack(e := e, c := chunk_id))) AS rank FROM r WHERE k <= 80 GROUP BY chunk_id)"""


@query(f"SELECT chunk_id AS message_id, rank::INT AS rank FROM {_LEG}")
def entity_leg(spark, sf_dir):
    return _leg(spark, sf_dir)


def _leg(spark, sf_dir) -> DataFrame:
    e = knowledge.entities(mention_items(spark, sf_dir)).orderBy(F.col("mentions").desc(), "id").limit(3)
    found = e.select("id", F.row_number().over(W.orderBy(F.col("mentions").desc(), "id")).alias("rank"))
    return ask.entity_leg(found, _mentions(spark, sf_dir), _chunks(spark, sf_dir), 20)


@query(f"""WITH w AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({bm25_sql(['the', 'of'], limit=40)})), u AS (SELECT id, r, 0 AS l FROM w UNION ALL SELECT chunk_id, rank, 2 FROM {_LEG})
SELECT id AS message_id, round(sum(1.0 / (60 + r)), 9) AS score, bool_or(l = 0) AS by_words, bool_or(l = 2) AS by_entity FROM u GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, min(struct_pack(l := l, r := r)), id LIMIT 30""")
def hybrid_with_entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = textindex.search(docs, "the of", limit=None, keep=()).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(40)
    words = best.select(F.format_string("%012d", "doc_id").alias("message_id"), F.row_number().over(W.orderBy(F.col("score").desc(), "doc_id")).alias("rank"))
    return ask.fold_hybrid(words, words.limit(0), _leg(spark, sf_dir), limit=30).select("message_id", F.round("score", 9).alias("score"), "by_words", "by_entity")


# text (F3, F16, U5, X2-X4, D2, T4)


@query(f"SELECT doc_id, array_to_string({TOKENS.replace('lower(coalesce(text', 'lower(coalesce(replace(text, chr(223), chr(115) || chr(115))')}, ' ') AS folded FROM documents")
def folded_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.fold_words(F.coalesce("text", F.lit(""))), " ").alias("folded"))


@query("SELECT event_id, list_filter([1, 2, 3], lambda n: n IN (event_id % 4, user_id % 5, 3)) AS cited FROM events")
def cited_sources(spark, sf_dir):
    answer = F.concat(F.lit("As [3] and ["), (F.col("event_id") % 4).cast("string"), F.lit("] say, not [x] or [99999999999999999999], see ["), (F.col("user_id") % 5).cast("string"), F.lit("]."))
    return table(spark, sf_dir, "events").select("event_id", ask.cited(answer, F.array(F.lit(1), F.lit(2), F.lit(3))).alias("cited"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([trim(split_part(p_brand, '#', 1)), p_name])), '|') AS links FROM part")
def wikilinks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("a [["), "p_name", F.lit("]] b [[ "), "p_brand", F.lit("#part|shown]] [["), "p_name", F.lit("|again]] [[]] [[ |x]]"))
    return p.select("p_partkey", F.array_join(X.wikilinks(text), "|").alias("links"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'organization' WHEN 1 THEN 'tool' ELSE event_type END AS kind, CASE WHEN event_id % 7 = 0 THEN 5 ELSE greatest(1, least(10, round_even(value / 10, 0)))::BIGINT END AS strength, lower(event_type) || ' x' AS fact_key FROM events")
def normalised_items(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "company").when(F.col("event_id") % 3 == 1, "software").otherwise(F.col("event_type"))
    strength = F.when(F.col("event_id") % 7 != 0, F.col("value") / 10)
    statement = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" \n x .;! "))
    return table(spark, sf_dir, "events").select("event_id", X.canonical_type(kind).alias("kind"), X.strength(strength).alias("strength"), X.fact_key(statement).alias("fact_key"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE text[1:79] || '…' END AS title FROM documents")
def clipped_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clip(F.col("text")).alias("title"))


@query("SELECT p_partkey, 'up_' || p_name || '/' || p_brand || '.md' AS path FROM part")
def safe_paths(spark, sf_dir):
    name = F.concat(F.lit("../.\\up?"), F.col("p_name"), F.lit(" /. /"), F.col("p_brand"), F.lit(".md"))
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_path(name).alias("path"))


@query("SELECT event_id FROM events WHERE event_id % 50 = 0 OR ts <= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 24 HOUR")
def expired_spaces(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("created_at"))
    return flows.expired(e, "2024-01-03 00:00:00").select("event_id")
