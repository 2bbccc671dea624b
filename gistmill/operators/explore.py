"""Views of the graph around an entity, a conversation, a topic, or the whole of it.

Inputs are tables: mention counts (entity_id, conversation_id, n), conversations, entities, related edges and topic
membership. Every view is joins and two bounded top-k cuts; nothing walks the graph node by node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gistmill.operators.ranks import numbered

ENTITIES, CONVERSATIONS, CANDIDATES, SHARED_CAP = 40, 16, 150, 3


def mention_counts(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many chunks of each conversation mention each entity; chunks of no conversation do not count."""
    own = chunks.where("conversation_id is not null").select(F.col("id").alias("src"), "conversation_id")
    return mentions.where("type = 'MENTIONS'").join(own, "src").groupBy(F.col("dst").alias("entity_id"), "conversation_id").agg(F.count("*").alias("n"))


def started() -> Column:
    return F.coalesce("created_at", "updated_at")


def timeline(conversations: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Conversations that started in each month, oldest first; undated ones are left out."""
    rows = conversations.where(F.col("source").isin(sources)) if sources else conversations
    return rows.where(started().isNotNull()).groupBy(F.substring(started(), 1, 7).alias("month")).agg(F.count("*").alias("conversations")).orderBy("month")


def candidates(entities: DataFrame, related: DataFrame, counts: DataFrame, in_topic: DataFrame, entity: str | None = None, conversation: str | None = None, topic: str | None = None) -> DataFrame:
    """(entity_id, place) of the entities a view may show, in order."""
    if entity:
        far = related.where((F.col("src") == entity) | (F.col("dst") == entity)).select(F.when(F.col("src") == entity, F.col("dst")).otherwise(F.col("src")).alias("entity_id"), "weight", "src", "dst")
        best = far.groupBy("entity_id").agg(F.min(F.struct(-F.col("weight"), F.col("dst"), F.col("src"))).alias("o"))
        me = entities.where(F.col("id") == entity).select(F.col("id").alias("entity_id"), F.lit(0).cast("long").alias("place"))
        return me.unionByName(numbered(best.where(F.col("entity_id") != entity), ["o", "entity_id"], "place").select("entity_id", "place"))
    if conversation:
        own = counts.where(F.col("conversation_id") == conversation)
        return numbered(own.select("entity_id", "n"), [F.col("n").desc(), "entity_id"], "place").drop("n")
    if topic:
        members = in_topic.where(F.col("dst") == topic).select(F.col("src").alias("id")).join(entities, "id")
        return numbered(members.select(F.col("id").alias("entity_id"), "mentions"), [F.col("mentions").desc(), "entity_id"], "place").drop("mentions")
    top = entities.orderBy(F.col("mentions").desc(), "id").limit(CANDIDATES)
    return top.select(F.col("id").alias("entity_id"), F.row_number().over(W.orderBy(F.col("mentions").desc(), "id")).cast("long").alias("place"))


def explore(entities: DataFrame, conversations: DataFrame, related: DataFrame, counts: DataFrame, in_topic: DataFrame, entity: str | None = None, conversation: str | None = None, topic: str | None = None, admits: Column | None = None, most_entities: int = ENTITIES, most_conversations: int = CONVERSATIONS) -> dict[str, DataFrame]:
    """entities (entity_id, place), conversations (id, place), related and mention edges inside the view, topics.

    admits is the window (store.window), if one narrows the view. The focus stays whatever the window.
    """
    narrowed = admits is not None
    found = candidates(entities, related, counts, in_topic, entity, conversation, topic)
    own = counts.join(found.select("entity_id"), "entity_id", "left_semi")
    allowed = conversations.where(admits | (F.col("id") == F.lit(conversation or ""))) if narrowed else conversations
    inside = own.join(allowed.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    weight = inside.groupBy("entity_id").agg(F.sum("n").alias("w"))
    ranked = found.join(weight, "entity_id", "left").withColumn("w", F.coalesce("w", F.lit(0)))
    if entity or conversation or topic:
        if narrowed:
            ranked = ranked.where((F.col("w") > 0) | (F.col("entity_id") == F.lit(entity or "")))
        order = ["place"]
    else:
        ranked = ranked.where("w > 0")
        order = [F.col("w").desc(), "place"]
    chosen = ranked.orderBy(*order).limit(max(1, most_entities)).withColumn("place", F.row_number().over(W.orderBy(*order))).select("entity_id", "place", "w")
    if conversation:
        scored = inside.where(F.col("conversation_id") != conversation).join(chosen.select("entity_id"), "entity_id", "left_semi").groupBy("conversation_id").agg(F.sum(F.least("n", F.lit(SHARED_CAP))).alias("score"))
    elif entity:
        scored = inside.where(F.col("entity_id") == entity).groupBy("conversation_id").agg(F.sum("n").alias("score"))
    else:
        scored = inside.join(chosen.select("entity_id"), "entity_id", "left_semi").groupBy("conversation_id").agg(F.sum("n").alias("score"))
    dated = scored.join(conversations.select(F.col("id").alias("conversation_id"), F.coalesce(started(), F.lit("")).alias("started")), "conversation_id")
    by = [F.col("score").desc(), "started", "conversation_id"]
    best = dated.orderBy(*by).limit(max(0, most_conversations - (1 if conversation else 0))).select("conversation_id", F.row_number().over(W.orderBy(*by)).alias("place"), "score")
    if conversation:
        focus = conversations.where(F.col("id") == conversation).select(F.col("id").alias("conversation_id"), F.lit(0).alias("place"), F.lit(None).cast("long").alias("score"))
        best = focus.unionByName(best)
    a, b = chosen.select(F.col("entity_id").alias("src")), chosen.select(F.col("entity_id").alias("dst"))
    links = related.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst", "weight")
    shown = own.join(chosen.select("entity_id"), "entity_id", "left_semi").join(best.select("conversation_id"), "conversation_id", "left_semi")
    topics = in_topic.join(a, "src", "left_semi").groupBy(F.col("src").alias("entity_id")).agg(F.min("dst").alias("topic_id"))
    return {"entities": chosen, "conversations": best, "related": links, "mentions": shown, "topics": topics}


def conversation_entities(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, conversation: str) -> DataFrame:
    """Entities of a conversation, most mentioned first, with the messages in order of their first chunk."""
    own = chunks.where(F.col("conversation_id") == conversation).select(F.col("id").alias("src"), "message_id")
    rows = mentions.where("type = 'MENTIONS'").join(own, "src")
    first = rows.groupBy("dst", "message_id").agg(F.min("src").alias("at"), F.count("*").alias("n"))
    per = first.groupBy("dst").agg(F.sum("n").alias("mentions"), F.transform(F.array_sort(F.collect_list(F.struct("at", "message_id"))), lambda x: x["message_id"]).alias("messages"), F.min("at").alias("first"))
    return per.join(entities.select(F.col("id").alias("dst"), "name", F.col("type").alias("kind")), "dst").orderBy(F.col("mentions").desc(), "first", "dst").select(F.col("dst").alias("id"), "name", "kind", "mentions", "messages")


def entity_graph(entities: DataFrame, related: DataFrame, limit: int = 150) -> tuple[DataFrame, DataFrame]:
    """The most mentioned entities that have a relationship either way, and the relationships among them."""
    linked = related.select(F.col("src").alias("id")).union(related.select("dst")).distinct()
    top = entities.join(linked, "id", "left_semi").orderBy(F.col("mentions").desc(), "id").limit(limit)
    a, b = top.select(F.col("id").alias("src")), top.select(F.col("id").alias("dst"))
    return top, related.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def related_entities(related: DataFrame, entities: DataFrame, entity: str, limit: int = 20) -> DataFrame:
    """The strongest relationships of an entity with the far entity."""
    far = related.where((F.col("src") == entity) | (F.col("dst") == entity)).withColumn("other", F.when(F.col("src") == entity, F.col("dst")).otherwise(F.col("src")))
    return far.join(entities.select(F.col("id").alias("other"), "name", F.col("type").alias("kind")), "other").orderBy(F.col("weight").desc(), "dst", "src").limit(limit)


def top_topics(view_topics: DataFrame, limit: int = 5) -> DataFrame:
    return view_topics.groupBy("topic_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "topic_id").limit(limit)


def report_lines(members: DataFrame, links: DataFrame, most: int = 30) -> DataFrame:
    """(topic, kind, rank, line): a topic's most mentioned members and strongest links, and how many members more."""
    m = members.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy(F.col("mentions").desc(), "name")))
    shown = m.where(F.col("rank") <= most).select("topic", F.lit("entity").alias("kind"), "rank", F.format_string("- %s (%s): %s", "name", "type", "summary").alias("line"))
    more = m.groupBy("topic").agg(F.max("rank").alias("n")).where(F.col("n") > most).select("topic", F.lit("entity").alias("kind"), F.lit(most + 1).alias("rank"), F.format_string("- and %d more", F.col("n") - most).alias("line"))
    x = links.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy(F.col("weight").desc(), "source", "target"))).where(F.col("rank") <= most)
    return shown.unionByName(more).unionByName(x.select("topic", F.lit("link").alias("kind"), "rank", F.format_string("- %s -> %s: %s", "source", "target", "description").alias("line")))


def suggest(entities: DataFrame, typed: str, limit: int = 6) -> DataFrame:
    """Entities whose name holds what is typed; names that start with it come first, then by mentions."""
    name = F.lower("name")
    return entities.where(name.contains(typed.lower())).orderBy(name.startswith(typed.lower()).desc(), F.col("mentions").desc(), "id").limit(limit)
