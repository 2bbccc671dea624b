"""The graph store: nodes, edges and embeddings as tables, and what reads and changes them.

Tables: nodes (id, label, text, title, source, conversation_id, created_at, props...), edges (src, type, dst, ...),
embeddings (node_id, vector). Changes return new tables; `write_table` replaces a stored one by way of a new folder.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Node labels and edge types.
LABELS = ("Conversation", "Message", "Chunk", "Entity", "Fact", "Topic")
EDGE_TYPES = ("HAS_MESSAGE", "REPLIES_TO", "HAS_CHUNK", "MENTIONS", "RELATED_TO", "ABOUT", "SUBJECT", "OBJECT", "ASSERTED_IN", "SUPERSEDES", "SAME_AS", "IN_TOPIC")
PROPERTY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


# reading


def find_nodes(nodes: DataFrame, label: str, where: dict | None = None, limit: int | None = None) -> DataFrame:
    """Nodes of a label whose properties equal all the given values (null equals nothing), by id."""
    for name in where or {}:
        if not PROPERTY.match(name):
            raise ValueError(f"not a property name: {name!r}")
    rows = nodes.where(F.col("label") == label)
    for name, value in (where or {}).items():
        rows = rows.where(F.col(name) == F.lit(value))
    rows = rows.orderBy("id")
    return rows.limit(limit) if limit is not None else rows


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the asked ids, each once; ids without a node are dropped."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def neighbors(edges: DataFrame, nodes: DataFrame, node_id: str, types: list[str] | None = None, direction: str = "out", limit: int | None = 100) -> DataFrame:
    """Edges of one node with the node on the other end, by (type, dst, src). A loop shows once."""
    sides = {"out": F.col("src") == node_id, "in": F.col("dst") == node_id, "both": (F.col("src") == node_id) | (F.col("dst") == node_id)}
    rows = edges.where(sides[direction])
    if types:
        rows = rows.where(F.col("type").isin(types))
    other = F.when(F.col("src") == node_id, F.col("dst")).otherwise(F.col("src"))
    far = nodes.select([F.col(c).alias(f"node_{c}") for c in nodes.columns])
    rows = rows.withColumn("other", other).join(far, F.col("other") == F.col("node_id")).drop("node_id").orderBy("type", "dst", "src")
    return rows.limit(limit) if limit is not None else rows


def edges_many(edges: DataFrame, ids: DataFrame, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """(asked, src, type, dst, other) for a set of nodes, without reading the far nodes."""
    rows = edges.where(F.col("type").isin(types)) if types else edges
    asked = ids.select(F.col("id").alias("asked")).distinct()
    out = rows.join(asked, rows["src"] == asked["asked"]).withColumn("other", F.col("dst"))
    into = rows.join(asked, rows["dst"] == asked["asked"]).withColumn("other", F.col("src"))
    if direction == "both":
        into = into.where("src <> dst")
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def neighbors_many(edges: DataFrame, ids: DataFrame, types: list[str] | None = None, direction: str = "out", limit: int = 100) -> DataFrame:
    """(asked, links): each asked node with its first links in order; an empty array if it has none."""
    rows = edges_many(edges, ids, types, direction)
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("asked").orderBy("type", "dst", "src"))).where(F.col("_r") <= limit)
    lists = ranked.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("type", "dst", "src", "other"))).alias("links"))
    none = F.array().cast("array<struct<type:string,dst:string,src:string,other:string>>")
    return ids.select(F.col("id").alias("asked")).distinct().join(lists, "asked", "left").withColumn("links", F.coalesce("links", none))


def count_by_label(nodes: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Every label with its count, 0 where it has none."""
    every = nodes.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return F.broadcast(every).join(nodes.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def list_conversations(conversations: DataFrame, source: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, newest first by update, else creation; undated last, ties by id."""
    rows = conversations.where(F.col("source") == source) if source is not None else conversations
    return rows.orderBy(F.coalesce("updated_at", "created_at", F.lit("")).desc(), "id").offset(offset).limit(limit)


def in_sources(rows: DataFrame, sources: list[str] | None, column: str = "source") -> DataFrame:
    """Rows of the sources; no list, or an empty one, filters nothing."""
    return rows.where(F.col(column).isin(sources)) if sources else rows


# changing


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by a sequence column, which is dropped."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r", order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key it has not."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old, and those of new whose key it has not."""
    return upsert(new, old, keys)


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_anti").unionByName(edges.join(ids, edges["dst"] == ids["id"], "left_anti")).distinct()


def with_both_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are among the ids."""
    a, b = ids.select(F.col("id").alias("_a")), ids.select(F.col("id").alias("_b"))
    return edges.join(a, edges["src"] == F.col("_a"), "left_semi").join(b, F.col("dst") == F.col("_b"), "left_semi")


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with new ones; raises if one of them has an end that is no node."""
    lost = missing_ends(new, nodes).limit(1).count()
    if lost:
        raise ValueError("an edge has an end that is no node")
    return upsert(edges, new, ["src", "type", "dst"])


def delete_nodes(ids: DataFrame, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the nodes, their edges either way, and their vectors."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    left = edges.join(gone, edges["src"] == gone["_id"], "left_anti").join(gone, edges["dst"] == gone["_id"], "left_anti")
    return nodes.join(gone, nodes["id"] == gone["_id"], "left_anti"), left, embeddings.join(gone, embeddings["node_id"] == gone["_id"], "left_anti")


def doomed_messages(old_messages: DataFrame, new_messages: DataFrame, chunks: DataFrame, keep: bool = True) -> DataFrame:
    """Ids of messages that a new copy of their conversations lacks, and of these messages' chunks."""
    touched = new_messages.select("conversation_id").distinct()
    lost = old_messages.join(touched, "conversation_id", "left_semi").select("id")
    if keep:
        lost = lost.join(new_messages.select("id"), "id", "left_anti")
    below = chunks.join(lost.withColumnRenamed("id", "message_id"), "message_id", "left_semi").select("id")
    return lost.unionByName(below)


def upsert_conversations(store: dict[str, DataFrame], conversations: DataFrame, messages: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """A store (nodes, edges, embeddings) after conversations came anew: vanished messages go with their chunks,
    surviving ones keep chunks and vectors, and reply links are rebuilt."""
    nodes, links, vectors = store["nodes"], store["edges"], store["embeddings"]
    old = nodes.where("label = 'Message'")
    gone = doomed_messages(old, messages, nodes.where("label = 'Chunk'"))
    nodes, links, vectors = delete_nodes(gone, nodes, links, vectors)
    fresh = messages.select("id")
    links = links.join(fresh, (links["src"] == fresh["id"]) & (links["type"] == "REPLIES_TO"), "left_anti")
    nodes = upsert(nodes, conversations.unionByName(messages, allowMissingColumns=True), ["id"])
    return {"nodes": nodes, "edges": upsert(links, edges, ["src", "type", "dst"]), "embeddings": vectors}


def delete_conversation(store: dict[str, DataFrame], conversation_id: str) -> dict[str, DataFrame]:
    """A store without one conversation, its messages and chunks."""
    nodes = store["nodes"]
    own = nodes.where((F.col("id") == conversation_id) | (F.col("conversation_id") == conversation_id)).select("id")
    return dict(zip(("nodes", "edges", "embeddings"), delete_nodes(own, nodes, store["edges"], store["embeddings"]), strict=True))


def set_embeddings(old: DataFrame, new: DataFrame, nodes: DataFrame, dimension: int) -> DataFrame:
    """Vectors replaced, all or none: raises on a wrong length or an unknown node."""
    ids = nodes.select("id")
    wrong = new.where(~F.coalesce(F.size("vector") == dimension, F.lit(False))).limit(1).count()
    unknown = new.join(ids, new["node_id"] == ids["id"], "left_anti").limit(1).count()
    if wrong or unknown:
        raise ValueError("a vector is of another length" if wrong else "a vector belongs to no node")
    return upsert(old, new, ["node_id"])


def add_outcomes(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (id, content_hash, ...) with the outcome against the library: new, updated or unchanged."""
    known = library.select("id", F.col("content_hash").alias("_old"))
    outcome = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("content_hash"), "unchanged").otherwise("updated")
    return incoming.join(known, "id", "left").withColumn("outcome", outcome).drop("_old")


def id_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, state): fresh, stale or unchanged, of two sets of ids."""
    a, b = old.select("id").distinct().withColumn("o", F.lit(1)), new.select("id").distinct().withColumn("n", F.lit(1))
    return a.join(b, "id", "full").select("id", F.when(F.col("o").isNull(), "fresh").when(F.col("n").isNull(), "stale").otherwise("unchanged").alias("state"))


def write_table(df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ()) -> str:
    """A table's new version in a folder of its own; readers switch by the returned path, so none sees half a write."""
    path = f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def open_tables(spark: SparkSession, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Empty tables of a new store, by name."""
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}


def window(since: str | None = None, until: str | None = None, sources: list[str] | None = None, started: Column | None = None) -> Column:
    """Rows that start inside [since, until], compared by the bound's own length, of the sources. Undated rows fail any bound."""
    at = started if started is not None else F.coalesce("created_at", "updated_at")
    tests = [F.col("source").isin(sources)] if sources else []
    if since:
        tests.append(F.coalesce(F.substring(at, 1, len(since)) >= since, F.lit(False)))
    if until:
        tests.append(F.coalesce(F.substring(at, 1, len(until)) <= until, F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))
