"""The engine's model over the driver's tables: messages, nodes, edges, chunks and deterministic extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gistmill.functions import ids

SOURCE = "table"
NAME = "[A-Z][a-z]{3,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, conversation_id, parent_id, position, role, text of the conversations table; the parent is the turn before."""
    rows = table(spark, sf_dir, "conversations")
    conv = ids.conversation_id(F.lit(SOURCE), F.col("conv_id"))
    rows = rows.select("conv_id", "turn", "role", "text", conv.alias("conversation_id")).withColumn("id", ids.message_id("conversation_id", "turn"))
    w = W.partitionBy("conversation_id").orderBy("turn")
    return rows.select("id", "conversation_id", F.lag("id").over(w).alias("parent_id"), (F.row_number().over(w) - 1).cast("long").alias("position"), "role", "text", "conv_id", "turn")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    conv = m.groupBy(F.col("conversation_id").alias("id")).agg(F.lit("Conversation").alias("label"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("conversation_id"))
    return conv.unionByName(m.select("id", F.lit("Message").alias("label"), "text", "conversation_id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    has = m.select(F.col("conversation_id").alias("src"), F.lit("HAS_MESSAGE").alias("type"), F.col("id").alias("dst"), "position")
    replies = m.where("parent_id is not null").select(F.col("id").alias("src"), F.lit("REPLIES_TO").alias("type"), F.col("parent_id").alias("dst"), F.lit(None).cast("long").alias("position"))
    return has.unionByName(replies)


def mention_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, pos, name, type, description, source): capitalised words of the documents, in order."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.format_string("%012d", "doc_id").alias("chunk_id"), "source", F.posexplode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("pos", "name"))
    return rows.select("chunk_id", F.col("pos").cast("long").alias("pos"), "name", F.lit("other").alias("type"), F.concat(F.lit("seen in "), "source").alias("description"), "source")


def relation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, pos, source, target, description, strength): each name with the next of its document."""
    d = table(spark, sf_dir, "documents").select(F.format_string("%012d", "doc_id").alias("chunk_id"), F.concat(F.lit("seen in "), "source").alias("description"), F.regexp_extract_all("text", F.lit(NAME), F.lit(0)).alias("source"))
    pairs = F.arrays_zip("source", F.slice("source", F.lit(2), F.greatest(F.size("source"), F.lit(1))).alias("target"))
    rows = d.where("size(source) > 1").select("chunk_id", "description", F.posexplode(pairs).alias("pos", "x")).where("x.target is not null")
    return rows.select("chunk_id", F.col("pos").cast("long").alias("pos"), "x.source", "x.target", "description", F.lit(5.0).alias("strength"))
