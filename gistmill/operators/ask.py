"""What a question finds: named entities, passages fused from two rankings, and notes."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gistmill.functions import ids
from gistmill.functions import text as X
from gistmill.operators import vectorsearch as V
from gistmill.operators.ranks import numbered

MAX_SOURCES, MAX_ENTITIES, MAX_TOPICS, MAX_FACTS, CHUNKS_PER_ENTITY, NEAR_CANDIDATES, NAME_WORDS, RRF_K = 8, 6, 2, 8, 3, 25, 4, 60
QUESTION_WORD = r"(?U)[\w][\w.+#'-]*"
SNIPPET_TOKENS = 16

#: Words that are never an entity's name.
NOT_NAMES = (
    "a about an and any are be can could did do does for from have how i if in is it its me my of on or "
    "should that the this to use was we were what when where which who why will with would you your"
).split()


def mentioned_entities(spark: SparkSession, question: str, entities: DataFrame) -> DataFrame:
    """(place, entity columns): entities the question names, longest names first. Ids come from the words, so the
    entities are met by an equi-join on a handful of ids."""
    row = spark.createDataFrame([(question,)], "q string").select(F.regexp_extract_all("q", F.lit(QUESTION_WORD), F.lit(0)).alias("w"))
    names = row.select(F.posexplode(X.ngrams(F.col("w"), NAME_WORDS)).alias("place", "n")).select("place", X.entity_key(F.col("n")).alias("asked"))
    names = names.where((F.length("asked") >= 2) & ~F.col("asked").isin(NOT_NAMES)).groupBy("asked").agg(F.min("place").alias("place"))
    return entities.join(F.broadcast(names.withColumn("id", ids.entity_id("asked"))), "id").where(X.entity_key(F.col("name")) == F.col("asked")).drop("asked")  # at most a question's n-grams


def interleave(rows: DataFrame, group: str, turn: str, key: str, most_turns: int) -> DataFrame:
    """(key, rank): groups take turns (turn 1 of each group in group order, then turn 2 ...); a key counts where it is first."""
    first = rows.where(F.col(turn) <= most_turns).groupBy(key).agg(F.min(F.struct(turn, group)).alias("_o"))
    return numbered(first, ["_o", key]).select(key, "rank")


def chunks_of(named: DataFrame, mentions: DataFrame, chunks: DataFrame, nearness: DataFrame | None) -> DataFrame:
    """(chunk_id, rank): chunks that mention the named entities, nearest (or, without nearness, newest) first, in turns."""
    rows = mentions.where("type = 'MENTIONS'").join(F.broadcast(named.select(F.col("id").alias("dst"), "place")), "dst").select(F.col("src").alias("chunk_id"), "place")
    if nearness is not None:
        offered = rows.join(nearness, "chunk_id").withColumn("turn", F.row_number().over(W.partitionBy("place").orderBy("near", "chunk_id")))
    else:
        dated = rows.join(chunks.select(F.col("id").alias("chunk_id"), "created_at"), "chunk_id")
        offered = dated.withColumn("turn", F.row_number().over(W.partitionBy("place").orderBy(F.coalesce("created_at", F.lit("")).desc(), "chunk_id")))
    return interleave(offered, "place", "turn", "chunk_id", CHUNKS_PER_ENTITY)


def retrieve(spark: SparkSession, question: str, entities: DataFrame, mentions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, query_vector: list[float] | None = None, limit: int = MAX_SOURCES) -> DataFrame:
    """(number, chunk columns, score): the passages to answer from."""
    named = mentioned_entities(spark, question, entities)
    lists, near = [], None
    if query_vector is not None and vectors is not None:
        hits = V.nearest(vectors, query_vector, "node_id", "vector", limit * NEAR_CANDIDATES)
        near = hits.select(F.col("node_id").alias("chunk_id"), F.row_number().over(W.orderBy("distance", "node_id")).alias("near"))
        lists.append(near.where(F.col("near") <= limit * 3).select("chunk_id", F.col("near").alias("rank")))
    lists.append(chunks_of(named, mentions, chunks, near))
    best = V.reciprocal_ranks(lists, "chunk_id", RRF_K, limit)
    order = W.orderBy(F.col("score").desc(), "first.list_no", "first.rank", "chunk_id")
    return best.withColumn("number", F.row_number().over(order)).join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id").drop("first", "in_0", "in_1").orderBy("number")


def notes(named: DataFrame, facts_by_entity: DataFrame, in_topic: DataFrame, topics: DataFrame) -> DataFrame:
    """(kind, rank, title, text): summaries of the first entities, their newest facts in turns, the topics they share."""
    first = named.orderBy("place").limit(MAX_ENTITIES)
    summaries = first.where(F.coalesce("summary", F.lit("")) != "").select(F.lit("entity").alias("kind"), F.row_number().over(W.orderBy("place")).alias("rank"), F.col("name").alias("title"), F.col("summary").alias("text"))
    offered = facts_by_entity.join(first.select(F.col("id").alias("entity_id"), "place"), "entity_id")
    order = interleave(offered, "place", "rank", "id", MAX_FACTS).where(F.col("rank") <= MAX_FACTS)
    said = F.when(F.coalesce("last_said", F.lit("")) != "", F.concat("statement", F.lit(" (said "), F.substring("last_said", 1, 10), F.lit(")"))).otherwise(F.col("statement"))
    told = order.join(offered.drop("rank", "place", "entity_id").dropDuplicates(["id"]), "id").select(F.lit("fact").alias("kind"), "rank", F.col("subject_key").alias("title"), said.alias("text"))
    shared = in_topic.join(named.select(F.col("id").alias("src"), "place"), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("place").alias("place"))
    top = shared.withColumn("rank", F.row_number().over(W.orderBy(F.col("n").desc(), "place", "id"))).where(F.col("rank") <= MAX_TOPICS)
    return summaries.unionByName(told).unionByName(top.join(topics, "id").select(F.lit("topic").alias("kind"), "rank", "title", F.col("summary").alias("text")))


def cited(answer: Column, numbers: Column) -> Column:
    """Numbers in [brackets] of an answer that are among the sources' numbers, in the sources' order."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.filter(numbers, lambda n: F.array_contains(found, n.cast("long")))


def fold_hybrid(words: DataFrame, meaning: DataFrame, entity: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """message_id, score, by_words, by_meaning, by_entity of ranked lists (message_id, rank)."""
    lists = [words, meaning, *([entity] if entity is not None else [])]
    fused = V.reciprocal_ranks(lists, "message_id", RRF_K, limit)
    return fused.select("message_id", "score", F.col("in_0").alias("by_words"), F.col("in_1").alias("by_meaning"), (F.col("in_2") if entity is not None else F.lit(False)).alias("by_entity"))


def best_per_message(hits: DataFrame, distance: str = "distance", limit: int | None = None) -> DataFrame:
    """(message_id, rank): messages by their nearest chunk, all of them or the first ones."""
    best = hits.groupBy("message_id").agg(F.min(F.struct(distance, "chunk_id")).alias("_b"))
    best = best.orderBy("_b", "message_id").limit(limit) if limit else best
    return numbered(best, ["_b", "message_id"]).select("message_id", "rank")


def entity_leg(found: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """(message_id, rank): messages of the chunks that mention found entities (id, rank), by entity and then chunk id."""
    rows = mentions.where("type = 'MENTIONS'").join(found.select(F.col("id").alias("dst"), F.col("rank").alias("e")), "dst").select(F.col("src").alias("chunk_id"), "e")
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("e").orderBy("chunk_id"))).where(F.col("_r") <= 4 * limit)
    first = rows.join(chunks.select(F.col("id").alias("chunk_id"), "message_id"), "chunk_id").groupBy("message_id").agg(F.min(F.struct("e", "chunk_id")).alias("_o"))
    return first.select("message_id", F.row_number().over(W.orderBy("_o", "message_id")).alias("rank"))


def snippet_of(text: str, words: set[str], size: int = SNIPPET_TOKENS) -> str:
    """The stretch of size words that holds the most hits, the earliest of equals, hits in brackets."""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    if not spans:
        return text
    hit = [not words.isdisjoint(X.tokens_of(text[a:b])) for a, b in spans]
    n = min(size, len(spans))
    running = [sum(hit[:n])]
    for k in range(1, len(spans) - n + 1):
        running.append(running[-1] - hit[k - 1] + hit[k + n - 1])
    first = running.index(max(running))
    stop = first + n
    at = spans[first][0] if first else 0
    end = spans[stop - 1][1] if stop < len(spans) else len(text)
    out = []
    for k in range(first, stop):
        a, b = spans[k]
        out += [text[at:a], f"[{text[a:b]}]" if hit[k] else text[a:b]]
        at = b
    return "..." * (first > 0) + "".join([*out, text[at:end]]).strip() + "..." * (end < len(text))


def snippets(rows: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """rows with `snippet`."""
    words = {w for p in X.query_words(query) for w in p}

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else snippet_of(t, words))

    return rows.withColumn("snippet", cut(text_col))


def linked_mentions(texts: DataFrame, names: list[str], text_col: str = "text") -> DataFrame:
    """rows with `found` (start, end, name) of whole-word mentions outside code, longest names first."""
    inner = "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)))
    pattern = rf"```.*?(?:```|\Z)|`[^`\n]*`|(?<!\w)({inner})(?!\w)" if inner else r"(?!)()"

    @F.pandas_udf("array<struct<start:long,end:long,name:string>>")
    def find(values: pd.Series) -> pd.Series:
        rule = re.compile(pattern, re.IGNORECASE | re.DOTALL)
        return values.map(lambda t: [{"start": m.start(1), "end": m.end(1), "name": m.group(1)} for m in rule.finditer(t or "") if m.group(1)])

    return texts.withColumn("found", find(text_col))


@lru_cache(100_000)
def _slot(word: str, size: int) -> int:
    return int.from_bytes(hashlib.sha256(word.encode()).digest(), "big") % size


def embed_text(text: str | None, size: int = 32) -> list[float]:
    """The offline default embedder: words counted in slots by their SHA-256, unit length."""
    v = [0.0] * size
    for word, times in Counter(X.fold_text(text or "")).items():
        v[_slot(word, size)] += times
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


@F.pandas_udf(ArrayType(FloatType()))
def embedded(texts: pd.Series) -> pd.Series:
    return texts.map(embed_text)


def embed(rows: DataFrame, cache: DataFrame, model: str = "hash", text_col: str = "text") -> DataFrame:
    """The cache (model, text_hash, vector) with vectors of the texts it lacked, each distinct text embedded once."""
    # known texts go before the distinct ones are told, so that they are not carried there
    new = rows.select(ids.text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(cache.where(F.col("model") == model).select("text_hash"), "text_hash", "left_anti").dropDuplicates(["text_hash"])
    return cache.unionByName(new.select(F.lit(model).alias("model"), "text_hash", embedded("text").alias("vector")))
