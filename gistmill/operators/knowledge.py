"""From answers about chunks to the graph of entities, relationships and facts.

extractions(chunk_id, pos, ...) are exploded items; "first seen" is by (chunk_id, pos), never by the order of rows.
All of it is one pass of partial aggregates for each output, keyed by entity, pair or fact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gistmill.functions import ids
from gistmill.functions import text as X
from gistmill.session import durable

SOURCES_KEPT, SIMILAR, START_CHARS = 20, 0.85, 4
#: Names of one key that one task compares with one another.
TILE = 2000


def seen(rows: DataFrame, *by: str) -> DataFrame:
    """How often each combination of values is in the rows, and where first: what the outputs below are counted from."""
    return rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min(F.struct("chunk_id", "pos")).alias("_first"))


def _mode(found: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """mode_first_seen() from seen() rows."""
    counted = found.groupBy(*keys, value).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    # max over (count, -first) has no negation for strings: the least (-count, first) is the same
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), "_first")).alias(name))


def _ordered(found: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """ordered_distinct() from seen() rows."""
    first = found.where(F.col(value) != "").groupBy(*keys, value).agg(F.min("_first").alias("_first"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def mode_first_seen(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each key; of equals, the one seen first."""
    return _mode(seen(rows, *keys, value), keys, value, name)


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Distinct non-empty values of each key in order of first appearance."""
    return _ordered(seen(rows.where(F.col(value) != ""), *keys, value), keys, value, name)


def entities(mentions: DataFrame) -> DataFrame:
    """mentions (chunk_id, pos, name, type, description) to entities: key, id, name, type, descriptions, mentions, text."""
    key = X.entity_key(F.col("name"))
    base = mentions.select(key.alias("key"), "chunk_id").where("key <> ''").groupBy("key").agg(F.countDistinct("chunk_id").alias("mentions"))
    # names are few beside their mentions: keys and types are made after the count
    found = durable(seen(mentions, "name", "type", "description")).withColumn("key", key).where("key <> ''").withColumn("type", X.canonical_type(F.col("type")))
    out = base.join(_mode(found, ["key"], "name", "name"), "key").join(_mode(found, ["key"], "type", "type"), "key").join(_ordered(found, ["key"], "description", "descriptions"), "key", "left")
    out = out.withColumn("descriptions", F.coalesce("descriptions", F.array().cast("array<string>")))
    summary = F.when(F.size("descriptions") == 1, F.element_at("descriptions", 1)).otherwise("")
    return out.select(ids.entity_id("key").alias("id"), "key", "name", "type", "descriptions", "mentions", summary.alias("summary"), F.concat("name", F.when(summary != "", F.concat(F.lit(": "), summary)).otherwise("")).alias("text"))


def mention_edges(mentions: DataFrame) -> DataFrame:
    """MENTIONS edges, one for each chunk and entity."""
    return mentions.select(F.col("chunk_id").alias("src"), ids.entity_id(X.entity_key(F.col("name"))).alias("dst")).distinct().select("src", F.lit("MENTIONS").alias("type"), "dst")


def relationships(items: DataFrame) -> DataFrame:
    """items (chunk_id, pos, source, target, description, strength) to RELATED_TO pairs: weight, count, descriptions. A
    pair is directed; one whose ends share a key is dropped."""
    strength = X.strength(F.col("strength"))
    pairs = items.groupBy("source", "target", "description").agg(F.sum(strength).alias("_w"), F.count("*").alias("_n"), F.min(F.struct("chunk_id", "pos")).alias("_first"))
    pairs = pairs.withColumn("a", X.entity_key(F.col("source"))).withColumn("b", X.entity_key(F.col("target"))).where("a <> b")
    by_text = pairs.groupBy("a", "b", "description").agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    told = F.collect_list(F.when(F.col("description") != "", F.struct("_first", F.col("description").alias("v"))))
    made = by_text.groupBy("a", "b").agg(F.sum("_w").alias("weight"), F.sum("_n").alias("count"), F.transform(F.array_sort(told), lambda x: x["v"]).alias("descriptions"))
    return made.select("a", "b", ids.entity_id("a").alias("src"), F.lit("RELATED_TO").alias("type"), ids.entity_id("b").alias("dst"), "weight", "count", "descriptions")


def facts(items: DataFrame) -> DataFrame:
    """items (chunk_id, pos, message_id, created_at, subject, statement, object) to facts with where they were said.

    One source for each message (its first chunk); said counts messages; the latest sources stay, newest last.
    """
    rows = items.withColumn("subject_key", X.entity_key(F.col("subject"))).withColumn("statement_key", X.fact_key(F.col("statement"))).where("statement_key <> ''")
    keys = ["subject_key", "statement_key"]
    at = F.coalesce("created_at", F.lit(""))
    per_message = rows.groupBy(*keys, "message_id").agg(F.min_by(F.struct(at.alias("created_at"), F.col("chunk_id"), F.col("message_id")), F.struct("chunk_id", "pos")).alias("source"))
    sources = F.array_sort(F.collect_list("source"))
    base = per_message.groupBy(*keys).agg(sources.alias("sources"), F.count("*").alias("said"))
    base = base.withColumn("dated", F.filter(F.transform("sources", lambda s: s["created_at"]), lambda d: d != ""))
    start = F.greatest(F.size("sources") - (SOURCES_KEPT - 1), F.lit(1))
    out = base.join(mode_first_seen(rows, keys, "statement", "statement"), keys).join(mode_first_seen(rows.where(F.coalesce("object", F.lit("")) != ""), keys, "object", "object"), keys, "left")
    return out.select(ids.fact_id("subject_key", "statement_key").alias("id"), *keys, "statement", "object", "said", F.array_min("dated").alias("first_said"), F.array_max("dated").alias("last_said"), F.slice("sources", start, SOURCES_KEPT).alias("sources"))


def fact_edges(found: DataFrame) -> DataFrame:
    """SUBJECT, OBJECT and ASSERTED_IN edges."""
    subject = found.select(F.col("id").alias("src"), F.lit("SUBJECT").alias("type"), ids.entity_id("subject_key").alias("dst"))
    other = found.where(F.coalesce("object", F.lit("")) != "").select(F.col("id").alias("src"), F.lit("OBJECT").alias("type"), ids.entity_id(X.entity_key(F.col("object"))).alias("dst"))
    said = found.select(F.col("id").alias("src"), F.lit("ASSERTED_IN").alias("type"), F.explode(F.transform("sources", lambda s: s["message_id"])).alias("dst"))
    return subject.unionByName(other).unionByName(said).distinct()


def newest_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.coalesce("last_said", F.lit("")).desc(), "id")


def facts_about(found: DataFrame, edges: DataFrame, entity_ids: DataFrame, limit: int | None = None) -> DataFrame:
    """(entity_id, rank, fact columns): facts whose subject or object is one of the entities, newest first."""
    own = edges.where(F.col("type").isin("SUBJECT", "OBJECT")).join(entity_ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("entity_id"), F.col("src").alias("id")).distinct()
    rows = own.join(found, "id").withColumn("rank", F.row_number().over(W.partitionBy("entity_id").orderBy(F.coalesce("last_said", F.lit("")).desc(), "id")))
    return rows.where(F.col("rank") <= limit) if limit else rows


# caches: answers are kept by (model, version, hash)


def latest_answers(cache: DataFrame, model: str, version: str, earlier: bool = True) -> DataFrame:
    """One answer for each text hash of a model: of the version, else (if earlier) of the highest older one."""
    rows = cache.where(F.col("model") == model)
    if not earlier:
        return rows.where(F.col("prompt_version") == version)
    order = [(F.col("prompt_version") == version).desc(), F.col("prompt_version").try_cast("int").desc()]
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("text_hash").orderBy(*order, F.col("prompt_version").desc()))).where("_r = 1").drop("_r")


def pending(chunks: DataFrame, cache: DataFrame, model: str, version: str) -> DataFrame:
    """One chunk (of the smallest id) for each distinct text without an answer."""
    known = cache.where((F.col("model") == model) & (F.col("prompt_version") == version)).select("text_hash")
    return chunks.join(known, "text_hash", "left_anti").groupBy("text_hash").agg(F.min_by(F.struct(*[F.col(c) for c in chunks.columns if c != "text_hash"]), "id").alias("_c")).select("text_hash", "_c.*")


def ask(rows: DataFrame, provider: Callable[[list[str]], list[str | None]], text_col: str = "text", batch_size: int = 4) -> DataFrame:
    """rows with `answer` from a provider that takes batches of texts; a batch it fails on stays null and pending."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[str | None] = []
            texts = frame[text_col].tolist()
            for at in range(0, len(texts), batch_size):
                part = texts[at : at + batch_size]
                try:
                    out += provider(part)
                except ValueError:
                    out += [None] * len(part)
            yield frame.assign(answer=out)

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))


def numbered(rows: DataFrame, batch: str, order: str, heading: Column, body: Column) -> DataFrame:
    """(batch, request): the rows of each batch as numbered blocks; heading and body are columns of a row."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), heading.alias("h"), body.alias("b"))))
    shown = F.transform(blocks, lambda x, i: F.concat(F.lit("### "), F.replace(x["h"], F.lit("{n}"), (i + 1).cast("string")), F.lit("\n"), x["b"]))
    return rows.groupBy(batch).agg(F.array_join(shown, "\n\n").alias("request"))


def passage_requests(chunks: DataFrame, batch: str = "batch") -> DataFrame:
    return numbered(chunks, batch, "id", F.lit("Passage {n}"), F.col("text"))


def to_summarise(found: DataFrame, cache: DataFrame) -> DataFrame:
    """Entities of several descriptions whose set of descriptions has no summary yet, with its key."""
    several = found.where(F.size("descriptions") > 1).withColumn("set_key", ids.content_hash(F.to_json(F.struct(F.col("name"), F.array_sort("descriptions").alias("d")))))
    return several.join(cache.select("set_key"), "set_key", "left_anti")


def summary_requests(found: DataFrame, batch: str = "batch", most: int = 20) -> DataFrame:
    lines = F.array_join(F.transform(F.slice("descriptions", 1, most), lambda d: F.concat(F.lit("- "), d)), "\n")
    return numbered(found, batch, "id", F.concat(F.lit("Entity {n}: "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")")), lines)


def pair_requests(pairs: DataFrame, found: DataFrame, batch: str = "batch") -> DataFrame:
    """Requests to compare pairs (a, b) of entity keys, each shown by name, type and summary."""
    card = F.format_string("- %s (%s): %s", "name", "type", "summary")
    a, b = found.select(F.col("key").alias("a"), card.alias("ca")), found.select(F.col("key").alias("b"), card.alias("cb"))
    return numbered(pairs.join(a, "a").join(b, "b").withColumn("o", F.struct("a", "b")), batch, "o", F.lit("Pair {n}"), F.concat_ws("\n", "ca", "cb"))


def answer_requests(question: str, sources: DataFrame, background: DataFrame) -> DataFrame:
    """One request: the question, numbered passages, and notes."""
    told = sources.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda s: F.concat(F.lit("["), s["number"].cast("string"), F.lit("] "), s["text"])), "\n\n").alias("p"))
    known = background.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "rank", "title", "text"))), lambda n: F.concat(F.lit("- "), n["title"], F.lit(": "), n["text"])), "\n").alias("n"))
    return told.join(F.broadcast(known)).select(F.concat(F.lit(f"Question: {question}\n\n"), "p", F.lit("\n\n"), "n").alias("request"))


def parse_numbered(rows: DataFrame, items: str, number: str, value: str, kind: str, answer_col: str = "answer", count_col: str = "count") -> DataFrame:
    """rows with (number, value) of an answer's list of numbered items, such as summaries or verdicts; numbers out of range go."""
    parsed = F.from_json(answer_col, f"{items} array<struct<{number}:int,{value}:{kind}>>")[items]
    one = rows.select("*", F.explode(parsed).alias("_i")).where(F.col(f"_i.{number}").between(1, F.col(count_col)) & F.col(f"_i.{value}").isNotNull())
    return one.select(*rows.columns, F.col(f"_i.{number}").alias("number"), F.col(f"_i.{value}").alias("value"))


def parse_reports(rows: DataFrame, answer_col: str = "answer", most: int = 5) -> DataFrame:
    """rows with title, summary and findings of a topic's report; one without title or summary is left out."""
    r = F.from_json(answer_col, "title string, summary string, findings array<string>")
    found = rows.withColumn("_r", r).withColumn("title", X.squeeze(F.col("_r.title"))).withColumn("summary", X.squeeze(F.col("_r.summary")))
    findings = F.slice(F.filter(F.transform(F.coalesce("_r.findings", F.array().cast("array<string>")), X.squeeze), lambda x: x != ""), 1, most)
    return found.withColumn("findings", findings).where("title <> '' and summary <> ''").drop("_r")


ANSWER = "passages array<struct<passage:int,entities:array<struct<name:string,type:string,description:string>>,relationships:array<struct<source:string,target:string,description:string,strength:double>>,facts:array<struct<subject:string,statement:string,object:string>>>>"


def parse_answers(rows: DataFrame, answer_col: str = "answer", count_col: str = "count") -> DataFrame:
    """rows with passages (number, entities, relationships, facts) of a model's JSON answer.

    Numbers out of 1 .. count go; of equal numbers the last stays; entities without a key go and the first of a key
    stays; a relationship needs both ends among its passage's entities, a fact its subject.
    """
    parsed = F.from_json(answer_col, ANSWER)["passages"]
    one = rows.select("*", F.posexplode(parsed).alias("_at", "_p")).where(F.col("_p.passage").between(1, F.col(count_col)))
    one = one.withColumn("_r", F.row_number().over(W.partitionBy(*rows.columns, "_p.passage").orderBy(F.col("_at").desc()))).where("_r = 1")

    def text(x: Column) -> Column:
        return F.coalesce(X.squeeze(x), F.lit(""))

    named = F.filter(F.transform(F.coalesce("_p.entities", F.from_json(F.lit("[]"), "array<struct<name:string,type:string,description:string>>")), lambda e: F.struct(X.entity_key(text(e["name"])).alias("key"), text(e["name"]).alias("name"), F.when(text(e["type"]) == "", "other").otherwise(F.lower(text(e["type"]))).alias("type"), text(e["description"]).alias("description"))), lambda e: e["key"] != "")
    first = F.filter(F.col("_e"), lambda e, i: F.array_position(F.transform(F.col("_e"), lambda x: x["key"]), e["key"]) == i + 1)
    one = one.withColumn("_e", named).withColumn("entities", first)
    keys = F.transform("entities", lambda e: e["key"])
    related = F.transform(F.coalesce("_p.relationships", F.from_json(F.lit("[]"), "array<struct<source:string,target:string,description:string,strength:double>>")), lambda r: F.struct(X.entity_key(text(r["source"])).alias("a"), X.entity_key(text(r["target"])).alias("b"), text(r["description"]).alias("description"), X.strength(r["strength"]).alias("strength")))
    one = one.withColumn("_k", keys).withColumn("relationships", F.filter(related, lambda r: F.array_contains(F.col("_k"), r["a"]) & F.array_contains(F.col("_k"), r["b"]) & (r["a"] != r["b"])))
    said = F.transform(F.coalesce("_p.facts", F.from_json(F.lit("[]"), "array<struct<subject:string,statement:string,object:string>>")), lambda f: F.struct(X.entity_key(text(f["subject"])).alias("subject"), text(f["statement"]).alias("statement"), X.fact_key(text(f["statement"])).alias("key"), X.entity_key(text(f["object"])).alias("object")))
    one = one.withColumn("facts", F.filter(said, lambda f: F.array_contains(F.col("_k"), f["subject"]) & (f["key"] != "")))
    return one.select(*rows.columns, F.col("_p.passage").alias("number"), "entities", "relationships", "facts")


# possible duplicates of entities


@F.pandas_udf(DoubleType())
def spelled_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def duplicate_blocks(keys: DataFrame) -> DataFrame:
    """Pairs by the rules that need no spelling: words added at the end or in front, and initials. Each is an equi-join
    on the shorter key itself: the longer one offers all its proper prefixes, suffixes and its initials."""
    rows = keys.select("key").distinct().withColumn("w", F.split("key", " "))
    n = F.size("w")
    long = rows.where(n > 1)
    heads = long.select("key", F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice("w", 1, k), " "))).alias("other"))
    tails = long.where(n > 2).select("key", F.explode(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.array_join(F.slice("w", -k, k), " "))).alias("other"))
    initials = long.select("key", F.array_join(F.transform("w", lambda x: F.substring(x, 1, 1)), "").alias("other")).where(F.length("other").between(2, 6))
    every = rows.select(F.col("key").alias("other"))
    pairs = heads.unionByName(tails).unionByName(initials).join(every, "other", "left_semi")
    return pairs.where("key <> other").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def letters(key: Column) -> Column:
    """A name's letters as a set: each with how often it has come before."""
    held = F.array_sort(F.regexp_extract_all(key, F.lit("(?s)."), F.lit(0)))
    return F.transform(held, lambda c, i: F.concat(c, (i + 1 - F.array_position(held, c)).cast("string")))


def spelling_bounds(keys: DataFrame) -> DataFrame:
    """(a, b): pairs of the same first letters that share enough letters for the spelling ratio, which no order of the
    letters can exceed. An exact set join: in the order of all names' letters, rarest first, a pair that shares at least
    `need` letters shares two of the first (length - need + 2) of each name. So a name is met under pairs of its rarest
    letters instead of with its whole block, and a key of very many names is cut into tiles of TILE names."""
    rows = keys.select("key").distinct().where(F.length("key") >= START_CHARS)
    each = durable(rows.select("key", F.explode(letters(F.col("key"))).alias("t")))
    common = each.groupBy("t").agg(F.count("*").alias("n"))
    named = each.join(common, "t").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "t")))["t"].alias("ts"))
    size = F.size("ts")
    need = F.ceil(SIMILAR * size / (2 - SIMILAR) - 1e-9)
    named = durable(named.withColumn("first", F.slice("ts", 1, F.least(size, (size - need + 2).cast("int")))))
    some = F.flatten(F.transform("first", lambda x, i: F.transform(F.slice("first", i + 2, F.size("first")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    met = named.select("key", "ts", F.substring("key", 1, START_CHARS).alias("start"), F.explode(some).alias("p")).select("key", "ts", F.xxhash64("start", "p.x", "p.y").alias("h"))
    # of a name, a key is met once
    met = durable(met.dropDuplicates(["key", "h"]))
    tiles = met.groupBy("h").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = met.join(tiles, "h").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    a = met.select("h", "tile", F.col("key").alias("a"), F.col("ts").alias("ta"))
    b = met.select("h", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("key").alias("b"), F.col("ts").alias("tb"))
    la, lb = F.size("ta"), F.size("tb")
    same = F.substring("a", 1, START_CHARS) == F.substring("b", 1, START_CHARS)
    near = a.join(b, ["h", "tile"]).where((F.col("a") < F.col("b")) & same & (2 * F.least(la, lb) >= SIMILAR * (la + lb)))
    return near.where(2 * F.size(F.array_intersect("ta", "tb")) >= SIMILAR * (la + lb)).select("a", "b").distinct()


def continued(keys: DataFrame) -> DataFrame:
    """(a, b): names and longer ones that begin with them: the longer one offers all its beginnings."""
    rows = keys.select("key").distinct().where(F.length("key") >= START_CHARS)
    heads = F.transform(F.sequence(F.lit(START_CHARS), F.length("key") - 1), lambda n: F.substring("key", F.lit(1), n))
    return rows.where(F.length("key") > START_CHARS).select(F.explode(heads).alias("a"), F.col("key").alias("b")).join(rows.withColumnRenamed("key", "a"), "a", "left_semi")


def duplicate_candidates(keys: DataFrame) -> DataFrame:
    """(a, b): pairs of entity keys that might name one thing. Spelling is compared by the matcher only where the shared
    letters allow it."""
    close = durable(spelling_bounds(keys)).where(spelled_alike("a", "b") >= SIMILAR)
    return continued(keys).unionByName(close).unionByName(duplicate_blocks(keys)).distinct()


def same_as_edges(verdicts: DataFrame) -> DataFrame:
    """SAME_AS edges, from the lower key to the higher, of pairs (a, b, same) judged one thing."""
    return verdicts.where("same").select(ids.entity_id(F.least("a", "b")).alias("src"), F.lit("SAME_AS").alias("type"), ids.entity_id(F.greatest("a", "b")).alias("dst"))


def topic_nodes(topics: DataFrame, entity_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics with ids by their members' keys, IN_TOPIC edges) of find_topics()."""
    rows = topics.select("topic", "size", F.explode("members").alias("id")).join(entity_keys.select("id", "key"), "id")
    named = rows.groupBy("topic", "size").agg(F.collect_list("key").alias("keys"))
    named = named.withColumn("topic_id", ids.topic_id(ids.keys_hash("keys")))
    edges = rows.join(named.select("topic", "topic_id"), "topic").select(F.col("id").alias("src"), F.lit("IN_TOPIC").alias("type"), F.col("topic_id").alias("dst"))
    return named.select(F.col("topic_id").alias("id"), "size", "keys"), edges


def message_window(messages: DataFrame, center: DataFrame, budget: int = 30_000) -> DataFrame:
    """Messages around a conversation's center (conversation_id, position) that fit a budget of characters, one side
    after the other, right first; a neighbour that does not fit closes its side.

    While both sides are open, what is used up to a neighbour is a running sum in the order of turns. The first step
    that does not fit, or at which a side has no more, closes that side; the other one goes on by its own running sum
    beside all that the closed side has taken. So windows over one conversation do it, in one shuffle, and spill.
    """
    rows = messages.select("conversation_id", "position", "role", "text").join(center.select("conversation_id", F.col("position").alias("center")), "conversation_id")
    whole = W.partitionBy("conversation_id")
    rows = rows.withColumn("_i", F.row_number().over(whole.orderBy("position", "role", "text")))
    rows = rows.withColumn("_o", F.col("_i") - F.min(F.when(F.col("position") == F.col("center"), F.col("_i"))).over(whole)).where("_o is not null")
    off, size = F.col("_o"), F.coalesce(F.length("text"), F.lit(0)).cast("long")
    # steps: 0 the center, 2k the k-th message after it, 2k + 1 the k-th before it
    rows = rows.withColumn("_step", F.abs(off) * 2 + (off < 0).cast("int")).withColumn("_side", F.signum(off.cast("double")).cast("int"))
    rows = rows.withColumn("_both", F.sum(size).over(whole.orderBy("_step").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_own", F.sum(size).over(W.partitionBy("conversation_id", "_side").orderBy("_step").rowsBetween(W.unboundedPreceding, 0)))
    ends = F.least(2 * (F.max(off).over(whole) + 1), 2 * (1 - F.min(off).over(whole)) + 1)
    rows = rows.withColumn("_shut", F.least(ends, F.coalesce(F.min(F.when((F.col("_both") > budget) & (off != 0), F.col("_step"))).over(whole), ends)))
    closed = F.when(F.col("_shut") % 2 == 0, 1).otherwise(-1)
    taken = (F.col("_step") < F.col("_shut")) & (F.col("_side") == closed)
    used = F.sum(F.when((off == 0) | taken, size).otherwise(0)).over(whole)
    rows = rows.withColumn("_in", (off == 0) | taken | ((F.col("_side") == -closed) & (used + F.col("_own") <= budget)))
    return rows.where("_in").select("conversation_id", "position", "role", "text")
