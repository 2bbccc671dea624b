"""Everything below a path at once: chat exports and agent sessions to their readers, the rest as documents.

Files are told apart as columns of one scan: an export by its name and first record, a session by its first lines.
What lies beside an export is part of it and is no document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.session import durable
from gistmill.sources import agents, chats, documents, files

#: Names of export files, files that are never read, and how exports are called.
EXPORT_FILES = ("conversations.json", "myactivity.json")
SKIPPED_FILES = (".ds_store", "thumbs.db", "desktop.ini")
SHOWN = {"chatgpt": "ChatGPT", "claude": "Claude", "gemini": "Gemini"}
MESSAGE = ("source", "conversation_id", "id", "parent_id", "position", "role", "text")


@dataclass
class Intake:
    """What was found: messages of all sources alike, what could not be used and why, and conversations of each source."""

    messages: DataFrame
    issues: DataFrame
    skipped: DataFrame
    counts: DataFrame


def sorted_out(found: DataFrame, root: str) -> DataFrame:
    """Files with `relative`, and `kind`: an export's or session's source, document, or null with a `reason` to skip it."""
    rows = found.withColumn("relative", documents.below(F.col("member"), root)).withColumn("name", F.lower(F.element_at(F.split("relative", "/"), -1)))
    # a member of an archive lies in a folder of that archive
    rows = rows.withColumn("file", F.when(F.col("member") == F.col("path"), F.col("path")).otherwise(F.concat_ws("/", "path", "member"))).withColumn("folder", F.regexp_replace("file", "[^/]*$", ""))
    hidden = F.exists(F.slice(F.split("relative", "/"), 1, F.size(F.split("relative", "/")) - 1), lambda x: x.startswith(".") | x.isin(*documents.SKIPPED_FOLDERS))
    rows = rows.where(~hidden & ~F.col("name").isin(*SKIPPED_FILES) & ~F.col("name").startswith("._"))
    first = F.to_json(F.try_variant_get(F.try_parse_json(F.when(F.col("name").isin(*EXPORT_FILES), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", ""))), "$[0]", "variant"))
    export = F.when(F.col("name").isin(*EXPORT_FILES), files.export_kind(first, F.lit("")))
    rows = durable(rows.withColumn("export", F.when((F.col("name") == "myactivity.json") & ~export.eqNullSafe("gemini"), "other").otherwise(export)))
    sessions = files.session_kind(files.lines_of(rows.where("name like '%.jsonl'").select(F.col("file").alias("path"), "content"))[0]).select(F.col("path").alias("file"), F.col("kind").alias("session"))
    beside = rows.where("export is not null and export <> 'other'").groupBy("folder").agg(F.min("export").alias("of"))
    rows = rows.join(sessions, "file", "left").join(beside, "folder", "left")
    names = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    claimed = F.col("of").isNotNull() & F.col("name").rlike(r"\.(json|html)$") & F.col("export").isNull()
    reason = F.when(F.col("export") == "other", "activity for another product").when(claimed, F.concat(F.lit("part of the "), names[F.col("of")], F.lit(" export")))
    kind = F.when(reason.isNull(), F.coalesce("export", "session", F.lit("document")))
    return rows.select("path", "member", "relative", "depth", "content", "file", kind.alias("kind"), reason.alias("reason"))


def read_intake(spark: SparkSession, path: str) -> Intake:
    """Exports first, then documents, each by its reader."""
    root = path.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    found = durable(files.scan_all(spark, path))
    closed = found.where("issue is not null").select(documents.below(F.col("member"), root).alias("relative"), F.col("issue").alias("reason"))
    rows = durable(sorted_out(found.where("issue is null").drop("issue"), root))
    made, issues = [], []

    def keep(source: Column, messages: DataFrame) -> None:
        made.append(messages.withColumn("source", source).select(*MESSAGE))

    for kind, read in (("chatgpt", chats.chatgpt_records), ("claude", chats.claude_records), ("gemini", chats.gemini_records)):
        items = durable(files.json_rows(rows.where(F.col("kind") == kind).select(F.col("file").alias("path"), "content")))
        got = read(items.where("issue is null").drop("issue"))
        keep(F.lit(kind), got.messages)
        issues += [got.issues, items.where("issue is not null").select(F.element_at(F.split("path", "/"), -1).alias("label"), F.col("issue").alias("reason"))]
    lines, bad = files.lines_of(rows.where("kind in ('claude_code', 'codex')").select(F.col("file").alias("path"), "content"))
    sessions, silent = agents.session_messages(lines, rows.where("kind in ('claude_code', 'codex')").select(F.col("file").alias("path"), "kind"))
    keep(F.col("source"), sessions.withColumn("text", F.array_join(F.transform("content", lambda p: p["text"]), "\n\n")))
    notes, skipped = documents.read_documents(rows.where("kind = 'document'"))
    keep(F.col("source"), notes.select("source", F.col("id").alias("conversation_id"), F.col("message_id").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("position"), F.lit("user").alias("role"), "text"))
    every, told = made[0], bad.unionByName(silent)
    for m in made[1:]:
        every = every.unionByName(m)
    for i in issues:
        told = told.unionByName(i)
    every = durable(every)
    counts = every.groupBy("source").agg(F.countDistinct("conversation_id").alias("conversations"), F.count("*").alias("messages"))
    return Intake(every, told, rows.where("reason is not null").select("relative", "reason").unionByName(skipped).unionByName(closed), counts)
