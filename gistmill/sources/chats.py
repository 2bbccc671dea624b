"""Chat exports to (conversations, messages, issues), by explicit schemas over JSON; trees are mended by pointer jumps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gistmill.functions import ids, markup
from gistmill.functions.text import clip
from gistmill.operators.graph import nearest_kept
from gistmill.operators.sessions import span, stretches
from gistmill.session import durable
from gistmill.sources import files

PART = "struct<type:string,text:string,language:string>"
#: Kinds of content that an export holds but never showed.
HIDDEN_CONTENT = ("thoughts", "reasoning_recap", "user_editable_context", "model_editable_context", "app_pairing_content")
ROOT_PARENT = "00000000-0000-4000-8000-000000000000"
PROMPTED = "Prompted "


@dataclass
class Imported:
    """What a reader found: conversations, their messages, and records it could not use."""

    conversations: DataFrame
    messages: DataFrame
    issues: DataFrame


def part(kind: str, text: Column, language: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"), (language if language is not None else F.lit(None).cast("string")).alias("language"))


def no_parts() -> Column:
    return F.array().cast(f"array<{PART}>")


def one_part(kind: str, text: Column, language: Column | None = None) -> Column:
    return F.when(F.coalesce(F.btrim(text) != "", F.lit(False)), F.array(part(kind, text, language))).otherwise(no_parts())


def rendered(parts: Column) -> Column:
    """A message's text: its non-empty parts, code in a fence, joined by blank lines."""
    shown = F.transform(F.filter(parts, lambda p: F.length(p["text"]) > 0), lambda p: F.when(p["type"] == "code", F.concat(F.lit("```"), F.coalesce(p["language"], F.lit("")), F.lit("\n"), p["text"], F.lit("\n```"))).otherwise(p["text"]))
    return F.array_join(shown, "\n\n")


def epoch(value: Column) -> Column:
    return F.timestamp_micros((value * 1_000_000).cast("long"))


def text_or_null(value: Column) -> Column:
    return F.when(value != "", value)


def _finish(convs: DataFrame, kept: DataFrame, tree: DataFrame) -> DataFrame:
    """Messages (conversation_id, external, ...) with ids and the parent: the nearest kept ancestor in the tree (conversation_id, external, parent)."""
    known = kept.select("conversation_id", "external").withColumn("kept", F.lit(True))
    nodes = tree.join(known, ["conversation_id", "external"], "left").select(F.col("conversation_id").alias("scope"), F.col("external").alias("id"), "parent", F.coalesce("kept", F.lit(False)).alias("kept"))
    anchor = nearest_kept(nodes).select(F.col("scope").alias("conversation_id"), F.col("id").alias("up"), "anchor")
    rows = kept.join(tree.select("conversation_id", "external", F.col("parent").alias("up")), ["conversation_id", "external"]).join(anchor, ["conversation_id", "up"], "left")
    return rows.withColumn("id", ids.message_id("conversation_id", "external")).withColumn("parent_id", F.when(F.col("anchor").isNotNull(), ids.message_id("conversation_id", "anchor"))).drop("up", "anchor")


MAPPING = "map<string,struct<parent:string,message:struct<author:struct<role:string,name:string>,create_time:double,content:struct<content_type:string,parts:array<variant>,text:string,language:string,title:string,url:string,result:string,summary:string>,metadata:struct<model_slug:string,is_visually_hidden_from_conversation:boolean,attachments:array<struct<name:string,mime_type:string>>>>>>"
CHATGPT = f"struct<title:string,create_time:double,update_time:double,conversation_id:string,id:string,default_model_slug:string,current_node:string,is_archived:boolean,mapping:{MAPPING}>"


def chatgpt_parts(content: Column) -> Column:
    kind = F.coalesce(content["content_type"], F.lit("text"))

    def piece(v: Column) -> Column:
        text, own = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$.content_type", "string")
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        heard = F.try_variant_get(v, "$.text", "string")
        return (
            F.when(~is_object & F.schema_of_variant(v).isin("STRING") & (F.btrim(text) != ""), part("text", text))
            .when(is_object & (own == "audio_transcription") & (heard != ""), part("text", heard))
            .when(is_object & (own == "image_asset_pointer"), part("other", F.lit("[image]")))
            .when(is_object & (own != "") & (own != "audio_transcription"), part("other", F.concat(F.lit("["), own, F.lit("]"))))
        )

    pieces = F.filter(F.transform(content["parts"], piece), lambda p: p.isNotNull())
    quote = F.concat_ws("\n", *[text_or_null(content[k]) for k in ("title", "url", "text")])
    language = F.when(content["language"] != "unknown", text_or_null(content["language"]))
    return (
        F.when(kind.isin(*HIDDEN_CONTENT), no_parts())
        .when(kind == "code", one_part("code", content["text"], language))
        .when(kind.isin("execution_output", "system_error"), one_part("other", content["text"]))
        .when(kind == "tether_quote", one_part("other", quote))
        .when(kind == "tether_browsing_display", one_part("other", F.coalesce(text_or_null(content["result"]), content["summary"])))
        .when(content["parts"].isNotNull(), pieces)
        .otherwise(one_part("other", content["text"]))
    )


def _records(spark: SparkSession, path: str, name: str, nearest: bool, read: Callable[[DataFrame], Imported]) -> Imported:
    """An export below a path or in archives there; a path that names a JSON file itself is read in splits."""
    if path.lower().endswith(".json"):
        items, bad = files.json_records(spark, path)
    else:
        found = files.scan(spark, path, name)
        rows = durable(files.json_rows(files.nearest(found) if nearest else found))
        items, bad = rows.where("issue is null").drop("issue"), rows.where("issue is not null").select(F.element_at(F.split("path", "/"), -1).alias("label"), F.col("issue").alias("reason"))
    got = read(items)
    return replace(got, issues=got.issues.unionByName(bad))


def chatgpt(spark: SparkSession, path: str) -> Imported:
    """Conversations of a `conversations.json` whose messages hang in a mapping."""
    return _records(spark, path, "conversations.json", True, chatgpt_records)


def chatgpt_records(items: DataFrame) -> Imported:
    """The same of records (path, index, record) in hand."""
    raw = items.withColumn("r", F.from_json("record", CHATGPT))
    external = F.coalesce(text_or_null(F.col("r.conversation_id")), text_or_null(F.col("r.id")))
    raw = raw.withColumn("external_id", external)
    label = F.coalesce(text_or_null(F.col("r.title")), F.concat(F.lit("conversation #"), F.col("index").cast("string")))
    bad = F.when(F.col("r.mapping").isNull(), "not a conversation (no mapping)").when(F.col("external_id").isNull(), "conversation has no id")
    issues = raw.where(bad.isNotNull()).select(label.alias("label"), bad.alias("reason"))
    good = raw.where(bad.isNull()).withColumn("conversation_id", ids.conversation_id(F.lit("chatgpt"), "external_id"))
    nodes = good.select("conversation_id", F.explode(F.map_entries("r.mapping")).alias("e")).select("conversation_id", F.col("e.key").alias("external"), F.col("e.value.parent").alias("parent"), F.col("e.value.message").alias("m"))
    nodes = nodes.withColumn("content", F.coalesce(chatgpt_parts(F.col("m.content")), no_parts()))
    shown = F.col("m").isNotNull() & ~F.coalesce(F.col("m.metadata.is_visually_hidden_from_conversation"), F.lit(False)) & F.col("m.author.role").isin("user", "assistant", "system", "tool") & F.exists("content", lambda p: F.btrim(p["text"]) != "")
    attachments = F.transform(F.filter(F.coalesce("m.metadata.attachments", F.array().cast("array<struct<name:string,mime_type:string>>")), lambda a: a["name"] != ""), lambda a: F.struct(a["name"].alias("name"), a["mime_type"].alias("mime")))
    kept = nodes.where(shown).select("conversation_id", "external", F.col("m.author.role").alias("role"), epoch(F.col("m.create_time")).alias("created_at"), "content", attachments.alias("attachments"), text_or_null(F.col("m.metadata.model_slug")).alias("model"))
    rows = _finish(good, kept, nodes.select("conversation_id", "external", "parent"))
    order = W.partitionBy("conversation_id").orderBy(F.col("created_at").asc_nulls_last(), "id")
    rows = rows.withColumn("position", (F.row_number().over(order) - 1).cast("long")).withColumn("text", rendered(F.col("content")))
    # the leaf: the nearest kept node at or above the one on screen
    known = kept.select("conversation_id", "external").withColumn("kept", F.lit(True))
    walk = nodes.join(known, ["conversation_id", "external"], "left").select(F.col("conversation_id").alias("scope"), F.col("external").alias("id"), "parent", F.coalesce("kept", F.lit(False)).alias("kept"))
    leaf = nearest_kept(walk).select(F.col("scope").alias("conversation_id"), F.col("id").alias("current_node"), "anchor")
    last_model = rows.groupBy("conversation_id").agg(F.max_by("model", F.when(F.col("model").isNotNull(), F.col("position"))).alias("last_model"), F.count("*").alias("message_count"))
    convs = good.select("conversation_id", "external_id", "r.*").drop("conversation_id", "id", "mapping").withColumn("conversation_id", ids.conversation_id(F.lit("chatgpt"), "external_id"))
    convs = convs.join(leaf, ["conversation_id", "current_node"], "left").join(last_model, "conversation_id", "left")
    out = convs.select(F.col("conversation_id").alias("id"), F.lit("chatgpt").alias("source"), "external_id", text_or_null(F.col("title")).alias("title"), epoch(F.col("create_time")).alias("created_at"), epoch(F.col("update_time")).alias("updated_at"), F.coalesce(text_or_null(F.col("default_model_slug")), "last_model").alias("model"), F.when(F.col("anchor").isNotNull(), ids.message_id("conversation_id", "anchor")).alias("current_leaf_id"), F.coalesce("message_count", F.lit(0)).alias("message_count"))
    return Imported(out, rows, issues)


BLOCK = "struct<type:string,text:string,name:string,input:variant,content:variant,is_error:boolean,hidden_in_chat:boolean>"
CLAUDE = f"struct<uuid:string,name:string,summary:string,created_at:string,updated_at:string,chat_messages:array<struct<uuid:string,parent_message_uuid:string,sender:string,text:string,content:array<{BLOCK}>,created_at:string,attachments:array<struct<file_name:string,file_type:string,extracted_content:string>>,files:array<struct<file_name:string>>>>>"


def claude_parts(m: Column) -> Column:
    def tool_text(content: Column) -> Column:
        nested = F.transform(F.try_variant_get(content, "$", "array<struct<text:string>>"), lambda b: text_or_null(b["text"]))
        return F.btrim(F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.array_join(nested, "\n")))

    def block(b: Column) -> Column:
        result = tool_text(b["content"])
        return (
            F.when(F.coalesce(b["hidden_in_chat"], F.lit(False)), None)
            .when((b["type"] == "text") & (F.btrim(b["text"]) != ""), part("text", b["text"]))
            .when(b["type"] == "tool_use", part("other", F.concat(F.lit("[tool call: "), F.coalesce(text_or_null(b["name"]), F.lit("tool")), F.lit("]\n"), F.coalesce(F.to_json(b["input"]), F.lit("null")))))
            .when((b["type"] == "tool_result") & (result != ""), part("other", F.concat(F.when(b["is_error"], "[tool error]\n").otherwise("[tool result]\n"), result)))
        )

    blocks = F.coalesce(F.filter(F.transform(m["content"], block), lambda p: p.isNotNull()), no_parts())
    body = F.when(F.size(blocks) > 0, blocks).otherwise(one_part("text", m["text"]))
    extracted = F.transform(F.filter(m["attachments"], lambda a: F.btrim(a["extracted_content"]) != ""), lambda a: part("other", F.concat(F.lit("[attachment: "), F.coalesce(text_or_null(a["file_name"]), F.lit("attachment")), F.lit("]\n"), a["extracted_content"])))
    return F.concat(body, F.coalesce(extracted, no_parts()))


def claude(spark: SparkSession, path: str) -> Imported:
    """Conversations of a `conversations.json` of chat_messages, with branches or without."""
    return _records(spark, path, "conversations.json", True, claude_records)


def claude_records(items: DataFrame) -> Imported:
    """The same of records (path, index, record) in hand."""
    raw = items.withColumn("r", F.from_json("record", CLAUDE))
    label = F.coalesce(text_or_null(F.col("r.name")), F.concat(F.lit("conversation #"), F.col("index").cast("string")))
    bad = F.when(F.col("r.chat_messages").isNull(), "not a conversation (no chat_messages)").when(text_or_null(F.col("r.uuid")).isNull(), "conversation has no uuid")
    good = raw.where(bad.isNull()).withColumn("conversation_id", ids.conversation_id(F.lit("claude"), "r.uuid"))
    each = good.select("conversation_id", label.alias("label"), F.posexplode("r.chat_messages").alias("at", "m")).where(text_or_null(F.col("m.uuid")).isNotNull())
    each = each.withColumn("_r", F.row_number().over(W.partitionBy("conversation_id", "m.uuid").orderBy("at"))).where("_r = 1").drop("_r")
    names = F.concat(F.transform(F.coalesce("m.attachments", F.array().cast("array<struct<file_name:string,file_type:string,extracted_content:string>>")), lambda a: F.struct(F.coalesce(text_or_null(a["file_name"]), F.lit("attachment")).alias("name"), text_or_null(a["file_type"]).alias("mime"))), F.transform(F.filter(F.coalesce("m.files", F.array().cast("array<struct<file_name:string>>")), lambda f: f["file_name"] != ""), lambda f: F.struct(f["file_name"].alias("name"), F.lit(None).cast("string").alias("mime"))))
    each = each.withColumn("attachments", names).withColumn("parts", claude_parts(F.col("m")))
    shared = part("other", F.concat(F.lit("[files: "), F.array_join(F.transform("attachments", lambda a: a["name"]), ", "), F.lit("]")))
    each = each.withColumn("content", F.when((F.size("parts") == 0) & (F.size("attachments") > 0), F.array(shared)).otherwise(F.col("parts")))
    role = F.when(F.col("m.sender") == "human", "user").when(F.col("m.sender") == "assistant", "assistant")
    each = each.withColumn("role", role).withColumn("kept", F.col("role").isNotNull() & (F.size("content") > 0))
    per = each.groupBy("conversation_id", "label").agg(F.count("*").alias("n"), F.bool_or(F.col("kept") & F.exists("content", lambda p: p["type"] != "other")).alias("readable"), F.bool_or(text_or_null(F.col("m.parent_message_uuid")).isNotNull()).alias("tree"))
    blank = per.where("not readable").select("label", F.format_string("no readable messages (%d blank)", "n").alias("reason"))
    empty = good.join(per, "conversation_id", "left_anti").select(label.alias("label"), F.lit("no readable messages (0 blank)").alias("reason"))
    ok = per.where("readable").select("conversation_id", "tree")
    each = each.join(ok, "conversation_id")
    in_order = W.partitionBy("conversation_id").orderBy("at")
    kept = each.where("kept").select("conversation_id", F.col("m.uuid").alias("external"), "role", F.to_timestamp(F.try_to_timestamp("m.created_at")).alias("created_at"), "content", "attachments", F.lit(None).cast("string").alias("model"), "at", (F.row_number().over(in_order) - 1).cast("long").alias("position"), F.lag("m.uuid").over(in_order).alias("_before"))
    parent = F.when(F.col("m.parent_message_uuid") != ROOT_PARENT, text_or_null(F.col("m.parent_message_uuid")))
    real = each.where("tree").select("conversation_id", F.col("m.uuid").alias("external"), parent.alias("parent"))
    chain = kept.join(ok.where("not tree"), "conversation_id", "left_semi").select("conversation_id", "external", F.col("_before").alias("parent"))
    rows = _finish(good, kept.drop("_before"), real.unionByName(chain)).withColumn("text", rendered(F.col("content")))
    leaf = rows.join(ok.where("tree"), "conversation_id", "left_semi").groupBy("conversation_id").agg(F.max_by("id", F.struct(F.coalesce("created_at", F.to_timestamp(F.lit("0001-01-01"))), "position")).alias("current_leaf_id"))
    counts = rows.groupBy("conversation_id").agg(F.count("*").alias("message_count"))
    out = good.join(ok, "conversation_id", "left_semi").join(leaf, "conversation_id", "left").join(counts, "conversation_id")
    out = out.select(F.col("conversation_id").alias("id"), F.lit("claude").alias("source"), F.col("r.uuid").alias("external_id"), text_or_null(F.col("r.name")).alias("title"), F.try_to_timestamp("r.created_at").alias("created_at"), F.try_to_timestamp("r.updated_at").alias("updated_at"), F.lit(None).cast("string").alias("model"), "current_leaf_id", "message_count")
    issues = raw.where(bad.isNotNull()).select(label.alias("label"), bad.alias("reason")).unionByName(blank).unionByName(empty)
    return Imported(out, rows.drop("at"), issues)


GEMINI = "struct<header:string,title:string,time:string,products:array<string>,safeHtmlItem:array<struct<html:string>>>"


def gemini(spark: SparkSession, path: str, gap_minutes: int = 30) -> Imported:
    """Activity entries to conversations by gaps between prompts: a gap of more than the limit opens a new one."""
    return _records(spark, path, "MyActivity.json", False, lambda items: gemini_records(items, gap_minutes))


def gemini_records(items: DataFrame, gap_minutes: int = 30) -> Imported:
    """The same of records (path, index, record) in hand."""
    raw = items.withColumn("r", F.from_json("record", GEMINI))
    own = F.coalesce(F.col("r.header").contains("Gemini"), F.lit(False)) | F.coalesce(F.exists("r.products", lambda p: p.contains("Gemini")), F.lit(False))
    turns = raw.where(own).select("path", "index", F.try_to_timestamp("r.time").alias("time"), F.coalesce("r.title", F.lit("")).alias("title"), markup.reply_text(F.transform("r.safeHtmlItem", lambda x: x["html"])).alias("response"))
    prompt = F.when(F.col("title").startswith(PROMPTED), F.btrim(F.substring("title", len(PROMPTED) + 1, 1_000_000))).when(F.col("response") != "", F.btrim("title"))
    turns = turns.withColumn("prompt", prompt)
    label = F.concat(F.lit("activity #"), F.col("index").cast("string"))
    reason = F.when(F.col("time").isNull(), "entry has no usable time").when(F.col("prompt") == "", "prompt is empty")
    issues = turns.where(reason.isNotNull()).select(label.alias("label"), reason.alias("reason"))
    gap, micros = gap_minutes * 60_000_000, F.unix_micros("time")
    turns = durable(turns.where(reason.isNull() & F.col("prompt").isNotNull()).withColumn("k", span(micros, gap)))
    # an export is one person's activity, so its sessions run over the whole file; no task has a whole session
    spans = stretches(turns.groupBy("path", "k").agg(F.min(micros).alias("low"), F.max(micros).alias("high")), ["path"], gap)
    opens = spans.groupBy("path", "first").agg(F.timestamp_micros(F.min("low")).alias("opened"))
    turns = turns.join(spans.select("path", "k", "first").join(opens, ["path", "first"]).select("path", "k", F.col("opened").alias("first")), ["path", "k"]).withColumn("stamp", iso("time")).withColumn("external_id", iso("first")).withColumn("conversation_id", ids.conversation_id(F.lit("gemini"), "external_id"))
    both = turns.select("*", F.posexplode(F.when(F.col("response") != "", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("response").alias("text")))).otherwise(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text"))))).alias("half", "said"))
    rows = both.select("conversation_id", "k", ids.message_id("conversation_id", F.concat("stamp", F.lit(":"), F.col("said.role"))).alias("id"), F.col("said.role").alias("role"), F.col("time").alias("created_at"), F.array(part("text", F.col("said.text"))).alias("content"), F.col("said.text").alias("text"), "time", "index", "half", "external_id")
    # places inside a span of time, and after the spans before it
    place = F.struct("time", "index", "half")
    order, later = W.partitionBy("conversation_id", "k").orderBy("time", "index", "half"), W.partitionBy("conversation_id").orderBy("k")
    held = rows.groupBy("conversation_id", "k").agg(F.count("*").alias("n"), F.max_by("id", place).alias("end"))
    held = held.select("conversation_id", "k", F.coalesce(F.sum("n").over(later.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("end").over(later).alias("end"))
    convs = rows.groupBy("conversation_id", "external_id").agg(F.min("time").alias("created_at"), F.max("time").alias("updated_at"), F.count("*").alias("message_count"))
    # texts are compared among the turns that open a session alone: an aggregate of texts sorts its rows
    convs = convs.join(turns.where(F.col("time") == F.col("first")).groupBy("conversation_id").agg(F.min_by("prompt", "index").alias("_t")), "conversation_id")
    rows = rows.withColumn("_r", F.row_number().over(order) - 1).withColumn("_p", F.lag("id").over(order)).join(held, ["conversation_id", "k"])
    rows = rows.withColumn("position", (F.col("before") + F.col("_r")).cast("long")).withColumn("parent_id", F.coalesce("_p", "end")).drop("k", "_r", "_p", "before", "end")
    line = F.element_at(F.split("_t", "\r?\n"), 1)
    out = convs.select(F.col("conversation_id").alias("id"), F.lit("gemini").alias("source"), "external_id", clip_line(line).alias("title"), "created_at", "updated_at", F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("current_leaf_id"), "message_count")
    return Imported(out, rows.drop("time", "index", "half", "external_id"), issues)


def clip_line(line: Column) -> Column:
    return clip(line)


def iso(column: str) -> Column:
    """ISO text of a timestamp in UTC, without a fraction where it is whole."""
    base = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(column) % 1_000_000
    return F.concat(base, F.when(micros == 0, "").otherwise(F.format_string(".%06d", micros)), F.lit("+00:00"))
