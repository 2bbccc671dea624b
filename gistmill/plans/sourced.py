"""Queries of the readers: exports and documents are written from the driver's tables, read, and held against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.plans.adapt import table
from gistmill.plans.queries import query
from gistmill.session import shared_dir
from gistmill.sources import agents, chats, documents, files


def _documents(name: Column, content: Column, rows: DataFrame) -> DataFrame:
    """Notes of files made one a row."""
    return documents.read_documents(rows.select(name.alias("path"), name.alias("relative"), content.cast("binary").alias("content")))[0]


def _named(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


# files (S2, S3, S31)


@query("SELECT doc_id, length(text)::BIGINT AS chars, source FROM documents")
def json_array_in_splits(spark, sf_dir):
    """All documents written as JSON arrays of one line, and read again split by split."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text", "source")).alias("r"))
    folder = f"{shared_dir(spark).rstrip('/')}/arrays_{uuid.uuid4().hex}"
    arrays = rows.groupBy((F.xxhash64("doc_id") % 64).alias("h")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ", "), F.lit("]")).alias("value"))
    arrays.select("value", F.monotonically_increasing_id().alias("file")).write.partitionBy("file").text(folder)
    record = F.from_json("record", "doc_id long, text string, source string")
    return files.json_records(spark, folder)[0].select(record.alias("r")).select("r.doc_id", F.length("r.text").cast("long").alias("chars"), "r.source")


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN p_partkey || '.zip' WHEN 1 THEN p_partkey || '.txt' ELSE p_partkey || '.tar' END AS member, p_partkey % 3 = 0 AS left_out, CASE WHEN p_partkey % 3 <> 0 THEN length(p_name)::INT END AS n_bytes FROM part")
def broken_archives(spark, sf_dir):
    """Zips without a directory beside files that can be read."""
    p, kind = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    name = F.concat(F.col("p_partkey").cast("string"), F.when(kind == 0, ".zip").when(kind == 1, ".txt").otherwise(".tar"))
    content = F.concat(F.when(kind == 0, F.unhex(F.lit("504B0304"))).otherwise(F.unhex(F.lit(""))), F.col("p_name").cast("binary"))
    found = files.opened(p.select(name.alias("path"), content.alias("content")))
    return found.select("member", F.col("issue").isNotNull().alias("left_out"), F.octet_length("content").alias("n_bytes"))


# documents (S15-S29)


@query("SELECT 's' || s_suppkey || '.csv' AS relative, 's' || s_suppkey AS title, 'name: ' || s_name || ', \"Ltd\" | nation: ' || s_nationkey || chr(10) || 'name: again' AS text FROM supplier")
def csv_documents(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    content = _named('name,empty,nation\n,,\n"', F.col("s_name"), ', ""Ltd""",,', F.col("s_nationkey"), ",beyond\n\nagain\n")
    return _documents(_named("s", F.col("s_suppkey"), ".csv"), content, s).select("relative", "title", "text")


@query("SELECT event_id || '.json' AS relative, 'event.id: ' || event_id || chr(10) || 'event.tags[0]: ' || event_type || chr(10) || 'event.tags[1][0]: ' || user_id || coalesce(chr(10) || 'event.props.k: ' || json_extract_string(props, '$.k'), '') AS text FROM events")
def flatten_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    content = _named('{"event": {"id": ', F.col("event_id"), ', "none": null, "blank": " ", "tags": ["', F.col("event_type"), '", [', F.col("user_id"), ']], "props": ', F.col("props"), "}}")
    return _documents(_named(F.col("event_id"), ".json"), content, e).select("relative", "text")


@query("SELECT doc_id || '.jsonl' AS relative, 'quality: ' || quality || chr(10) || chr(10) || 'toxic: ' || toxic AS text FROM labels")
def flatten_json_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return _documents(_named(F.col("doc_id"), ".jsonl"), _named('{"quality": ', F.col("quality"), '}\n\n{"toxic": ', F.col("toxic"), "}\n"), rows).select("relative", "text")


@query("SELECT p_partkey || '.xml' AS relative, p_name || chr(10) || p_brand AS text FROM part")
def xml_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    content = _named("<part>\n  <name>  ", F.regexp_replace("p_name", " ", "\n"), " </name><brand kind='x'>", F.col("p_brand"), "</brand><none/></part>")
    return _documents(_named(F.col("p_partkey"), ".xml"), content, p).select("relative", "text")


@query("SELECT p_partkey || '.rtf' AS relative, p_name || chr(10) || p_brand AS text FROM part")
def rtf_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    content = _named("{\\rtf1\\ansi{\\*\\generator x;}\\b ", F.col("p_name"), "\\b0\\par\\par ", F.col("p_brand"), "}")
    return _documents(_named(F.col("p_partkey"), ".rtf"), content, p).select("relative", "text")


@query("SELECT n_nationkey || '.md' AS relative, 'Land ' || n_name AS title, '# H' || chr(10) || n_name AS text, '2024-01-02T00:00:00' AS created_at, 'markdown' AS source, '[[' || n_name || ']]' AS link FROM nation")
def markdown_notes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    content = _named("---\ntitle: Land ", F.col("n_name"), "\ncreated: 2024-01-02\n---\n\n# H\n", F.col("n_name"), "\n\n")
    return _documents(_named(F.col("n_nationkey"), ".md"), content, n).select("relative", "title", "text", "created_at", "source", _named("[[", F.regexp_extract("title", "Land (.*)", 1), "]]").alias("link"))


@query(f"SELECT '<' || conv_id || '.' || turn || '>' AS external_id, 'c' || conv_id AS title, 'From: ' || role || '@x.org' || chr(10) || 'To: y@x.org' || chr(10) || chr(10) || {_STRIP.format('text')} AS text, '2026-01-05T10:00:00+00:00' AS created_at FROM conversations WHERE {_STRIP.format('text')} <> ''")
def email_messages(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").where("text is not null")
    head = _named("From: ", F.col("role"), "@x.org\nTo: y@x.org\nSubject: c", F.col("conv_id"), "\nMessage-ID: <", F.col("conv_id"), ".", F.col("turn"), ">\nDate: Mon, 05 Jan 2026 10:00:00 +0000\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n")
    strip = F.regexp_replace(F.col("text"), r"(?U)^\s+|\s+$", "")
    rows = _documents(_named(F.col("conv_id"), "-", F.col("turn"), ".eml"), F.concat(head, strip, F.lit("\n")), m)
    return rows.select("external_id", "title", "text", "created_at")


@query("SELECT name, CASE WHEN name LIKE '%.png' THEN 'not a kind of file that is read' WHEN name LIKE '%.txt' THEN 'it is empty' WHEN name LIKE '%.log' THEN 'it holds no text' ELSE 'it could not be read' END AS reason FROM (SELECT n_nationkey || unnest(['.png', '.txt', '.log', '.json']) AS name FROM nation)")
def unreadable_documents(spark, sf_dir):
    kinds = F.explode(F.array(F.lit(".png"), F.lit(".txt"), F.lit(".log"), F.lit(".json")))
    n = table(spark, sf_dir, "nation").select("n_nationkey", kinds.alias("kind")).select(F.concat(F.col("n_nationkey").cast("string"), "kind").alias("relative"))
    skipped = documents.read_documents(n.select(F.col("relative").alias("path"), "relative", F.lit(" {").cast("binary").alias("content")).withColumn("content", F.when(F.col("relative").rlike("txt|log"), F.lit(b" \n")).otherwise(F.col("content"))))[1]
    return skipped.select(F.col("relative").alias("name"), F.regexp_extract("reason", "^[^:]*", 0).alias("reason"))


# exports (S1, S4-S13, T1)

_TURNS = f"(SELECT *, {_STRIP.format('coalesce(text, chr(32))')} <> '' AS said FROM conversations)"


def _digest(prefix: str, *parts: str) -> str:
    return f"'{prefix}' || substr(sha256({' || chr(31) || '.join(parts)}), 1, 24)"


def _export_sql(source: str, kept: str, key: str, turn: str = "turn") -> str:
    conv = _digest("conv_", f"'{source}'", "'c' || conv_id")
    return f"""WITH k AS (SELECT *, {conv} AS conversation_id FROM {_TURNS} WHERE said AND {kept}), m AS (SELECT *, {_digest('msg_', 'conversation_id', key)} AS id FROM k)
SELECT conversation_id, id, lag(id) OVER w AS parent_id, (row_number() OVER w - 1)::BIGINT AS position, role, text FROM m WINDOW w AS (PARTITION BY conversation_id ORDER BY {turn})"""


def _conversations(spark, sf_dir, record: Column, rows: DataFrame) -> DataFrame:
    """Items (path, index, record), one a conversation, from its turns as an array of rows."""
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return per.select(F.lit("export").alias("path"), F.col("conv_id").alias("index"), record.alias("record"))


@query(_export_sql("chatgpt", "role <> 'system'", "'t' || turn"))
def chatgpt_export(spark, sf_dir):
    """Turns as a mapping; those of the system are hidden and their children hang higher."""

    def node(t: Column) -> Column:
        message = F.struct(
            F.struct(t["role"].alias("role")).alias("author"), t["turn"].cast("double").alias("create_time"), F.struct(F.lit("text").alias("content_type"), F.array(t["text"]).alias("parts")).alias("content"),
            F.struct((t["role"] == "system").alias("is_visually_hidden_from_conversation")).alias("metadata"),
        )
        parent = F.when(t["turn"] > 0, F.concat(F.lit("t"), (t["turn"] - 1).cast("string"))).otherwise("root")
        return F.struct(F.concat(F.lit("t"), t["turn"].cast("string")).alias("key"), F.struct(parent.alias("parent"), message.alias("message")).alias("value"))

    record = F.to_json(F.struct(_named("c", F.col("conv_id")).alias("conversation_id"), F.lit("T").alias("title"), _named("t", F.array_max("turns")["turn"]).alias("current_node"), F.map_from_entries(F.transform("turns", node)).alias("mapping")))
    return chats.chatgpt_records(_conversations(spark, sf_dir, record, table(spark, sf_dir, "conversations"))).messages.select("conversation_id", "id", "parent_id", "position", "role", "text")


@query(_export_sql("claude", "role <> 'system'", "'m' || turn"))
def claude_export(spark, sf_dir):
    def message(t: Column) -> Column:
        sender = F.when(t["role"] == "user", "human").otherwise(t["role"])
        return F.struct(_named("m", t["turn"]).alias("uuid"), sender.alias("sender"), t["text"].alias("text"))

    record = F.to_json(F.struct(_named("c", F.col("conv_id")).alias("uuid"), F.lit("N").alias("name"), F.transform("turns", message).alias("chat_messages")))
    return chats.claude_records(_conversations(spark, sf_dir, record, table(spark, sf_dir, "conversations"))).messages.select("conversation_id", "id", "parent_id", "position", "role", "text")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (ORDER BY ts, event_id)), r AS (SELECT *, sum(s) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT 'ask ' || arg_min(event_id, (ts, event_id)) AS title, (2 * count(*))::BIGINT AS message_count, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us FROM r GROUP BY k""")
def gemini_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    html = F.concat(F.lit("<p>"), F.col("event_type"), F.lit("</p><ul><li>"), F.col("user_id").cast("string"), F.lit("</li></ul><style>x</style>"))
    record = F.to_json(F.struct(F.lit("Gemini Apps").alias("header"), _named("Prompted ask ", F.col("event_id")).alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.array(F.struct(html.alias("html"))).alias("safeHtmlItem")))
    found = chats.gemini_records(e.select(F.lit("MyActivity.json").alias("path"), F.col("event_id").alias("index"), record.alias("record"))).conversations
    return found.select("title", "message_count", F.unix_micros("created_at").alias("started_us"), F.unix_micros("updated_at").alias("ended_us"))


@query("SELECT event_id, event_type || chr(10) || chr(10) || '- ' || user_id || chr(10) || '- <b>' AS text FROM events")
def reply_html(spark, sf_dir):
    from gistmill.functions import markup

    html = F.concat(F.lit("<p>"), F.col("event_type"), F.lit("</p>\n\n<ul><li>"), F.col("user_id").cast("string"), F.lit("</li><li> &lt;b&gt;</li></ul><script>if (a < b) x</script>"))
    return table(spark, sf_dir, "events").select("event_id", markup.reply_text(F.array(html)).alias("text"))


@query(f"""WITH k AS (SELECT *, 'c' || conv_id AS path, 'u' || turn AS key FROM {_TURNS} WHERE said AND role <> 'system')
SELECT path, key, lag(key) OVER w AS parent, role, text, 'c' || conv_id AS session, last_value(key) OVER (PARTITION BY path ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS leaf FROM k WINDOW w AS (PARTITION BY path ORDER BY turn)""")
def code_sessions(spark, sf_dir):
    """Turns as records of a coding agent; those of the system are meta records, and answers come as two blocks."""
    t = table(spark, sf_dir, "conversations").where("text is not null")
    half = F.greatest(F.floor(F.length("text") / 2), F.lit(1)).cast("int")
    blocks = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    content = F.when(F.col("role") == "assistant", F.to_json(blocks)).otherwise(F.to_json(F.struct(F.col("text").alias("x"))))
    whole = F.when(F.col("role") == "assistant", content).otherwise(F.regexp_extract(content, r'^\{"x":(.*)\}$', 1))
    kind = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    parent = F.when(F.col("turn") > 0, _named('"u', F.col("turn") - 1, '"')).otherwise("null")
    record = _named('{"type":"', kind, '","uuid":"u', F.col("turn"), '","parentUuid":', parent, ',"sessionId":"c', F.col("conv_id"), '","isMeta":', F.when(F.col("role") == "system", "true").otherwise("false"), ',"message":{"content":', whole, "}}")
    lines = t.where(half > 0).select(_named("c", F.col("conv_id")).alias("path"), F.col("turn").cast("int").alias("line"), F.parse_json(record).alias("v"))
    return agents.code_sessions(lines).select("path", "key", "parent", "role", F.array_join(F.transform("content", lambda p: p["text"]), "\n").alias("text"), "session", "leaf")


@query(f"""WITH k AS (SELECT *, 'c' || conv_id AS path FROM {_TURNS} WHERE said AND role <> 'system'), s AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS s FROM k WINDOW w AS (PARTITION BY path ORDER BY turn)),
r AS (SELECT *, sum(s) OVER (PARTITION BY path ORDER BY turn) - 1 AS run FROM s)
SELECT path, run::BIGINT::VARCHAR AS key, any_value(role) AS role, string_agg(text, '|' ORDER BY turn) AS text FROM r GROUP BY path, run""")
def codex_sessions(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("text is not null")
    record = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.col("role"), F.array(F.struct("text")).alias("content")).alias("payload")))
    lines = t.select(_named("c", F.col("conv_id")).alias("path"), F.col("turn").cast("int").alias("line"), F.parse_json(record).alias("v"))
    return agents.codex_sessions(lines).select("path", "key", "role", F.array_join(F.transform("content", lambda p: p["text"]), "|").alias("text"))


@query("SELECT event_id, ['chatgpt', 'claude', 'gemini', 'markdown', NULL][event_id % 5 + 1] AS kind FROM events")
def detected_exports(spark, sf_dir):
    k = F.col("event_id") % 5
    record = F.when(k == 0, '{"mapping": {}, "title": 1}').when(k == 1, '{"chat_messages": []}').when(k == 2, '{"header": "x", "time": null}').otherwise("[]")
    return table(spark, sf_dir, "events").select("event_id", files.export_kind(record, F.when(k == 3, "A.MD").otherwise("a.bin")).alias("kind"))


@query("SELECT 'f' || user_id AS path, CASE WHEN user_id % 3 = 0 THEN 'claude_code' ELSE 'codex' END AS kind FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 <> 2")
def detected_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    k = F.col("user_id") % 3
    record = F.when(k == 0, '{"type": "user", "sessionId": "s"}').when(k == 1, '{"type": "session_meta", "payload": {"id": 1}}').otherwise('{"type": "user"}')
    lines = e.select(_named("f", F.col("user_id")).alias("path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("line"), record.alias("record"))
    return files.session_kind(lines.where("line = 2"))


@query("SELECT event_id, epoch_us(ts) // 1000 * 1000 AS us, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS word FROM events")
def parsed_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) / 1000.0
    return e.select("event_id", F.unix_micros(chats.epoch(seconds)).alias("us"), chats.text_or_null(F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type"))).alias("word")).withColumn("us", (F.round(F.col("us") / 1000) * 1000).cast("long"))
