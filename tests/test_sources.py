import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gistmill.operators import graph
from gistmill.sources import agents, archive, chats, documents, files


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else (data if isinstance(data, str) else json.dumps(data)).encode())
    return str(path)


def node(parent, role, said, at=None, **content):
    body = {"content_type": "text", "parts": [said]} | content
    return {"parent": parent, "message": {"author": {"role": role}, "create_time": at, "content": body, "metadata": {"model_slug": "m1" if role == "assistant" else None}}}


def test_mapping_export(spark, tmp_path):
    hidden = node("root", "system", "secret", 1.0)
    hidden["message"]["metadata"]["is_visually_hidden_from_conversation"] = True
    mapping = {
        "root": {"parent": None, "message": None}, "h": hidden, "u": node("h", "user", "How?", 2.0), "a1": node("u", "assistant", "So.", 3.0), "a2": node("u", "assistant", "Thus.", 4.0),
        "t": node("a2", "assistant", None, 5.0, content_type="thoughts"), "c": node("t", "assistant", None, 6.0, content_type="code", text="x = 1", language="unknown"),
        "i": node("c", "user", None, 7.0, parts=[{"content_type": "image_asset_pointer"}, "look", {"content_type": "audio_transcription", "text": "hi"}]),
    }
    export = [{"title": "T", "conversation_id": "x1", "current_node": "t", "create_time": 1.5, "mapping": mapping}, {"title": "none"}, {"mapping": {}, "title": "no id"}]
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("deep/conversations.json", "﻿" + json.dumps(export))
    got = chats.chatgpt(spark, str(tmp_path))
    m = {r.external: r for r in got.messages.collect()}
    assert set(m) == {"u", "a1", "a2", "c", "i"} and [r.external for r in got.messages.orderBy("position").collect()] == ["u", "a1", "a2", "c", "i"]
    assert m["u"].parent_id is None and m["a2"].parent_id == m["u"].id and m["c"].parent_id == m["a2"].id
    assert m["c"].content[0].type == "code" and m["c"].content[0].language is None and [p.text for p in m["i"].content] == ["[image]", "look", "hi"]
    c = got.conversations.first()
    assert c.current_leaf_id == m["a2"].id and c.model == "m1" and c.message_count == 5
    assert sorted(r.reason for r in got.issues.collect()) == ["conversation has no id", "not a conversation (no mapping)"]


def test_branching_export(spark, tmp_path):
    def say(uuid, parent, sender, text, at, **more):
        return {"uuid": uuid, "parent_message_uuid": parent, "sender": sender, "text": text, "created_at": at} | more

    tree = [
        say("1", chats.ROOT_PARENT, "human", "hi", "2026-01-01T10:00:00Z"), say("2", "1", "assistant", "", "2026-01-01T10:01:00Z", content=[{"type": "thinking", "text": "hm"}, {"type": "text", "text": "yes"}, {"type": "tool_use", "name": "calc", "input": {"b": 1, "a": 2}}, {"type": "tool_result", "content": [{"type": "text", "text": "3"}], "is_error": True}, {"type": "text", "text": "no", "hidden_in_chat": True}]),
        say("3", "1", "assistant", "again", "2026-01-01T10:02:00Z"), say("4", "9", "human", "", None, files=[{"file_name": "a.png"}]),
    ]
    export = [{"uuid": "u1", "name": "N", "chat_messages": tree}, {"uuid": "u2", "name": "blank", "chat_messages": [say("5", None, "human", " ", None)]}, {"uuid": "u3", "name": "line", "chat_messages": [say("6", None, "human", "a", None), say("7", None, "assistant", "b", None)]}, {"uuid": "u4"}]
    got = chats.claude(spark, put(tmp_path / "conversations.json", export))
    m = {r.external: r for r in got.messages.collect()}
    assert set(m) == {"1", "2", "3", "4", "6", "7"} and m["7"].parent_id == m["6"].id and m["3"].parent_id == m["1"].id and m["1"].parent_id is None
    assert [p.text for p in m["2"].content] == ["yes", '[tool call: calc]\n{"a":2,"b":1}', "[tool error]\n3"] and m["4"].content[0].text == "[files: a.png]"
    leaf = {r.external_id: r.current_leaf_id for r in got.conversations.collect()}
    assert leaf == {"u1": m["3"].id, "u3": None}
    assert {r.label for r in got.issues.collect()} == {"blank", "conversation #3"}


def test_activity_sessions(spark, tmp_path):
    def act(time, title, html=None, header="Gemini Apps"):
        return {"header": header, "title": title, "time": time, "safeHtmlItem": [{"html": html}] if html else None}

    acts = [
        act("2026-01-01T11:00:00Z", "Prompted third", "<p>c</p>"), act("2026-01-01T10:30:00Z", "Prompted second"), act("2026-01-01T10:00:00Z", "Prompted first\nline", "<p>a</p><ul><li>b</li></ul><script>x</script>"),
        act("2026-01-01T11:30:00.000001Z", "Prompted fourth"), act(None, "Prompted lost"), act("2026-01-01T10:00:00Z", "Gave feedback"), act("2026-01-01T10:00:00Z", "Searched", header="Search"),
    ]
    got = chats.gemini(spark, put(tmp_path / "My" / "MyActivity.json", acts).rsplit("/", 1)[0])
    convs = got.conversations.orderBy("created_at").collect()
    assert [(c.message_count, c.title) for c in convs] == [(5, "first"), (1, "fourth")] and convs[0].external_id == "2026-01-01T10:00:00+00:00"
    first = got.messages.where(F.col("conversation_id") == convs[0].id).orderBy("position").collect()
    assert first[1].text == "a\n\n- b" and first[1].parent_id == first[0].id and [r.reason for r in got.issues.collect()] == ["entry has no usable time"]


def test_agent_sessions(spark, tmp_path):
    def rec(uuid, parent, kind, content, **more):
        return {"type": kind, "uuid": uuid, "parentUuid": parent, "sessionId": "s1", "timestamp": "2026-01-01T10:00:00Z", "cwd": "/p", "message": {"id": more.pop("api", None), "content": content, "model": "m"}} | more

    lines = [
        {"type": "summary", "summary": "About", "leafUuid": "x"}, rec("1", None, "user", "do it"), rec("2", "1", "assistant", [{"type": "thinking", "text": "t"}], api="A"), rec("3", "2", "assistant", [{"type": "text", "text": "ok"}], api="A"),
        rec("4", "3", "assistant", [{"type": "tool_use", "name": "ls", "input": {"d": "."}}], api="A"), rec("5", "4", "user", [{"type": "tool_result", "content": "f" * 2100}]), rec("6", "5", "user", "<command-name>x"), rec("7", "6", "assistant", "done", api="B"), rec("8", "7", "user", "side", isSidechain=True),
    ]
    put(tmp_path / "a" / "one.jsonl", "\n".join(map(json.dumps, lines)) + "\nnot json\n")
    codex = [
        {"type": "session_meta", "payload": {"id": "c1", "cwd": "/q"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "<environment_context>"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "hey"}]}}, {"type": "response_item", "payload": {"type": "function_call", "name": "sh", "arguments": "{}"}}, {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"text": "hm"}]}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": '{"output": "out"}'}}, {"type": "response_item", "payload": {"type": "reasoning"}},
    ]
    put(tmp_path / "b" / "two.jsonl", "\n".join(map(json.dumps, codex)))
    put(tmp_path / "b" / "other.jsonl", '{"a": 1}')
    messages, issues = agents.read_sessions(spark, str(tmp_path))
    one = messages.where("source = 'claude_code'").orderBy("position").collect()
    assert [(r.role, len(r.content)) for r in one] == [("user", 1), ("assistant", 2), ("tool", 1), ("assistant", 1)] and one[0].title == "About" and one[0].external_id == "s1"
    assert one[2].content[0].text.endswith("[100 more characters]") and one[3].parent_id == one[2].id and one[0].current_leaf_id == one[3].id
    two = messages.where("source = 'codex'").orderBy("position").collect()
    assert [(r.role, [p.text for p in r.content]) for r in two] == [("user", ["hey"]), ("assistant", ["[tool call: sh]\n{}", "hm"]), ("tool", ["[tool result]\nout"])]
    assert [(r.label, r.reason) for r in issues.collect()] == [("one.jsonl:10", "not valid JSON")]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_", ".").replace("RELS", "_rels"), text)
    return out.getvalue()


def test_documents(spark):
    w = 'xmlns:w="w"'
    mail = "From: a@b\nTo: c@d\nSubject: S\nMessage-ID: <1>\nDate: Mon, 05 Jan 2026 10:00:00 +0000\n\nhello\n"
    page_mail = "From: a@b\nSubject: P\nMessage-ID: <9>\nContent-Type: text/html\n\n<p>one &amp; two</p>"
    given = {
        "a.csv": 'name,city\n,\nMaya,Lisbon\n\nSam,\n"Ann, B",Porto,more\n', "h.csv": " , \na,b\n", "t.tsv": "k\tv\n1\t2\n", "e.csv": ",\n",
        "a.json": '{"trip": {"to": "Porto", "days": [1, {"x": true}, [2, " "]], "x": null}, "n": 1.5}', "b.json": "[[1], []]", "l.jsonl": '{"a": 1}\n\n{"b": [2, 3]}\n',
        "p.html": '<!doctype html><html><head><title> A &amp;  b </title><style>x</style></head><body><!-- no > --><p class="a > b">one</p><div>two <b>three</b>&nbsp;x<br/>&lt;y&gt;</div><svg/>s<script>if (a < b) "</p>"</script></body>',
        "q.htm": "<p>no title<svg><text>hidden</text></svg><script>open", "x.log": "caf\xe9".encode("cp1252"), "y.log": "hi".encode("utf-16"), "z.log": b"\x81\xe9", "bom.log": "\ufeffx".encode(), "py.py": "x = 1",
        "r.rtf": r"{\rtf1{\*\x A;}\b Bold\b0\par next}", "d.xml": "<a><b> x  y </b><c>z</c></a>", "n/a.md": "---\ntitle: T\ncreated: 2026-01-05\n---\n# H\nbody [[x]]", "b.md": "---\n: [broken\n---\n# Head #\n",
        "a.docx": zipped(word__document_xml=f"<w:d {w}><w:p><w:r><w:t>Hello </w:t><w:t>you</w:t></w:r></w:p><w:p/></w:d>", docProps__core_xml='<c xmlns:d="d"><d:title>Doc</d:title></c>'),
        "a.pptx": zipped(ppt__slides__slide10_xml='<a xmlns:a="a"><a:p><a:t>ten</a:t></a:p></a>', ppt__slides__slide2_xml='<a xmlns:a="a"><a:p><a:t>two</a:t></a:p></a>'),
        "a.xlsx": zipped(xl__sharedStrings_xml="<s><si><t>name</t></si><si><t>Maya</t></si></s>", xl__worksheets__sheet1_xml='<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>n</v></c></row><row/><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></w>', xl__worksheets__sheet2_xml="<w><row><c><v>only</v></c></row></w>"),
        "a.epub": zipped(**{"META-INF__container_xml": '<c><rootfile full-path="o/p.opf"/></c>', "o__p_opf": '<p><title>Book</title><item id="1" href="c.html"/><item id="2" href="d.html"/><itemref idref="2"/><itemref idref="1"/></p>', "o__c_html": "<p>chapter</p>", "o__d_html": "<title>t</title><p>first</p>"}),
        "m.eml": mail, "p.eml": page_mail, "m.mbox": "From x\n" + mail + "\nFrom y\n" + mail.replace("<1>", "<2>"), "none.eml": "From: a@b\n\n  \n",
        "e.md": b"", "x.unknown": b"\0\1", "a.png": b"x", "bad.json": b"{", "a.txt": b" ", "cut.dat": "x" * 8191 + "\u00e9 more", "wrong.dat": b"x" * 8000 + b"\xff" + b"x" * 400, "end.dat": b"abc\xc3",
    }
    notes, skipped = documents.read_documents(spark.createDataFrame([(n, n, d if isinstance(d, bytes) else d.encode()) for n, d in given.items()], "path string, relative string, content binary"))
    rows = notes.collect()
    text = {r.relative: r.text for r in rows}
    assert text["a.csv"] == "name: Maya | city: Lisbon\nname: Sam\nname: Ann, B | city: Porto" and text["h.csv"] == "a | b" and text["t.tsv"] == "k: 1 | v: 2"
    assert text["a.json"] == "trip.to: Porto\ntrip.days[0]: 1\ntrip.days[1].x: True\ntrip.days[2][0]: 2\nn: 1.5" and text["b.json"] == "[0][0]: 1" and text["l.jsonl"] == "a: 1\n\nb[0]: 2\nb[1]: 3"
    assert text["p.html"] == "one\ntwo three x\n<y>\ns" and text["q.htm"] == "no title"
    assert [text[x] for x in ("x.log", "y.log", "z.log", "bom.log")] == ["caf\xe9", "hi", "\x81\xe9", "x"]
    assert text["r.rtf"] == "Bold\nnext" and text["d.xml"] == "x y\nz" and text["n/a.md"] == "# H\nbody [[x]]"
    assert text["a.docx"] == "Hello you" and text["a.pptx"] == "Slide 1\ntwo\n\nSlide 2\nten" and text["a.xlsx"] == "name: Maya | n: 7\n\nonly" and text["a.epub"] == "first\n\nchapter"
    title = {r.relative: r.title for r in rows}
    assert [title[x] for x in ("p.html", "q.htm", "n/a.md", "b.md", "a.docx", "a.epub", "a.csv", "m.eml")] == ["A & b", "q", "T", "Head", "Doc", "Book", "a", "S"]
    first = next(r for r in rows if r.relative == "m.eml")
    assert (first.external_id, first.source, first.text, first.created_at) == ("<1>", "email", "From: a@b\nTo: c@d\n\nhello", "2026-01-05T10:00:00+00:00")
    assert text["p.eml"] == "From: a@b\n\none & two" and sum(r.relative == "m.mbox" for r in rows) == 2
    assert next(r.created_at for r in rows if r.relative == "n/a.md") == "2026-01-05T00:00:00" and next(r.language for r in rows if r.relative == "py.py") == "python"
    why = {r.relative: r.reason for r in skipped.collect()}
    assert set(why) == {"e.csv", "none.eml", "e.md", "x.unknown", "a.png", "bad.json", "a.txt", "wrong.dat", "end.dat"} and len(text["cut.dat"]) == 8197
    assert why["e.csv"] == "it holds no text" and why["none.eml"] == "it holds no email with text" and why["bad.json"].startswith("it could not be read")


def test_folder(spark, tmp_path):
    put(tmp_path / "n.md", "# One\ntext"), put(tmp_path / "sub" / "d.csv", "a,b\n1,2\n"), put(tmp_path / "x.png", b"\x89PNG"), put(tmp_path / ".git" / "c.txt", "no")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/t.txt", "inside")
        z.writestr("../out.txt", "escapes")
    notes, skipped = documents.read_folder(spark, str(tmp_path))
    assert {(r.relative, r.text) for r in notes.collect()} == {("n.md", "# One\ntext"), ("sub/d.csv", "a: 1 | b: 2"), ("in/t.txt", "inside")}
    assert [(r.reason, r.n) for r in documents.describe_skipped(skipped).collect()] == [("not a kind of file that is read", 1)]


def test_kinds(spark):
    rows = spark.createDataFrame([('{"mapping": {}}', "a"), ('{"chat_messages": []}', "a"), ('{"header": 1, "time": 2}', "a"), ("[]", "n.MD"), ("[]", "x")], "r string, n string")
    got = [r.k for r in rows.select(files.export_kind(F.col("r"), F.col("n")).alias("k")).collect()]
    assert got == ["chatgpt", "claude", "gemini", "markdown", None]


def test_archive_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("v", "Conversation"), ("c", "Chunk"), ("e", "Entity")], "id string, label string")
    edges = spark.createDataFrame([("c", "MENTIONS", "e"), ("v", "HAS", "c"), ("v", "X", "v"), ("e", "SAME_AS", "gone")], "src string, type string, dst string")
    conv = spark.createDataFrame([("v", "s", "A: b", "2026-01-01", None), ("w", "s", "A: b", "2026-01-01", None)], "id string, source string, title string, created_at string, updated_at string")
    messages = spark.createDataFrame([("v", "m1", None, 0, "user", "hi"), ("v", "m2", "m1", 1, "assistant", "yo"), ("w", "m3", None, 0, "user", "hm")], "conversation_id string, id string, parent_id string, position long, role string, text string")
    target = str(tmp_path / "out")
    archive.export(conv, messages, nodes, edges, target)
    back = archive.read(spark, target, {"nodes": "id string, label string", "edges": "src string, type string, dst string"})
    assert back["nodes"].count() == 2 and back["edges"].count() == 3
    n, e = archive.restore(nodes.where("id = 'v'"), edges.limit(0), back["nodes"], back["edges"])
    assert n.count() == 3 and {r.type for r in e.collect()} == {"MENTIONS", "HAS"}
    branch = graph.active_branch(messages, spark.createDataFrame([("v", "m2")], "conversation_id string, leaf_id string"))
    out = {r.name: r.body for r in archive.markdown(conv, branch).collect()}
    assert set(out) == {"2026-01-01 A- b.md", "2026-01-01 A- b w.md"} and out["2026-01-01 A- b.md"].endswith("# A: b\n\n## You\n\nhi\n\n## Assistant\n\nyo\n")
    kept = archive.merge_cache(spark.createDataFrame([("k", 1)], "k string, v int"), spark.createDataFrame([("k", 2), ("j", 3)], "k string, v int"), ["k"])
    assert {tuple(r) for r in kept.collect()} == {("k", 1), ("j", 3)}


def test_office_files(spark):
    rel = 'xmlns:r="http://r"'
    book = dict(  # the folder _rels has its name from a mark that zipped() would change
        xl__workbook_xml=f'<w {rel}><sheets><sheet name="Second" r:id="b"/><sheet name="First" r:id="a"/><sheet name="Empty" r:id="c"/><sheet name="Chart" r:id="d"/></sheets></w>',
        xl__RELS__workbook_xml_rels='<r><R Id="a" Target="worksheets/one.xml"/><R Id="b" Target="/xl/worksheets/two.xml"/><R Id="c" Target="worksheets/three.xml"/><R Id="d" Target="charts/x.xml"/></r>',
        xl__worksheets__one_xml='<w><row><c r="A1" t="inlineStr"><is><t>name</t></is></c><c r="B1"><v> </v></c></row><row><c r="A2" t="inlineStr"><is><t> Maya </t></is></c><c r="B2"><v>7</v></c></row></w>',
        xl__worksheets__two_xml='<w><row><c r="A1"><v>only</v></c><c r="C1"><v>row</v></c></row></w>',
        xl__worksheets__three_xml="<w><row/></w>",
    )
    odt = '<d xmlns:t="t"><t:h>Head</t:h><t:p>one  two</t:p><t:table><t:table-row><t:table-cell><t:p>a</t:p></t:table-cell><t:table-cell><t:p>b</t:p></t:table-cell><t:table-cell/></t:table-row></t:table><t:p>one  two</t:p></d>'
    given = {
        "b.xlsx": zipped(**book),
        "o.odt": zipped(content_xml=odt, meta_xml='<m xmlns:d="d"><d:title> The title </d:title></m>'),
        "d.docx": zipped(word__document_xml='<w:d xmlns:w="w"><w:p><w:r><w:t>a</w:t><w:tab/><w:t> b   c </w:t></w:r></w:p></w:d>'),
        "s.pptx": zipped(ppt__slides__slide3_xml='<a xmlns:a="a"><a:p/></a>', ppt__slides__slide12_xml='<a xmlns:a="a"><a:p><a:t>last</a:t></a:p></a>'),
    }
    notes, skipped = documents.read_documents(spark.createDataFrame([(n, n, d) for n, d in given.items()], "path string, relative string, content binary"))
    got = {r.relative: (r.title, r.text) for r in notes.collect()}
    assert got == {
        "b.xlsx": ("b", "Second\nonly | row\n\nFirst\nname: Maya | 7"),
        "o.odt": ("The title", "Head\none two\na | b\na\nb"),
        "d.docx": ("d", "a b c"),
        "s.pptx": ("s", "Slide 2\nlast"),
    }
    assert skipped.count() == 0
