import json

from gistmill.sources import intake


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_intake_sends_files_to_their_readers(spark, tmp_path):
    mapping = {"root": {"parent": None, "message": None}, "u": {"parent": "root", "message": {"author": {"role": "user"}, "create_time": 1.0, "content": {"content_type": "text", "parts": ["How?"]}, "metadata": {}}}}
    put(tmp_path / "gpt" / "conversations.json", json.dumps([{"conversation_id": "x", "title": "T", "current_node": "u", "mapping": mapping}]))
    put(tmp_path / "gpt" / "user.json", "{}"), put(tmp_path / "gpt" / "chat.html", "<p>no</p>"), put(tmp_path / "gpt" / "note.md", "# Own\ntext")
    put(tmp_path / "claude" / "conversations.json", json.dumps([{"uuid": "c", "name": "N", "chat_messages": [{"uuid": "1", "sender": "human", "text": "hi"}, {"uuid": "2", "sender": "assistant", "text": "yo"}]}]))
    put(tmp_path / "g" / "MyActivity.json", json.dumps([{"header": "Gemini Apps", "title": "Prompted first", "time": "2026-01-01T10:00:00Z"}]))
    put(tmp_path / "other" / "MyActivity.json", json.dumps([{"header": "Search", "title": "x"}]))
    put(tmp_path / "s" / "one.jsonl", json.dumps({"type": "user", "uuid": "1", "sessionId": "s1", "message": {"content": "do it"}}) + "\nnot json\n")
    put(tmp_path / "s" / "rows.jsonl", '{"a": 1}\n'), put(tmp_path / "odd" / "conversations.json", '{"a": [1]}'), put(tmp_path / "x.png", b"\x89"), put(tmp_path / ".git" / "c.txt", "no")
    got = intake.read_intake(spark, str(tmp_path))
    assert {(r.source, r.conversations, r.messages) for r in got.counts.collect()} == {("chatgpt", 1, 1), ("claude", 1, 2), ("gemini", 1, 1), ("claude_code", 1, 1), ("markdown", 1, 1), ("document", 2, 2)}
    text = {(r.source, r.role, r.text) for r in got.messages.collect()}
    assert {("claude", "assistant", "yo"), ("claude_code", "user", "do it"), ("document", "user", "a: 1"), ("document", "user", "a[0]: 1"), ("chatgpt", "user", "How?")} <= text
    assert {(r.relative, r.reason) for r in got.skipped.collect()} == {("gpt/user.json", "part of the ChatGPT export"), ("gpt/chat.html", "part of the ChatGPT export"), ("other/MyActivity.json", "activity for another product"), ("x.png", "not a kind of file that is read")}
    assert [(r.label, r.reason) for r in got.issues.collect()] == [("one.jsonl:2", "not valid JSON")]
