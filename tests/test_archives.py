"""Archives, and files that cannot be read beside those that can."""

import gzip
import io
import json
import random
import tarfile
import zipfile

import pyarrow as pa
import pytest

from gistmill import session
from gistmill.sources import files, intake


def tarred(mode, members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_tar_and_gzip_members(spark, tmp_path, monkeypatch):
    export = b'[{"mapping": {}}]'
    inner = tarred("w", {"deep/conversations.json": export})
    (tmp_path / "a.tar").write_bytes(tarred("w", {"./x/conversations.json": export, "x/b.txt": b"b", "../out.txt": b"no", "in.tar": inner}))
    (tmp_path / "b.TGZ").write_bytes(tarred("w:gz", {"c.txt": b"c", "d.txt.gz": gzip.compress(b"d")}))
    (tmp_path / "c.tar.xz").write_bytes(tarred("w:xz", {"e.txt": b"e"}))
    (tmp_path / "conversations.json.gz").write_bytes(gzip.compress(export))
    (tmp_path / "bad.gz").write_bytes(b"\x1f\x8bno")
    got = {r.member.rsplit("/", 1)[-1]: bytes(r.content) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"conversations.json": export, "b.txt": b"b", "c.txt": b"c", "d.txt": b"d", "e.txt": b"e", "bad.gz": b"\x1f\x8bno"}
    named = files.scan(spark, str(tmp_path), "conversations.json").collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in named) == ["a.tar", "a.tar", "conversations.json.gz"]
    for size, count in ((20, 9), (99, 1)):
        assert list(files._members("a.tar", tarred("w", {"a": b"x" * 15, "b": b"x" * 15}), 0, files.Budget(size, count))) == [("a.tar", None, files.TOO_MUCH)]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_one_bad_file_stops_nothing(spark, tmp_path, monkeypatch):
    good = zipped({"in/a.txt": b"inside", "b.zip": zipped({"deep.txt": b"deep"})})
    locked = bytearray(zipped({"c.txt": b"secret"}))
    locked[6] |= 1
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    bomb = zipped({"zeros.txt": bytes(3_000_000)})
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "broken.zip").write_bytes(good[:60])
    (tmp_path / "torn.zip").write_bytes(good[:35] + b"\0\0\0" + good[38:])
    (tmp_path / "locked.zip").write_bytes(bytes(locked))
    (tmp_path / "bomb.zip").write_bytes(bomb)
    (tmp_path / "holds.tar").write_bytes(tarred("w", {"x.txt": b"x", "bad.zip": good[:60]}))
    (tmp_path / "plain.txt").write_bytes(b"plain words")
    (tmp_path / "conversations.json").write_bytes(b'[{"mapping": {}}, {"mapping"')
    (tmp_path / "s.jsonl").write_bytes(b'{"type": "user", "uuid": "1", "sessionId": "s1", "message": {"content": "hello"}}\n{"x": "\xff"}\n')
    monkeypatch.setattr(files, "MAX_BYTES", 1_000_000)
    found = files.scan_all(spark, str(tmp_path)).collect()
    issues = {r.member.rsplit("/", 1)[-1]: r.issue for r in found if r.issue}
    assert issues.pop("locked.zip") == files.LOCKED and issues.pop("bomb.zip") == files.TOO_MUCH
    assert set(issues) == {"broken.zip", "torn.zip", "bad.zip"} and all(i.startswith(files.UNREADABLE) for i in issues.values())
    assert {r.member.rsplit("/", 1)[-1] for r in found if not r.issue} == {"a.txt", "deep.txt", "x.txt", "plain.txt", "conversations.json", "s.jsonl"}
    got = intake.read_intake(spark, str(tmp_path))
    assert {"inside", "deep", "x", "plain words", "hello"} <= {r.text for r in got.messages.collect()}
    assert {r.relative: r.reason for r in got.skipped.collect()}["locked.zip"] == files.LOCKED
    assert ("s.jsonl:2", "not valid UTF-8") in {(r.label, r.reason) for r in got.issues.collect()}


def test_bad_json_is_an_issue(spark):
    rows = [("a", b'\xef\xbb\xbf[1, {"k": "\xc3\xa9"}]'), ("b", b"[1,"), ("c", b'{"k": 1}'), ("d", b'["\xff"]'), ("e", b"")]
    got = files.json_rows(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [(r.path, r["index"], r.record) for r in got if not r.issue] == [("a", 0, "1"), ("a", 1, '{"k": "é"}')]
    assert {r.path: r.issue for r in got if r.issue} == {"b": "not valid JSON", "c": "should hold a list", "d": "not valid JSON", "e": "not valid JSON"}


@pytest.mark.parametrize("split", (64, 1000, 1 << 20))
def test_json_arrays_are_read_in_splits(spark, tmp_path, split):
    """The same records wherever the splits lie: strings with commas, brackets, quotes and backslashes, deep records."""
    rng = random.Random(split)

    def value(depth):
        kind = rng.randrange(6 if depth < 4 else 3)
        if kind < 2:
            return "".join(rng.choices([",", "[", "]", "{", "}", '"', "\\", '\\"', "é", "日", " ", "a", "\n"], k=rng.randint(0, 12)))
        if kind == 2:
            return rng.choice([None, True, 1.5, -3, ""])
        return [value(depth + 1) for _ in range(rng.randint(0, 4))] if kind < 5 else {f"k{k},": value(depth + 1) for k in range(rng.randint(0, 3))}

    want = {}
    for name in ("a", "b", "none"):
        items = [] if name == "none" else [value(0) for _ in range(60)]
        (tmp_path / f"{name}.json").write_text(("\ufeff" if name == "b" else "") + json.dumps(items, ensure_ascii=name == "a", indent=2 if name == "b" else None) + "\n", encoding="utf-8")
        want |= {(f"{name}.json", k): x for k, x in enumerate(items)}
    (tmp_path / "c.json").write_bytes(b'[{"a": 1}, {"b": "\xff"}, {"c": tru}, {"d": [1, 2')
    (tmp_path / "d.json").write_text('{"k": [1, 2]}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        records, issues = files.json_records(spark, str(tmp_path))
        got = {(r.path.rsplit("/", 1)[-1], r["index"]): json.loads(r.record) for r in records.collect()}
        told = {(r.label, r.reason) for r in issues.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want | {("c.json", 0): {"a": 1}}
    assert told == {("c.json#1", "not valid UTF-8"), ("c.json#2", "not valid JSON"), ("c.json#3", "not valid JSON"), ("d.json", "should hold a list")}


def test_pieces_of_json_records_are_not_stored_or_shuffled(spark, tmp_path, monkeypatch):
    """Records of many commas: what is kept on the way is a row a record or a split, not one a comma."""
    kept = []
    for name in ("durable", "stored"):
        monkeypatch.setattr(files, name, lambda df, fn=getattr(session, name): kept.append(fn(df)) or kept[-1], raising=False)
    (tmp_path / "a.json").write_text(json.dumps([{"t": ", ".join("ab" * 50)} for _ in range(40)]))
    records, issues = files.json_records(spark, str(tmp_path))
    assert records.count() == 40 and issues.count() == 0 and {len(json.loads(r.record)["t"]) for r in records.collect()} == {298}
    assert max(df.count() for df in kept) <= 41


def test_another_cut_of_a_file_is_no_silent_loss():
    batch = pa.RecordBatch.from_pydict({"split": [None], "inside": [None], "deep": [None], "value": [b"[1"]}, schema=pa.schema([("split", pa.int64()), ("inside", pa.int64()), ("deep", pa.int64()), ("value", pa.binary())]))
    with pytest.raises(RuntimeError):
        list(files._split_records(iter([batch])))
