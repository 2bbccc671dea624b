"""Files of any depth, single files and members of zip, tar and gzip archives, as rows; and what kind of export they hold."""

from __future__ import annotations

import contextlib
import gzip
import io
import itertools
import json
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gistmill.session import durable, stored

ROW = "path string, member string, depth int, content binary, issue string"
ARROW = pa.schema([("path", pa.string()), ("member", pa.string()), ("depth", pa.int32()), ("content", pa.binary()), ("issue", pa.string())])
#: What _split_sums and _split_records give.
SUMS = pa.schema([("path", pa.string()), *((name, pa.int64()) for name in ("block", "quotes", "d0", "d1"))])
PARTS = pa.schema([("split", pa.int64()), ("k", pa.int64()), ("closed", pa.bool_()), ("text", pa.binary())])
#: Limits of an unpacked archive: nesting, bytes and files.
MAX_NESTED, MAX_BYTES, MAX_FILES = 4, 2_000_000_000, 100_000
ISSUE = "label string, reason string"
TARS = (".tar", ".tgz", ".tbz2", ".txz", ".tar.gz", ".tar.bz2", ".tar.xz")
PACKED_DOCUMENTS = (".docx", ".pptx", ".xlsx", ".odt", ".odp", ".ods", ".epub", ".jar")
BROKEN = (tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError)
TOO_MUCH, LOCKED, UNREADABLE = "the archive unpacks to more than is read", "the archive is locked with a password", "the archive could not be unpacked"


class Fault(ValueError):
    """Why an archive is left out."""


class Budget:
    """What may still come out of a file, in bytes and files."""

    def __init__(self, size: int, count: int) -> None:
        self.size, self.count = size, count

    def spend(self, size: int, count: int) -> None:
        self.size -= size
        self.count -= count
        if self.size < 0 or self.count < 0:
            raise Fault(TOO_MUCH)


def _untarred(data: bytes, budget: Budget) -> list[tuple[str, bytes]] | None:
    """(name, content) of the files of a tar, compressed or not; None if it cannot be read."""
    out = []
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as bundle:
            for entry in bundle:
                name = entry.name.replace("\\", "/").removeprefix("./")
                if not entry.isfile() or ".." in name.split("/") or name.startswith("/"):
                    continue
                budget.spend(entry.size, 1)
                out.append((name, bundle.extractfile(entry).read()))
    except BROKEN:
        return None
    return out


def _gunzipped(path: str, data: bytes, budget: Budget) -> list[tuple[str, bytes]] | None:
    """(name, content) of a gzip's one file; None if it cannot be read."""
    parts = []
    try:
        with gzip.open(io.BytesIO(data)) as packed:
            while piece := packed.read(1 << 20):
                budget.spend(len(piece), 0)
                parts.append(piece)
    except BROKEN:
        return None
    budget.spend(0, 1)
    return [(path[: -len(".gz")], b"".join(parts))]


def _unzipped(data: bytes, budget: Budget) -> list[tuple[str, bytes]]:
    """(name, content) of the files of a zip. What a member says of its size is not believed: it is read to the limit."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir() or ".." in info.filename.replace("\\", "/").split("/") or info.filename.startswith("/"):
                    continue
                if info.flag_bits & 1:
                    raise Fault(LOCKED)
                budget.spend(0, 1)
                with z.open(info) as member:
                    content = member.read(budget.size + 1)
                budget.spend(len(content), 0)
                out.append((info.filename, content))
    except (zipfile.BadZipFile, NotImplementedError, *BROKEN) as why:
        raise Fault(f"{UNREADABLE}: {type(why).__name__}") from why
    return out


def _members(path: str, data: bytes, level: int, budget: Budget) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(member, content, issue) of a file: itself, or all files of a zip, tar or gzip, at any nesting up to the limit. An
    archive that is locked, broken or too large gives one row with its issue, and the files beside it are read; a tar or
    gzip that is none is passed on as it is."""
    lower, packed = path.lower(), None
    try:
        if level < MAX_NESTED and lower.endswith(TARS):
            packed = _untarred(data, budget)
        elif level < MAX_NESTED and lower.endswith(".gz"):
            packed = _gunzipped(path, data, budget)
        elif level < MAX_NESTED and data[:4] == b"PK\x03\x04" and not lower.endswith(PACKED_DOCUMENTS):
            packed = _unzipped(data, budget)
    except Fault as why:
        yield path, None, str(why)
        return
    if packed is None:
        yield path, data, None
        return
    for inner, content in packed:
        yield from _members(inner, content, level + 1, budget)


def scan_all(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(path, member, depth, content, issue): files below a path, archives opened, those of a base name only if one is
    given; and a row with an issue for each archive that could not be opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if name:
        files = files.where(F.lower(F.element_at(F.split("path", "/"), -1)).isin(name.lower()) | F.lower("path").rlike(r"\.(zip|tar|tgz|tbz2|txz|gz|tar\.bz2|tar\.xz)$"))
    return opened(files, name)


def opened(files: DataFrame, name: str | None = None) -> DataFrame:
    """The same of files (path, content) in hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for member, data, issue in _members(at, cell.as_py(), 0, Budget(MAX_BYTES, MAX_FILES)):
                    if issue or not name or member.rsplit("/", 1)[-1].lower() == name.lower():
                        row = {"path": at, "member": member, "depth": member.count("/"), "content": data, "issue": issue}
                        yield pa.RecordBatch.from_pylist([row], schema=ARROW)

    return files.select("path", "content").mapInArrow(run, ROW)


def scan(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(path, member, depth, content) of scan_all() without its issues."""
    return scan_all(spark, path, name).where("issue is null").drop("issue")


def nearest(files: DataFrame) -> DataFrame:
    """Of each scan, the file nearest to the root, by depth and name."""
    return files.orderBy("depth", "member").limit(1)


def json_rows(files: DataFrame) -> DataFrame:
    """(path, index, record, issue): each element of the files' top-level JSON arrays as JSON, a byte-order mark skipped;
    a file that holds no such array gives one row with an issue."""

    def items(path: str, content: bytes) -> pd.DataFrame:
        try:
            data = json.loads(bytes(content).decode("utf-8-sig"))
        except (UnicodeDecodeError, ValueError, RecursionError):
            data = None
        if not isinstance(data, list):
            why = "not valid JSON" if data is None else "should hold a list"
            return pd.DataFrame({"path": [path], "index": pd.array([None], "Int64"), "record": [None], "issue": [why]})
        return pd.DataFrame({"path": path, "index": pd.array(range(len(data)), "Int64"), "record": [json.dumps(x, ensure_ascii=False) for x in data], "issue": None})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame.path, frame.content, strict=True):
                yield items(p, content)

    return files.select("path", "content").mapInPandas(run, "path string, index long, record string, issue string")


def json_items(files: DataFrame) -> DataFrame:
    """(path, index, record) of json_rows() without its issues."""
    return json_rows(files).where("issue is null").drop("issue")


SIGNS = np.zeros(256, bool)
SIGNS[list(b'"[]{}' + b"\\")] = True
DEPTH = np.zeros(256, np.int64)
DEPTH[list(b"[{")], DEPTH[list(b"]}")] = 1, -1


def _signs(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, quote, depth) of the quotes and brackets in pieces of JSON, without those behind a backslash."""
    cells = values.cast(pa.large_binary())
    _, ends, data = cells.buffers()
    ends = np.frombuffer(ends, np.int64)[cells.offset : cells.offset + len(cells) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    at = np.flatnonzero(SIGNS[data])
    sign, piece = data[at], np.searchsorted(ends - ends[0], at, "right") - 1
    slash, place = sign == ord("\\"), np.arange(len(at))
    beside = np.zeros(len(at), bool)  # directly behind a backslash of the same piece
    beside[1:] = slash[:-1] & (at[1:] == at[:-1] + 1) & (piece[1:] == piece[:-1])
    # the place in its row of backslashes; behind an odd number of them a sign is escaped
    row = place - np.maximum.accumulate(np.where(slash & ~beside, place, -1)) + 1 if len(at) else place
    free = ~slash
    free[1:] &= ~(beside[1:] & (row[:-1] % 2 == 1))
    return piece[free], sign[free] == ord('"'), DEPTH[sign[free]]


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch cut where a column changes."""
    key = batch.column(column).to_numpy(zero_copy_only=False)
    cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else []
    for start, end in itertools.pairwise(cuts):
        yield batch.slice(start, end - start)


def _split_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, value) to (path, block, quotes, d0, d1): a split's quotes, and what it adds to the depth if it begins
    outside of a string and if inside one."""
    at, sums = None, [0, 0, 0]

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [at[0]], "block": [at[1]], "quotes": [sums[0]], "d0": [sums[1]], "d1": [sums[2]]}, schema=SUMS)

    for batch in batches:
        for of_path in _runs(batch, "path"):
            for run in _runs(of_path, "block"):
                here = (run.column("path")[0].as_py(), run.column("block")[0].as_py())
                if at not in (None, here):
                    yield told()
                    sums = [0, 0, 0]
                at = here
                _, quote, depth = _signs(run.column("value"))
                odd = (sums[0] + np.cumsum(quote)) % 2 == 1
                sums = [sums[0] + int(quote.sum()), sums[1] + int(depth[~odd].sum()), sums[2] + int(depth[odd].sum())]
    if at:
        yield told()


def _split_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(split, inside, deep, value) to (split, k, closed, text): what a split holds of records, in order; the last of them
    may not be closed in it."""
    at, k, odd, deep, rest = None, 0, 0, 0, []

    def left() -> Iterator[pa.RecordBatch]:
        if rest:
            yield pa.RecordBatch.from_pydict({"split": [at], "k": [k], "closed": [False], "text": [b",".join(rest)]}, schema=PARTS)

    for batch in batches:
        for run in _runs(batch, "split"):
            here = run.column("split")[0].as_py()
            if here is None:
                raise RuntimeError("a file was cut otherwise in the first reading")
            if here != at:
                yield from left()
                at, k, rest = here, 0, []
                odd, deep = run.column("inside")[0].as_py(), run.column("deep")[0].as_py()
            values = run.column("value").cast(pa.binary())
            piece, quote, depth = _signs(values)
            inside = (odd + np.cumsum(quote)) % 2 == 1
            odds = (odd + np.cumsum(np.bincount(piece[quote], minlength=len(values)))) % 2
            deeps = deep + np.cumsum(np.bincount(piece, depth * ~inside, len(values)).astype(np.int64))
            odd, deep = int(odds[-1]), int(deeps[-1])
            stops = np.flatnonzero((odds == 0) & (deeps <= 1)) + 1
            if len(stops):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), values)
                text = pc.binary_join(lists, b",")
                if rest:
                    text = pa.concat_arrays([pa.array([b",".join([*rest, text[0].as_py()])], pa.binary()), text[1:]])
                n, rest = len(stops), []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at), pa.int64()), pa.array(np.arange(k, k + n), pa.int64()), pa.array(np.ones(n, bool)), text], schema=PARTS)
                k += n
            rest += values[stops[-1] if len(stops) else 0 :].to_pylist()
    yield from left()


def json_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((path, index, record), issues) of files that hold one JSON array each, of any size: a file is read in splits.

    Spark's text reader cuts a file at commas, split by split. Whether a comma ends a record depends on all before it: on
    being inside a string, and on the depth of brackets. A first reading counts the quotes of each split and the brackets
    outside of strings for both states in which it may begin; sums over a file's splits say which state holds. A second
    reading puts the records together; only what a split begins and ends with is shuffled, to be joined by the record's
    number. So no task reads more than a split, and what is broadcast is a row a split. Backslashes stand inside strings
    alone, so an escaped quote is known without the state.
    """
    with _same_splits(spark):
        return _json_records(spark, path)


@contextlib.contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are cut alike in every reading, though executors come and go."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None):
        yield
        return
    spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key)


def _json_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.option("lineSep", ",").option("recursiveFileLookup", "true").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.mapInArrow(_split_sums, "path string, block long, quotes long, d0 long, d1 long")
    states = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    deep = F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))).over(before), F.lit(0))
    states = stored(states.select("path", "block", "inside", deep.alias("deep"), F.monotonically_increasing_id().alias("split")))
    known = rows.join(F.broadcast(states), ["path", "block"], "left").select("split", "inside", "deep", "value")
    parts = stored(known.mapInArrow(_split_records, "split long, k long, closed boolean, text binary"))
    counted = parts.groupBy("split").agg(F.count_if("closed").alias("n"), F.max("k").alias("end")).join(states, "split")
    splits = durable(counted.select("split", "path", "block", "end", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    placed = parts.join(F.broadcast(splits), "split").withColumn("index", F.col("first") + F.col("k"))
    outer = (F.col("k") == 0) | (F.col("k") == F.col("end"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.col("text").cast("string").alias("text")))), lambda x: x["text"]), ",")
    made = durable(placed.where(outer).groupBy("path", "index").agg(joined.alias("text")))
    ends = made.groupBy("path").agg(F.max("index").alias("last"), F.min_by("text", "index").alias("head"), F.max_by("text", "index").alias("tail"))
    ends = durable(ends.select("path", "last", F.regexp_like("head", F.lit(r"^\ufeff?\s*\[")).alias("opens"), F.regexp_like("tail", F.lit(r"\]\s*$")).alias("closes")))
    made = made.unionByName(placed.where(~outer).select("path", "index", F.col("text").cast("string").alias("text"))).join(F.broadcast(ends), "path")
    text = F.when(F.col("index") == 0, F.regexp_replace("text", r"^\ufeff?\s*\[", "")).otherwise(F.col("text"))
    text = F.when((F.col("index") == F.col("last")) & F.col("closes"), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    made = made.withColumn("record", F.btrim(text, F.lit(" \t\n\x0b\f\r")))
    empty = (F.col("last") == 0) & (F.col("record") == "")
    why = F.when(~F.col("opens"), "should hold a list").when(~F.is_valid_utf8("text"), "not valid UTF-8").when(~F.col("closes") & (F.col("index") == F.col("last")), "not valid JSON").when(F.try_parse_json("record").isNull(), "not valid JSON")
    made = made.where(~(empty & F.col("opens") & F.col("closes"))).withColumn("why", why)
    label = F.concat(F.element_at(F.split("path", "/"), -1), F.when(F.col("opens"), F.concat(F.lit("#"), F.col("index").cast("string"))).otherwise(F.lit("")))
    return made.where("why is null").select("path", "index", "record"), made.where("why is not null").select(label.alias("label"), F.col("why").alias("reason")).distinct()


def json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((path, line, record), issues) of JSON Lines files at any depth; a bad line is reported by its number."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    return lines_of(found.select("path", "content"))


def lines_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of files (path, content) in hand; a line that is not UTF-8 is reported like a bad one."""
    raw = F.col("content").cast("string")
    rows = found.select("path", F.is_valid_utf8(raw).alias("whole"), F.posexplode(F.split(F.make_valid_utf8(raw), "\r?\n")).alias("at", "record")).where(F.length(F.btrim("record")) > 0)
    # only in a text that had to be mended does this sign stand for what was no character
    coded = F.col("whole") | ~F.contains("record", F.lit("\ufffd"))
    rows = rows.withColumn("line", F.col("at") + 1).withColumn("ok", coded & F.try_parse_json("record").isNotNull())
    reason = F.when(coded, "not valid JSON").otherwise("not valid UTF-8")
    issues = rows.where("not ok").select(F.concat_ws(":", F.element_at(F.split("path", "/"), -1), F.col("line").cast("string")).alias("label"), reason.alias("reason"))
    return rows.where("ok").select("path", "line", "record"), issues


def export_kind(record: Column, name: Column) -> Column:
    """Which export a first record belongs to, by its keys rather than its name."""
    def has(key: str) -> Column:
        return F.coalesce(F.array_contains(F.json_object_keys(record), key), F.lit(False))

    return F.when(has("mapping"), "chatgpt").when(has("chat_messages"), "claude").when(has("header") & has("time"), "gemini").when(F.lower(name).rlike(r"\.(md|markdown|txt)$"), "markdown")


def session_kind(lines: DataFrame, sniffed: int = 30) -> DataFrame:
    """(path, kind) of agent session files, by the record types among their first lines."""
    r = F.col("record")
    kind, head = F.get_json_object(r, "$.type"), F.col("line") == 1

    def has(key: str) -> Column:
        return F.coalesce(F.array_contains(F.json_object_keys(r), key), F.lit(False))

    is_code = kind.isin("user", "assistant", "system", "summary", "custom-title") & (has("sessionId") | has("leafUuid"))
    is_codex = kind.isin("session_meta", "response_item", "event_msg", "turn_context") & F.get_json_object(r, "$.payload").startswith("{")
    is_old = head & kind.isNull() & has("id") & has("instructions")
    found = lines.where(F.col("line") <= sniffed).select("path", "line", F.when(is_code, "claude_code").when(is_codex | is_old, "codex").alias("kind")).where("kind is not null")
    return found.groupBy("path").agg(F.min_by("kind", "line").alias("kind"))
