"""Blocks of documents, their distinct words, and questions about words answered once for all blocks.

A block holds some tens of MB of text: per document the codes of its words, and each distinct word once.
Words travel to hash buckets as one packed row per (block, bucket), are answered there, and the answers
return to their block. So a word crosses the network once per block however often it occurs, no key is hot,
and a task holds one bucket or one block. Ids, codes and answers are numpy arrays inside binary columns.
"""

from __future__ import annotations

import ctypes
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.session import shared_dir

#: A block closes at so many bytes of text or documents; a single longer document is a block of its own.
BLOCK_BYTES, BLOCK_DOCS = 32_000_000, 60_000
ROW = "block string, kind int, bucket int, payload binary"
ARROW = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
ZSTD = pa.Codec("zstd", 9)


def tune(spark: SparkSession) -> None:
    """Whole texts and packed blocks are large rows: few to an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def buckets(spark: SparkSession) -> int:
    """As many buckets as the cluster's shuffle has partitions, so that a bucket's share follows the cluster's sizing."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Gives a worker's freed memory back to the system, as an idle worker lives on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def pack(*arrays: np.ndarray, codec: pa.Codec = ZSTD) -> bytes:
    """Arrays to bytes: a header of types and lengths, then each array's byte planes, zstd-compressed."""
    parts = [struct.pack("<H", len(arrays))]
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
        body = codec.compress(planes, asbytes=True) if planes else b""
        parts += [struct.pack("<8sQQ", a.dtype.str.encode(), len(a), len(body)), body]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays that pack() took."""
    (n,), at, out = struct.unpack_from("<H", data), 2, []
    for _ in range(n):
        kind, rows, size = struct.unpack_from("<8sQQ", data, at)
        at += 24
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        if rows:
            planes = ZSTD.decompress(data[at : at + size], rows * dtype.itemsize, asbytes=True)
            out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, rows).T).view(dtype).ravel())
        else:
            out.append(np.empty(0, dtype))
        at += size
    return out


def pack_codes(codes: np.ndarray) -> list[np.ndarray]:
    """Codes as streams that compress well: a byte for the 255 most frequent, then two bytes, then four for the rest."""
    n = np.bincount(codes) if len(codes) else np.empty(0, np.int64)
    order = np.argsort(-n, kind="stable").astype(np.int32)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    rank = rank[codes]
    rest = rank[rank >= 255] - 255
    return [order[: 65535 + 255].copy(), np.minimum(rank, 255).astype(np.uint8), np.minimum(rest, 65535).astype(np.uint16), order[rest[rest >= 65535] + 255]]


def unpack_codes(order: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The codes that pack_codes() took; its last stream holds codes themselves."""
    out = np.empty(len(low), np.int32)
    first = low < 255
    out[first] = order[low[first]]
    rest = np.empty(len(mid), np.int32)
    near = mid < 65535
    rest[~near] = high
    at = mid[near].astype(np.int64) + 255
    rest[near] = order[at]
    out[~first] = rest
    return out


def ragged_take(offsets: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows index of a ragged array: (lengths, values)."""
    lengths = (offsets[1:] - offsets[:-1])[index]
    ends = np.cumsum(lengths)
    shift = np.repeat(offsets[:-1][index] - (ends - lengths), lengths)
    return lengths, values[shift + np.arange(ends[-1] if len(ends) else 0)]


class Codes(dict):
    """Words to codes in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that block operators read: the id as a long, the text as UTF-8 bytes (null: empty)."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def ids_to_array(ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their validity as packable arrays."""
    return np.array([x or 0 for x in ids], np.int64), np.array([x is not None for x in ids], np.uint8)


def array_to_ids(ids: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=valid == 0)


def partition() -> int:
    return TaskContext.get().partitionId() if TaskContext.get() else 0


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """(id, text) of each row of texts()."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list[bytes]]]:
    """(block name, ids, texts) of bounded size, in the order of the rows."""
    ids: list = []
    held: list[bytes] = []
    size = n = 0
    for i, t in pairs(batches):
        if held and (size + len(t) > BLOCK_BYTES or len(held) >= BLOCK_DOCS):
            yield f"{partition()}-{n}", ids, held
            ids, held, size, n = [], [], 0, n + 1
        ids.append(i)
        held.append(t)
        size += len(t)
    if held:
        yield f"{partition()}-{n}", ids, held


def word_bucket(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % np.uint32(n)


def rows(block: str, kind: int, payloads: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """One batch for each packed row, so that no batch grows with the number of buckets."""
    for bucket, payload in payloads:
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], schema=ARROW)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of a sorted partition, group by group."""
    now: object = None
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def new_table() -> str:
    return f"blocks_{uuid.uuid4().hex}"


def put_bucketed(df: DataFrame, name: str, key: str, n: int) -> None:
    """Adds df to a table in the shared folder that is kept in n buckets of a key: groups of the key are read from it
    without moving. A checkpoint forgets how its rows lie, such a table does not."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}"
    df.write.mode("append").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    """The table as it is now."""
    spark.catalog.refreshTable(name)
    return spark.table(name)


def forget_table(spark: SparkSession, name: str) -> None:
    """Takes the table's entry out of the catalog; its files stay for the plans that read them."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def releasing(fn: Callable) -> Callable:
    """fn over batches, with release() at the end of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def by_key(df: DataFrame, key: str, order: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn over partitions in which rows of a key lie together, in the given order."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(releasing(fn), schema)
