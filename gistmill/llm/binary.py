"""Operator 3: token ids in fixed-width bit-packed shards.

A shard is one binary value: a header, the token offset of each of its documents and of each block, and the ids in
as few bits as the largest id of the vocabulary needs. Widths are the same everywhere, so id k of a shard lies at bit
k * width: readers unpack a block, or any slice, with numpy alone. Shards are kept as rows of a Parquet table in the
shared folder, in ascending document order: rows are dealt by range of the id, sorted inside each range, and cut
into shards of bounded size; `inside` is the shard's place in its range. To read them, only the ranges' places in the
whole sequence (one number for each) are sent to the tasks; shards are read where they lie.

Encoding: the text is cut at ASCII white space so that no pre-token of the byte-level pattern is cut (a single space
goes with the word after it), and each distinct piece of a worker's documents is encoded once, by the file's ranks. Texts with other white
space or special strings are encoded whole.

Defined results: a null or empty text is the end id alone; null ids sort first; repeated ids keep all their rows in
the order of their texts' hashes; other columns are not read; an empty table writes no shard and reads no row.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gistmill.llm import blocks as B
from gistmill.llm.bpe import tokenizer
from gistmill.session import shared_dir

MAGIC, END_ID = b"TOKPACK1", 0
#: A shard closes at about so many ids; ids of a block of the index.
SHARD_IDS, BLOCK_IDS = 2_000_000, 4096
HELD_PIECES = 400_000
#: Texts are encoded together up to so many bytes.
CHUNK_BYTES = 6_000_000
#: 1 for each byte of a word, 0 for white space.
INSIDE = bytes(c not in b" \t\n\v\f\r" for c in range(256))
ODD = re.compile("[^\\S \t-\r]")


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids in width bits each, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count of packed data, without reading the rest."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, start * width // 8).astype(np.uint32)
    first = start * width
    raw = np.frombuffer(data, np.uint8, (first + count * width + 7) // 8 - first // 8, first // 8)
    bits = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + count * width].reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """A shard: magic, width, counts; document ids, validity and offsets; block offsets in bits; packed ids."""
    keys, valid = B.ids_to_array(doc_ids)
    blocks = np.arange(0, len(ids), BLOCK_IDS, dtype=np.uint64) * np.uint64(width)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return struct.pack("<8sIQQQ", MAGIC, width, len(doc_ids), len(ids), len(blocks)) + keys.astype("<i8").tobytes() + valid.tobytes() + offsets.tobytes() + blocks.astype("<u8").tobytes() + pack_bits(ids, width)


class Shard:
    """Random access to a shard's documents and ids."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, docs, self.n_ids, blocks = struct.unpack_from("<8sIQQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<8sIQQQ")
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.valid = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.offsets = np.frombuffer(data, "<u8", docs + 1, at + 9 * docs).astype(np.int64)
        self.blocks = np.frombuffer(data, "<u8", blocks, at + 17 * docs + 8).astype(np.int64)
        self.body = memoryview(data)[at + 17 * docs + 8 + 8 * blocks :]

    def slice(self, start: int, count: int) -> np.ndarray:
        """Ids start .. start + count, by way of the block that start lies in."""
        if not count:
            return np.empty(0, np.uint32)
        block = start // BLOCK_IDS
        head = int(self.blocks[block]) // 8
        skip = int(self.blocks[block]) % 8
        inside = start - block * BLOCK_IDS
        if self.width in (8, 16, 32):
            return unpack_bits(self.body[head:], self.width, inside, count)
        first = skip + inside * self.width
        raw = np.frombuffer(self.body, np.uint8, (first + count * self.width + 7) // 8, head)
        bits = np.unpackbits(raw, bitorder="little")[first : first + count * self.width].reshape(count, self.width)
        return (bits.astype(np.uint32) << np.arange(self.width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible bytes are their own letter, the others
    take the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str):
    """An encoder of pieces from the tokenizer file's own vocabulary, whose ids rise with the merges: the same ids as
    the tokenizer gives, several times as fast."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def specials(path: str) -> tuple[bytes, ...]:
    return tuple(t.content.encode() for t in tokenizer(path).get_added_tokens_decoder().values())


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each text's number of pieces, the codes of all pieces, and the distinct pieces. A piece is a word with the space
    before it; white space before that, and its last byte where that is no space; or white space at a text's end."""
    joined = b"".join(texts)
    data, inside = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(INSIDE), bool)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    mark = np.zeros(len(data) + 1, bool)
    mark[1:-1] = inside[:-1] & ~inside[1:]
    words = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    begins = np.zeros(len(data) + 1, bool)
    begins[0] = begins[ends] = True
    words = words[~begins[words]]
    mark[words - 1] = True
    mark[words[data[words - 1] != 32]] = True
    at = np.flatnonzero(mark | begins)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(joined)]).dictionary_encode()
    _, cuts, letters = pieces.dictionary.buffers()
    bounds = np.frombuffer(cuts, np.int64, len(pieces.dictionary) + 1).tolist() if len(pieces) else [0]
    held = letters.to_pybytes() if len(pieces) else b""
    return np.diff(np.searchsorted(at, ends), prepend=0), pieces.indices.to_numpy(), [held[x:y] for x, y in itertools.pairwise(bounds)]


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts of up to CHUNK_BYTES or a single longer one, in their order."""
    held: list[bytes] = []
    size = 0
    for raw in texts:
        if held and size + len(raw) > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


class Pieces:
    """Ids of pieces; each distinct piece is encoded once until the table is full and starts anew."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.table, self.lengths, self.flat, self.offsets = B.Codes(), np.empty(0, np.int64), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.table) > HELD_PIECES:
            self.clear()
        whole = [any(s in raw for s in specials(self.path)) or (not raw.isascii() and ODD.search(raw.decode("utf-8", "replace")) is not None) for raw in texts]
        counts, codes, pieces = cut([raw for raw, odd in zip(texts, whole, strict=True) if not odd])
        codes = np.fromiter(map(self.table.__getitem__, pieces), np.int64, len(pieces))[codes]
        encoder = piece_encoder(self.path)
        made = [encoder.encode_ordinary(p.decode("utf-8", "replace")) for p in itertools.islice(self.table, len(self.lengths), None)]
        n = np.fromiter(map(len, made), np.int64, len(made))
        self.lengths = np.concatenate([self.lengths, n])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(n.sum()))])
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        n, ids = B.ragged_take(self.offsets, self.flat, codes)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        plain = iter(np.split(ids, ends[:-1]))
        library = tokenizer(self.path)
        return [np.array(library.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) if odd else next(plain) for odd, raw in zip(whole, texts, strict=True)]


def shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of docs in ascending order of their ids, as rows (part, shard, inside, n_ids, data). Texts are dealt by ranges of
    the id before they are encoded, since the sampling of the ranges reads its input once more."""
    B.tune(docs.sparkSession)
    width = bit_width(tokenizer(path).get_vocab_size())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, inside, pieces = TaskContext.get().partitionId(), 0, 0, Pieces(path)
        for _, keys, texts in B.blocked(batches):
            made = [np.append(x, np.uint32(END_ID)) for chunk in chunks(texts) for x in pieces.encode(chunk)]
            lengths = np.array([len(x) for x in made], np.int64)
            group = np.maximum(np.cumsum(lengths) - 1, 0) // SHARD_IDS
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                n_ids = int(lengths[own].sum())
                data = write_shard([keys[k] for k in own], lengths[own], np.concatenate([made[k] for k in own]), width)
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (part, shard, inside, n_ids)), pa.array([data], pa.binary())], names=["part", "shard", "inside", "n_ids", "data"])
                shard, inside = shard + 1, inside + n_ids

    n = B.buckets(docs.sparkSession)
    first, tie = F.col("id").asc_nulls_first(), F.col("tie")
    dealt = B.texts(docs, id_col, text_col).withColumn("tie", F.crc32("text")).repartitionByRange(n, first, tie).sortWithinPartitions(first, tie)
    return dealt.select("id", "text").mapInArrow(run, "part long, shard long, inside long, n_ids long, data binary")


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids binary (little-endian unsigned 32-bit) of all shards of a folder."""
    B.tune(spark)
    shards = spark.read.parquet(target)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range, whatever the documents
    starts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column("first").to_pylist(), batch.column("data"), strict=True):
                shard = Shard(data.as_buffer())
                for at in range(0, len(shard.doc_ids), 512):
                    end = min(at + 512, len(shard.doc_ids))
                    yield pa.RecordBatch.from_arrays(
                        [B.array_to_ids(shard.doc_ids[at:end], shard.valid[at:end]), pa.array(shard.offsets[at:end] + first, pa.int64()), pa.array(np.diff(shard.offsets[at : end + 1]), pa.int64()), pa.array([shard.document(k).astype("<u4").tobytes() for k in range(at, end)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    # without the hint both sides are shuffled before their sizes are known: the ids once more on disk
    placed = shards.join(F.broadcast(starts), "part").select((F.col("inside") + F.col("part_start")).alias("first"), "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op3(docs: DataFrame, path: str) -> DataFrame:
    """Encode, write in the shared folder, read back, and digest what was read."""
    spark = docs.sparkSession
    B.tune(spark)
    target = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    shards(docs, path).write.parquet(target)
    return read_tokens(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
