"""Operator 1: BPE encoding and decoding over a distinct-word table.

Spark splits texts into arrays of words -> one row of codes (positions in a distinct-word list) and one distinct-word
list for each block (cut with a checkpoint) -> each distinct word is encoded once, in the one bucket its hash names ->
ids return to the blocks and are joined to the codes by position -> decoding joins each id to its piece.

Two of the joins are not Spark joins of single words or ids. A row for each word of a text, with its position, sorted
back by position, is several times the input on disk, where the limit is 1.5 times; a block's packed codes and answers
are 1.4 times. And the piece table is keyed by 0 .. vocabulary - 1, so its join is a gather from the table in id order
(as large as the vocabulary, whatever the data), which moves no row.

Words split at ASCII white space, which the tokenizer's pattern never crosses and drops, so the ids of a text are
the ids of its words one after the other. Defined results: a null or empty text has no ids and decodes to "";
a null id stays null; repeated rows each give a row; other columns of the input are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import blocks as B
from gistmill.session import durable

#: ASCII white space as a pattern and as characters.
SPACE, SPACE_CHARS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
#: Words that one call of the tokenizer takes, joined by a special token.
CALL_WORDS = 2000


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, once for each worker; truncation and padding off."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def separator(path: str) -> tuple[str, int]:
    """A special token: the tokenizer never merges across it."""
    i, token = max(tokenizer(path).get_added_tokens_decoder().items())
    return token.content, i


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids) of words, each as the tokenizer encodes it alone."""
    tok, (mark, mark_id) = tokenizer(path), separator(path)
    out: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]
    for at in range(0, len(words), CALL_WORDS):
        part = words[at : at + CALL_WORDS]
        odd = {k: tok.encode(w, add_special_tokens=False).ids for k, w in enumerate(part) if any(s in w for s in specials)}
        ids = np.array(tok.encode(mark.join("" if k in odd else w for k, w in enumerate(part)), add_special_tokens=False).ids, np.int64)
        cuts = np.flatnonzero(ids == mark_id)
        bounds = np.concatenate([[-1], cuts, [len(ids)]])
        n = np.diff(bounds) - 1
        ids = np.delete(ids, cuts)
        if odd:
            pieces = np.split(ids, np.cumsum(n)[:-1])
            for k, x in odd.items():
                pieces[k] = np.array(x, np.int64)
            n, ids = np.array([len(x) for x in pieces]), np.concatenate(pieces)
        out.append(ids)
        lengths.append(n)
    return np.concatenate(lengths or [np.empty(0, np.int64)]), np.concatenate(out or [np.empty(0, np.int64)])


def split_blocks(n_buckets: int):
    def packed(name: str, ids: list, lengths: list[int], codes: list[np.ndarray], table: B.Codes) -> Iterator[pa.RecordBatch]:
        words = list(table)
        bucket = B.word_bucket(words, n_buckets)
        flat = np.concatenate(codes) if codes else np.empty(0, np.int32)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32) if n_buckets - 1 <= np.iinfo(k).max)
        yield from B.rows(name, 0, [(0, B.pack(*B.ids_to_array(ids), np.array(lengths, np.int32), bucket.astype(kind), *B.pack_codes(flat)))])
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            if cuts[b] < cuts[b + 1]:
                raw = b"\n".join(words[k] for k in order[cuts[b] : cuts[b + 1]])
                yield from B.rows(name, 1, [(b, B.ZSTD.compress(raw, asbytes=True) + len(raw).to_bytes(8, "little"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = B.partition(), 0
        ids, lengths, codes, table, size = [], [], [], B.Codes(), 0
        for batch in batches:
            words = batch.column("words")
            ends = np.asarray(words.offsets, np.int64)
            flat = words.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.binary())
            ends, n_bytes = ends - ends[0], np.asarray(pc.binary_length(flat), np.int64)
            if not len(batch):
                continue
            # each distinct word of the batch is looked up once
            local = flat.dictionary_encode()
            place = np.asarray(local.indices, np.int32)
            filled = np.diff(ends) - (n_bytes[ends[:-1]] == 0)  # a text without words is one empty word
            own = local.dictionary.to_pylist()
            weight = np.add.reduceat(n_bytes, ends[:-1]) + np.diff(ends)
            at = 0
            for k, i in enumerate(batch.column("id").to_pylist()):
                if ids and (size + weight[k] > B.BLOCK_BYTES or len(ids) >= B.BLOCK_DOCS):
                    if at < k:
                        codes.append(coded(table, own, place[ends[at] : ends[k]]))
                    yield from packed(f"{part}-{n}", ids, lengths, codes, table)
                    ids, lengths, codes, table, size, n, at = [], [], [], B.Codes(), 0, n + 1, k
                ids.append(i)
                lengths.append(int(filled[k]))
                size += weight[k]
            codes.append(coded(table, own, place[ends[at] :]))
        if ids:
            yield from packed(f"{part}-{n}", ids, lengths, codes, table)

    return run


def coded(table: B.Codes, words: list[bytes], place: np.ndarray) -> np.ndarray:
    """Codes of words given by their places in a list; the empty word is none."""
    used = np.flatnonzero(np.bincount(place, minlength=len(words)))
    to = np.full(len(words), -1, np.int32)
    to[used] = [table[words[k]] if words[k] else -1 for k in used]
    out = to[place]
    return out[out >= 0]


def answer(path: str):
    """Each distinct word of a bucket is encoded once; every asking block gets its ids in the order it asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, asked in B.grouped(batches, "bucket"):
            table = B.Codes()
            want = []
            for row in asked:
                raw = row["payload"]
                words = B.ZSTD.decompress(raw[:-8], int.from_bytes(raw[-8:], "little"), asbytes=True).split(b"\n")
                want.append((row["block"], np.fromiter(map(table.__getitem__, words), np.int64, len(words))))
            lengths, ids = encode_words([w.decode("utf-8", "replace") for w in table], path)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            for block, index in want:
                n, got = B.ragged_take(offsets, ids, index)
                yield from B.rows(block, 1, [(bucket, B.pack(n.astype(np.uint32), got.astype(np.uint32)))])

    return run


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a block's documents, by the positions of their words."""
    for block, parts in B.grouped(batches, "block"):
        if parts[0]["kind"] != 0:
            raise ValueError(f"block {block} has answers but no documents")
        ids, valid, lengths, bucket, *streams = B.unpack(parts[0]["payload"])
        codes = B.unpack_codes(*streams)
        order = np.argsort(bucket, kind="stable")  # words in the order of the answers
        answers = [B.unpack(p["payload"]) for p in parts[1:]]
        n = np.concatenate([a[0] for a in answers]) if answers else np.empty(0, np.uint32)
        if len(n) != len(bucket):
            raise ValueError(f"block {block} lacks answers")
        flat = np.concatenate([a[1] for a in answers]) if answers else np.empty(0, np.uint32)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        offsets = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        step = 512
        for at in range(0, len(lengths), step):
            few = lengths[at : at + step]
            k, tokens = B.ragged_take(offsets, flat, place[codes[ends[at] : ends[at + len(few)]]])
            sums = np.concatenate([[0], np.cumsum(k, dtype=np.int64)])
            per = sums[(ends[at : at + len(few) + 1] - ends[at])]
            raw = pa.Array.from_buffers(pa.large_binary(), len(few), [None, pa.py_buffer((per * 4).astype(np.int64)), pa.py_buffer(tokens.astype("<u4"))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([B.array_to_ids(ids[at : at + len(few)], valid[at : at + len(few)]), pa.array(np.diff(per), pa.int64()), raw], names=["doc_id", "n_tokens", "ids"])


ENCODED = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id long, n_tokens long, ids binary (little-endian unsigned 32-bit), one row for each row of docs; if decoded,
    with the text that decode() makes of the ids, by the same worker."""
    spark = docs.sparkSession
    B.tune(spark)
    text = F.coalesce(docs[text_col], F.lit(""))
    words = F.split(F.btrim(text, F.lit(SPACE_CHARS)), SPACE)
    made = durable(docs.select(docs[id_col].cast("long").alias("id"), words.alias("words")).mapInArrow(B.releasing(split_blocks(B.buckets(spark))), B.ROW))
    replies = B.by_key(made.where("kind = 1"), "bucket", ["block"], answer(path), B.ROW)
    blocks = made.where("kind = 0").unionByName(replies)
    if decoded:
        return B.by_key(blocks, "block", ["kind", "bucket"], lambda batches: with_text(path)(assemble(batches)), f"{ENCODED}, text string")
    return B.by_key(blocks, "block", ["kind", "bucket"], assemble, ENCODED)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """The piece of each id, by id; null where no id is."""
    tok = tokenizer(path)
    found = {i: w for w, i in tok.get_vocab(with_added_tokens=True).items()}
    return pa.array([found.get(i) for i in range(max(found) + 1)], pa.string())


def with_text(path: str):
    """The pieces of each row's ids joined as the tokenizer without a decoder does, by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in batches:
            raw = batch.column("ids").cast(pa.large_binary())
            flat = np.frombuffer(b"".join(raw.to_pylist()), "<u4")
            n = np.asarray(batch.column("n_tokens"), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), table.take(pa.array(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.binary_join(lists, " ")], names=[*batch.schema.names, "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (from encode) with text."""
    B.tune(encoded.sparkSession)
    return encoded.mapInArrow(with_text(path), f"{ENCODED}, text string")


def op1(docs: DataFrame, path: str) -> DataFrame:
    """The contract's digest of encode and decode."""
    both = encode(docs, path, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
