"""Operator 9: LM scoring by deleted interpolation of trigrams, bigrams and unigrams.

P(w | u v) = a[k] c(u, v, w) / c(u, v) + b[k] c(v, w) / c(v) + d[k] c(w) / N + e[k] / (V + 1), where k is the bucket of
c(u, v) by powers of two, or that of c(v) where u v was not seen. The weights of each bucket are learned by
expectation-maximisation on counts from which the token at hand is deleted: every training token is held out in turn,
(c(u, v, w) - 1) / (c(u, v) - 1) and so on predict it. A part whose context was not seen has weight 0.

Flow: documents become blocks of word codes in a table that is kept in buckets of the block. Each block asks hash
buckets for the counts of its distinct words and bigrams and adds its own training counts; totals return to the block's
bucket. Then it asks for trigrams, but only for those of which both bigrams occur outside the block: no trigram occurs
more often than its bigrams, so the count of any other one is the block's own. Blocks then sum up the cells of the EM
(their number is fixed by the resolution, whatever the corpus) and score their documents. For the cells, shares are
rounded to half powers of two; scores use exact counts. Words meet by a 64-bit hash, bigrams and trigrams by one of 54
bits: of n distinct ones, about n / 2**54 share a count with another (one in four million for four thousand million).

Defined results: a null or empty text is its end token alone; the first token's context is the end token, and it has no
trigram; rows whose crc32(id as text) mod folds is the held-out remainder give no counts (a null id counts as the empty
text); repeated rows count each time; with no training rows N and V are 0 and the model is uniform; other columns are
not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import blocks as B

FOLDS, HELD_OUT = 7, 2
#: A block closes at so many bytes of text or documents; a single longer document is a block of its own.
BLOCK_BYTES, BLOCK_DOCS = 12_000_000, 40_000
#: Context buckets by powers of two; bins of a share: none, then half powers of two, for n-gram and for word shares.
CONTEXTS, STEPS, BINS, WORD_BINS = 24, 2, 40, 96
ROUNDS = 60
END = b"\n"  # no word: words hold no white space
#: 1 for each byte of a word, 0 for white space.
INSIDE = bytes(c not in b" \t\n\v\f\r" for c in range(256))
#: Hashes and counts hardly get smaller at higher levels.
FAST = pa.Codec("zstd", 1)
WORDS, PAIRS, TRIPLES, TOTALS = 1, 2, 3, 9


def is_held_out(doc_id: int | None, folds: int = FOLDS, remainder: int = HELD_OUT) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == remainder


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(*arrays: np.ndarray) -> bytes:
    return B.pack(*arrays, codec=FAST)


def previous(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The code before each token; the end token (code 0) before a text's first."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[np.cumsum(lengths) - lengths] = 0
    return out


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each text's number of tokens, the codes of all tokens in order of first appearance, and the words of the codes; the
    end token, code 0, closes every text."""
    joined = b"\n".join([*texts, b""]).lower()
    inside = np.frombuffer(joined.translate(INSIDE), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the last byte is white space, so that words come to an end
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    offsets = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])])
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(joined, np.uint8)[inside])]).dictionary_encode()
    ends = np.searchsorted(edges[::2], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
    lengths = np.diff(ends, prepend=0) + 1
    word = np.ones(int(lengths.sum()), bool)
    word[np.cumsum(lengths) - 1] = False
    codes = np.zeros(len(word), np.int32)
    codes[word] = words.indices.to_numpy() + 1
    _, cuts, letters = words.dictionary.buffers()
    cut = np.frombuffer(cuts, np.int64, len(words.dictionary) + 1).tolist() if len(words) else [0]
    held = letters.to_pybytes() if len(words) else b""
    return lengths.astype(np.int32), codes, [END, *(held[x:y] for x, y in itertools.pairwise(cut))]


def split_blocks(folds: int, remainder: int):
    def block(name: str, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        lengths, codes, words = coded(texts)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        train = np.array([not is_held_out(i, folds, remainder) for i in ids], np.uint8)
        yield from B.rows(name, 0, [(0, packed(*B.ids_to_array(ids), lengths, train, hashes, *B.pack_codes(codes)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = B.partition(), 0, 0
        ids: list = []
        texts: list[bytes] = []
        for i, raw in B.pairs(batches):
            if ids and (size + len(raw) > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                yield from block(f"{part}-{n}", ids, texts)
                ids, texts, size, n = [], [], 0, n + 1
            ids.append(i)
            texts.append(raw)
            size += len(raw)
        if ids:
            yield from block(f"{part}-{n}", ids, texts)

    return run


def distinct(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the place of each key among them; keys are from 0 to below the bound. Where a key and
    its position fit into one number, numbers are sorted, which is several times as fast as sorting positions by key."""
    bits = len(keys).bit_length()
    if bound.bit_length() + bits > 63:
        found, at = np.unique(keys, return_inverse=True)
        return found, at.astype(np.int32)
    both = np.sort((keys << bits) | np.arange(len(keys)))
    position = both & ((1 << bits) - 1)
    both >>= bits
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    at = np.empty(len(both), np.int32)
    at[position] = np.cumsum(new, dtype=np.int32) - 1
    return both[new], at


def placed(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (bucket, hash within it), and where each bucket starts. A block and its answers agree on it."""
    # the bucket rises with the hash, so sorting the hash sorts both; its upper bits with the position are one number
    bits = np.uint64(len(h).bit_length())
    both = np.sort((h >> bits << bits) | np.arange(len(h), dtype=np.uint64))
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    risen = h[order]
    if (risen[1:] < risen[:-1]).any():  # two hashes that differ in the lower bits alone
        order = np.argsort(h, kind="stable")
        risen = h[order]
    bucket = (risen >> np.uint64(48)) * np.uint64(n_buckets) >> np.uint64(16)
    return order, np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))


def shares(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    return part / np.maximum(whole, 1)


class Block:
    """Documents as codes, with their distinct words, bigrams and trigrams, and the counts asked for so far."""

    def __init__(self, payload: bytes, replies: list[tuple[int, int, bytes]] = (), n_buckets: int = 1) -> None:
        self.ids, self.valid, self.lengths, self.train, self.hashes, *streams = B.unpack(payload)
        self.codes = B.unpack_codes(*streams)
        self.n_buckets = n_buckets
        self.replies = sorted(replies, key=lambda r: r[:2])
        n = len(self.hashes)
        pairs, self.at = distinct(previous(self.codes, self.lengths).astype(np.int64) * n + self.codes, n * n)
        self.first, self.last = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        self.counted = np.repeat(self.train, self.lengths).astype(bool)
        if self.replies:
            self.word_count, _ = self.back(WORDS, self.word_keys())
            self.pair_count, extra = self.back(PAIRS, self.pair_keys())
            self.pair_all = self.pair_count + extra

    def word_keys(self) -> np.ndarray:
        return mixed(self.hashes)

    def pair_keys(self) -> np.ndarray:
        return mixed(mixed(self.hashes)[self.first] + np.uint64(0x9E3779B97F4A7C15) * self.hashes[self.last])

    def triples(self) -> None:
        """Distinct trigrams: the places of their two bigrams, and for each token its trigram's place (-1 for a text's first)."""
        inside = np.ones(len(self.codes), bool)
        inside[np.cumsum(self.lengths) - self.lengths] = False
        own = np.flatnonzero(inside)
        found, at = distinct(self.at[own - 1].astype(np.int64) * len(self.first) + self.at[own], len(self.first) ** 2)
        self.context, self.suffix = (found // max(len(self.first), 1)).astype(np.int32), (found % max(len(self.first), 1)).astype(np.int32)
        self.tri_at = np.full(len(self.codes), -1, np.int32)
        self.tri_at[own] = at
        self.tri_own = np.bincount(at[self.counted[own]], minlength=len(found))
        everywhere = np.bincount(at, minlength=len(found))
        # both bigrams occur outside the block, in documents of either kind
        self.asked = np.flatnonzero(np.minimum(self.pair_all[self.context], self.pair_all[self.suffix]) > everywhere)

    def triple_keys(self) -> np.ndarray:
        own = self.asked
        return mixed(self.pair_keys()[self.context[own]] * np.uint64(3) + self.hashes[self.last[self.suffix[own]]] * np.uint64(0xD1342543DE82EF95))

    def tri_counts(self) -> np.ndarray:
        out = self.tri_own.copy()
        if len(self.asked):
            out[self.asked], _ = self.back(TRIPLES, self.triple_keys())
        return out

    def back(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Answers of a kind: training counts, and counts of the other documents."""
        order, _ = placed(h, self.n_buckets)
        got = [B.unpack(p) for k, _, p in self.replies if k == kind]
        out = []
        for part in (0, 1):
            flat = np.concatenate([g[part] for g in got] or [np.empty(0, np.int64)])
            if len(flat) != len(h):
                raise ValueError("a block lacks answers")
            put = np.empty(len(h), np.int64)
            put[order] = flat
            out.append(put)
        return out[0], out[1]

    def tokens(self) -> tuple[np.ndarray, ...]:
        """Places of the distinct (trigram, bigram) pairs of tokens: for each the trigram's place or -1, the bigram's, and
        for each token the pair's place."""
        starts = np.cumsum(self.lengths) - self.lengths
        opening, where = np.unique(self.at[starts], return_inverse=True)
        tri = np.concatenate([np.full(len(opening), -1), np.arange(len(self.suffix))])
        at = self.tri_at + len(opening)
        at[starts] = where
        return tri, np.concatenate([opening, self.suffix]), at


def request_rows(block: str, kind: int, h: np.ndarray, n: np.ndarray, extra: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Per bucket: sorted hashes (as steps), and counts in training and other documents."""
    order, cuts = placed(h, n_buckets)
    h, n, extra = h[order], n[order].astype(np.uint32), extra[order].astype(np.uint32)
    if kind != WORDS:
        h = h >> np.uint64(10)  # 54 bits are left: steps between sorted hashes then take about four bytes
    for b in range(n_buckets):
        if cuts[b] < cuts[b + 1]:
            x, y = cuts[b], cuts[b + 1]
            yield from B.rows(block, kind, [(b, packed(h[x : x + 1], np.diff(h[x:y]), n[x:y], extra[x:y]))])


def requests(n_buckets: int):
    """Words and bigrams of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block(row["payload"])
                for kind, keys, at in ((WORDS, own.word_keys(), own.codes), (PAIRS, own.pair_keys(), own.at)):
                    n, every = np.bincount(at[own.counted], minlength=len(keys)), np.bincount(at, minlength=len(keys))
                    yield from request_rows(row["block"], kind, keys, n, every - n, n_buckets)

    return run


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of a bucket's hashes, returned to each asking block in its order; and the bucket's N and V (of no block)."""
    for bucket, asked in B.grouped(batches, "bucket"):
        for kind in (WORDS, PAIRS, TRIPLES):
            rows = [(r["block"], B.unpack(r["payload"])) for r in asked if r["kind"] == kind]
            if not rows:
                continue
            keys = [np.cumsum(np.concatenate([x[0], x[1]]), dtype=np.uint64) for _, x in rows]
            every = np.concatenate(keys)
            order = np.argsort(every, kind="stable")  # merges what each block has sorted
            new = np.diff(every[order], prepend=np.uint64(0)) > 0
            new[0] = True
            at = np.empty(len(every), np.int64)
            at[order] = np.cumsum(new) - 1
            total, extra = (np.bincount(at, weights=np.concatenate([x[k] for _, x in rows])).astype(np.int64) for k in (2, 3))
            cut = 0
            for (block, _), own in zip(rows, keys, strict=True):
                index = at[cut : cut + len(own)]
                yield from B.rows(block, kind, [(bucket, packed(total[index], extra[index]))])
                cut += len(own)
            if kind == WORDS:
                yield from B.rows("", TOTALS, [(bucket, packed(np.array([total.sum(), (total > 0).sum()], np.int64)))])


def opened(rows: pa.Table, n_buckets: int) -> tuple[str, Block]:
    """A block and its answers."""
    kinds = rows.column("kind").to_pylist()
    if 0 not in kinds:
        raise ValueError("answers of a block that is not there")
    payloads = rows.column("payload").to_pylist()
    replies = [(k, b, p) for k, b, p in zip(kinds, rows.column("bucket").to_pylist(), payloads, strict=True) if k]
    own = Block(payloads[kinds.index(0)], replies, n_buckets)
    own.triples()
    return rows.column("block")[0].as_py(), own


def more_requests(n_buckets: int):
    """Trigrams of a block that may occur outside it."""

    def run(rows: pa.Table) -> pa.Table:
        name, own = opened(rows, n_buckets)
        n = own.tri_own[own.asked]
        every = np.bincount(own.tri_at[own.tri_at >= 0], minlength=len(own.tri_own))[own.asked]
        return pa.Table.from_batches(request_rows(name, TRIPLES, own.triple_keys(), n, every - n, n_buckets), schema=B.ARROW)

    return run


def context_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then by powers of two."""
    return np.minimum(np.frexp(np.asarray(count, np.float64))[1], CONTEXTS - 1)


def bucket_of(pair_context: np.ndarray, word_context: np.ndarray) -> np.ndarray:
    """The bucket of the count of the two words before, or that of the one before where those were not seen."""
    return np.where(pair_context > 0, context_of(pair_context), CONTEXTS + context_of(word_context))


def bin_of(p: np.ndarray, bins: int) -> np.ndarray:
    """0 for no share, then half powers of two downwards."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-np.log2(p) * STEPS), 0, bins - 2) + 1, 0).astype(np.int64)


def cell_of(bucket: np.ndarray, p3: np.ndarray, p2: np.ndarray, p1: np.ndarray) -> np.ndarray:
    return ((bucket * BINS + bin_of(p3, BINS)) * BINS + bin_of(p2, BINS)) * WORD_BINS + bin_of(p1, WORD_BINS)


def cells(n_buckets: int, total: int):
    """Sums of the EM's cells over a block's training tokens, each deleted from the counts that predict it."""

    def run(rows: pa.Table) -> pa.Table:
        _, own = opened(rows, n_buckets)
        tri, pair, at = own.tokens()
        n = np.bincount(at[own.counted], minlength=len(tri))
        keep = np.flatnonzero(n)
        tri, pair, n = tri[keep], pair[keep], n[keep]
        triple = np.where(tri >= 0, own.tri_counts()[tri] if len(own.tri_own) else 0, 1) - 1
        before = np.where(tri >= 0, own.pair_count[own.context[tri]] if len(own.context) else 0, 1) - 1
        word = own.word_count[own.first[pair]] - 1
        cell, where = distinct(cell_of(bucket_of(before, word), np.where(before > 0, shares(triple, before), 0.0), np.where(word > 0, shares(own.pair_count[pair] - 1, word), 0.0), (own.word_count[own.last[pair]] - 1) / max(total - 1, 1)), 2 * CONTEXTS * BINS * BINS * WORD_BINS)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(np.bincount(where, weights=n, minlength=len(cell)), pa.float64())})

    return run


def learn(cell: np.ndarray, n: np.ndarray, vocabulary: int) -> np.ndarray:
    """Weights (buckets, 4) by EM; a bucket without counts takes those of the nearest lower one of its kind."""
    value = np.concatenate([[0.0], 2.0 ** (-np.arange(WORD_BINS - 1) / STEPS)])
    k = cell // (BINS * BINS * WORD_BINS)
    p = np.stack([value[cell // (BINS * WORD_BINS) % BINS], value[cell // WORD_BINS % BINS], value[cell % WORD_BINS], np.full(len(cell), 1.0 / (vocabulary + 1))], axis=1)
    allowed = np.ones((2 * CONTEXTS, 4))
    allowed[CONTEXTS:, 0] = 0  # no trigram without its context
    allowed[CONTEXTS, 1] = 0
    w = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        part = w[k] * p
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(k, weights=part[:, j], minlength=2 * CONTEXTS) for j in range(4)], axis=1)
        # a thousandth of a token keeps every weight above 0, so that unseen words keep some probability
        new = (new + 1e-3) * allowed
        w = new / new.sum(axis=1, keepdims=True)
    seen = np.bincount(k, minlength=2 * CONTEXTS) > 0
    for kind in (0, CONTEXTS):
        for j in range(kind + 2, kind + CONTEXTS):
            if not seen[j] and seen[kind + 1 : j].any():
                w[j] = w[j - 1]
    return w


def scores(n_buckets: int, total: int, vocabulary: int, weights: np.ndarray):
    def run(rows: pa.Table) -> pa.Table:
        _, own = opened(rows, n_buckets)
        tri, pair, at = own.tokens()
        triple = np.where(tri >= 0, own.tri_counts()[tri] if len(own.tri_own) else 0, 0)
        before = np.where(tri >= 0, own.pair_count[own.context[tri]] if len(own.context) else 0, 0)
        word = own.word_count[own.first[pair]]
        w = weights[bucket_of(before, word)]
        p = w[:, 0] * shares(triple, before) + w[:, 1] * shares(own.pair_count[pair], word) + w[:, 2] * own.word_count[own.last[pair]] / max(total, 1) + w[:, 3] / (vocabulary + 1)
        log_p = np.log10(p)[at]
        base = np.log10((own.word_count + 1) / (total + vocabulary + 1))
        starts = np.cumsum(own.lengths) - own.lengths
        return pa.table(
            {
                "doc_id": B.array_to_ids(own.ids, own.valid),
                "held_out": pa.array(own.train == 0),
                "n_tokens": pa.array(own.lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat((own.word_count > 0)[own.codes].astype(np.int64), starts), pa.int64()),
                "train_tokens": pa.array(np.full(len(starts), total), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base[own.codes], starts), pa.float64()),
                "score": pa.array(np.add.reduceat(log_p, starts), pa.float64()),
            }
        )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, remainder: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row for each row of docs."""
    spark = docs.sparkSession
    B.tune(spark)
    n = B.buckets(spark)
    # blocks and their answers lie in one table, in buckets of the block: answers come to it once, and no block moves
    table = B.new_table()
    B.put_bucketed(B.texts(docs, id_col, text_col).mapInArrow(B.releasing(split_blocks(folds, remainder)), B.ROW), table, "block", n)

    def answered(asked: DataFrame) -> None:
        B.put_bucketed(B.by_key(asked, "bucket", ["kind", "block"], answers, B.ROW).repartition(n, "block"), table, "block", n)

    def at_blocks(fn, schema: str) -> DataFrame:
        return B.read_bucketed(spark, table).where(f"kind < {TOTALS}").groupBy("block").applyInArrow(fn, schema)

    answered(B.read_bucketed(spark, table).mapInArrow(B.releasing(requests(n)), B.ROW))
    totals = [B.unpack(r.payload)[0] for r in B.read_bucketed(spark, table).where(f"kind = {TOTALS}").collect()]  # two numbers for each bucket
    total, vocabulary = (int(sum(x[j] for x in totals)) for j in (0, 1))
    answered(at_blocks(more_requests(n), B.ROW))
    gathered = at_blocks(cells(n, total), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # bounded by the bins
    weights = learn(np.array([r.cell for r in gathered], np.int64), np.array([r.n for r in gathered], np.float64), vocabulary)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = at_blocks(scores(n, total, vocabulary, weights), schema)
    B.forget_table(spark, table)
    return out
