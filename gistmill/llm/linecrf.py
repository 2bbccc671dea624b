"""Operator 4: quality classifier, a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are shape ratios of the line itself and of both neighbours; transitions tie
lines together. Training lines carry the label of their document; weights maximise the regularised likelihood.
A document's score is the forward-backward marginal of "good", averaged over its lines by their length.

The fit reads a bounded sample of rows: of the labelled rows that are not held out, the SAMPLE_DOCS with the smallest
hash of their id, each with all its lines. Scoring reads every line of every text.

Defined results: a null or empty text is one empty line and gets that line's marginal; lines of no bytes weigh as one
byte; without training rows every score is 0.5; a null id is scored and never trained on; rows that repeat are scored
alike; all columns of the input may be carried, whatever their names (free_name() finds one for the score). A sampled
id that labels or documents hold several times is one label (the larger) and all its texts. No id, language or source
is a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm import blocks as B

FOLDS, HELD_OUT = 3, 1
SAMPLE_DOCS = 4000
ROUNDS, RATE, DECAY = 220, 0.15, 1e-3
SYMBOLS, MARKS, STOPS, DIGITS, UPPER = b"#*$%&|<>{}[]=+~^\\@_", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = 20
#: Lines whose features are held at once while scoring; a longer text is a group of its own.
HELD_LINES = 50_000


def shape(line: bytes, seen: set[bytes], last: bytes | None) -> list[float]:
    """Features of one line."""
    words = line.split()
    n, k = max(len(line), 1), max(len(words), 1)
    symbols = (len(line) - len(line.translate(None, SYMBOLS))) / n
    marks = (len(line) - len(line.translate(None, MARKS))) / n
    stops = (len(line) - len(line.translate(None, STOPS))) / k
    digits = (len(line) - len(line.translate(None, DIGITS))) / n
    upper = (len(line) - len(line.translate(None, UPPER))) / n
    distinct = len(set(words)) / k
    short = sum(len(w) <= 3 for w in words) / k
    mean = n / k
    again = line in seen and bool(words)
    return [
        1.0, min(len(words), 60) / 60, symbols * 5, marks * 5, stops, digits * 5, upper * 3, distinct, short, min(mean, 40) / 10,
        float(symbols > 0.03), float(symbols > 0.12), float(marks > 0.05), float(upper > 0.3), float(distinct < 0.5), float(distinct < 0.2),
        float(len(words) < 4), float(again), float(line == last and bool(words)), float(digits > 0.2),
    ]


def document(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with those of its neighbours, lengths of the lines)."""
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    own = np.empty((len(lines), FEATURES), np.float64)
    last = None
    for k, line in enumerate(lines):
        own[k] = shape(line, seen, last)
        seen.add(line)
        last = line
    wide = np.zeros((len(lines), 3 * FEATURES), np.float64)
    wide[:, :FEATURES] = own
    wide[1:, FEATURES : 2 * FEATURES] = own[:-1]
    wide[:-1, 2 * FEATURES :] = own[1:]
    return wide, np.array([max(len(x), 1) for x in lines], np.float64)


class Chains:
    """Documents as columns of padded arrays, longest first, so that each step works on those that still have lines."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        self.steps = int(self.lengths[0]) if len(lengths) else 0
        self.live = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left")  # documents with a line t

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of good for each line, expected transitions 2 x 2); unary is the log-odds of good."""
        n = len(self.lengths)
        phi = np.stack([np.ones_like(unary), np.exp(np.clip(unary, -30, 30))], axis=1)
        trans = np.exp(pair)
        alpha = np.empty((len(unary), 2))
        now = np.empty((n, 2))
        for t in range(self.steps):
            m = self.live[t]
            at = self.starts[:m] + t
            now = phi[at] * (now[:m] @ trans if t else 1.0)
            now /= now.sum(axis=1, keepdims=True)
            alpha[at] = now
        good = np.empty(len(unary))
        both = np.zeros((2, 2))
        back = np.ones((n, 2))
        for t in range(self.steps - 1, -1, -1):
            m = self.live[t]
            at = self.starts[:m] + t
            joint = alpha[at] * back[:m]
            joint /= joint.sum(axis=1, keepdims=True)
            good[at] = joint[:, 1]
            if t:
                weighted = phi[at] * back[:m]
                edge = alpha[at - 1][:, :, None] * trans[None] * weighted[:, None, :]
                edge /= edge.sum(axis=(1, 2), keepdims=True)
                both += edge.sum(axis=0)
                back[:m] = weighted @ trans.T
                back[:m] /= back[:m].sum(axis=1, keepdims=True)
        return good, both


def fit(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights of good, 2 x 2 transitions) by Adam on the mean log-likelihood of a document."""
    w, pair = np.zeros(features.shape[1]), np.zeros((2, 2))
    if not len(lengths):
        return w, pair
    chains = Chains(lengths)
    gold = np.repeat(labels, lengths).astype(np.float64)
    edges = np.zeros((2, 2))
    for y in (0, 1):
        edges[y, y] = (lengths[labels == y] - 1).sum()
    # a long document does not outweigh a short one
    weight = np.repeat(1.0 / np.sqrt(lengths), lengths)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, ROUNDS + 1):
        good, both = chains.marginals(features @ w, pair)
        grads = ((features.T @ ((gold - good) * weight)) / weight.sum() - DECAY * w, (edges - both) / max(edges.sum(), 1) - DECAY * pair)
        rate = RATE * (1 - step / (ROUNDS + 1))
        for k, (x, g) in enumerate(zip((w, pair), grads, strict=True)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            x += rate * state[2 * k] / (1 - 0.9**step) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return w, pair


def held_out(doc_id, folds: int = FOLDS, remainder: int = HELD_OUT):
    """Whether a row is held out, as a column."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, remainder: int = HELD_OUT) -> tuple[np.ndarray, np.ndarray]:
    """The model, from the bounded sample of labelled rows."""
    B.tune(docs.sparkSession)
    own = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).dropna()
    sample = own.where(~held_out(F.col("id"), folds, remainder)).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, label in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                wide, _ = document(raw)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([label], pa.int32()), pa.array([len(wide)], pa.int32()), pa.array([B.pack(wide.astype(np.float32).ravel())], pa.binary())], names=["id", "label", "n", "wide"])

    found = B.texts(docs, id_col, text_col).join(F.broadcast(sample), "id").mapInArrow(run, "id long, label int, n int, wide binary").collect()
    found.sort(key=lambda r: (r.id, r.wide))
    wide = np.concatenate([B.unpack(r.wide)[0].reshape(r.n, -1) for r in found]).astype(np.float64) if found else np.empty((0, 3 * FEATURES))
    return fit(wide, np.array([r.n for r in found], np.int64), np.array([r.label for r in found], np.int64))


def with_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """All columns of docs, and the score as the last one; name must be free, see free_name()."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    B.tune(docs.sparkSession)
    at = docs.columns.index(text_col)
    w, pair = model

    def scored(unary: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Scores of some documents, from the log-odds and lengths of their lines."""
        lengths = np.array([len(x) for x in sizes])
        good, _ = Chains(lengths).marginals(np.concatenate(unary), pair)
        size, starts = np.concatenate(sizes), np.cumsum(lengths) - lengths
        return np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, unary, sizes, held = [np.empty(0)], [], [], 0
            for t in batch.column(at).to_pylist():
                wide, size = document((t or "").encode("utf-8", "replace"))
                if held and held + len(size) > HELD_LINES:
                    out.append(scored(unary, sizes))
                    unary, sizes, held = [], [], 0
                unary.append(wide @ w)  # one number a line is kept, not its features
                sizes.append(size)
                held += len(size)
            if held:
                out.append(scored(unary, sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(np.concatenate(out), 0.0, 1.0))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or the first of name_1, name_2 ... that is no column of docs in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    return next(x for x in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if x.lower() not in taken)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
