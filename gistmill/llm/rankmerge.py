"""Operator 10: token counts by rank-synchronous array merging.

Distinct words of a block become pre-tokens (the tokenizer's own normaliser and splitter), pre-tokens become rows of
symbol ids, padded to the width of their length class. In each round every row looks up the ranks of its adjacent
pairs at once, and merges all places of its lowest-ranked pair, leftmost first; rows without a known pair leave.
What is left of a row is its number of tokens. A text's count is the sum over its words. A row of more than LONG symbols
is merged alone in the same rounds, with its symbols linked, so that a round looks up only pairs beside its merges.

Defined results: a null or empty text has 0 tokens and 0 bytes; special strings inside a text count as one token
each, as the library splits at them by default; a null id stays null; repeated rows each give a row; other columns
are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import blocks as B
from gistmill.llm.bpe import tokenizer

LIMIT = 2048
#: A worker forgets its words once it holds so many, so that its memory stays bounded.
HELD_WORDS = 600_000
#: Cells (rows times width) that one round of merging holds.
CELLS = 1_000_000
#: Symbols of a row that is merged alone.
LONG = 2048


class Merges:
    """Symbols and merge ranks of a byte-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.size = max(self.vocab.values()) + 1
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]

    def symbols(self, token: str) -> list[int]:
        """First symbols of a pre-token: one for each of its byte characters, the last with the suffix.

        The byte alphabet is whole in the vocabulary, with and without suffix, so no character is unknown.
        """
        return [*[self.vocab[c] for c in token[:-1]], self.vocab[token[-1] + self.suffix]]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the number of merges where there is none) and its place in the tables."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == keys), self.rank[at], len(self.keys)), at

    def counts(self, rows: list[list[int]]) -> np.ndarray:
        """Tokens left of each row."""
        out = np.array([len(r) for r in rows], np.int64)
        order = np.argsort(out, kind="stable")
        sizes = out[order]
        at = 0
        while at < len(order):
            if out[order[at]] < 2:
                at = int(np.searchsorted(sizes, 2))
                continue
            if out[order[at]] > LONG:
                out[order[at]] = self.merged_alone(np.array(rows[order[at]], np.int64))
                at += 1
                continue
            width = max(8, int(out[order[at]]))
            end = int(np.searchsorted(sizes, width, side="right"))
            end = min(end, at + max(1, CELLS // width))
            part = order[at:end]
            width = max(len(rows[k]) for k in part)
            grid = np.full((len(part), width), -1, np.int64)
            lengths = np.array([len(rows[k]) for k in part])
            grid[np.arange(width)[None, :] < lengths[:, None]] = np.concatenate([np.array(rows[k], np.int64) for k in part])
            out[part] = self.merged(grid)
            at = end
        return out

    def merged_alone(self, symbol: np.ndarray) -> int:
        """Length of one long row after all merges."""
        none = len(self.keys)
        n = len(symbol)
        after, before = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
        rank = np.append(self.lookup(symbol[:-1], symbol[1:])[0], none)
        left = n
        while (best := int(rank.min())) < none:
            hit = np.flatnonzero(rank == best)
            # of hits that overlap, every second from the left
            starts = np.append(True, after[hit[:-1]] != hit[1:])
            first = np.maximum.accumulate(np.where(starts, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            gone = after[hit]
            symbol[hit] = self.made[np.searchsorted(self.keys, symbol[hit] * self.size + symbol[gone])]
            rank[gone] = none
            after[hit] = after[gone]
            beyond = after[hit] >= 0
            before[after[hit][beyond]] = hit[beyond]
            near = np.concatenate([hit, before[hit]])
            near = near[near >= 0]
            pair = near[after[near] >= 0]
            rank[near[after[near] < 0]] = none
            rank[pair] = self.lookup(symbol[pair], symbol[after[pair]])[0]
            left -= len(gone)
        return left

    def merged(self, grid: np.ndarray) -> np.ndarray:
        """Lengths of the rows of a grid (symbols, then -1) after all merges."""
        final = np.empty(len(grid), np.int64)
        live = np.arange(len(grid))
        none = len(self.keys)
        while len(live):
            rank, at = self.lookup(grid[:, :-1], grid[:, 1:]) if grid.shape[1] > 1 else (np.full((len(grid), 1), none), None)
            best = rank.min(axis=1)
            done = best == none
            if done.any():
                final[live[done]] = (grid[done] >= 0).sum(axis=1)
                live, grid, rank, best = live[~done], grid[~done], rank[~done], best[~done]
                if not len(live):
                    break
                at = at[~done]
            hit = rank == best[:, None]
            # of hits that overlap (the same symbol three times or more), every second from the left
            for j in range(1, hit.shape[1]):
                hit[:, j] &= ~hit[:, j - 1]
            symbol = self.made[at]
            grid[:, :-1] = np.where(hit, symbol, grid[:, :-1])
            gone = np.zeros(grid.shape, bool)
            gone[:, 1:] = hit
            keep = ~gone & (grid >= 0)
            lengths = keep.sum(axis=1)
            width = int(lengths.max())
            packed = np.full((len(grid), width), -1, np.int64)
            packed[np.arange(width)[None, :] < lengths[:, None]] = grid[keep]
            grid = packed
        return final


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(maxsize=2)
def special_pattern(path: str) -> tuple[str, re.Pattern]:
    """What all special strings begin with, and a pattern of them."""
    marks = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return os.path.commonprefix(marks), re.compile("|".join(map(re.escape, marks)) if marks else r"(?!)")


def word_counts(words: list[str], path: str) -> np.ndarray:
    """Tokens of each word: its special strings, and what is left of its pre-tokens."""
    tok, table, (start, marks) = tokenizer(path), merges(path), special_pattern(path)
    total = np.zeros(len(words), np.int64)
    seen = B.Codes()
    owner: list[int] = []
    tokens: list[int] = []
    for k, word in enumerate(words):
        parts = [word]
        if start in word and (found := marks.findall(word)):
            total[k] += len(found)
            parts = marks.split(word)
        for part in parts:
            if part:
                for piece, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part) if tok.normalizer else part):
                    owner.append(k)
                    tokens.append(seen[piece])
    if tokens:
        n = table.counts([table.symbols(p) for p in seen])
        np.add.at(total, np.array(owner), n[np.array(tokens)])
    return total


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, n_bytes long, n_tokens long, one row for each row of docs. No shuffle: a block counts its own words."""
    B.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = B.Codes()
        known = np.empty(0, np.int64)
        for _, ids, texts in B.blocked(batches):
            if len(table) > HELD_WORDS:
                table, known = B.Codes(), np.empty(0, np.int64)
            codes = [np.fromiter(map(table.__getitem__, words), np.int64, len(words)) for words in map(bytes.split, texts)]
            fresh = [w.decode("utf-8", "replace") for w in list(table)[len(known) :]]
            for at in range(0, len(fresh), 50_000):
                known = np.concatenate([known, word_counts(fresh[at : at + 50_000], path)])
            totals = [int(known[c].sum()) for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return B.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op10(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
