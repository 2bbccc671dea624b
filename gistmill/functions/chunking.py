"""Messages cut into chunks that fit a budget of characters: paragraphs and fenced code are packed greedily, a short
prose tail is carried over. Cuts come from running sums of the units' lengths; messages are independent and run in
Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import ids
from gistmill.functions.text import CHARS_PER_TOKEN, token_estimate

MAX_TOKENS, OVERLAP_TOKENS = 400, 40
ROLES = ("user", "assistant")
BLANK_LINES = re.compile(r"\n\s*\n")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
#: A fence, lines that open no other, and the next fence, of the same kind. A fence without such a partner is prose.
FENCED = re.compile(r"^[ \t]*(```|~~~).*\n(?:(?![ \t]*(?:```|~~~)).*\n)*[ \t]*\1.*", re.MULTILINE)


def markdown_units(text: str) -> tuple[list[str], list[bool]]:
    """Paragraphs and whole fenced blocks in order, and which are code."""
    blocks = list(FENCED.finditer(text))
    starts, ends = [m.start() for m in blocks], [m.end() for m in blocks]
    units: list[str] = []
    code: list[bool] = []
    for k, (start, end) in enumerate(zip([0, *ends], [*starts, len(text)], strict=True)):
        prose = [p for part in BLANK_LINES.split(text[start:end]) if (p := part.strip())]
        units += prose
        code += [False] * len(prose)
        if k < len(blocks):
            units.append(blocks[k].group().strip())
            code.append(True)
    return units, code


def stretches(sizes: np.ndarray, glue: int, most: int, opens: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where stretches of items begin and end that hold as many as fit: for every item the end of a stretch from there
    comes from one search in the running sums, so that a text of a million items costs as many steps, not their square.
    opens: the item with which a stretch from each item really begins; shared: how many items before each end are the
    next stretch's, too."""
    run = np.r_[0, np.cumsum(sizes + glue)]
    stop = np.maximum(np.searchsorted(run, run[:-1] + most + glue, "right") - 1, np.arange(1, len(sizes) + 1))
    at = 0
    while at < len(sizes) and (at := int(opens[at])) < len(sizes):
        end = int(stop[at])
        yield at, end
        at = end - int(shared[end])


def cut_unit(text: str, code: bool, most: int) -> list[str]:
    """Parts of at most most characters of a unit, cut at lines or sentence ends, or anywhere where one is too long."""
    if len(text) <= most:
        return [text]
    glue = "\n" if code else " "
    parts = [part[at : at + most] for part in (text.split("\n") if code else SENTENCE_END.split(text)) for at in range(0, max(len(part), 1), most)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    # a stretch does not begin with an empty line
    full = np.flatnonzero(sizes)
    opens = np.r_[full, len(parts)][np.searchsorted(full, np.arange(len(parts)))]
    cut = [glue.join(parts[a:b]) for a, b in stretches(sizes, 1, most, opens, np.zeros(len(parts) + 1, np.int64))]
    return cut if cut[-1].strip() else cut[:-1]


def pack(texts: list[str], code: list[bool], most: int, overlap: int) -> list[str]:
    """Units joined by blank lines up to most characters; a prose unit of at most overlap characters before a cut opens
    the next chunk, too, if the unit after the cut still fits beside it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    again = np.zeros(len(texts) + 1, np.int64)
    again[1:-1] = ~np.array(code[:-1], bool) & (sizes[:-1] <= overlap) & (sizes[:-1] + 2 + sizes[1:] <= most)
    return ["\n\n".join(texts[a:b]) for a, b in stretches(sizes, 2, most, np.arange(len(texts)), again)]


def chunk_text(parts: list[tuple[str, str]], max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> list[str]:
    """Chunks of a message's (type, text) parts."""
    most, overlap = max_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN
    texts: list[str] = []
    code: list[bool] = []
    for kind, text in parts:
        units, fenced = markdown_units(text) if kind == "text" else ([text], [True]) if kind == "code" and text.strip() else ([], [])
        for unit, is_code in zip(units, fenced, strict=True):
            cut = cut_unit(unit, is_code, most)
            texts += cut
            code += [is_code] * len(cut)
    return pack(texts, code, most, overlap) if texts else []


def chunks(messages: DataFrame, text: Column | str = "text", max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """One row a chunk of the user's and assistant's messages: the message's columns, `order`, chunk_text, id, text_hash, token_estimate."""
    if not max_tokens > overlap_tokens >= 0:
        raise ValueError("the overlap must be smaller than a chunk")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text([("text", t)], max_tokens, overlap_tokens) if t else [])

    rows = messages.where(F.col("role").isin(*ROLES)) if "role" in messages.columns else messages
    made = rows.select("*", F.posexplode(cut(F.col(text) if isinstance(text, str) else text)).alias("order", "chunk_text"))
    own = F.col("id") if "id" in rows.columns else F.lit("")
    return made.select("*", ids.chunk_id(own, F.col("order"), F.col("chunk_text")).alias("chunk_id"), ids.text_hash(F.col("chunk_text")).alias("text_hash"), token_estimate(F.col("chunk_text")).alias("token_estimate"))
