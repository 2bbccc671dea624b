"""Operator 11: license scans by an exact set-similarity join of text blocks with license templates.

A block is a paragraph: lines without a blank one (no word in it) between them. Its tokens are its pairs of consecutive
words, as a set; a template is a paragraph of a license notice in the same form. A template matches a block that holds
at least `threshold` of its tokens (containment: a block may hold anything besides). The join is exact:

- tokens are ordered by the number of blocks of the whole corpus that hold them, rarest first;
- prefix filter: a matching pair shares one of the template's first (size - need + 1) tokens, and it lies among the
  block's first (held - least need + 1) tokens;
- length filter: the block holds at least `need` tokens of any template;
- positional filter: after a first shared token at places i and j, at most the shorter rest can be shared as well;
- verification: the sets are intersected.

Each text is read once; what stays of it is a row of numbers and, for blocks that pass the length filter, the tokens
that some template has. No block exceeds the templates' vocabulary, so a paragraph of any length is a bounded row.
Templates are a setting of the caller, of at most TEMPLATE_BYTES (the texts of all registered licenses are some 5 MB);
that bound is checked, so their prefixes are broadcast, and no hot token or license line moves blocks to one task.

Templates of fewer than 10 tokens must be held whole at the default threshold, so that versions of a license are told
apart by their number. Paragraphs of fewer than MIN_TOKENS tokens are headings, not templates.

Defined results: a null text is an empty one; repeated rows and ids are scanned row by row; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm import blocks as B
from gistmill.session import durable

THRESHOLD, MIN_TOKENS, TEMPLATE_BYTES = 0.9, 3, 16_000_000

# Phrases that count as license marks by themselves, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Paragraphs of public license notices, and their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-2", "GNU General Public License version 2"),
    ("gpl-2", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "GNU General Public License version 3"),
    ("gpl-3", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "GNU Lesser General Public License version 2.1"),
    ("lgpl-3", "GNU Lesser General Public License version 3"),
    ("agpl-3", "GNU Affero General Public License version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mpl-2", "Mozilla Public License Version 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("boost-1", "Boost Software License Version 1.0"),
    ("cc0-1", "CC0 1.0 Universal"),
    ("cc-by", "Creative Commons Attribution 4.0 International"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0"),
)

#: ASCII but for digits, letters and line feeds becomes a space; A-Z becomes a-z.
PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c == 10 or c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
BREAK = re.compile(rb"\n *\n")
PARSED = "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<first:long,n:long,tokens:array<int>>>"
ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string())), ("blocks", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int32()))])))])


def paragraphs(text: bytes) -> list[list[bytes]]:
    """The words of each paragraph; digits, ASCII letters and all beyond ASCII make words."""
    return [block.split() for block in BREAK.split(text.translate(PLAIN))]


class Templates:
    """Templates as sets of tokens, numbered over all templates."""

    def __init__(self, texts: Sequence[tuple[str, str]], threshold: float) -> None:
        if sum(len(t.encode()) for _, t in texts) > TEMPLATE_BYTES:
            raise ValueError(f"license templates of more than {TEMPLATE_BYTES} bytes")
        self.ids: dict[bytes, dict[bytes, int]] = {}
        self.labels, self.sets, self.size = [], [], 0
        for label, text in texts:
            for words in paragraphs(text.encode()):
                if len(pairs := set(pairwise(words))) >= MIN_TOKENS:
                    self.labels.append(label)
                    self.sets.append({self._id(a, b) for a, b in pairs})
        self.needs = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.least = min(self.needs, default=1)

    def _id(self, a: bytes, b: bytes) -> int:
        seconds = self.ids.setdefault(a, {})
        if b not in seconds:
            seconds[b], self.size = self.size, self.size + 1
        return seconds[b]

    def held(self, words: list[bytes]) -> list[int]:
        """The tokens of a block that some template has."""
        get = self.ids.get
        return list({t for a, b in pairwise(words) if (seconds := get(a)) is not None and (t := seconds.get(b)) is not None})


def places(words: list[bytes], phrases: Sequence[tuple[str, str]]) -> tuple[list[int], list[str]]:
    """Where phrases start, and the labels found."""
    line = b" %b " % b" ".join(words)
    starts, labels = [], set()
    for phrase, label in phrases:
        mark = b" %b " % phrase.encode()
        at = line.find(mark)
        while at >= 0:
            starts.append(line.count(b" ", 0, at))
            labels.add(label)
            at = line.find(mark, at + 1)
    return starts, sorted(labels)


def parsed(docs: DataFrame, templates: Templates, phrases: Sequence[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """One row for each row of docs: base marks, and blocks that can match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = B.partition() << 33
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                groups = paragraphs(text.as_py())
                starts, labels = places([w for g in groups for w in g], phrases)
                held, first = [], 0
                for g in groups:
                    if len(g) > templates.least and len(tokens := templates.held(g)) >= templates.least:
                        held.append({"first": first, "n": len(g), "tokens": tokens})
                    first += len(g)
                out.append({"row": row, "doc_id": doc_id, "n_words": first, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base": labels, "blocks": held})
                row += 1
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return B.texts(docs, id_col, text_col).mapInArrow(run, PARSED)


def ranked(tokens: Column, rank: np.ndarray) -> Column:
    """Tokens of each block as ranks, rarest first."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        owner = np.repeat(np.arange(len(column)), np.diff(ends))
        ranks = rank[column.flatten().to_numpy()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ranks[np.lexsort((ranks, owner))], pa.int32()))

    return run(tokens)


def joined(found: DataFrame, templates: Templates) -> DataFrame:
    """row, first_word, n_words, label, template, containment: every block that holds enough of a template."""
    spark = found.sparkSession
    blocks = found.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    # no more rows than the templates have tokens
    seen = dict(blocks.select(F.explode("tokens").alias("t")).groupBy("t").count().collect())
    order = sorted(range(templates.size), key=lambda t: (seen.get(t, 0), t))
    rank = np.empty(templates.size, np.int32)
    rank[order] = np.arange(templates.size, dtype=np.int32)
    prefixes = []
    for k, (label, tokens, need) in enumerate(zip(templates.labels, templates.sets, templates.needs, strict=True)):
        ranks = sorted(int(rank[t]) for t in tokens)
        prefixes += [(token, k, label, i, need, ranks) for i, token in enumerate(ranks[: len(ranks) - need + 1])]
    index = F.broadcast(spark.createDataFrame(prefixes, "token int, template int, label string, i int, need int, ranks array<int>"))
    blocks = blocks.select("row", "first", "n", ranked(F.col("tokens"), rank).alias("held")).withColumn("m", F.size("held"))
    probes = blocks.select("*", F.posexplode(F.slice("held", 1, F.col("m") - templates.least + 1)).alias("j", "token"))
    rest = F.least(F.size("ranks") - F.col("i"), F.col("m") - F.col("j"))
    shared = F.size(F.array_intersect("held", "ranks"))
    pairs = probes.join(index, "token").where((F.col("m") >= F.col("need")) & (rest >= F.col("need"))).where(shared >= F.col("need"))
    return pairs.select("row", F.col("first").alias("first_word"), F.col("n").alias("n_words"), "label", "template", (shared / F.size("ranks")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, phrases: Sequence[tuple[str, str]] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels of phrases) and matches, an array of blocks by their
    first word and number of words with label, template (its number) and containment, for each row of docs."""
    B.tune(docs.sparkSession)
    known = Templates(templates, threshold)
    found = durable(parsed(docs, known, phrases, id_col, text_col))
    match = F.struct("first_word", "n_words", "template", "label", "containment")
    matches = joined(found.where(F.size("blocks") > 0), known).groupBy("row").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    return found.drop("blocks").join(matches, "row", "left").drop("row")


def op11(docs: DataFrame) -> DataFrame:
    """The contract's columns. score: 1 where a phrase stands, else the highest containment of a template that matches, else 0."""
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.col("matches.label"), F.array().cast("array<string>")))))
    best = F.coalesce(F.array_max(F.col("matches.containment")), F.lit(0.0))
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"))


def sql() -> str:
    """The same by plain counting: blocks joined with all tokens of all templates."""
    known = Templates(TEMPLATES, THRESHOLD)
    names = {t: f"{a.decode()} {b.decode()}" for a, seconds in known.ids.items() for b, t in seconds.items()}
    tokens = ", ".join(f"({k}, '{label}', {len(s)}, {need}, '{names[t]}')" for k, (label, s, need) in enumerate(zip(known.labels, known.sets, known.needs, strict=True)) for t in sorted(s))
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES)
    return f"""
WITH tokens(k, label, size, need, token) AS (VALUES {tokens}),
phrases(words, label) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]', ' ', 'g') AS text FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(text, '[^ \\n]+') AS ws FROM d),
marks AS (SELECT r, label, i FROM w, phrases, unnest(range(len(ws))) AS u(i) WHERE contains(array_to_string(ws, ' '), array_to_string(words, ' ')) AND ws[i + 1:i + len(words)] = words),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM marks GROUP BY r),
blocks AS (SELECT r, generate_subscripts(bs, 1) AS b, regexp_extract_all(unnest(bs), '[^ \\n]+') AS ws FROM (SELECT r, regexp_split_to_array(text, '\\n *\\n') AS bs FROM d)),
held AS (SELECT DISTINCT r, b, ws[i] || ' ' || ws[i + 1] AS token FROM blocks, unnest(range(1, len(ws))) AS u(i)),
pairs AS (SELECT r, label, count(*) / size AS share FROM held JOIN tokens USING (token) GROUP BY r, b, k, label, size, need HAVING count(*) >= need),
said AS (SELECT r, label, 1.0 AS share, true AS base FROM marks UNION ALL SELECT r, label, share, false FROM pairs),
named AS (SELECT r, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share)::DOUBLE AS score FROM said GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN named USING (r)"""
