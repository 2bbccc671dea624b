"""Operator 12: fill-in-the-middle rearrangement of whole texts on ropes.

A text is a rope: a balanced tree whose leaves hold runs of whole units (a word with the white space before it, or
trailing white space) and whose nodes cache the units and code points below them. Two splits at unit ranks give
prefix, middle and suffix without a copy of the text, rearranged subtrees are concatenated with sentinels between them,
and the inverse finds the sentinels in the output and splits its tree at their code points. Both are columns over
Arrow batches: rows keep all their other columns, nothing is shuffled, and a task holds one batch of texts.

The draws of a document come from the sha256 of `seed:id`, so that reruns and retries agree.

Defined results: a null text is an empty one and stays plain; a text that contains a sentinel stays plain, so that every
output can be read back; a null id draws by `seed:`, and repeated ids draw alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm import blocks as B

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED, RATE, SPM_RATE = 42, 50, 80
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
UNIT_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
#: Code points of a leaf, more where a unit is longer.
LEAF = 2048
FORM = "n long, form string, prefix_chars long, middle_chars long, output string"
ARROW = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


@dataclass(slots=True)
class Rope:
    """A leaf has text; a node has two ropes."""

    units: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            if (rope := stack.pop()).left is None:
                yield rope.text
            else:
                stack += [rope.right, rope.left]

    def __str__(self) -> str:
        return "".join(self.leaves())


def leaf(text: str) -> Rope:
    return Rope(len(UNIT.findall(text)), len(text), text)


def concat(*ropes: Rope) -> Rope:
    """Ropes in order as one, by halves."""
    if len(ropes) < 2:
        return ropes[0] if ropes else leaf("")
    left, right = concat(*ropes[: len(ropes) // 2]), concat(*ropes[len(ropes) // 2 :])
    return Rope(left.units + right.units, left.chars + right.chars, "", left, right)


def rope_of(text: str) -> Rope:
    """A balanced rope; leaves end where units end."""
    cuts = [0]
    while cuts[-1] < len(text):
        end = UNIT_END.search(text, cuts[-1] + LEAF - 1)
        cuts.append(end.end() if end else len(text))
    return concat(*(leaf(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)))


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The rope before and from a rank of units or chars on. Only the leaf at the rank is cut."""
    if rope.left is None:
        if by == "units":
            at = 0
            for unit, _ in zip(UNIT.finditer(rope.text), range(rank), strict=False):
                at = unit.end()
        else:
            at = rank
        return leaf(rope.text[:at]), leaf(rope.text[at:])
    inside = getattr(rope.left, by)
    if rank < inside:
        a, b = split(rope.left, rank, by)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - inside, by)
    return concat(rope.left, a), b


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def arranged(text: str, doc_id: int | None, seed: int, rate: int, spm_rate: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    rope = rope_of(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return rope.units, "plain", None, None, text
    low, high = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
    head, suffix = split(rope, high)
    prefix, middle = split(head, low)
    p, s, m = map(leaf, SENTINELS)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    out = concat(s, suffix, p, prefix, m, middle) if form == "spm" else concat(p, prefix, s, suffix, m, middle)
    return rope.units, form, prefix.chars, middle.chars, str(out)


def put_back(output: str, form: str) -> str:
    """The text that arranged() took. A sentinel cannot arise at a seam, as its first and last characters occur in it once."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else SENTINELS
    parts, rest = {}, rope_of(output)
    for name in reversed(order):
        before, after = split(rest, output.index(name), "chars")
        parts[name] = split(after, len(name), "chars")[1]
        rest = before
    return str(concat(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]))


def infilled(text: Column, doc_id: Column, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> Column:
    """A struct of n, form, prefix_chars, middle_chars and output."""

    @F.arrow_udf(FORM)
    def run(texts: pa.Array, ids: pa.Array) -> pa.Array:
        made = (arranged(t.as_py() or "", i.as_py(), seed, rate, spm_rate) for t, i in zip(texts, ids, strict=True))
        return pa.array([dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), row, strict=True)) for row in made], ARROW)

    return run(text, doc_id.cast("long"))


def restored(output: Column, form: Column) -> Column:
    """The text before infilled()."""

    @F.arrow_udf("string")
    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([put_back(o.as_py(), f.as_py()) for o, f in zip(outputs, forms, strict=True)], pa.large_string())

    return run(output, form)


def op12(docs: DataFrame, seed: int = SEED) -> DataFrame:
    B.tune(docs.sparkSession)
    made = docs.select(docs["doc_id"].cast("long").alias("doc_id"), infilled(docs["text"], docs["doc_id"], seed).alias("made")).select("doc_id", "made.*")
    back = made.withColumn("restored", restored(F.col("output"), F.col("form")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r, len(u) AS n FROM d),
c AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= {RATE} THEN 'plain' WHEN r[4] % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
             least(r[1] % (n + 1), r[2] % (n + 1)) AS low, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS high FROM g),
p AS (SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS pre, coalesce(array_to_string(u[low + 1:high], ''), '') AS mid, coalesce(array_to_string(u[high + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""
