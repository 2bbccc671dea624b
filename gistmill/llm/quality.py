"""Operator 2: quality rules, a threshold table compiled into one projection of built-in functions.

Words are runs of anything but ASCII white space. Defined results: a null or empty text has no words, fails the
base rule and is not kept; a null id stays null; repeated rows each give a row; other columns pass through
rules() untouched when asked for; one that is named like a result gets `kept_` before its name. A stop word counts in
any case of its letters and with marks at its ends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: What may stand at the ends of a word without being part of it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…¿¡–—"

#: Frequent function words of the four languages, in lower case.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au aux dans de des du en est et il la le les on ou par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine im in ist mit nicht sich und von zu "
    "con del el en es las lo los no para por que se su un una y"
)


@dataclass(frozen=True)
class Rule:
    """A document is dropped if the measure lies outside [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production thresholds; measures are the names of measures().
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("shouting", "mark_ratio", None, 0.30),
    Rule("stop_words", "stop_ratio", 0.04, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.50),
    Rule("repeated_words", "repeat_ratio", None, 0.50),
)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once for each row, however often then reads it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more, each word once.

    Most texts repeat no window: a count of distinct windows settles them. Else windows are sorted with their
    places (hash first, so that strings are compared on ties alone), those equal to a neighbour are kept, and
    the words they cover are counted from the gaps between their places.
    """

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.slice(words, i, 3))

    places = F.sequence(F.lit(1), F.size(words) - 2)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.when(j + 1 < F.size(at), F.least(F.lit(3), F.get(at, j + 1) - p)).otherwise(3))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def twice(held: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))

        kept = F.filter(held, lambda x, j: same(x, F.get(held, j - 1)) | same(x, F.get(held, j + 1)))
        return let(F.sort_array(F.transform(kept, lambda x: x["i"])), covered)

    def from_windows(windows: Column) -> Column:
        held = F.sort_array(F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("h"), w.alias("w"), i.cast("int").alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(held, twice))

    return F.when(F.size(words) < 4, 0).otherwise(let(F.transform(places, window), from_windows))


def measures(text: Column) -> Column:
    """A struct of counts and ratios of one text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    stop = sorted(set(STOP_WORDS.split()))

    def of(words: Column) -> Column:
        chars = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(MARKS))).isin(stop))).cast("long").alias("n_stop"),
            (F.length(whole) - F.length(F.translate(whole, "!", ""))).cast("long").alias("n_marks"),
        )

    return let(words_of(text), of)


def rules(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), table: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep columns, the counts, a boolean for each rule of the table, base_failed and kept."""
    m = F.col("_m")
    n = F.greatest(m["n_words"], F.lit(1)).cast("double")
    ratio = {
        "mean_word_chars": m["word_chars"] / n,
        "symbol_ratio": m["n_symbols"] / n,
        "mark_ratio": m["n_marks"] / n,
        "stop_ratio": m["n_stop"] / n,
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "repeat_ratio": m["n_repeat_words"] / n,
    }

    def broken(rule: Rule) -> Column:
        low = F.lit(False) if rule.low is None else ratio[rule.measure] < rule.low
        high = F.lit(False) if rule.high is None else ratio[rule.measure] > rule.high
        return low | high

    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    failed = [broken(r).alias(f"failed_{r.name}") for r in table]
    kept = ~base
    for r in table:
        kept = kept & ~broken(r)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    taken = {*counts, *(f"failed_{r.name}" for r in table), "base_failed", "kept"}
    held = docs.select(*[docs[k].alias(f"c{i}") for i, k in enumerate(keep)], measures(docs[text_col]).alias("_m"))
    own = [F.col(f"c{i}").alias(f"kept_{k}" if k in taken else k) for i, k in enumerate(keep)]
    return held.select(*own, *[m[c].alias(c) for c in counts], *failed, base.alias("base_failed"), kept.alias("kept"))


def op2(docs: DataFrame) -> DataFrame:
    return rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql() -> str:
    """The same counts in DuckDB, where words and windows are unnested and grouped."""
    stop = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS.split())))
    marks = MARKS.replace("'", "''")
    limits = {r.name: r for r in RULES}
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
t AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 4),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM t),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(trim(x, '{marks}')) IN ({stop}))) AS n_stop, length(text) - length(replace(text, '!', '')) AS n_marks
      FROM w LEFT JOIN c USING (doc_id)),
v AS (SELECT *, greatest(n_words, 1)::DOUBLE AS n, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n BETWEEN {limits['word_length'].low} AND {limits['word_length'].high}
       AND n_symbols / n <= {limits['symbols'].high} AND n_marks / n <= {limits['shouting'].high} AND n_stop / n >= {limits['stop_words'].low}
       AND n_dup_lines / greatest(n_lines, 1) <= {limits['repeated_lines'].high} AND n_repeat_words / n <= {limits['repeated_words'].high} AS kept
FROM v"""
