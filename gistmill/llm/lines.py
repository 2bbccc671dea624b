"""Operator 7: line dedup with built-in functions only.

Lines are exploded once with their positions and hashed (two independent 64-bit hashes), documents are counted for
each hash, lines of hashes over the threshold go, except in the document with the largest id, and what stays is put
together by position. Counting first groups (hash, document), so a line that a third of all documents hold is spread
over all tasks, then (hash) with map-side partial counts. Lines meet the counts in two ways: the HEAVY most frequent
hashes are broadcast (a fixed number of rows), so that their lines move nowhere; of the others none has more than
1 / HEAVY of all lines, and they meet by a shuffle. Lost positions return to a document by its id and a hash of its
text, whatever its number of lines.

Defined results: a null or empty text is one empty line; the key of a line has ASCII white space stripped at both
ends and A-Z in lower case; documents of the same id count once for a line, and each such row keeps or loses its
lines alike; null ids count as one document and never keep a hot line unless no other id has it; other columns
are carried on request, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.session import durable

SPACE_CHARS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Most frequent hashes that are broadcast.
HEAVY = 1024


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), string.ascii_uppercase, string.ascii_lowercase)


def hash_of(line: Column, min_chars: int) -> Column:
    """A line's hash pair, or null for a line whose key is too short to count. A short line has a short key."""
    key = key_of(line)
    pair = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key, F.lit(7)).alias("b"))
    return F.when((F.length(line) >= min_chars) & (F.length(F.btrim(line, F.lit(SPACE_CHARS))) >= min_chars), pair)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text and the carried columns (as a struct, row) for each row of docs."""
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(carry)]) if carry else F.lit(None).cast("struct<c0:int>")
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), row.alias("row"))
    lines = F.split("text", "\n")
    held = base.select("doc_id", "t", F.posexplode(F.transform(lines, lambda x: hash_of(x, min_chars))).alias("pos", "h")).where("h is not null")
    held = durable(held.select("doc_id", "t", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b")))
    once = held.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
    hot = durable(once.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs))
    heavy = F.broadcast(hot.orderBy(F.col("n").desc(), "a", "b").limit(HEAVY).select("a", "b", F.struct("keeper").alias("found")))
    met = held.join(heavy, ["a", "b"], "left")
    light = hot.join(heavy, ["a", "b"], "left_anti").select("a", "b", F.struct("keeper").alias("found"))
    lose = met.where("found is not null").unionByName(met.where("found is null").drop("found").join(light, ["a", "b"])).where(~F.col("doc_id").eqNullSafe(F.col("found.keeper")))
    lost = lose.groupBy("doc_id", "t").agg(F.collect_list("pos").alias("lost"))
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.t") == F.col("l.t"))
    both = base.alias("d").join(lost.alias("l"), same, "left").select("d.doc_id", "d.text", "d.row", "l.lost").withColumn("lines", lines)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost")), lambda i: F.get("lines", i))
    n_lines = F.size("lines").cast("long")
    # repeated rows bring the same positions again
    both = both.withColumn("kept", F.when(F.col("lost").isNotNull(), kept))
    n_dropped = F.coalesce(n_lines - F.size("kept"), F.lit(0)).cast("long")
    return both.select("doc_id", "row", n_lines.alias("n_lines"), F.when(F.col("kept").isNull(), 0).otherwise(n_dropped).cast("long").alias("n_dropped"), F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"))


def op7(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (hot.key IS NOT NULL AND k.doc_id <> keeper)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot.key IS NULL OR k.doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY k.doc_id"""
