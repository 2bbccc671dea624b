"""Operator 5: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / quality, u a hash of its id and of the seed; within a source, documents are
taken by ascending key until the source's budget of words is met. Whole epochs come first: a source whose target
is 1.3 times its size takes all documents once and the first 0.3 of the key order again.

The order is a prefix sum over (source, bin of the key), and inside one bin by the key. Bins rise with the key and are
even on six scales at once, a power of two apart, so that keys spread over them whatever the qualities of a source are:
of documents of one quality (1 / 32 to 1) no bin gets more than ten times its even share of 1 / BINS. So a source that
holds a third of all rows is spread over hundreds of tasks.

Defined results: sources order by code point with null last and weigh 3, 1, 2, repeating; a null text has size 0
and is taken 0 times; a document at the edge of the budget is taken if that brings the source nearer its target;
rows of the same id and text share a key and order among themselves by text; rows of a null id are told apart by their
texts; an empty table gives no rows; other columns are carried by mix() on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
TOTAL, MOST, SEED = 1.5, 2.0, 20240607
#: Bins of a source's key order, and the scales on which they are even.
BINS, SCALES = 4096, (1.0, 1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 32)
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """A weight from 0.05 to 1: how much of the text is neither digits nor signs, squared."""
    plain = F.length(F.translate(F.coalesce(text, F.lit("")), "#*$%&|<>!{}[]=+0123456789", ""))
    return F.greatest(F.lit(0.05), F.pow(plain / F.greatest(F.length(text), F.lit(1)), 2.0))


def key_of(doc_id: Column, text: Column, quality: Column, seed: int = SEED) -> Column:
    """-ln(u) / quality, u a double in (0, 1] of 53 hash bits of the id, and of the text where the id is null."""
    own = F.xxhash64(doc_id, F.lit(seed), F.when(doc_id.isNull(), text))
    u = (F.shiftrightunsigned(own, 11).cast("double") + 1.0) / F.lit(2.0**53)
    return -F.log(u) / quality


def bin_of(key: Column) -> Column:
    spread = F.lit(0.0)
    for scale in SCALES:
        spread = spread + (1.0 - F.exp(-key * scale))
    return F.least(F.floor(spread / len(SCALES) * BINS), F.lit(BINS - 1)).cast("int")


def targets(sizes: DataFrame) -> DataFrame:
    """source_key, source_size, target from (source_key, null_last, source_size): weights share the total, capped.

    Capping and resharing the excess until none is above its cap fills all sources to one level of words per unit
    of weight: in order of cap / weight, a source is capped while the level over it and those after is above its own.
    One row for each source, so the windows over all of them are small whatever the documents.
    """
    order = W.orderBy("null_last", "source_key")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", MOST * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    by = W.orderBy("ratio", "null_last", "source_key")
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("total", TOTAL * F.sum("source_size").over(every))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "null_last", "source_key", "level"))).over(every)
    rows = rows.withColumn("final", first["level"])
    return rows.select("source_key", "null_last", "source_size", F.least(F.col("cap"), F.col("w") * F.col("final")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), quality: Column | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs (times taken) and the carried columns (as a struct, row), one row a document."""
    text, source = docs[text_col], docs[source_col].cast("string")
    base = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(source, F.lit("")).alias("source_key"),
        source.isNull().cast("int").alias("null_last"),
        size_of(text).alias("size"),
        key_of(docs[id_col], text, quality if quality is not None else quality_of(text), seed).alias("key"),
        F.xxhash64(text).alias("tie"),
        (F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(carry)]) if carry else F.lit(None).cast("struct<c0:int>")).alias("row"),
    )
    base = base.withColumn("bin", bin_of(F.col("key")))
    named, binned = ["source_key", "null_last"], ["source_key", "null_last", "bin"]
    bins = base.groupBy(*binned).agg(F.sum("size").alias("bin_size"))
    by_source = bins.groupBy(*named).agg(F.sum("bin_size").alias("source_size"))
    before = W.partitionBy(*named).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    placed = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).drop("bin_size").join(targets(by_source), named)
    # the join and the window deal rows by the same three keys, so a document moves once
    rows = base.join(placed, binned)
    inside = W.partitionBy(*binned).orderBy("key", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    again = (F.col("size") > 0) & (F.col("at") + F.col("size") / 2.0 <= rest)
    epochs = (whole + again.cast("int")).cast("long")
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (epochs * F.col("size")).alias("taken"), epochs.alias("epochs"), "row")


def op5(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
