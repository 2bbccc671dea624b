"""A training-data pipeline over the documents table: classify, dedup lines, dedup documents, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder and reads it
back as the next stage's docs. All stages but the last return the columns of documents.

Defined results: a null text is scored, deduplicated and encoded as an empty one, and the mix takes it 0 times, as any
text without words; the near-duplicate stage decides row by row, whether ids repeat or are null, and of rows of one id
and text keeps one, chosen by a hash of its other columns; columns beyond those of documents pass through all stages
but the last, whatever their names and types; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import bpe, jaccard, linecrf, lines, mixing
from gistmill.session import shared_dir

TOKENIZER = "word_bpe_49k.json"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the line CRF rejects go."""
    model = linecrf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = linecrf.free_name(docs, "_score")
    return linecrf.with_scores(docs, model, name=score).where(F.col(score) >= 0.5).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines of many documents stay in one of them; n_chars follows the text."""
    carry = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    made = lines.dedup_lines(docs, carry=carry)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")} | {c: F.col(f"row.c{k}") for k, c in enumerate(carry)}
    return made.select(*[new[c].alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one row of each group of near-duplicates stays: the one of the least id, null ids last, and of rows of
    one id the one of the least hash of its text."""
    kept = jaccard.join(docs, rows=True).where("kept_row").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).distinct()
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    hashed = F.xxhash64(F.coalesce(docs["text"].cast("binary"), F.lit(b"")))
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()], hashed.alias("h"))
    same = rows[names["doc_id"]].cast("long").eqNullSafe(kept["id"]) & (rows["h"] == kept["h"])
    rows = rows.join(kept, same, "left_semi")
    # the hash of the rest as JSON tells rows of one text apart, whatever the types of their columns
    rest = F.xxhash64(F.to_json(F.struct(*[n for c, n in names.items() if c != "text"])))
    one = rows.groupBy(names["doc_id"], "h").agg(F.min_by(F.struct(*[n for c, n in names.items() if c != "doc_id"]), rest).alias("row"))
    return one.select(*[(F.col(n) if c == "doc_id" else F.col(f"row.{n}")).alias(c) for c, n in names.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: a document appears as often as the mix takes it."""
    made = mixing.mix(docs, carry=tuple(docs.columns)).where("epochs > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    return made.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ids of each document, and the text they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    return bpe.encode(docs, path, decoded=True)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("mixing", mix),
    ("bpe", encode),
]

#: No SQL: the classifier is learned and the near-duplicate groups are transitive.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
