"""A library and its derived graph as a folder of JSON Lines, merged like any import; branches as Markdown files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gistmill.functions.text import squeeze
from gistmill.operators import store
from gistmill.session import stored

VERSION = 1
DERIVED = ("Chunk", "Entity", "Topic", "Fact")


def derived_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Derived nodes, and every edge that touches one, each once."""
    own = nodes.where(F.col("label").isin(*DERIVED))
    a, b = own.select(F.col("id").alias("src")), own.select(F.col("id").alias("dst"))
    touched = edges.join(a, "src", "left_semi").unionByName(edges.join(b, "dst", "left_semi")).dropDuplicates(["src", "type", "dst"])
    return own, touched


def export(conversations: DataFrame, messages: DataFrame, nodes: DataFrame, edges: DataFrame, target: str) -> None:
    spark = conversations.sparkSession
    own, touched = derived_graph(nodes, edges)
    conversations.write.mode("errorifexists").json(f"{target}/conversations")
    messages.write.json(f"{target}/messages")
    own.orderBy("id").write.json(f"{target}/nodes")
    touched.orderBy("src", "type", "dst").write.json(f"{target}/edges")
    spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.json(f"{target}/manifest")  # last: a folder without it is half a write


def read(spark: SparkSession, target: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of an archive; one of a later version is refused."""
    version = spark.read.schema("version int").json(f"{target}/manifest").first().version
    if version > VERSION:
        raise ValueError(f"the archive is of version {version}; this reads up to {VERSION}")
    return {name: spark.read.schema(schema).json(f"{target}/{name}") for name, schema in schemas.items()}


def restore(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with the archive's; archived edges with an end in neither are dropped."""
    every = store.upsert(nodes, new_nodes, ["id"])
    # ids and edges lie in files before they meet: no task holds the buffers of what made them and of the joins at once
    ids, new_edges = stored(every.select("id")), stored(new_edges)
    return every, store.upsert(edges, store.with_both_ends(new_edges, ids), ["src", "type", "dst"])


def merge_cache(cache: DataFrame, archived: DataFrame, keys: list[str]) -> DataFrame:
    """A cache with the archive's answers to keys it lacks."""
    return store.insert_absent(cache, archived, keys)


#: How a note names the roles.
ROLE_NAMES = {"user": "You", "assistant": "Assistant", "system": "System"}
UNSAFE, NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]+', 80


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))


def _stamp(at: Column) -> Column:
    """An ISO text as date and minute in UTC; null stays null."""
    return F.concat(F.replace(F.substring(at, 1, 16), F.lit("T"), F.lit(" ")), F.lit(" UTC"))


def markdown(conversations: DataFrame, branch: DataFrame) -> DataFrame:
    """(source, name, body): a note for each conversation's active branch, named by date and title; the second of a name
    gets the end of its id. Messages without text are left out."""
    who = F.coalesce(F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])[F.col("role")], F.initcap("role"))
    when = F.coalesce(F.concat(F.lit(" · "), _stamp(F.col("created_at"))), F.lit("")) if "created_at" in branch.columns else F.lit("")
    said = F.concat(F.lit("## "), who, when, F.lit("\n\n"), F.btrim("text"), F.lit("\n"))
    shown = branch.where(F.btrim("text") != "").groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("branch_position", said.alias("t")))), lambda x: x["t"]), "\n").alias("said"))
    rows = conversations.join(shown.withColumnRenamed("conversation_id", "id"), "id", "left")
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("(untitled)"))
    clean = F.rtrim(F.substring(squeeze(F.regexp_replace(F.coalesce("title", F.lit("untitled")), UNSAFE, "-")), 1, NAME_CHARS), F.lit(" ."))
    day = F.substring(F.coalesce("created_at", "updated_at"), 1, 10)
    rows = rows.withColumn("stem", F.concat_ws(" ", day, F.when(clean == "", "untitled").otherwise(clean)))
    taken = F.row_number().over(W.partitionBy("source", "stem").orderBy("id"))
    name = F.when(taken == 1, F.col("stem")).otherwise(F.concat("stem", F.lit(" "), F.regexp_replace(F.substring("id", -8, 8), UNSAFE, "-")))
    model = F.col("model") if "model" in conversations.columns else F.lit(None).cast("string")
    fields = (("title", _quoted(title)), ("source", F.col("source")), ("id", F.col("id")), ("created", _stamp(F.col("created_at"))), ("updated", _stamp(F.col("updated_at"))), ("model", model))
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields], F.lit("---"))
    return rows.select("source", F.concat(name, F.lit(".md")).alias("name"), F.concat(head, F.lit("\n\n# "), title, F.lit("\n\n"), F.coalesce("said", F.lit(""))).alias("body"))
