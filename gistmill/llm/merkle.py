"""Operator 13: a Merkle manifest of a dataset, built bottom up, with proofs pushed top down.

Each row is a leaf, the hash of its fields. The leaves of a source, by id, are hashed in runs of FANOUT into the next
level until one node remains, the source's root; the roots of all sources form one more such tree. A level is a table
of (group, place, hash, children's hashes), kept in the shared folder before the next is built, so that a lost executor
costs one level. Proofs go down the same levels: children join their parents by place, and each prepends its siblings to
the suffix that its parent has inherited. A proof is the list, leaf level first, of what stands left and right of the
node in its run; folding a leaf through it gives the root again.

No task holds a source: places come from a range sort of all leaves by (source, id, hash) and a running count of the
pieces in which a source lies; parents have at most FANOUT children, so all joins and groups are even whatever the
sizes of the sources. Rows that are equal in all of it are told apart by their number, so that copies spread, too.
Texts are read once, for the hashes; from then on a row is some 200 bytes.

Defined results: a null field counts as `-`; a null source is a source of its own, before all others; within a source
null ids come first, rows of one id are ordered by their hash; repeated rows are leaves of their own; a single row is
its own root, with an empty proof; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.session import durable

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<before:string,after:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def sized(value: Column) -> Column:
    """A field as its UTF-8 byte count and itself, `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return digest(F.concat(*map(sized, fields)))


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds i, a row's place in its group g by the given order, and n, the group's rows."""
    nodes = nodes.withColumn("copy", F.monotonically_increasing_id())
    lying = durable(nodes.repartitionByRange("g", *order, "copy").sortWithinPartitions("g", *order, "copy").drop("copy").withColumn("at", F.monotonically_increasing_id()))
    piece = F.shiftright("at", 33).alias("piece")
    pieces = lying.groupBy("g", piece).agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    before, whole = Window.partitionBy("g").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    pieces = pieces.select("g", "piece", "start", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    return lying.withColumn("piece", F.shiftright("at", 33)).join(pieces, ["g", "piece"]).withColumn("i", F.col("at") - F.col("start") + F.col("before")).drop("at", "piece", "start", "before")


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Each level of all groups' trees as g, i, n (nodes of the group there), hash and kids; first the leaves themselves."""
    built = [durable(leaves)]
    while not (below := built[-1].where("n > 1")).isEmpty():
        run = F.transform(F.array_sort(F.collect_list(F.struct("i", "hash"))), lambda x: x["hash"])
        parents = below.groupBy("g", F.floor(F.col("i") / fanout).alias("p"), F.ceil(F.col("n") / fanout).alias("m")).agg(run.alias("kids"))
        built.append(durable(parents.select("g", F.col("p").alias("i"), F.col("m").alias("n"), digest(F.array_join("kids", "")).alias("hash"), "kids")))
    return built


def pushed(built: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every leaf with its proof and what tops carries. tops: g, proof and carried columns of each group's root."""
    carried = [c for c in tops.columns if c != "g"]
    above = None
    for level in reversed(built):
        own_cols = [c for c in level.columns if c != "n"]
        here = level.where("n = 1").join(tops, "g").select(*own_cols, *carried)
        if above is not None:
            place = (F.col("c.i") % fanout).cast("int")
            own = F.struct(F.array_join(F.slice("a.kids", F.lit(1), place), "").alias("before"), F.array_join(F.slice("a.kids", place + 2, F.lit(fanout)), "").alias("after"))
            met = level.where("n > 1").alias("c").join(above.alias("a"), (F.col("c.g") == F.col("a.g")) & (F.floor(F.col("c.i") / fanout) == F.col("a.i")))
            proof = F.concat(F.array(own), "a.proof").alias("proof")
            here = here.unionByName(met.select(*(f"c.{c}" for c in own_cols), *(proof if c == "proof" else f"a.{c}" for c in carried)))
        above = here
    return above


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def proof_text(proof: Column) -> Column:
    """All siblings' hashes, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(rows: DataFrame, group: Column, leaf: Column, order: Sequence[str], carry: Sequence[str] = (), fanout: int = FANOUT) -> DataFrame:
    """For each row: the order and carried columns, leaf, subroot, root and proof (array of before and after)."""
    held = [*dict.fromkeys((*order, *carry))]
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    leaves = rows.select(*(F.col(c).alias(f"v_{c}") for c in held), key.alias("g"), leaf.alias("hash"))
    built = levels(placed(durable(leaves), [*(f"v_{c}" for c in order), "hash"]), fanout)
    roots = None
    for level in built:
        top = level.where("n = 1").select("g", "hash")
        roots = top if roots is None else roots.unionByName(top)
    over = levels(placed(durable(roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "hash")), ["name"]), fanout)
    root = over[-1].where("n = 1").select("g", F.col("hash").alias("root"), F.array().cast(SIBLINGS).alias("proof"))
    tops = pushed(over, root, fanout).select(F.col("name").alias("g"), F.col("hash").alias("subroot"), "root", "proof")
    proofs = pushed(built, durable(tops), fanout)
    return proofs.select(*(F.col(f"v_{c}").alias(c) for c in held), F.col("hash").alias("leaf"), "subroot", "root", "proof")


def op13(docs: DataFrame) -> DataFrame:
    """The contract's columns; tampering takes the line feeds out of some texts."""
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars"), "text")
    rows = fields.select("doc_id", "source", leaf_hash([F.col(c) for c in FIELDS]).alias("whole"), leaf_hash([text if c == "text" else F.col(c) for c in FIELDS]).alias("tampered"))
    made = manifest(rows, F.col("source"), F.col("whole"), ["doc_id"], ["tampered"])
    return made.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("proof"))).alias("proof_sha256"), folded(F.col("tampered"), F.col("proof")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of the decimal id by its table; levels by recursion, each level only from the one before.
SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), b)) AS t),
d AS (SELECT row_number() OVER () AS r, *, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT) & 1 = 1 AS even FROM documents, crc),
f AS (SELECT r, doc_id, coalesce('=' || source, '') AS g, {" || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in FIELDS[:-1])} AS head, text, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS bad FROM d),
h AS (SELECT r, doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(bad) || ':' || bad, '-')) AS tampered FROM f),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h),
up(g, l, i, n, hash) AS (SELECT g, 0, i, n, leaf FROM leaves UNION ALL SELECT g, l + 1, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(hash, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY g, l, i // {FANOUT}, n),
tops AS MATERIALIZED (SELECT g, l, hash, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
over_(l, i, n, hash) AS (SELECT 0, i, n, hash FROM tops UNION ALL SELECT l + 1, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(hash, '' ORDER BY i)) FROM over_ WHERE n > 1 GROUP BY l, i // {FANOUT}, n),
nodes AS MATERIALIZED (SELECT g, l, i, hash FROM up UNION ALL SELECT NULL, l, i, hash FROM over_),
sides AS MATERIALIZED (SELECT a.g, a.l, a.i, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.g IS NOT DISTINCT FROM b.g AND a.l = b.l AND a.i // {FANOUT} = b.i // {FANOUT} GROUP BY ALL),
root AS (SELECT hash AS root FROM over_ WHERE n = 1),
walk(r, doc_id, top, g, l, i, height, proof, fold) AS (
  SELECT r, doc_id, leaves.g, leaves.g, 0, leaves.i, tops.l, '', tampered FROM leaves JOIN tops ON leaves.g = tops.g
  UNION ALL
  SELECT r, doc_id, top, CASE WHEN at_top THEN NULL ELSE w.g END, CASE WHEN at_top THEN 0 ELSE w.l + 1 END, CASE WHEN at_top THEN t.i ELSE w.i // {FANOUT} END, CASE WHEN at_top THEN (SELECT max(l) FROM over_) ELSE height END,
    proof || CASE WHEN at_top THEN '' ELSE before || after END, CASE WHEN at_top THEN fold ELSE sha256(before || fold || after) END
  FROM (SELECT *, l = height AND g IS NOT NULL AS at_top FROM walk WHERE l < height OR g IS NOT NULL) w
  JOIN sides s ON w.g IS NOT DISTINCT FROM s.g AND w.l = s.l AND w.i = s.i JOIN tops t ON t.g = w.top),
done AS (SELECT * FROM walk WHERE g IS NULL AND l = height)
SELECT done.doc_id, leaf, tops.hash AS subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM done JOIN leaves USING (r) JOIN tops ON tops.g = done.top, root"""
