"""Operator 8: n-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts become sets of five-word shingles. Texts of the same set are one class; from here on a class counts once.
Each class has a label of LABEL MinHash values, a byte each, in every one of TREES prefix tries. Two classes meet in a
node of a trie if their labels there share the node's prefix. The matched prefix starts at the whole label. After the
nodes of a depth are verified, the exact similarities of the links found there, each weighed by the chance that the
forest shows such a link at this depth, estimate how similar the table's links are; from that comes the longest
shorter prefix that would show RECALL of them. It is taken, verified and estimated anew, until the estimate reaches
RECALL. The prefix is never shortened below the depth at which a pair of the threshold itself is shown with RECALL;
where no link is found, that depth is taken. Tables of close copies so stay at long prefixes, with few chance meetings.

Verification is exact and stays inside the nodes: a node's classes are cut into tiles of bounded size, shared shingles
are counted pair of tiles by pair of tiles, and of the trees in which a pair meets only the first one counts it. Nodes
of the same members in several trees are verified once. Results are one row for each class of a pair of tiles, never
one for each pair.

Words are runs of anything but ASCII white space, as they are. Defined results: a text of one to four words has one
shingle, all its words; a text without words (or null) has none and links with nothing; documents of a null id are
joined like others, and their class_id is the smallest id of their group, null if it has none; repeated rows count as
documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm import blocks as B
from gistmill.llm.langmodel import mixed
from gistmill.operators.graph import connected_components, local_roots
from gistmill.session import durable

WORDS, THRESHOLD = 5, 0.8
TREES, LABEL, RECALL = 20, 8, 0.9999
#: A verification tile holds about so many classes or bytes of shingles; columns of an incidence block; rows of a strip.
TILE, TILE_BYTES, COLUMNS, STRIP = 1024, 4_000_000, 1024, 128
#: Bins of similarity between the threshold and 1 that the recall is estimated from.
BINS = 40
HELD_WORDS = 300_000
_rng = np.random.default_rng(0x5EED)
FACTORS = _rng.integers(1, 2**63, TREES * LABEL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, TREES * LABEL, dtype=np.uint64)
PLACES = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]


def recall(similarity, depth: int, trees: int = TREES):
    """The chance that two sets of that Jaccard similarity share a prefix of that depth in some tree."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def shortest_prefix(threshold: float, target: float = RECALL) -> int:
    """The longest prefix that reaches the target for pairs of the threshold itself; 1 if none does."""
    return next((d for d in range(LABEL, 1, -1) if recall(threshold, d) >= target), 1)


def next_prefix(found: np.ndarray, depth: int, threshold: float, target: float = RECALL) -> int:
    """The prefix to match next, from the links found at a depth by bins of similarity; depth itself if they suffice."""
    floor = min(shortest_prefix(threshold, target), depth)
    if not found.sum():
        return floor
    similarity = threshold + (1.0 - threshold) * np.arange(BINS) / BINS  # the lower end of each bin
    real = found / recall(similarity, depth)
    return next((d for d in range(depth, floor, -1) if (real * recall(similarity, d)).sum() >= target * real.sum()), floor)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, table: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    if len(table) > HELD_WORDS:
        table.clear()
    k = min(WORDS, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * PLACES[j]
    return np.unique(mixed(total + np.uint64(k)))


def label_of(own: np.ndarray) -> bytes:
    """The labels of a set in all trees, LABEL bytes each."""
    low = np.full(TREES * LABEL, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 2048):
            low = np.minimum(low, (own[at : at + 2048, None] * FACTORS[None, :] + OFFSETS[None, :]).min(axis=0))
        return mixed(low).astype(np.uint8).tobytes()


def set_hash(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = WordHashes()
    for batch in batches:
        sets = [shingles(t, table) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("k"), batch.column("h"), pa.array([set_hash(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([label_of(s) if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "k", "h", "c", "n", "label"],
        )


def group_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the documents that stand for a class; a document of the same key but another set is not one."""
    table = WordHashes()
    for batch in batches:
        sets = [shingles(t, table) for t in batch.column("text").to_pylist()]
        own = [j for j, (s, c) in enumerate(zip(sets, batch.column("c").to_pylist(), strict=True)) if set_hash(s) == c]
        at = pa.array(own, pa.int64())
        yield pa.RecordBatch.from_arrays([*[batch.column(x).take(at) for x in ("c", "m", "n", "label")], pa.array([sets[j].tobytes() for j in own], pa.binary())], names=["c", "m", "n", "label", "s"])


def shared(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of a shares with each of b (of a, if b is None)."""
    every = a if b is None else a + b
    values, at, n = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every), dtype=np.int32), [len(s) for s in every])
    common = np.flatnonzero(n > 1)
    place = np.full(len(values), -1, np.int32)
    place[common] = np.arange(len(common))
    place = place[at]
    del values, at, n
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(a), len(a) if b is None else len(b)), np.float32)
    for lo in range(0, len(common), COLUMNS):
        x, y = np.searchsorted(place, (lo, lo + COLUMNS))
        grid = np.zeros((len(every), min(COLUMNS, len(common) - lo)), np.float32)
        grid[row[x:y], place[x:y] - lo] = 1.0
        left, right = grid[: len(a)], grid if b is None else grid[len(a) :]
        # rows without a shingle of this block take no part
        p, q = np.flatnonzero(left.any(axis=1)), np.flatnonzero(right.any(axis=1))
        out[np.ix_(p, q)] += left[p] @ right[q].T
    return out


def prefix_keys(labels: list[bytes], depth: int) -> np.ndarray:
    """For each label and tree, its prefix as a number (of up to eight bytes)."""
    values = np.frombuffer(b"".join(labels), np.uint8).reshape(len(labels), TREES, LABEL)[:, :, :depth].astype(np.uint64)
    return (values << (np.arange(depth, dtype=np.uint64) * np.uint64(8))).sum(axis=2, dtype=np.uint64)


def verify(threshold: float, depth: int):
    """A pair of tiles of a node: for each class with a link that this tree is the first to show, how many documents
    it links to and the least class it hangs with; and links by bin of similarity (rows of a null class)."""
    names = ["c", "links", "low", "bin"]
    schema = pa.schema([("c", pa.binary()), ("links", pa.int64()), ("low", pa.binary()), ("bin", pa.int32())])

    def pair(rows: list[dict]) -> tuple[list, list, list, np.ndarray]:
        rows.sort(key=lambda r: (r["tile"], r["c"]))
        crossed, tree = rows[0]["crossed"], rows[0]["tree"]
        cut = next((k for k, r in enumerate(rows) if r["tile"] != rows[0]["tile"]), len(rows))
        bins = np.zeros(BINS, np.int64)
        if (crossed and cut == len(rows)) or len(rows) < 2:
            return [], [], [], bins
        sets = [np.frombuffer(r["s"], np.uint64) for r in rows]
        keys = prefix_keys([r["label"] for r in rows], depth)
        size = np.array([len(s) for s in sets], np.float32)
        m = np.array([r["m"] for r in rows], np.int64)
        both = shared(sets[:cut], sets[cut:] if crossed else None)
        first = cut if crossed else 0
        n, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for x in range(0, cut, STRIP):
            part = both[x : x + STRIP]
            likeness = part / (size[x : x + len(part), None] + size[None, first:] - part)
            i, j = np.nonzero(likeness >= threshold - 1e-6)
            if not crossed:
                i, j = i[j > i + x], j[j > i + x]
            near = likeness[i, j]
            i, j = i + x, j + first
            # in whole numbers, as single precision may round the quotient
            top, whole = both[i, j - first].astype(np.float64), size[i].astype(np.float64) + size[j]
            own = top >= threshold * (whole - top) - 1e-9
            for t in range(tree):
                own &= keys[i, t] != keys[j, t]
            i, j, near = i[own], j[own], near[own]
            if len(i):
                bins += np.bincount(np.clip(((near - threshold) / (1 - threshold) * BINS).astype(np.int64), 0, BINS - 1), minlength=BINS)
                n += (np.bincount(i, weights=m[j], minlength=len(rows)) + np.bincount(j, weights=m[i], minlength=len(rows))).astype(np.int64)
                root = local_roots(len(rows), np.concatenate([np.arange(len(rows)), i]), np.concatenate([root, j]))
        own = np.flatnonzero(n)
        return [rows[k]["c"] for k in own], n[own].tolist(), [rows[k]["c"] for k in root[own]], bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        held: tuple[list, list, list] = ([], [], [])
        for _, rows in B.grouped(batches, "pair"):
            *found, bins = pair(list({(r["tile"], r["c"]): r for r in rows}.values()))
            total += bins
            for a, b in zip(held, found, strict=True):
                a.extend(b)
            if len(held[0]) > 5000:
                yield pa.RecordBatch.from_arrays([*[pa.array(h, schema.field(k).type) for k, h in enumerate(held)], pa.nulls(len(held[0]), pa.int32())], names=names)
                held = ([], [], [])
        own = np.flatnonzero(total)
        none = [None] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(held[0] + none, pa.binary()), pa.array(held[1] + total[own].tolist(), pa.int64()), pa.array(held[2] + none, pa.binary()), pa.array([None] * len(held[0]) + own.tolist(), pa.int32())], names=names)

    return run


def in_trees(classes: DataFrame, depth: int, *columns: str) -> DataFrame:
    """A row for each class and tree, with the key of the class's node at that depth."""
    rows = classes.select(*columns, "label", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    prefix: Column = F.expr(f"substring(label, tree * {LABEL} + 1, {depth})")
    return rows.select(*columns, "tree", F.xxhash64(prefix).alias("key"))


def linked_in_nodes(sets: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Rows of verify() for all nodes of a depth, from the classes' sets."""
    nodes = in_trees(sets, depth, "c", "n")
    members = [F.bit_xor(F.xxhash64("c", F.lit(k))).alias(f"f{k}") for k in (1, 2)]
    met = nodes.groupBy("tree", "key").agg(F.count("*").alias("classes"), F.sum(F.col("n") * 8).alias("bytes"), *members).where("classes > 1")
    once = met.groupBy("classes", "bytes", "f1", "f2").agg(F.min(F.struct("tree", "key")).alias("node"))
    tiles = F.greatest(F.ceil(F.col("classes") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    once = durable(once.select("node.tree", "node.key", tiles.alias("tiles")))
    placed = nodes.join(once, ["tree", "key"]).select("c", "tree", "key", "tiles").withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
    wanted = placed.join(sets, "c").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    name = F.concat_ws("-", "tree", F.hex("key"), F.least("tile", "other"), F.greatest("tile", "other"))
    rows = wanted.select(name.alias("pair"), "tree", "c", "tile", "m", (F.col("other") != F.col("tile")).alias("crossed"), "label", "s")
    return durable(B.by_key(rows, "pair", [], verify(threshold, depth), "c binary, links long, low binary, bin int"))


def forest_links(sets: DataFrame, threshold: float, target: float = RECALL) -> tuple[DataFrame, int]:
    """The rows of linked_in_nodes() at the prefix that reaches the target recall, and that prefix's depth."""
    depth = LABEL
    while True:
        rows = linked_in_nodes(sets, depth, threshold)
        found = np.zeros(BINS)
        for r in rows.where("bin is not null").groupBy("bin").agg(F.sum("links").alias("n")).collect():  # BINS rows
            found[r.bin] = r.n
        shorter = next_prefix(found, depth, threshold, target)
        if shorter == depth:
            return rows.where("bin is null").drop("bin"), depth
        depth = shorter


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rows: bool = False) -> DataFrame:
    """doc_id, class_id (smallest id of its group of links), copy_id (smallest id of its shingle set), n_links, kept.

    Where ids repeat or are null they do not name a row: with rows, text_hash (xxhash64 of the text's bytes) and kept_row
    come, too: of each group the least (id, text_hash) stays, null ids last, and each row without a word."""
    B.tune(docs.sparkSession)
    base = B.texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).withColumn("k", F.coalesce("id", "h"))
    signed = durable(base.mapInArrow(B.releasing(signatures), "doc_id long, k long, h long, c binary, n long, label binary"))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = durable(signed.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.min(own).alias("first"), F.min("k").alias("k"), F.count("*").alias("m"), F.max("n").alias("n"), F.first("label").alias("label")))
    # only classes that meet another at the shortest prefix take part; their sets are made once
    nodes = in_trees(classes, shortest_prefix(threshold), "c")
    met = durable(nodes.groupBy("tree", "key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("tree", "key"))
    near = nodes.join(met, ["tree", "key"], "left_semi").select("c").distinct()
    wanted = base.join(classes.drop("least", "first").join(near, "c"), "k").select("text", "c", "m", "n", "label")
    sets = durable(wanted.mapInArrow(B.releasing(group_sets), "c binary, m long, n long, label binary, s binary").dropDuplicates(["c"]))
    links, _ = forest_links(sets, threshold)
    roots = connected_components(links.select(F.col("c").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "c")
    joined = classes.select("c", "least", "first").join(roots, "c")
    smallest = durable(joined.groupBy("root").agg(F.min("least").alias("class_id"), F.min("first").alias("group_first")))
    counts = links.groupBy("c").agg(F.sum("links").alias("links"))
    linked = joined.select("c", "root").join(smallest, "root").join(counts, "c").select("c", "class_id", "group_first", "links")
    # cut here, so that the join of all rows, where one class may hold a third of them, can be split
    of_class = durable(classes.select("c", "least", "first", "m").join(linked, "c", "left"))
    every = signed.select("doc_id", "h", "c", "n").join(of_class, "c", "left")
    alone = F.col("n") == 0
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("class_id")))
    n_links = F.when(alone, F.lit(0)).otherwise(F.col("m") - 1 + F.coalesce("links", F.lit(0))).cast("long")
    more = [F.col("h").alias("text_hash"), (alone | own.eqNullSafe(F.coalesce("group_first", "first"))).alias("kept_row")] if rows else []
    return every.select("doc_id", class_id.alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("copy_id"), n_links.alias("n_links"), F.coalesce(F.col("doc_id") == class_id, class_id.isNull()).alias("kept"), *more)
