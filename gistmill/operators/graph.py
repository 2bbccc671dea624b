"""Trees, components and contraction; communities are in topics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gistmill.session import durable, stored

#: Edges that one task of connected_components settles: some ten MB.
IN_TASK = 100_000
#: Edges of whole numbers of which `forest` keeps a tree for each part: some 300 MB.
FOREST = 4_000_000


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1 and links (i, j), the smallest node that each reaches.

    Every root with a smaller root beside it hangs itself under the least of those, and paths are pressed flat before
    the next round. Two rounds leave at most half the roots of a component that still has several.
    """
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def numbered_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of links (a, b) of whole numbers in order, and the links by their places there."""
    low, high = int(min(a.min(), b.min())), int(max(a.max(), b.max()))
    if high - low > 4 * len(a):
        names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
        return names, ends[: len(a)], ends[len(a) :]
    # close numbers are marked in an array instead of sorted
    a, b, met = a - low, b - low, np.zeros(high - low + 1, bool)
    met[a] = met[b] = True
    place = np.cumsum(met) - 1
    return np.flatnonzero(met) + low, place[a], place[b]


def _finish(kind: T.DataType):
    """All edges of a small graph in one task: (id, root)."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        ends = [pa.chunked_array([b.column(k) for b in held], type=arrow) for k in (0, 1)] if held else []
        if not held or not len(ends[0]):
            return
        both = pa.chunked_array([c for e in ends for c in e.chunks], type=arrow).combine_chunks()
        names = both.unique()
        names = names.take(pc.sort_indices(names))
        at = pc.index_in(both, names).to_numpy()
        roots = local_roots(len(names), at[: len(at) // 2], at[len(at) // 2 :])
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(roots))], names=["id", "root"])

    return run


def _trees(most: int):
    """Edges (a, b), whole numbers, by the most: for each node that has a smaller one in its part there, (least, node)."""

    def some(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([r.column(k).to_numpy() for r in held]) for k in (0, 1))
        names, i, j = numbered_ends(a, b)
        root = local_roots(len(names), i, j)
        under = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[root[under]]), pa.array(names[under])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= most:
                yield some(held)
                held, n = [], 0
        if n:
            yield some(held)

    return run


def forest(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Edges (a, b) of longs with the components of the given ones, which are stored without nulls: trees of the edges
    that a task reads, then of these trees, as long as that halves them. Where nodes are about as many as edges, the
    first pass is all it costs."""
    most, left, n = most or FOREST, edges.select("a", "b"), edges.count()
    while n > most:
        # as few tasks as hold `most` edges each: trees of many edges are fewer
        fewer = left.coalesce(max(n // most, 1)).mapInArrow(_trees(most), "a long, b long")
        left, before = stored(fewer), n
        n = left.count()
        if n * 2 > before:
            break
    return left


def connected_components(edges: DataFrame, in_task: int = IN_TASK, once: bool = False) -> DataFrame:
    """(id, root): the smallest id that each id of the edges (a, b) reaches. Loops, repeats and null ends do no harm. With
    `once`, the edges are stored already, without loops and repeats, and are not told apart again.

    Contraction at random: in each round every node has a new random rank, adopts the neighbour of the least rank (or
    itself), and then what that one adopted; edges are rewritten between what their ends adopted, and those inside one
    node vanish. Ranks are new in each round, so the order of ids plays no part: a path keeps about two nodes in five
    and a star one, whatever their ids, and the rounds are the logarithm of the nodes. As soon as no more than in_task
    edges are left, one task settles them, however large the graph was. Adoptions are followed from the last round
    back, over ever larger tables, so that work adds up to a multiple of the first round.

    Minima are partial before the shuffle, every table is cut with a checkpoint, so that joins read it through an
    exchange that adaptive execution can split, and nothing is collected but the number of edges left.
    """
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("root", kind)])
    left = edges if once else durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    adopted: list[DataFrame] = []
    while left.limit(in_task + 1).count() > in_task:
        rank = len(adopted)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b", F.lit(rank)).alias("h"), F.col("b").alias("x")))
        near = durable(both.groupBy("a").agg(least.alias("m")).select(F.col("a").alias("id"), F.least("m", F.struct(F.xxhash64("a", F.lit(rank)).alias("h"), F.col("a").alias("x")))["x"].alias("root")))
        step = durable(near.alias("x").join(near.alias("y"), F.col("x.root") == F.col("y.id")).select("x.id", "y.root"))
        adopted.append(step)
        # one row of step for each id: edges need no sort to be joined to it
        moved = left.join(step.select(F.col("id").alias("a"), F.col("root").alias("ra")).hint("shuffle_hash"), "a").join(step.select(F.col("id").alias("b"), F.col("root").alias("rb")).hint("shuffle_hash"), "b")
        left = durable(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    now = durable(left.coalesce(1).mapInArrow(_finish(kind), schema))
    if not adopted:
        return now
    for step in reversed(adopted):
        up = now.select(F.col("id").alias("root"), F.col("root").alias("up"))
        now = durable(step.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")))
    least = durable(now.groupBy("root").agg(F.min("id").alias("least")))
    return durable(now.join(least, "root").select("id", F.col("least").alias("root")))


def _rounds(nodes: DataFrame) -> int:
    """Doublings after which every path without a cycle has ended."""
    return math.ceil(math.log2(nodes.count() + 2)) + 1


def nearest_kept(nodes: DataFrame) -> DataFrame:
    """nodes (scope, id, parent, kept) with `anchor`, the nearest kept ancestor, the node itself included; null on a
    cycle of dropped nodes or at a root. Pointers double each round: the rounds are the logarithm of the depth."""
    now = durable(nodes.select("scope", "id", "kept", F.when(F.col("kept"), F.col("id")).otherwise(F.col("parent")).alias("to")))
    for _ in range(_rounds(nodes)):
        far = now.select(F.col("scope").alias("_s"), F.col("id").alias("_i"), F.col("kept").alias("_k"), F.col("to").alias("_t"))
        step = now.join(far, (now["scope"] == far["_s"]) & (now["to"] == far["_i"]), "left")
        settled = F.col("_k") | F.col("_i").isNull()
        step = step.select("scope", "id", "kept", F.when(F.col("kept"), F.col("id")).when(F.col("_i").isNull(), F.lit(None)).when(F.col("_k"), F.col("to")).otherwise(F.col("_t")).alias("to"), (~settled & ~F.col("kept")).alias("moved"))
        step = durable(step)
        moved = step.where("moved").limit(1).count()
        now = step.drop("moved")
        if not moved:
            break
    stuck = now.alias("a").join(nodes.alias("n"), (F.col("a.scope") == F.col("n.scope")) & (F.col("a.to") == F.col("n.id")), "left")
    return stuck.select("a.scope", "a.id", F.when(F.col("n.kept"), F.col("a.to")).alias("anchor"))


def depths(nodes: DataFrame) -> DataFrame:
    """nodes (scope, id, parent) with depth (0 at a root), or null on a cycle. Pointer doubling."""
    now = durable(nodes.select("scope", "id", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("d")))
    for _ in range(_rounds(nodes)):
        far = now.select(F.col("scope").alias("_s"), F.col("id").alias("_i"), F.col("to").alias("_t"), F.col("d").alias("_d"))
        now = durable(now.join(far, (now["scope"] == far["_s"]) & (now["to"] == far["_i"]), "left").select("scope", "id", F.col("_t").alias("to"), (F.col("d") + F.coalesce("_d", F.lit(0))).cast("long").alias("d")))
        if not now.where("to is not null").limit(1).count():
            break
    return now.select("scope", "id", F.when(F.col("to").isNull(), F.col("d")).alias("depth"))


def tree_faults(messages: DataFrame) -> DataFrame:
    """(conversation_id, fault): repeated ids, parents that are not there, cycles."""
    repeated = messages.groupBy("conversation_id", "id").count().where("count > 1").select("conversation_id", F.lit("repeated id").alias("fault"))
    ids = messages.select("conversation_id", F.col("id").alias("parent_id"))
    orphans = messages.where("parent_id is not null").join(ids, ["conversation_id", "parent_id"], "left_anti").select("conversation_id", F.lit("unknown parent").alias("fault"))
    # an id that comes several times has one parent here: else every doubling would pair all its rows with all of its parent's
    tree = messages.groupBy(F.col("conversation_id").alias("scope"), "id").agg(F.max("parent_id").alias("parent"))
    cycles = depths(tree).where("depth is null").select(F.col("scope").alias("conversation_id"), F.lit("cycle").alias("fault"))
    return repeated.unionByName(orphans).unionByName(cycles).distinct()


def active_branch(messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """messages (conversation_id, id, parent_id, position) on the path from the root to the conversation's leaf, with
    branch_position; a conversation without a leaf keeps all its messages in stored order.

    Marks double their reach each round: each marked message marks the one 2^k steps above it.
    """
    scope = messages.select(F.col("conversation_id").alias("scope"), "id", F.col("parent_id").alias("to"))
    marked = durable(leaves.where("leaf_id is not null").select(F.col("conversation_id").alias("scope"), F.col("leaf_id").alias("id")))
    hop = durable(scope)
    for _ in range(_rounds(messages)):
        more = marked.join(hop, ["scope", "id"]).where("to is not null").select("scope", F.col("to").alias("id"))
        marked = durable(marked.unionByName(more).distinct())
        far = hop.select(F.col("scope").alias("_s"), F.col("id").alias("_i"), F.col("to").alias("_t"))
        hop = durable(hop.join(far, (hop["scope"] == far["_s"]) & (hop["to"] == far["_i"])).where("_t is not null").select("scope", "id", F.col("_t").alias("to")))
        if not hop.limit(1).count():
            break
    depth = depths(scope.withColumnRenamed("to", "parent"))
    on_path = messages.join(marked.select(F.col("scope").alias("conversation_id"), "id"), ["conversation_id", "id"], "left_semi").join(depth.select(F.col("scope").alias("conversation_id"), "id", "depth"), ["conversation_id", "id"]).withColumn("branch_position", F.col("depth").cast("long")).drop("depth")
    no_leaf = messages.join(leaves.where("leaf_id is not null").select("conversation_id"), "conversation_id", "left_anti").withColumn("branch_position", F.col("position").cast("long"))
    return on_path.unionByName(no_leaf)


def contract(links: DataFrame, roots: DataFrame) -> DataFrame:
    """links (source, target, weight) between roots, parallel ones summed, direction and loops dropped."""
    a, b = roots.select(F.col("id").alias("source"), F.col("root").alias("_a")).hint("shuffle_hash"), roots.select(F.col("id").alias("target"), F.col("root").alias("_b")).hint("shuffle_hash")
    rows = links.join(a, "source").join(b, "target").where("_a <> _b")
    return rows.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("weight").alias("weight"))
