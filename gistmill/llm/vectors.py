"""Operator 6: near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are brought to unit length and turned onto principal axes (fitted on a bounded sample; a rotation changes no
cosine). They are dealt to cells by their places on the first two axes, cells are cut into bands of bounded size, and
bands into tiles. Two unit vectors of cosine t lie no further apart than sqrt(2 - 2 t), so a band meets only bands
within reach on the first axis, and in a pair of bands a tile only tiles within reach by their boxes on the leading
axes. A band is as wide as leaves enough pairs for the cluster's partitions, so that a vector is sent about twice the
root of their number times, up to the width that a task can hold. Inside a pair of tiles, products of the leading axes
are summed first; what the other axes can add is bounded by the product of the suffix norms, and a pair is dropped as
soon as sum plus bound stays under the threshold. Survivors are decided in double precision on the given components.

Links are folded square by square into counts and roots. A pair of bands gives one row for each vector that has a link
there: how many, and the smallest row of those it hangs together with. So a group of any size gives rows in proportion
to its vectors, not to its pairs, and no task holds more links than a square has.

Defined results: null or zero vectors, and those with a null, NaN or infinite component, link with nothing, are
their own component and are kept; a shorter vector counts as padded with zeros; rows of the same id are vectors of
their own; a component of null ids alone has a null id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import blocks as B
from gistmill.operators.graph import connected_components, local_roots
from gistmill.session import durable

THRESHOLD = 0.95
#: Rows that axes and cells are fitted on; rows of a tile, and of the squares that are compared at once.
SAMPLE, TILE, SQUARE = 16_384, 4096, 512
#: Rows and bytes of a band at most; leading axes that a tile's box is kept on.
BAND, BAND_BYTES, BOX = 65_536, 24_000_000, 8
#: Leading axes of each stage of a comparison.
STAGES = (12, 24)
#: Survivors of a square above which one product of all is cheaper than one for each.
DENSE = 20_000


def unit_rows(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of unit rows, which rows are valid)."""
    out = np.zeros((len(vectors), width))
    ok = np.zeros(len(vectors), bool)
    for k, v in enumerate(vectors):
        if v is not None and len(v) and all(x is not None for x in v):
            row = np.array(v, np.float64)
            top = np.abs(row).max()
            if np.isfinite(top) and top > 0 and np.isfinite(row).all():
                row = row / top  # so that squares neither vanish nor overflow
                out[k, : len(row)] = row / math.sqrt(float(row @ row))
                ok[k] = True
    return out, ok


def axes_of(sample: np.ndarray) -> np.ndarray:
    """Principal axes as columns, the strongest first."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(vectors[:, ::-1])


def square_links(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs with cosine >= threshold, square by square; a, b are turned rows, ua, ub the given unit rows."""
    cuts = [0, *[s for s in STAGES if s < a.shape[1]], a.shape[1]]
    slack = threshold - 1e-9
    rest_a = [np.sqrt(np.maximum((a[:, c:] ** 2).sum(axis=1), 0)) for c in cuts[1:]]
    rest_b = [np.sqrt(np.maximum((b[:, c:] ** 2).sum(axis=1), 0)) for c in cuts[1:]]
    few = max(1, 1_000_000 // a.shape[1])
    for x in range(0, len(a), SQUARE):
        for y in range(x if same else 0, len(b), SQUARE):
            p, q = a[x : x + SQUARE], b[y : y + SQUARE]
            dot = p[:, : cuts[1]] @ q[:, : cuts[1]].T
            live = dot + np.outer(rest_a[0][x : x + SQUARE], rest_b[0][y : y + SQUARE]) >= slack
            if same and x == y:
                live = np.triu(live, 1)
            i, j = np.nonzero(live)
            sums = dot[i, j]
            for stage in range(1, len(cuts) - 1):
                if not len(i):
                    break
                lo, hi = cuts[stage], cuts[stage + 1]
                if len(i) > DENSE:
                    sums = sums + (p[:, lo:hi] @ q[:, lo:hi].T)[i, j]
                else:
                    sums = sums + np.einsum("ij,ij->i", p[i, lo:hi], q[j, lo:hi])
                keep = sums + rest_a[stage][x + i] * rest_b[stage][y + j] >= slack
                i, j, sums = i[keep], j[keep], sums[keep]
            if len(i) > DENSE:
                exact = (ua[x : x + SQUARE] @ ub[y : y + SQUARE].T)[i, j] >= threshold
            else:
                exact = np.concatenate([np.einsum("ij,ij->i", ua[i[k : k + few] + x], ub[j[k : k + few] + y]) >= threshold for k in range(0, len(i), few)] or [np.empty(0, bool)])
            if exact.any():
                yield i[exact] + x, j[exact] + y


class Cells:
    """Cells by quantiles on the first axis and, inside each of those, on the second."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        slabs = max(1, min(int(math.sqrt(n)), len(sample) // 16))
        self.parts = max(1, min(-(-n // slabs), len(sample) // (16 * slabs)))
        self.slabs = np.quantile(sample[:, 0], np.arange(1, slabs) / slabs) if slabs > 1 else np.empty(0)
        own = np.searchsorted(self.slabs, sample[:, 0]) if len(sample) else np.empty(0, np.int64)
        cut = np.arange(1, self.parts) / self.parts
        self.cuts = [np.quantile(sample[own == k, 1], cut) if self.parts > 1 and (own == k).any() else np.empty(0) for k in range(slabs)]

    def of(self, places: np.ndarray) -> np.ndarray:
        slab = np.searchsorted(self.slabs, places[:, 0])
        part = np.zeros(len(places), np.int64)
        for k in np.unique(slab):
            own = slab == k
            part[own] = np.searchsorted(self.cuts[k], places[own, 1])
        return (slab * self.parts + part).astype(np.int32)


def celled(axes: np.ndarray, cells: Cells):
    """Unit rows of valid vectors with their cell and their place on the first axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, ok = unit_rows(batch.column("v").to_pylist(), len(axes))
            own = np.flatnonzero(ok)
            places = unit[own] @ axes[:, :2]
            cell = cells.of(places) if axes.shape[0] > 1 else np.searchsorted(cells.slabs, places[:, 0]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(places[:, 0]), batch.column("rid").take(pa.array(own)), pa.array([unit[k].tobytes() for k in own], pa.binary())], names=["cell", "place", "rid", "v"])

    return run


def packed_tiles(band: int):
    """Tiles of bounded size (cell, part, tile, lo, hi, rids, v); part counts the bands of a cell, tile the tiles of a band."""
    size = min(TILE, band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, rids, places, vectors = None, 0, [], [], []

        def close() -> pa.RecordBatch:
            first = done - len(rids)
            values = [now, first // band, first % band // size, min(places), max(places), np.array(rids, np.int64).tobytes(), b"".join(vectors)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["cell", "part", "tile", "lo", "hi", "rids", "v"])

        for batch in batches:
            for cell, place, rid, v in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if rids and (cell != now or done % band % size == 0):
                    yield close()
                    rids, places, vectors = [], [], []
                if cell != now:
                    now, done = cell, 0
                done += 1
                rids.append(rid)
                places.append(place)
                vectors.append(v)
        if rids:
            yield close()

    return run


def compare(axes: np.ndarray, threshold: float):
    """A pair of bands: (rid, n, root) of each vector with links in it."""
    width, reach = len(axes), math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def links(sides: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sides.sort(key=lambda r: (r["number"], r["tile"]))
        given = [np.frombuffer(s["v"], np.float64).reshape(-1, width) for s in sides]
        turned = [g @ axes for g in given]
        boxes = [(t[:, :BOX].min(axis=0), t[:, :BOX].max(axis=0)) for t in turned]
        rids = np.concatenate([np.frombuffer(s["rids"], np.int64) for s in sides])
        order = np.argsort(rids, kind="stable")  # nodes by rid, so that the smallest node is the smallest rid
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        starts = np.concatenate([[0], np.cumsum([len(g) for g in given])])
        n, ends = np.zeros(len(rids), np.int64), []
        for x in range(len(sides)):
            for y in range(x, len(sides)):
                # a band with itself is one pair, so tiles of one side meet only there
                if sides[x]["crossed"] and sides[x]["number"] == sides[y]["number"]:
                    continue
                gap = np.maximum(np.maximum(boxes[x][0] - boxes[y][1], boxes[y][0] - boxes[x][1]), 0.0)
                if float(gap @ gap) > reach * reach:
                    continue
                # nodes of the two tiles, by rid
                nodes = np.unique(np.concatenate([place[starts[k] : starts[k + 1]] for k in {x, y}]))
                at = [np.searchsorted(nodes, place[starts[k] : starts[k + 1]]) for k in (x, y)]
                root = np.arange(len(nodes))
                for i, j in square_links(turned[x], turned[y], given[x], given[y], threshold, x == y):
                    i, j = at[0][i], at[1][j]
                    n[nodes] += np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
                    root = local_roots(len(nodes), np.concatenate([np.arange(len(nodes)), i]), np.concatenate([root, j]))
                moved = np.flatnonzero(root != np.arange(len(nodes)))
                ends.append((nodes[moved], nodes[root[moved]]))
        own = np.flatnonzero(n)
        root = local_roots(len(rids), *(np.concatenate([e[k] for e in ends]) for k in (0, 1))) if ends else np.arange(len(rids))
        return rids[order][own], n[own], rids[order][root[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sides in B.grouped(batches, "pair"):
            if not sides[0]["crossed"] or len({s["number"] for s in sides}) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(sides)], names=["rid", "n", "root"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each row of vectors."""
    spark = vectors.sparkSession
    B.tune(spark)
    base = durable(vectors.select(F.monotonically_increasing_id().alias("rid"), vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v")))
    sums = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not sums.n or not sums.width or sums.width < 1:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample, ok = unit_rows([r.v for r in base.where(F.size("v") > 0).orderBy(F.xxhash64("rid")).limit(SAMPLE).select("v").collect()], sums.width)
    sample = sample[ok]
    axes = axes_of(sample) if len(sample) else np.eye(sums.width)
    # wide bands send a vector to few pairs; as many bands as give every partition some pairs
    band = max(1, min(BAND, BAND_BYTES // (8 * sums.width), max(TILE, math.ceil(sums.n / (2 * math.sqrt(B.buckets(spark)))))))
    placed = base.select("rid", "v").mapInArrow(celled(axes, Cells(sample @ axes[:, :2], math.ceil(sums.n / band))), "cell int, place double, rid long, v binary")
    ddl = "cell int, part int, tile int, lo double, hi double, rids binary, v binary"
    tiles = durable(placed.repartition("cell").sortWithinPartitions("cell", "place", "rid").mapInArrow(packed_tiles(band), ddl))
    # the bands' ranges on the first axis: one row for each band
    metas = sorted((r.lo, r.hi, r.cell, r.part) for r in tiles.groupBy("cell", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    lows = np.array([m[0] for m in metas])
    # bands are in the order of their lower ends, and their upper ends are made to rise: band k meets k .. end - 1, and first .. k - 1 meet it
    ends = np.searchsorted(lows, np.maximum.accumulate(np.array([m[1] for m in metas])) + reach, side="right")
    firsts = np.searchsorted(ends, np.arange(len(metas)), side="right")
    ranges = spark.createDataFrame([(m[2], m[3], k, int(ends[k]), int(firsts[k])) for k, m in enumerate(metas)], "cell int, part int, number long, end long, first long")
    named = tiles.join(ranges, ["cell", "part"])
    payload = ["number", "tile", "rids", "v"]
    left = named.select(F.explode(F.sequence("number", F.col("end") - 1)).alias("other"), *payload).select(F.concat_ws("-", "number", "other").alias("pair"), (F.col("other") != F.col("number")).alias("crossed"), *payload)
    right = named.where("first < number").select(F.explode(F.sequence("first", F.col("number") - 1)).alias("other"), *payload).select(F.concat_ws("-", "other", "number").alias("pair"), F.lit(True).alias("crossed"), *payload)
    met = left.unionByName(right).repartition(max(B.buckets(spark), 2 * len(metas)), "pair").sortWithinPartitions("pair")
    links = durable(met.mapInArrow(compare(axes, threshold), "rid long, n long, root long"))
    roots = connected_components(links.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rid").agg(F.sum("n").alias("n_links"))
    # rid -> root of its component -> the component's smallest vec_id; rids without links are their own
    linked = base.select("rid", "vec_id").join(roots.withColumnRenamed("id", "rid"), "rid")
    smallest = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = linked.join(smallest, "root").join(counts, "rid").select("rid", "n_links", "component_id")
    rows = base.select("rid", "vec_id").join(known, "rid", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
