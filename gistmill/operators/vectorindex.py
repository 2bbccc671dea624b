"""Vectors kept in cells, searched exactly without reading the cells that cannot matter.

Each vector lies in the cell of its nearest centre; a cell knows the largest distance of its vectors from the centre. No
vector of a cell is nearer to a query than the query's distance from the centre less that radius. A query reads cells in
the order of this bound: the first that hold enough vectors give a k-th distance, and only cells whose bound is not
beyond it are read besides. The result is that of a full scan; clustered vectors let most cells be passed over.

Centres come from a sample of at most SAMPLE vectors on the driver, and are at most CELLS; every vector is placed by a
task that holds the centres alone. Cells that hold very many vectors are written by several tasks. Vectors that are null,
of another length or not finite are in no cell, as they are at no distance from anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.operators import vectorsearch
from gistmill.session import stored

SAMPLE, CELLS, ROUNDS, SEED = 16_384, 1024, 8, 11
#: Rounding of distances on the way to a bound.
SLACK = 1e-6


def centres_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by a few rounds of means, each vector with its nearest one."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = nearest_centre(sample, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and its exact distance."""
    own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(1))


class VectorIndex:
    """Cells below a folder that all executors share: rows with all their columns, partitioned by cell, and a table of
    cells (cell, centre, radius, n)."""

    def __init__(self, spark: SparkSession, root: str, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        self.spark, self.root, self.id_col, self.vector_col = spark, root.rstrip("/"), id_col, vector_col

    def build(self, rows: DataFrame, dimension: int, cells: int | None = None) -> VectorIndex:
        """Writes all rows whose vector has that many finite components. cells: some hundred vectors each if not given."""
        v = F.col(self.vector_col)
        good = rows.where((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        sample = np.array([r[0] for r in good.orderBy(F.xxhash64(self.id_col)).select(v).limit(SAMPLE).collect()], float).reshape(-1, dimension)
        cells = cells or int(min(CELLS, max(1, np.sqrt(good.count()) / 4)))
        centres = centres_of(sample, cells) if len(sample) else np.zeros((1, dimension))
        at = rows.columns.index(self.vector_col)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)
                own, far = nearest_centre(x, centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(far)], names=[*batch.schema.names, "_cell", "_far"])

        placed = stored(good.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])))
        self.name = uuid.uuid4().hex
        salted = placed.repartition("_cell", F.pmod(F.xxhash64(self.id_col), F.lit(8)))
        salted.drop("_far").write.partitionBy("_cell").parquet(f"{self.root}/cells_{self.name}")
        radius = placed.groupBy(F.col("_cell").alias("cell")).agg(F.max("_far").alias("radius"), F.count("*").alias("n"))
        shape = self.spark.createDataFrame([(k, [float(y) for y in c]) for k, c in enumerate(centres)], "cell int, centre array<double>")
        shape.join(radius, "cell").coalesce(1).write.parquet(f"{self.root}/shape_{self.name}")  # at most CELLS rows
        self.shape = self.spark.read.parquet(f"{self.root}/shape_{self.name}").collect()
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/cells_{self.name}")

    def bounds(self, query: list[float]) -> list[tuple[float, int, int]]:
        """(least distance, cell, vectors), nearest first."""
        far = lambda c: float(np.sqrt(((np.array(query) - np.array(c.centre)) ** 2).sum())) - c.radius - SLACK
        return sorted((max(0.0, far(c)), c.cell, c.n) for c in self.shape)

    def within(self, cells: list[int]) -> DataFrame:
        """The rows of some cells: their folders alone are opened."""
        return self.rows().where(F.col("_cell").isin(cells)).drop("_cell")

    def nearest(self, query: list[float], limit: int = 20, where: Column | None = None) -> DataFrame:
        """The rows of vectorsearch.nearest() over all rows, with the distance; a filter applies before the cut."""
        order, first, held = self.bounds(query), [], 0
        while order and held < limit:
            _, cell, n = order[len(first)] if len(first) < len(order) else (0, 0, 0)
            if not n:
                break
            first.append(cell)
            held += n
        seen = vectorsearch.nearest(self.within(first), query, self.id_col, self.vector_col, limit, where).select("distance").collect()
        most = seen[-1].distance + SLACK if len(seen) == limit else float("inf")
        return vectorsearch.nearest(self.within([cell for least, cell, _ in order if least <= most]), query, self.id_col, self.vector_col, limit, where)
