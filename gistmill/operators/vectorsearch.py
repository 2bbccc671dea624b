"""Exact nearest neighbours by Euclidean distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import vectors as V

OVERFETCH = 4


def nearest(rows: DataFrame, query: list[float], id_col: str = "vec_id", vector_col: str = "embedding", limit: int = 20, where: Column | None = None, compat: bool = False) -> DataFrame:
    """The nearest rows, nearest first, with their distance. A filter applies before the cut, so a full limit is found.

    compat: cut to limit * 4 first and filter then, which may find fewer.
    """
    if not query:
        raise ValueError("an empty query vector")
    found = rows.withColumn("distance", V.l2(F.col(vector_col), V.literal(query)))
    order = ["distance", id_col]
    if where is None:
        return found.orderBy(*order).limit(limit)
    if compat:
        return found.orderBy(*order).limit(limit * OVERFETCH).where(where).orderBy(*order).limit(limit)
    return found.where(where).orderBy(*order).limit(limit)


def check_dimension(rows: DataFrame, dimension: int, vector_col: str = "embedding") -> DataFrame:
    """rows; reading one of another or no length raises."""
    right = F.coalesce(F.size(vector_col) == dimension, F.lit(False))
    return rows.where(F.coalesce(F.assert_true(right, F.lit(f"a vector is not of {dimension} components")).cast("string"), F.lit("")) == "")


def reciprocal_ranks(lists: list[DataFrame], key: str, k: int = 60, limit: int | None = None) -> DataFrame:
    """Fusion of ranked lists (key, rank): the sum of 1 / (k + rank); ties by the first list that has the key, then rank."""
    every = [x.select(key, F.lit(n).alias("list_no"), F.col("rank")) for n, x in enumerate(lists)]
    rows = every[0]
    for x in every[1:]:
        rows = rows.unionByName(x)
    first = F.min(F.struct("list_no", "rank"))
    flags = [F.max((F.col("list_no") == n).cast("boolean")).alias(f"in_{n}") for n in range(len(lists))]
    fused = rows.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), first.alias("first"), *flags)
    fused = fused.orderBy(F.col("score").desc(), "first.list_no", "first.rank", key)
    return fused.limit(limit) if limit else fused
