"""Cells against a full scan, and how much of clustered vectors is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmill.operators import vectorsearch
from gistmill.operators.vectorindex import VectorIndex


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 10
    made = [(k, (centres[k % 12] + rng.normal(size=8)).tolist(), k % 5) for k in range(900)]
    odd = [(900, None, 0), (901, [1.0], 0), (902, [float("nan")] * 8, 0), (903, made[0][1], 0), (904, [float("inf")] * 8, 1), (905, [1.0] * 7 + [None], 1)]
    return spark.createDataFrame(made + odd, "vec_id long, embedding array<double>, label long")


def test_cells_give_the_full_scan(spark, rows, tmp_path):
    index = VectorIndex(spark, str(tmp_path)).build(rows, 8, 20)
    good = rows.where("vec_id < 900 OR vec_id = 903")
    assert index.rows().count() == 901
    for k, limit, where in ((0, 1, None), (7, 25, None), (13, 200, F.col("label") == 2), (5, 2000, None)):
        q = rows.where(F.col("vec_id") == k).first().embedding if k else [0.0] * 8
        got = [(r.vec_id, r.distance) for r in index.nearest(q, limit, where).collect()]
        assert got == [(r.vec_id, r.distance) for r in vectorsearch.nearest(good, q, limit=limit, where=where).collect()]


def test_far_cells_are_not_read(spark, rows, tmp_path):
    index = VectorIndex(spark, str(tmp_path)).build(rows, 8, 12)
    q = rows.where("vec_id = 0").first().embedding
    plan = index.nearest(q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    near = sum(n for least, _, n in index.bounds(q) if least <= 6)
    assert near < 300


def test_an_empty_table(spark, rows, tmp_path):
    index = VectorIndex(spark, str(tmp_path)).build(rows.where("vec_id = 900"), 8)
    assert index.shape == []
