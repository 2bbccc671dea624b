"""Numbers of rows in one order over all of them, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.session import stored


def numbered(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows with their number from 1 by the order, as a long. Rows are sorted by ranges; a piece begins where the pieces
    before it end, and the pieces are as many as the shuffle has partitions."""
    lying = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    piece = F.shiftright("_at", 33)
    pieces = lying.groupBy(piece.alias("_piece")).agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_piece", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start") + 1).alias("_shift"))  # a row for each partition
    return lying.join(F.broadcast(pieces), piece == F.col("_piece")).withColumn(name, (F.col("_at") + F.col("_shift")).cast("long")).drop("_at", "_piece", "_shift")
