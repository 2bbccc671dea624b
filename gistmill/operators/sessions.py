"""Sessions, runs and limits over ordered events, in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gistmill.session import durable

GAP = "30 minutes"
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
#: Spans that one window puts in order.
BLOCK = 4096


def gap_micros(gap: str) -> int:
    n, unit = gap.split()
    return int(n) * SECONDS[unit.rstrip("s")] * 1_000_000


def span(micros: Column, gap: int) -> Column:
    """Where the span of `gap` microseconds begins that a time lies in. Two times of one span are less than the gap apart."""
    return micros - F.pmod(micros, F.lit(gap))


def stretches(spans: DataFrame, by: list[str], gap: int) -> DataFrame:
    """spans (by, k, low, high), one row for each k = span(...) of a key with its least and greatest time, and `first`:
    the k at which the session opens that the span lies in.

    A window puts the spans of a block of time in order, and one more the blocks of a key: 85 days each for a gap of half
    an hour. So what a task sorts grows with the time that the events cover, not with their number.
    """
    rows = durable(spans.withColumn("_b", span(F.col("k"), gap * BLOCK)))
    inside = W.partitionBy(*by, "_b").orderBy("k")
    near = F.coalesce(F.col("low") - F.lag("high").over(inside) <= gap, F.lit(False))
    rows = rows.withColumn("_own", F.last(F.when(~near, F.col("k")), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    blocks = rows.groupBy(*by, "_b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("_own").alias("_head"), F.max("_own").alias("_tail"))
    w = W.partitionBy(*by).orderBy("_b")
    blocks = blocks.withColumn("_near", F.coalesce(F.col("low") - F.lag("high").over(w) <= gap, F.lit(False)))
    # the session at a block's end is its own, unless the block is one stretch that goes on from the block before
    blocks = blocks.withColumn("_end", F.last(F.when(~F.col("_near") | (F.col("_head") != F.col("_tail")), F.col("_tail")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    blocks = blocks.withColumn("_from", F.when(F.col("_near"), F.lag("_end").over(w))).select(*by, "_b", "_head", "_from")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*by, "_b"]]
    met = rows.alias("x").join(blocks.alias("y"), same).select(*[F.col(f"x.{c}") for c in spans.columns], "_own", "_head", "_from")
    return met.withColumn("first", F.when(F.col("_own") == F.col("_head"), F.coalesce("_from", "_own")).otherwise(F.col("_own"))).drop("_own", "_head", "_from")


def sessions(events: DataFrame, ts: str = "ts", by: tuple[str, ...] = (), gap: str = GAP) -> DataFrame:
    """One row a session: start, end, n. A gap of exactly the limit stays inside; only a longer one opens a session.

    Events are counted by spans of time as long as the gap, which lie in one session each, with partial sums; then spans
    are put together. So neither the whole stream nor one hot key is sorted in a single task.
    """
    micros, wide = F.unix_micros(F.col(ts).cast("timestamp")), gap_micros(gap)
    spans = events.where(micros.isNotNull()).groupBy(*by, span(micros, wide).alias("k")).agg(F.min(micros).alias("low"), F.max(micros).alias("high"), F.count("*").alias("n"))
    whole = stretches(spans, list(by), wide).groupBy(*by, "first").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    return whole.select(*by, F.timestamp_micros("low").alias("started"), F.timestamp_micros("high").alias("ended"), "n")


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with `run`: the number of the stretch of equal values it lies in, from 1."""
    w = W.partitionBy(*by).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    return rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_c")


def rolling_count(events: DataFrame, by: str, ts: str = "ts", seconds: int = 3600) -> DataFrame:
    """events with `recent`: how many of the key lie in the window before it, itself included; the far end is open."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(by).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("_us", micros).withColumn("recent", F.count("*").over(w)).drop("_us")


def admitted(events: DataFrame, by: str = "user_id", ts: str = "ts", key: str = "event_id", per_hour: int = 10) -> DataFrame:
    """(key, by, ts, admitted): each key's requests against a sliding hour in which refused ones do not count. A fold for each key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([ts, key], ignore_index=True)
        taken: list = []
        low = 0
        out = []
        for at in rows[ts]:
            while low < len(taken) and taken[low] <= at - pd.Timedelta(hours=1):
                low += 1
            ok = len(taken) - low < per_hour
            if ok:
                taken.append(at)
            out.append(ok)
        return rows.assign(admitted=out)

    part = events.select(key, by, ts)
    from pyspark.sql.types import BooleanType, StructField, StructType

    return part.groupBy(by).applyInPandas(run, StructType([*part.schema.fields, StructField("admitted", BooleanType())]))


def day_limit(requests: DataFrame, ts: str = "ts", key: str = "event_id", per_day: int = 300) -> DataFrame:
    """requests with `in_day`: whether it is among the first per_day of its UTC day."""
    w = W.partitionBy(F.to_date(ts)).orderBy(ts, key)
    return requests.withColumn("in_day", F.row_number().over(w) <= per_day)
