"""Structured Streaming forms of what the batch operators do. Batch is the reference: a watermark drops late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gistmill.operators.sessions import GAP


def session_stream(events: DataFrame, ts: str = "ts", by: tuple[str, ...] = (), gap: str = GAP, delay: str = "10 minutes") -> DataFrame:
    """Sessions of a stream, each given out when the watermark passes its end."""
    at = F.col(ts).cast("timestamp")
    rows = events.withColumn("_at", at).withWatermark("_at", delay)
    return rows.groupBy(*by, F.session_window("_at", f"{gap} 1 microsecond").alias("w")).agg(F.min("_at").alias("started"), F.max("_at").alias("ended"), F.count("*").alias("n")).drop("w")


def hourly_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", delay: str = "10 minutes") -> DataFrame:
    at = F.col(ts).cast("timestamp")
    return events.withColumn("_at", at).withWatermark("_at", delay).groupBy(F.window("_at", "1 hour").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), by, "n")


def admitted_stream(events: DataFrame, by: str = "user_id", ts: str = "ts", key: str = "event_id", per_hour: int = 10) -> DataFrame:
    """(key, by, ts, admitted): a sliding hour for each visitor, whose state is at most per_hour timestamps."""
    part = events.select(F.col(key).cast("long").alias("event_id"), F.col(by).cast("long").alias("user_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def run(user: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["us", "event_id"], ignore_index=True)
        out = []
        for us in rows.us:
            taken = [x for x in taken if x > us - 3_600_000_000]
            out.append(len(taken) < per_hour)
            if out[-1]:
                taken.append(us)
        state.update((taken,))
        yield rows.assign(admitted=out)

    return part.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, us long, admitted boolean", "taken array<long>", "append", GroupStateTimeout.NoTimeout)


def incremental(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs apply on each new batch of files once and ends when there is nothing new (a re-import touches only changes)."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired(spaces: DataFrame, now: str, keep: timedelta = timedelta(hours=24)) -> DataFrame:
    """Spaces created longer ago than they are kept; an unreadable date counts as expired."""
    limit = F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(keep.total_seconds())} SECONDS")
    return spaces.where(F.coalesce(F.try_to_timestamp("created_at") <= limit, F.lit(True)))
