"""Activity sessions: runs of one actor's events without a pause above a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_MINUTES = 120


def activity_sessions(df: DataFrame, keys: list[str], time: str, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Sessions of each ``keys`` value: keys, session_no, start_us, end_us, duration_us, n_events.

    A pause of more than ``gap_minutes`` begins a new session; a single event
    is a session of duration 0. Rows with a null key or time are ignored; ties
    and repeated rows count as events; an empty table gives no rows. Only the
    keys and ``time`` are read, so any other columns, whatever their names, do
    no harm.

    Two events in one time block of the gap's length can never be separated,
    so blocks are aggregated first (map-side, whatever the skew of the keys);
    lag and the running sum of break flags then see one row per key and block.
    That bounds the window of the hottest key by the time span covered and not
    by its events.
    """
    gap_us = gap_minutes * 60_000_000
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.unix_micros(F.col(time)).alias("__us")).dropna()
    blocks = rows.groupBy(*names, F.floor(F.col("__us") / F.lit(gap_us)).alias("__block")).agg(
        F.min("__us").alias("__lo"), F.max("__us").alias("__hi"), F.count(F.lit(1)).alias("__n")
    )
    order = Window.partitionBy(*names).orderBy("__block")
    flagged = blocks.withColumn("__new", F.coalesce((F.col("__lo") - F.lag("__hi").over(order) > gap_us).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("session_no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*names, "session_no").agg(F.min("__lo").alias("start_us"), F.max("__hi").alias("end_us"), F.sum("__n").alias("n_events"))
    return out.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], "session_no", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events"
    )
