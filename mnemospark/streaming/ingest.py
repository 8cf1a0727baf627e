"""Structured Streaming twins: deduplicated ingest, session windows, latest revisions and threshold triggers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merging import upsert
from ..sources.tables import VersionedTable


def deduplicated(events: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once while its copies arrive within ``delay``; rows with a null key all pass."""
    keyed = events.withWatermark(time, delay)
    whole = F.concat_ws("\x1f", *[F.coalesce(k, F.lit("\x00")) for k in keys])
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return keyed.withColumn("__key", F.when(missing, F.uuid()).otherwise(whole)).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def sessions(events: DataFrame, keys: list[str], time: str, gap: str = "120 minutes", delay: str = "10 minutes") -> DataFrame:
    """Session windows per key, given out once the watermark has passed them."""
    grouped = events.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.max(time).alias("last_at")).select(*keys, F.col("w.start").alias("start_at"), "last_at", "n_events")


def triggered(events: DataFrame, key: str, enough: int = 12) -> DataFrame:
    """(key, n) whenever ``enough`` events of a key have come in; the rest is kept for later batches.

    Windows that are due because they are old are found by the batch read
    ``scans.ready_windows``, which needs no timer per key.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = (state.get[0] if state.exists else 0) + sum(len(p) for p in parts)
        full, rest = divmod(held, enough)
        state.update((rest,))
        if full:
            yield pd.DataFrame({key: [k[0]] * full, "n": [enough] * full})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)


def accumulated(events: DataFrame, key: str, amount: str, low: float, high: float) -> DataFrame:
    """(key, level) after each batch: a running sum held to [low, high]."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else 0.0
        for part in parts:
            for x in part[amount]:
                level = min(high, max(low, level + float(x)))
        state.update((level,))
        yield pd.DataFrame({key: [k[0]], "level": [level]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, amount).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, level double", "level double", "update", GroupStateTimeout.NoTimeout)


def upsert_into(table: VersionedTable, keys: list[str], order: str):
    """A foreachBatch sink that merges each batch by key; a batch written again changes nothing further."""

    def sink(batch: DataFrame, _: int) -> None:
        if table.revision:
            table.upsert(batch, keys, order)
        else:
            table.write(upsert(batch.limit(0), batch, keys, order))

    return sink
