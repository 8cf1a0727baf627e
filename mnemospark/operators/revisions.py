"""Revisioned events: latest revision, deliveries, gaps and compare-and-set folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_revision(events: DataFrame, domain: list[str], revision: str = "revision") -> DataFrame:
    """The newest revision of each identity; one aggregate, no self-join."""
    newest = F.max_by(F.struct(*[c for c in events.columns if c not in domain]), F.col(revision)).alias("__e")
    return events.groupBy(*domain).agg(newest).select(*domain, "__e.*")


def undelivered(events: DataFrame, acks: DataFrame, consumer: str, after: tuple | None, limit: int, order: list[str]) -> DataFrame:
    """The next ``limit`` events that ``consumer`` hasn't acknowledged, after a keyset cursor."""
    mine = acks.where(F.col("consumer_id") == consumer).select(F.col("event_id").alias("__e"), F.col("revision").alias("__r"))
    left = events.join(mine, (F.col("event_id") == F.col("__e")) & (F.col("revision") == F.col("__r")), "left_anti")
    if after is not None:
        cursor = [(a if isinstance(a, Column) else F.lit(a)).cast(left.schema[c].dataType).alias(c) for a, c in zip(after, order, strict=True)]
        left = left.where(F.struct(*order) > F.struct(*cursor))
    return left.orderBy(*order).limit(limit)


def gaps(revisions: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    """(key, after, before) where revisions of a key don't follow one another."""
    before = F.lag(revision).over(Window.partitionBy(key).orderBy(revision))
    rows = revisions.select(key, revision).distinct().withColumn("after", before)
    return rows.where(F.col(revision) > F.col("after") + 1).select(key, "after", F.col(revision).alias("before"))


def compare_and_set(changes: DataFrame, key: str, at: str = "at") -> DataFrame:
    """(key, revision, applied, deleted) after changes in order; each must carry the current revision + 1, a tombstone is final.

    ``changes``: key, at, event_id, revision, tombstone; an event id counts
    once. What a change does depends on all before it, so a key's changes are
    gone through in order; they stream by in batches, and only the state of the
    current key is held.
    """
    once = changes.groupBy(key, "event_id").agg(F.min(F.struct(at, "revision", "tombstone")).alias("c")).select(key, F.col(f"c.{at}").alias("at"), "event_id", F.col("c.revision").alias("revision"), F.col("c.tombstone").alias("tombstone"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for part in parts:
            out = []
            for k, revision, dead in zip(part[key], part["revision"], part["tombstone"], strict=True):
                if state is None or k != held:
                    if state is not None:
                        out.append((held, *state))
                    held, state = k, (0, 0, False)
                if not state[2] and revision == state[0] + 1:
                    state = (int(revision), state[1] + 1, bool(dead))
            yield pd.DataFrame(out, columns=[key, "revision", "applied", "deleted"])
        if state is not None:
            yield pd.DataFrame([(held, *state)], columns=[key, "revision", "applied", "deleted"])

    kind = changes.schema[key].dataType.simpleString()
    ordered = once.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, "at", "event_id").select(key, "revision", F.coalesce("tombstone", F.lit(False)).alias("tombstone"))
    return ordered.mapInPandas(run, f"{key} {kind}, revision bigint, applied bigint, deleted boolean")
