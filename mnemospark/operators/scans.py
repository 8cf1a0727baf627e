"""Bounded reads of memories and timeline: filters that reach the scan and top-k."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGES = ("user_message", "bot_response")


@dataclass(frozen=True)
class Context:
    """Who asks, and from where."""

    scope: str = "private"
    session_id: str | None = None
    platform: str | None = None
    user_id: str | None = None
    group_id: str | None = None
    bot_id: str | None = None
    strict_session: bool = False


def last_seen() -> Column:
    return F.coalesce("occurred_at", "updated_at", "created_at")


def candidates(memories: DataFrame, include_pending: bool = False) -> DataFrame:
    """Rows that may be found at all: not archived and, unless asked for, not pending; nulls pass."""
    rows = memories.where(~F.col("lifecycle").eqNullSafe("archived"))
    return rows if include_pending else rows.where(~F.col("review_status").eqNullSafe("pending"))


def top(df: DataFrame, limit: int, *order: Column, tie: str = "id") -> DataFrame:
    """The first ``limit`` rows; nulls last, ties by id."""
    return df.orderBy(*order, F.col(tie)).limit(limit)


def priority(memories: DataFrame, limit: int = 2000, include_pending: bool = False) -> DataFrame:
    return top(candidates(memories, include_pending), limit, F.col("importance").desc_nulls_last(), F.col("occurred_at").desc_nulls_last())


def current_window(memories: DataFrame, ctx: Context, limit: int = 600, include_pending: bool = False) -> DataFrame:
    """Rows of the asking session, its group, or the private user's pair; nothing without any of them."""
    tests = []
    if ctx.session_id:
        tests.append(F.col("session_id") == ctx.session_id)
    if ctx.scope == "group" and ctx.group_id:
        tests.append((F.col("scope") == "group") & (F.col("group_id") == ctx.group_id))
    if ctx.scope == "private" and ctx.user_id:
        tests.append((F.col("scope") == "private") & ((F.col("subject.id") == ctx.user_id) | (F.col("object.id") == ctx.user_id)))
    if not tests:
        return memories.limit(0)
    any_of = tests[0]
    for t in tests[1:]:
        any_of = any_of | t
    return top(candidates(memories, include_pending).where(any_of), limit, F.col("importance").desc_nulls_last(), last_seen().desc_nulls_last())


def time_window(memories: DataFrame, start: Column, end: Column, limit: int = 1600, include_pending: bool = False) -> DataFrame:
    """Rows with any of their times inside [start, end)."""
    within = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    rows = candidates(memories, include_pending).where(within("occurred_at") | within("created_at") | within("updated_at"))
    return top(rows, limit, F.col("importance").desc_nulls_last(), last_seen().desc_nulls_last())


def containing(memories: DataFrame, terms: list[str], limit: int = 1200, include_pending: bool = False) -> DataFrame:
    """Rows whose text or ids contain any of at most 24 terms, with a count of those found; rows with a session first."""
    wanted = [t.lower() for t in dict.fromkeys(terms) if t][:24]
    hay = F.lower(F.concat_ws(" ", "content", "evidence", F.concat_ws(" ", "tags"), "metadata", "subject.id", "subject.name", "object.id", "object.name", "session_id", "group_id"))
    hits = sum([hay.contains(t).cast("int") for t in wanted], F.lit(0))
    rows = candidates(memories, include_pending).withColumn("hits", hits).where("hits > 0")
    return top(rows, limit, F.col("session_id").isNull(), F.col("importance").desc_nulls_last())


def top_per_type(memories: DataFrame, per_type: int, hard_limit: int = 120) -> DataFrame:
    """The newest ``per_type`` rows of each memory type, then the newest over all."""
    order = Window.partitionBy("memory_type").orderBy(last_seen().desc_nulls_last(), F.col("importance").desc_nulls_last(), "id")
    rows = candidates(memories).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_type)
    return top(rows, hard_limit, last_seen().desc_nulls_last(), F.col("importance").desc_nulls_last())


def valid_at(at: Column, statuses: tuple[str, ...] = ("active",)) -> Column:
    """Status and validity interval [valid_from, valid_to) hold; a null bound is open."""
    return F.col("validity_status").isin(*statuses) & (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))


def as_of(memories: DataFrame, at: Column, statuses: tuple[str, ...] = ("active",), owner: str | None = None, limit: int | None = None) -> DataFrame:
    """The state of ``memories`` at an instant."""
    rows = memories.where(valid_at(at, statuses))
    if owner:
        rows = rows.where(F.col("owner_bot_id") == owner)
    return rows if limit is None else top(rows, limit, F.col("salience").desc_nulls_last(), F.col("importance").desc_nulls_last(), F.coalesce("valid_from", "occurred_at").desc_nulls_last())


def page(df: DataFrame, filters: dict[str, str | None], limit: int, after: tuple | None = None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Equality filters and keyset paging: the ``limit`` rows after the key ``after`` of the last page."""
    for column, value in filters.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    if after is not None:
        df = df.where(F.struct(*order) > F.struct(*[F.lit(v) for v in after]))
    return df.orderBy(*order).limit(limit)


def matching_page(memories: DataFrame, query: str = "", entity: str = "", filters: dict[str, str | None] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of memories, newest first: equality for each filter that is set, ``query`` contained in a text or id whatever its case, ``entity`` as subject, object or group."""
    for column, value in (filters or {}).items():
        if value:
            memories = memories.where(F.col(column) == value)
    if query:
        hay = [F.lower(F.coalesce(c, F.lit(""))).contains(query.lower()) for c in ("content", "evidence", "subject.id", "subject.name", "object.id", "object.name", "session_id", "group_id", "metadata")]
        memories = memories.where(reduce(lambda a, b: a | b, hay))
    if entity:
        memories = memories.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == entity, F.lit(False)) for c in ("subject.id", "object.id", "group_id")]))
    return memories.orderBy(F.col("created_at").desc_nulls_last(), "id").offset(offset).limit(limit)


def pending_rows(timeline: DataFrame, session_id: str, limit: int, after: tuple | None = None) -> DataFrame:
    """The first ``limit`` unsummarised messages of a session after a cursor (occurred_at, id), oldest first; rows without time are left out."""
    rows = timeline.where(F.col("summarized_at").isNull() & F.col("event_type").isin(*MESSAGES) & (F.col("session_id") == session_id) & F.col("occurred_at").isNotNull())
    if after is not None:
        rows = rows.where(F.struct("occurred_at", "id") > F.struct(F.lit(after[0]).cast("timestamp").alias("occurred_at"), F.lit(after[1]).alias("id")))
    return rows.orderBy("occurred_at", "id").limit(limit)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among ``ids``; AQE broadcasts a small id list."""
    return df.join(ids.select(F.col(key).alias("__id")).distinct(), F.col(key) == F.col("__id"), "left_semi")


def recent_timeline(timeline: DataFrame, limit: int, scope: str | None = None, session_id: str | None = None, entity_id: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The newest rows of a scope, session or entity, optionally inside [start, end)."""
    rows = timeline
    if scope:
        rows = rows.where(F.col("scope") == scope)
    if session_id:
        rows = rows.where(F.col("session_id") == session_id)
    if entity_id:
        rows = rows.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))
    if start is not None:
        rows = rows.where(F.col("occurred_at") >= start)
    if end is not None:
        rows = rows.where(F.col("occurred_at") < end)
    return top(rows, limit, F.col("occurred_at").desc_nulls_last(), F.col("created_at").desc_nulls_last())


def cross_window(timeline: DataFrame, source_scope: str, session_id: str, since: Column, limit: int = 240) -> DataFrame:
    """Messages of another scope and session since an instant."""
    rows = timeline.where((F.col("scope") == source_scope) & (F.col("session_id") != session_id) & F.col("event_type").isin(*MESSAGES) & (F.col("occurred_at") >= since))
    return top(rows, limit, F.col("occurred_at").desc_nulls_last())


def pending_windows(timeline: DataFrame) -> DataFrame:
    """Per session: unsummarised messages, the first and the last of them."""
    rows = timeline.where(F.col("summarized_at").isNull() & F.col("event_type").isin(*MESSAGES) & F.col("session_id").isNotNull())
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_pending"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def ready_windows(timeline: DataFrame, now: Column, enough: int = 12, some: int = 8, after_minutes: int = 60) -> DataFrame:
    """Sessions to summarise: enough messages pend, or some and the first is old enough."""
    old = F.col("first_at") <= now - F.expr(f"INTERVAL {after_minutes} MINUTES")
    return pending_windows(timeline).where((F.col("n_pending") >= enough) | ((F.col("n_pending") >= some) & old))


def without_vector(records: DataFrame, vectors: DataFrame, key: str = "id", hash_column: str = "text_hash") -> DataFrame:
    """Records that have no vector, or one made of another text."""
    held = vectors.select(F.col("memory_id").alias("__m"), F.col("text_hash").alias("__h"))
    joined = records.join(held, F.col(key) == F.col("__m"), "left")
    return joined.where(F.col("__h").isNull() | (F.col("__h") != F.col(hash_column))).withColumn("state", F.when(F.col("__h").isNull(), "missing").otherwise("stale")).drop("__m", "__h")
