"""Writing and listing records: each write is a frame in, a frame out, over the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Reviews that accept a record.
ACCEPTED = ("approve", "approved", "auto")
# What one injection adds to what recalls hold of a record, the class of timeline rows that are kept for good, and the class of those imported.
REINFORCEMENT, KEPT_FOR_GOOD = 0.025, "historical_archive"
# Seconds of the first pause after a failure, the most doublings, and what a longer pause is cut to.
RETRY_SECONDS, RETRY_DOUBLINGS, RETRY_MOST = 60, 8, 1800


def newest(df: DataFrame, by: str, limit: int, offset: int = 0, filters: dict[str, str | None] | None = None, either: tuple[tuple[str, ...], str] | None = None, tie: str = "id") -> DataFrame:
    """A page of the rows that pass, newest first, nulls last, ties by ``tie``: equality for each filter that is set, and one of some columns equal to a value."""
    for column, value in (filters or {}).items():
        if value:
            df = df.where(F.col(column) == value)
    if either and either[1]:
        test = F.lit(False)
        for column in either[0]:
            test = test | F.coalesce(F.col(column) == either[1], F.lit(False))
        df = df.where(test)
    return df.orderBy(F.col(by).desc_nulls_last(), tie).offset(offset).limit(limit)


def recent_memories(memories: DataFrame, limit: int, include_pending: bool = False) -> DataFrame:
    rows = memories if include_pending else memories.where(~F.col("review_status").eqNullSafe("pending"))
    return newest(rows, "created_at", limit)


def decay_pool(memories: DataFrame, limit: int) -> DataFrame:
    """Stable records that are not pending, oldest first."""
    rows = memories.where((F.col("lifecycle") == "stable_memory") & ~F.col("review_status").eqNullSafe("pending"))
    return rows.orderBy(F.coalesce("occurred_at", "created_at").asc_nulls_first(), F.col("created_at").asc_nulls_first(), "id").limit(limit)


def of_import(memories: DataFrame, batch: str) -> DataFrame:
    """Records of one import that are not archived, with place: the most important first, then the oldest."""
    rows = memories.where((F.col("import_batch_id") == batch) & ~F.col("lifecycle").eqNullSafe("archived"))
    order = Window.partitionBy("import_batch_id").orderBy(F.col("importance").desc_nulls_last(), F.coalesce("occurred_at", "created_at").asc_nulls_first(), "id")
    return rows.withColumn("place", F.row_number().over(order))


def import_counts(memories: DataFrame) -> DataFrame:
    """Per import its records by type, and all of them with a null type; one pass."""
    rows = memories.where("import_batch_id is not null")
    return rows.groupingSets([["import_batch_id", "memory_type"], ["import_batch_id"]], "import_batch_id", "memory_type").agg(F.count(F.lit(1)).alias("n"), (F.grouping("memory_type") == 1).alias("total")).select("import_batch_id", "memory_type", "n", "total")


def lacking_vectors(memories: DataFrame, vectors: DataFrame, provider: str, include_pending: bool = False) -> DataFrame:
    """Imported records without a vector of ``provider``, or with one that names no text."""
    rows = memories.where(F.col("import_batch_id").isNotNull() & ~F.col("lifecycle").eqNullSafe("archived"))
    if not include_pending:
        rows = rows.where(~F.col("review_status").eqNullSafe("pending"))
    held = vectors.where((F.col("provider_id") == provider) & (F.coalesce("text_hash", F.lit("")) != "")).select(F.col("memory_id").alias("__m"))
    return rows.join(held, F.col("id") == F.col("__m"), "left_anti")


def import_status(batches: DataFrame, messages: DataFrame, memories: DataFrame) -> DataFrame:
    """Imports, newest first, each with its messages and records; counts are aggregated before the join."""
    count = lambda df, name: df.where("import_batch_id is not null").groupBy(F.col("import_batch_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    out = batches.join(count(messages, "n_messages"), "id", "left").join(count(memories, "n_memories"), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_messages", "n_memories")})


def archive(memories: DataFrame, ids: DataFrame, reason: str, now: Column, supersedes: str = "") -> DataFrame:
    """``memories`` with those among ``ids`` archived, and why and when written to their metadata; archived ones stay as they are."""
    gone = ids.select(F.col("id").alias("__id")).distinct()
    rows = memories.join(gone, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull() & ~F.col("lifecycle").eqNullSafe("archived")
    why = F.to_json(F.struct(F.lit(reason).alias("reason"), F.lit(supersedes).alias("supersedes_id"), F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("archived_at")))
    kept = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    told = F.to_json(F.map_concat(F.map_filter(kept, lambda k, _: k != "decay_archived"), F.create_map(F.lit("decay_archived"), why)))
    change = {"lifecycle": F.lit("archived"), "validity_status": F.lit("archived"), "supersedes_id": F.lit(supersedes), "metadata": told, "updated_at": now}
    return rows.withColumn("__hit", hit).withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in change.items()}).drop("__id", "__hit")


def review(memories: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """``memories`` after ``decisions`` (id, status): accepted ones are stable and active, all others archived; the last decision in order of ``at`` counts."""
    last = decisions.groupBy(F.col("id").alias("__id")).agg(F.max_by("status", F.struct("at", "status")).alias("__status"))
    accepted = F.lower(F.trim("__status")).isin(*ACCEPTED)
    rows = memories.join(last, F.col("id") == F.col("__id"), "left").withColumns({"__hit": F.col("__id").isNotNull(), "__ok": F.coalesce(accepted, F.lit(False))})
    pick = lambda yes, no: F.when(F.col("__ok"), yes).otherwise(no)
    change = {"review_status": pick("auto", "rejected"), "lifecycle": pick("stable_memory", "archived"), "validity_status": pick("active", "archived"), "updated_at": now}
    return rows.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in change.items()}).drop("__id", "__status", "__hit", "__ok")


def set_lifecycle(memories: DataFrame, where: Column, lifecycle: str, now: Column) -> DataFrame:
    """``memories`` with another lifecycle, and the validity that goes with it, where a condition holds."""
    hit = F.coalesce(where, F.lit(False))
    change = {"lifecycle": F.lit(lifecycle), "validity_status": F.lit("archived" if lifecycle == "archived" else "active"), "updated_at": now}
    return memories.withColumn("__hit", hit).withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in change.items()}).drop("__hit")


def mark_used(memories: DataFrame, uses: DataFrame) -> DataFrame:
    """``memories`` after ``uses`` (id, at, injected): each access counts once, each injection raises what recalls hold by ``REINFORCEMENT``, up to 1."""
    per = uses.groupBy(F.col("id").alias("__id")).agg(
        F.count_if(~F.col("injected")).alias("__n"), F.max(F.when(~F.col("injected"), F.col("at"))).alias("__at"), F.count_if(F.col("injected")).alias("__m"), F.max(F.when(F.col("injected"), F.col("at"))).alias("__in")
    )
    rows = memories.join(per, F.col("id") == F.col("__id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.withColumns({
        "access_count": zero("access_count") + zero("__n"), "last_accessed_at": F.coalesce("__at", "last_accessed_at"), "injection_count": zero("injection_count") + zero("__m"), "last_injected_at": F.coalesce("__in", "last_injected_at"),
        "reinforcement_score": F.when(zero("__m") > 0, F.least(F.lit(1.0), F.coalesce("reinforcement_score", F.lit(0.0)) + REINFORCEMENT * F.col("__m"))).otherwise(F.col("reinforcement_score")),
    }).drop("__id", "__n", "__at", "__m", "__in")


def prunable(timeline: DataFrame, before: Column, limit: int | None = None) -> DataFrame:
    """Ids of summarised timeline rows before an instant that aren't kept for good, oldest first."""
    seen = F.coalesce("occurred_at", "created_at")
    rows = timeline.where(F.col("summarized_at").isNotNull() & ~F.col("retention_class").eqNullSafe(KEPT_FOR_GOOD) & (seen < before)).select("id", seen.alias("seen"))
    return rows if limit is None else rows.orderBy("seen", "id").limit(limit)


def mark_summarised(timeline: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """``timeline`` with the rows among ``ids`` summarised now."""
    done = ids.select(F.col("id").alias("__id")).distinct()
    return timeline.join(done, F.col("id") == F.col("__id"), "left").withColumn("summarized_at", F.when(F.col("__id").isNotNull(), now).otherwise(F.col("summarized_at"))).drop("__id")


def event_key(event_type: Column, session: Column, subject: Column, message: Column) -> Column:
    """The key under which a delivered message counts once; '' for one without message id."""
    filled = lambda c, n: F.coalesce(X.clean_text(c, n), F.lit(""))
    key = X.stable_fingerprint(F.lit("timeline"), filled(event_type, 80), filled(session, 200), filled(subject, 120), filled(message, 120))
    return F.when(filled(message, 120) == "", F.lit("")).otherwise(key)


def ingest(timeline: DataFrame, arriving: DataFrame) -> DataFrame:
    """(id, stored_id, fresh) of each arriving event: the row that holds it, and whether it was added.

    Events without message id are always added. Of the others the first under
    one key is, unless ``timeline`` (id, key) holds that key already; the rest
    are told the row that does. ``arriving``: id, key, at. Keys are compared
    after a map-side minimum, so a message sent very often is one row.
    """
    held = timeline.where("key <> ''").groupBy("key").agg(F.min("id").alias("held"))
    first = arriving.where("key <> ''").groupBy("key").agg(F.min(F.struct("at", "id")).alias("f"))
    owner = first.join(held, "key", "left").select(F.col("key").alias("__key"), F.coalesce("held", "f.id").alias("owner"), F.col("held").isNull().alias("open"))
    rows = arriving.join(owner, F.col("key") == F.col("__key"), "left")
    return rows.select("id", F.coalesce("owner", "id").alias("stored_id"), (F.col("owner").isNull() | (F.col("open") & (F.col("owner") == F.col("id")))).alias("fresh"))


def failures(log: DataFrame) -> DataFrame:
    """Per session of a log of failures (session_id, at, id, error): how many, the last error, and the seconds to wait after it, doubled each time."""
    last = F.struct("at", "id")
    out = log.groupBy("session_id").agg(F.count(F.lit(1)).alias("retry_count"), F.max_by("error", last).alias("last_error"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    pause = F.least(F.lit(float(RETRY_MOST)), RETRY_SECONDS * F.pow(F.lit(2.0), F.least(F.lit(RETRY_DOUBLINGS), F.col("retry_count") - 1).cast("double")))
    return out.withColumn("wait_seconds", pause.cast("bigint"))


def append_revisions(events: DataFrame, arriving: DataFrame, domain: list[str]) -> DataFrame:
    """(event_id, revision, result) of each arriving revision: 'added', 'duplicate', or 'conflict' where its event id belongs to another domain.

    An event id is bound to the domain that it came with first: in ``events``,
    or else at the earliest ``at``.
    """
    whole = F.struct(*[F.col(c) for c in domain])
    bound = events.select("event_id", F.lit(0).alias("late"), F.lit(None).cast("timestamp").alias("at"), "revision", whole.alias("d")).unionByName(arriving.select("event_id", F.lit(1).alias("late"), "at", "revision", whole.alias("d")))
    owner = bound.groupBy("event_id").agg(F.min(F.struct("late", "at", "revision", "d")).alias("o")).select(F.col("event_id").alias("__e"), F.col("o.d").alias("__d"))
    held = events.select(F.col("event_id").alias("__he"), F.col("revision").alias("__hr")).distinct()
    rows = arriving.join(owner, F.col("event_id") == F.col("__e")).join(held, (F.col("event_id") == F.col("__he")) & (F.col("revision") == F.col("__hr")), "left")
    nth = F.row_number().over(Window.partitionBy("event_id", "revision").orderBy((~F.col("__d").eqNullSafe(whole)), "at"))
    clash = ~F.col("__d").eqNullSafe(whole)
    result = F.when(clash, "conflict").when(F.col("__he").isNotNull() | (F.col("nth") > 1), "duplicate").otherwise("added")
    return rows.withColumn("nth", nth).select("event_id", "revision", result.alias("result"))


def acknowledge(deliveries: DataFrame, acks: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """``deliveries`` (event_id, revision, consumer_id, acked_at) with those acknowledged that are open and whose event has not expired; an earlier acknowledgement stands."""
    alive = events.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(F.col("event_id").alias("__e"), F.col("revision").alias("__r"))
    given = acks.select(F.col("event_id").alias("__e"), F.col("revision").alias("__r"), F.col("consumer_id").alias("__c")).distinct().join(alive, ["__e", "__r"], "left_semi")
    rows = deliveries.join(given, (F.col("event_id") == F.col("__e")) & (F.col("revision") == F.col("__r")) & (F.col("consumer_id") == F.col("__c")), "left")
    return rows.withColumn("acked_at", F.when(F.col("acked_at").isNull() & F.col("__e").isNotNull(), now).otherwise(F.col("acked_at"))).drop("__e", "__r", "__c")


def trace(events: DataFrame, deliveries: DataFrame, trace_id: str, limit: int = 100) -> DataFrame:
    """The revisions of a trace in order, each with how many consumers it went to and how many of them acknowledged it."""
    rows = events.where(F.col("trace_id") == trace_id).orderBy("revision", "event_id").limit(limit)
    per = deliveries.groupBy(F.col("event_id").alias("__e"), F.col("revision").alias("__r")).agg(F.count(F.lit(1)).alias("n_delivered"), F.count("acked_at").alias("n_acked"))
    return rows.join(per, (F.col("event_id") == F.col("__e")) & (F.col("revision") == F.col("__r")), "left").drop("__e", "__r").fillna(0, ["n_delivered", "n_acked"])


def erase_namespace(records: DataFrame, where: Column) -> DataFrame:
    """Namespaced ``records`` with those that a condition hits made tombstones: a revision further, payload erased. Tombstones stay as they are, whatever comes."""
    hit = F.coalesce(where, F.lit(False)) & ~F.col("deleted")
    rows = records.withColumn("__hit", hit)
    return rows.withColumns({"revision": F.col("revision") + F.col("__hit").cast("bigint"), "payload": F.when(F.col("__hit") | F.col("deleted"), F.lit("{}")).otherwise(F.col("payload")), "deleted": F.col("deleted") | F.col("__hit")}).drop("__hit")


def live_records(records: DataFrame, namespace: str, kind: str, limit: int = 100) -> DataFrame:
    """The records of a namespace and kind that aren't deleted, in order of revision."""
    return records.where((F.col("namespace") == namespace) & (F.col("record_kind") == kind) & ~F.col("deleted")).orderBy("revision", "record_id").limit(limit)


# What a record's salience, importance and confidence are where nothing is given.
DEFAULT_SALIENCE, DEFAULT_IMPORTANCE, DEFAULT_CONFIDENCE = 0.3, 0.3, 0.5
# Durabilities that a mode of decay in the metadata stands for.
MODE_DURABILITY = {"no_decay": "pinned", "scar_slow_decay": "durable", "creative_milestone": "durable", "slow_decay": "durable", "summary_decay": "short"}


def normalise(memories: DataFrame, now: Column) -> DataFrame:
    """``memories`` as they are stored: times, texts, scores, states and tags filled in, cleaned and held to their ranges.

    What a column lacks, or holds as its default, is taken from the metadata if
    they have it, then from other columns: a salience from the importance, a
    durability from the mode of decay and then from the type, an archived
    validity from the lifecycle. Texts lose secrets and are cut to 4,000
    characters, as the store does. Other columns stay as they are.
    """
    meta = lambda name: F.nullif(F.get_json_object("metadata", f"$.{name}"), F.lit(""))
    number = lambda name: meta(name).try_cast("double")
    score = lambda c, default: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, default)))
    low = lambda c, n: F.lower(X.clean_text(c, n))
    importance = score(F.col("importance"), F.lit(DEFAULT_IMPORTANCE))
    validity = F.coalesce(F.nullif(F.col("validity_status"), F.lit("")), F.lit("active"))
    validity = F.when(validity == "active", F.coalesce(meta("validity_status"), validity)).otherwise(validity)
    validity = F.when(F.col("lifecycle").eqNullSafe("archived") & (validity == "active"), "archived").otherwise(validity)
    held = F.coalesce(F.nullif(low(F.col("durability"), 24), F.lit("")), F.lit("normal"))
    mode = reduce(lambda c, e: c.when(low(meta("decay_mode"), 40) == e[0], e[1]), MODE_DURABILITY.items(), F.when(F.lit(False), F.lit(""))).otherwise("normal")
    told = low(meta("durability"), 24)
    older = F.when(told.isin(*X.DURABILITY_DAYS), told).when(told != "", "normal").otherwise(mode)
    durability = F.when(held != "normal", held).when(older != "normal", older).otherwise(X.durability_of_type(F.col("memory_type"), F.lit("normal")))
    secrecy = F.coalesce(F.nullif(F.col("sensitivity"), F.lit("")), F.lit("private"))
    salience = F.when(F.coalesce("salience", F.lit(DEFAULT_SALIENCE)) == DEFAULT_SALIENCE, F.coalesce(number("salience"), importance)).otherwise(F.col("salience"))
    created = F.coalesce("created_at", now)
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: X.clean_text(t, 80)), lambda t: t != "")
    return memories.withColumns({
        "created_at": created, "updated_at": F.coalesce("updated_at", created), "occurred_at": F.coalesce("occurred_at", created), "content": X.clean_text(X.redact_secrets(F.col("content")), 4000), "evidence": X.clean_text(X.redact_secrets(F.col("evidence")), 4000),
        "confidence": score(F.col("confidence"), F.lit(DEFAULT_CONFIDENCE)), "importance": importance, "owner_bot_id": X.clean_text(F.coalesce(F.nullif(F.col("owner_bot_id"), F.lit("")), meta("owner_bot_id")), 120), "validity_status": X.validity_status(validity),
        "salience": score(salience, importance), "durability": F.when(durability.isin(*X.DURABILITY_DAYS), durability).otherwise("normal"), "sensitivity": X.sensitivity(F.when(secrecy == "private", F.coalesce(meta("sensitivity"), secrecy)).otherwise(secrecy)),
        "reinforcement_score": score(F.when(F.coalesce("reinforcement_score", F.lit(0.0)) == 0.0, F.coalesce(number("reinforcement_score"), F.lit(0.0))).otherwise(F.col("reinforcement_score")), F.lit(0.0)), "tags": tags,
        "merged_count": F.greatest(F.lit(1), F.coalesce("merged_count", F.lit(1))).cast(memories.schema["merged_count"].dataType),
    })


def session_context(rows: DataFrame) -> DataFrame:
    """``rows`` (session_id, scope, platform, user_id, group_id) with what the session key tells filled in where a column lacks it."""
    clean = {c: X.clean_text(F.col(c), n) for c, n in (("session_id", 200), ("scope", 40), ("platform", 80), ("user_id", 120), ("group_id", 120))}
    out = rows.withColumns(clean).withColumn("__s", X.session_scope(F.col("session_id")))
    out = out.withColumn("scope", F.when(F.col("scope").isin("", "unknown"), F.col("__s.scope")).otherwise(F.col("scope")))
    fill = lambda c, when, value: F.when((F.col(c) == "") & when, X.clean_text(value, 120)).otherwise(F.col(c))
    return out.withColumns({
        "platform": fill("platform", F.col("session_id").contains(":"), F.substring_index("session_id", ":", 1)), "user_id": fill("user_id", F.col("scope") == "private", F.col("__s.target")), "group_id": fill("group_id", F.col("scope") == "group", F.col("__s.target")),
    }).drop("__s")
