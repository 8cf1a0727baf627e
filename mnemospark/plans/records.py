"""Queries of writing and listing records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..runtime import table
from .reading import NOW, _at, _memories, _timeline

BATCH = "SELECT min(id) AS id FROM chat_import_batches"


def _now():
    return _at(NOW)


def recent_memories(spark, sf_dir):
    return records.recent_memories(_memories(spark, sf_dir), 60).select("id", "created_at")


def decay_pool(spark, sf_dir):
    return records.decay_pool(_memories(spark, sf_dir), 400).select("id", "occurred_at")


def identity_page(spark, sf_dir):
    return records.newest(table(spark, sf_dir, "identities"), "updated_at", 40, 20).select("id", "entity_id", "updated_at")


def relationship_page(spark, sf_dir):
    rows = _memories(spark, sf_dir).select("id", F.col("subject.id").alias("subject_id"), F.col("object.id").alias("object_id"), "scope", "session_id", "group_id", "updated_at")
    return records.newest(rows, "updated_at", 50, 0, {"scope": "group", "group_id": "880000001", "session_id": None}, (("subject_id", "object_id"), "880000001")).select("id", "subject_id", "object_id")


def thread_page(spark, sf_dir):
    """Threads between a message's session and the one in which the same subject wrote before."""
    rows = _timeline(spark, sf_dir).where("event_type = 'user_message' and session_id is not null and subject_id is not null").select("id", "session_id", F.col("object_id").alias("to_session"), F.col("event_type").alias("status"), "created_at")
    return records.newest(rows, "created_at", 30, 0, {"status": "user_message"}, (("session_id", "to_session"), "qq:GroupMessage:880000001")).select("id", "session_id")


def log_page(spark, sf_dir):
    return records.newest(_timeline(spark, sf_dir), "created_at", 30, 0, {"scope": "private", "session_id": None}).select("id", "created_at")


def import_batches(spark, sf_dir):
    out = records.import_status(table(spark, sf_dir, "chat_import_batches"), table(spark, sf_dir, "parsed_messages", "import_batch_id"), _memories(spark, sf_dir).select("import_batch_id"))
    return out.select("id", "state", "updated_at", "n_messages", "n_memories")


def _first_batch(spark, sf_dir) -> str:
    return table(spark, sf_dir, "chat_import_batches", "id").agg(F.min("id").alias("id")).first().id or ""


def import_memories(spark, sf_dir):
    return records.of_import(_memories(spark, sf_dir), _first_batch(spark, sf_dir)).select("id", F.col("place").cast("bigint").alias("place"))


def import_memory_counts(spark, sf_dir):
    return records.import_counts(_memories(spark, sf_dir))


def import_missing_vectors(spark, sf_dir):
    memories = _memories(spark, sf_dir)
    number = F.conv(F.substring("id", 13, 8), 16, 10).cast("bigint")
    vectors = memories.where(number % 2 == 0).select(F.col("id").alias("memory_id"), F.when(number % 3 == 0, "p2").otherwise("p1").alias("provider_id"), F.when(number % 5 == 0, "").otherwise("h").alias("text_hash"))
    return records.lacking_vectors(memories, vectors, "p1").select("id")


def archive_memories(spark, sf_dir):
    m = _memories(spark, sf_dir)
    out = records.archive(m, m.where("importance < 0.4").select("id"), "faded", _now())
    return out.select("id", "lifecycle", "validity_status", "supersedes_id", "updated_at", F.get_json_object("metadata", "$.decay_archived").isNotNull().alias("told"))


def review_decisions(spark, sf_dir):
    m = _memories(spark, sf_dir)
    seen = F.coalesce("updated_at", "created_at")
    pending = m.where("review_status = 'pending'").select("id", seen.alias("at"))
    decisions = pending.withColumn("status", F.lit("Approved")).unionByName(pending.where("substring(id, 5, 1) < '8'").select("id", (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("at"), F.lit("no").alias("status")))
    return records.review(m, decisions, _now()).select("id", "review_status", "lifecycle", "validity_status", "updated_at")


def lifecycle_change(spark, sf_dir):
    return records.set_lifecycle(_memories(spark, sf_dir), F.col("memory_type") == "open_loop", "archived", _now()).groupBy("lifecycle", "validity_status").agg(F.count(F.lit(1)).alias("n"))


def usage_marks(spark, sf_dir):
    m = _memories(spark, sf_dir)
    times = m.select("id", F.explode(F.sequence(F.lit(1), F.pmod(F.conv(F.substring("id", 13, 4), 16, 10).cast("bigint"), F.lit(5)))).alias("k"))
    uses = times.where("k > 0").select("id", (_now() + F.make_interval(hours=F.col("k").cast("int"))).alias("at"), (F.col("k") % 2 == 0).alias("injected"))
    return records.mark_used(m, uses).select("id", "access_count", "last_accessed_at", "injection_count", "last_injected_at", F.round("reinforcement_score", 6).alias("reinforcement_score"))


def prune_timeline(spark, sf_dir):
    return records.prunable(_timeline(spark, sf_dir), _at("2026-05-12")).select("id")


def summary_marks(spark, sf_dir):
    t = _timeline(spark, sf_dir)
    done = t.where("event_type = 'user_message'").select("id")
    return records.mark_summarised(t, done, _now()).groupBy("event_type").agg(F.count("summarized_at").alias("n_done"), F.max("summarized_at").alias("last_at"))


def event_keys(spark, sf_dir):
    return _timeline(spark, sf_dir).select("id", records.event_key(*[F.col(c) for c in ("event_type", "session_id", "subject_id", "message_id")]).alias("key"))


def ingest_events(spark, sf_dir):
    """Rows that arrived before an instant are held, the others arrive."""
    rows = _timeline(spark, sf_dir).select("id", records.event_key(*[F.col(c) for c in ("event_type", "session_id", "subject_id", "message_id")]).alias("key"), F.col("created_at").alias("at"))
    early = F.coalesce(F.col("at") < _at("2026-05-15"), F.lit(False))
    return records.ingest(rows.where(early), rows.where(~early))


def summary_failures(spark, sf_dir):
    log = _timeline(spark, sf_dir).where("event_type not in ('user_message', 'bot_response') and session_id is not null").select("session_id", F.col("created_at").alias("at"), "id", F.col("event_type").alias("error"))
    return records.failures(log)


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    stream = F.concat_ws("/", "event_type", F.pmod("event_id", F.lit(500)).cast("string"))
    return e.select(stream.alias("event_id"), (F.pmod("event_id", F.lit(7)) + 1).alias("revision"), F.col("event_type").alias("scope"), F.pmod("user_id", F.lit(3)).alias("owner"), F.col("ts").alias("at"), F.col("event_id").alias("n"))


def event_append(spark, sf_dir):
    e = _events(spark, sf_dir)
    early = e.where("n % 11 = 0").groupBy("event_id").agg(F.min(F.struct("at", "revision", "scope", "owner")).alias("f")).select("event_id", "f.*")
    arriving = e.where("n % 11 <> 0").groupBy("event_id", "revision", "scope", "owner").agg(F.min("at").alias("at"))
    return records.append_revisions(early, arriving, ["scope", "owner"]).groupBy("result").agg(F.count(F.lit(1)).alias("n"))


def _deliveries(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("event_id", "revision").agg(F.min("at").alias("at"), F.min("n").alias("n"))
    events = e.select("event_id", "revision", F.when(F.col("n") % 2 == 0, F.col("at")).otherwise(F.lit("2030-01-01").cast("timestamp")).alias("expires_at"), F.substring_index("event_id", "/", 1).alias("trace_id"))
    sent = e.select("event_id", "revision", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("consumer_id"), F.when(F.col("n") % 5 == 0, F.col("at")).alias("acked_at"), "n")
    acks = sent.where("n % 3 = 0 and consumer_id = 'a'").select("event_id", "revision", "consumer_id")
    return events, sent.drop("n"), acks


def delivery_acks(spark, sf_dir):
    events, sent, acks = _deliveries(spark, sf_dir)
    return records.acknowledge(sent, acks.unionByName(acks), events, _now()).withColumn("acked_at", F.col("acked_at").cast("timestamp_ntz"))


def event_trace(spark, sf_dir):
    events, sent, acks = _deliveries(spark, sf_dir)
    done = records.acknowledge(sent, acks, events, _now())
    return records.trace(events, done, "click", 50).select("event_id", "revision", "n_delivered", "n_acked")


def _scoped(spark, sf_dir) -> DataFrame:
    m = _memories(spark, sf_dir)
    return m.select(F.concat_ws("|", "scope", "owner_bot_id").alias("namespace"), F.col("memory_type").alias("record_kind"), F.col("id").alias("record_id"), F.coalesce("merged_count", F.lit(1)).cast("bigint").alias("revision"), F.coalesce("content", F.lit("")).alias("payload"), F.coalesce(F.col("validity_status") == "expired", F.lit(False)).alias("deleted"))


def namespace_erase(spark, sf_dir):
    out = records.erase_namespace(_scoped(spark, sf_dir), (F.col("namespace") == "group|bot_1") & F.col("record_id").startswith("mem_"))
    return out.select("namespace", "record_kind", "record_id", "revision", F.length("payload").cast("bigint").alias("n_chars"), "deleted")


def namespace_list(spark, sf_dir):
    return records.live_records(_scoped(spark, sf_dir), "private|bot_2", "preference", 50).select("record_id", "revision")


def normalised_records(spark, sf_dir):
    """The memories with gaps made in their columns, half of them told in the metadata."""
    m = _memories(spark, sf_dir)
    n = F.conv(F.substring("id", 13, 4), 16, 10).cast("bigint")
    gap = lambda c, k, other=None: F.when(n % k == 0, F.lit(other)).otherwise(F.col(c))
    rough = m.withColumns({
        "created_at": F.when(n % 7 == 0, None).otherwise(F.col("created_at")), "importance": F.when(n % 5 == 0, 3.0).otherwise(F.col("importance")), "salience": gap("salience", 3, 0.3), "durability": gap("durability", 2, "normal"), "validity_status": gap("validity_status", 11, ""), "sensitivity": gap("sensitivity", 13, "odd"), "owner_bot_id": gap("owner_bot_id", 3, ""),
        "metadata": F.when(n % 4 == 0, F.lit('{"owner_bot_id": "bot_9", "decay_mode": "slow_decay", "salience": 0.9, "validity_status": "expired", "sensitivity": "public"}')).otherwise(F.lit("{}")),
    })
    out = records.normalise(rough, _now())
    return out.select("id", "created_at", "updated_at", "occurred_at", F.sha1("content").alias("content_hash"), "confidence", F.round("importance", 6).alias("importance"), "owner_bot_id", "validity_status", F.round("salience", 6).alias("salience"), "durability", "sensitivity", F.concat_ws("|", "tags").alias("tags"))


def session_contexts(spark, sf_dir):
    rows = _timeline(spark, sf_dir).select("id", "session_id", F.when(F.substring("id", 4, 1) < "8", F.col("scope")).alias("scope"), F.lit("").alias("platform"), F.lit(None).cast("string").alias("user_id"), F.when(F.substring("id", 5, 1) < "4", "given").alias("group_id"))
    return records.session_context(rows)


def queries() -> dict:
    named = (
        normalised_records, session_contexts,
        recent_memories, decay_pool, identity_page, relationship_page, thread_page, log_page, import_batches, import_memories, import_memory_counts, import_missing_vectors, archive_memories, review_decisions, lifecycle_change, usage_marks,
        prune_timeline, summary_marks, event_keys, ingest_events, summary_failures, event_append, delivery_acks, event_trace, namespace_erase, namespace_list,
    )
    return {f.__name__: f for f in named}


_AT = f"'{NOW}'::TIMESTAMPTZ"
_KEY = r"""CASE WHEN trim(regexp_replace(coalesce(message_id, ''), '[\s\x{3000}]+', ' ', 'g')) = '' THEN '' ELSE sha1(lower('timeline|' || coalesce(event_type, '') || '|' || coalesce(session_id, '') || '|' || coalesce(subject_id, '') || '|' || trim(regexp_replace(message_id, '[\s\x{3000}]+', ' ', 'g')))) END"""
_EV = "e AS (SELECT event_type || '/' || (event_id % 500) AS event_id, event_id % 7 + 1 AS revision, event_type AS scope, user_id % 3 AS owner, ts AS seen, event_id AS n FROM events)"
_DELIVERED = f"""{_EV}, d AS (SELECT event_id, revision, min(seen) AS seen, min(n) AS n FROM e GROUP BY 1, 2), s AS (SELECT event_id, revision, consumer_id,
  CASE WHEN n % 5 = 0 THEN seen WHEN n % 3 = 0 AND consumer_id = 'a' AND (n % 2 <> 0 OR seen > '{NOW}') THEN '{NOW}'::TIMESTAMP END AS acked_at, n FROM d, (VALUES ('a'), ('b')) c(consumer_id))"""
_SCOPED = "s AS (SELECT concat_ws('|', scope, owner_bot_id) AS namespace, memory_type AS record_kind, id AS record_id, coalesce(merged_count, 1)::BIGINT AS revision, coalesce(content, '') AS payload, coalesce(validity_status = 'expired', false) AS deleted FROM memories)"


def oracle_sql() -> dict[str, str]:
    number = "('0x' || substr(id, 13, 8))::BIGINT"
    clean = lambda c: rf"trim(regexp_replace(coalesce({c}, ''), '[\s\x{{3000}}]+', ' ', 'g'))"
    return {
        "normalised_records": f"""WITH r AS (SELECT * REPLACE (CASE WHEN n % 7 = 0 THEN NULL ELSE created_at END AS created_at, CASE WHEN n % 5 = 0 THEN 3.0 ELSE importance END AS importance, CASE WHEN n % 3 = 0 THEN 0.3 ELSE salience END AS salience, CASE WHEN n % 2 = 0 THEN 'normal' ELSE durability END AS durability,
  CASE WHEN n % 11 = 0 THEN '' ELSE validity_status END AS validity_status, CASE WHEN n % 13 = 0 THEN 'odd' ELSE sensitivity END AS sensitivity, CASE WHEN n % 3 = 0 THEN '' ELSE owner_bot_id END AS owner_bot_id), n % 4 = 0 AS told FROM (SELECT *, ('0x' || substr(id, 13, 4))::BIGINT AS n FROM memories)),
c AS (SELECT *, coalesce(created_at, {_AT}) AS made, greatest(0.0, least(1.0, coalesce(importance, 0.3))) AS imp, coalesce(nullif(validity_status, ''), 'active') AS v, coalesce(nullif(sensitivity, ''), 'private') AS s, coalesce(nullif(lower(trim(durability)), ''), 'normal') AS d, lower(trim(coalesce(memory_type, ''))) AS k FROM r),
e AS (SELECT *, CASE WHEN v = 'active' AND told THEN 'expired' WHEN v = 'active' AND lifecycle = 'archived' THEN 'archived' ELSE lower(trim(v)) END AS v2, CASE WHEN s = 'private' AND told THEN 'public' ELSE lower(trim(s)) END AS s2,
  CASE WHEN d <> 'normal' THEN d WHEN told THEN 'durable' WHEN k IN ('manual_memory', 'explicit_memory') THEN 'pinned' WHEN k IN ('user_profile', 'user_preference', 'relationship_claim', 'promise', 'open_loop', 'creative_work') THEN 'durable' WHEN k IN ('emotion_state', 'current_state', 'schedule_fragment', 'bot_detail_fragment', 'proactive_message') THEN 'short'
  WHEN k IN ('raw_event', 'timeline_event') THEN 'ephemeral' ELSE 'normal' END AS d2 FROM c)
SELECT id, made AS created_at, coalesce(updated_at, made) AS updated_at, coalesce(occurred_at, made) AS occurred_at, sha1(CASE WHEN length({clean("content")}) > 4000 THEN rtrim(left({clean("content")}, 3999)) || '…' ELSE {clean("content")} END) AS content_hash, greatest(0.0, least(1.0, coalesce(confidence, 0.5))) AS confidence, round(imp, 6) AS importance,
trim(coalesce(nullif(owner_bot_id, ''), CASE WHEN told THEN 'bot_9' END, '')) AS owner_bot_id, CASE WHEN v2 IN ('active', 'superseded', 'expired', 'archived', 'deleted', 'quarantined') THEN v2 ELSE 'quarantined' END AS validity_status,
round(greatest(0.0, least(1.0, CASE WHEN coalesce(salience, 0.3) = 0.3 THEN CASE WHEN told THEN 0.9 ELSE imp END ELSE salience END)), 6) AS salience, CASE WHEN d2 IN ('ephemeral', 'short', 'normal', 'durable', 'pinned') THEN d2 ELSE 'normal' END AS durability,
CASE WHEN s2 IN ('public', 'internal', 'private', 'restricted') THEN s2 ELSE 'restricted' END AS sensitivity, array_to_string(list_filter(list_transform(coalesce(tags, []), lambda t: trim(coalesce(t, ''))), lambda t: t <> ''), '|') AS tags FROM e""",
        "session_contexts": """WITH s AS (SELECT id, coalesce(session_id, '') AS session_id, CASE WHEN substr(id, 4, 1) < '8' THEN coalesce(scope, '') ELSE '' END AS scope, CASE WHEN substr(id, 5, 1) < '4' THEN 'given' ELSE '' END AS g FROM timeline),
p AS (SELECT *, CASE WHEN contains(lower(session_id), ':groupmessage:') THEN 'group' WHEN contains(lower(session_id), ':friendmessage:') THEN 'private' ELSE 'unknown' END AS told, CASE WHEN contains(session_id, ':') THEN split_part(session_id, ':', -1) ELSE '' END AS target FROM s),
q AS (SELECT *, CASE WHEN scope IN ('', 'unknown') THEN told ELSE scope END AS sc, CASE WHEN told = 'unknown' THEN '' ELSE target END AS t FROM p)
SELECT id, session_id, sc AS scope, CASE WHEN contains(session_id, ':') THEN split_part(session_id, ':', 1) ELSE '' END AS platform, CASE WHEN sc = 'private' THEN t ELSE '' END AS user_id, CASE WHEN g <> '' THEN g WHEN sc = 'group' THEN t ELSE '' END AS group_id FROM q""",
        "recent_memories": "SELECT id, created_at FROM memories WHERE coalesce(review_status, '') <> 'pending' ORDER BY created_at DESC NULLS LAST, id LIMIT 60",
        "decay_pool": "SELECT id, occurred_at FROM memories WHERE lifecycle = 'stable_memory' AND coalesce(review_status, '') <> 'pending' ORDER BY coalesce(occurred_at, created_at) ASC NULLS FIRST, created_at ASC NULLS FIRST, id LIMIT 400",
        "identity_page": "SELECT id, entity_id, updated_at FROM identities ORDER BY updated_at DESC NULLS LAST, id LIMIT 40 OFFSET 20",
        "relationship_page": "SELECT id, subject.id AS subject_id, object.id AS object_id FROM memories WHERE scope = 'group' AND group_id = '880000001' AND (coalesce(subject.id = '880000001', false) OR coalesce(object.id = '880000001', false)) ORDER BY updated_at DESC NULLS LAST, id LIMIT 50",
        "thread_page": "SELECT id, session_id FROM timeline WHERE event_type = 'user_message' AND session_id IS NOT NULL AND subject_id IS NOT NULL AND (session_id = 'qq:GroupMessage:880000001' OR coalesce(object_id = 'qq:GroupMessage:880000001', false)) ORDER BY created_at DESC NULLS LAST, id LIMIT 30",
        "log_page": "SELECT id, created_at FROM timeline WHERE scope = 'private' ORDER BY created_at DESC NULLS LAST, id LIMIT 30",
        "import_batches": "SELECT id, state, updated_at, (SELECT count(*) FROM parsed_messages p WHERE p.import_batch_id = b.id) AS n_messages, (SELECT count(*) FROM memories m WHERE m.import_batch_id = b.id) AS n_memories FROM chat_import_batches b",
        "import_memories": f"SELECT id, row_number() OVER (ORDER BY importance DESC NULLS LAST, coalesce(occurred_at, created_at) ASC NULLS FIRST, id) AS place FROM memories WHERE import_batch_id = ({BATCH}) AND coalesce(lifecycle, '') <> 'archived'",
        "import_memory_counts": "SELECT import_batch_id, memory_type, count(*) AS n, false AS total FROM memories WHERE import_batch_id IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT import_batch_id, NULL, count(*), true FROM memories WHERE import_batch_id IS NOT NULL GROUP BY 1",
        "import_missing_vectors": f"SELECT id FROM memories WHERE import_batch_id IS NOT NULL AND coalesce(lifecycle, '') <> 'archived' AND coalesce(review_status, '') <> 'pending' AND NOT ({number} % 2 = 0 AND {number} % 3 <> 0 AND {number} % 5 <> 0)",
        "archive_memories": f"""SELECT id, CASE WHEN hit THEN 'archived' ELSE lifecycle END AS lifecycle, CASE WHEN hit THEN 'archived' ELSE validity_status END AS validity_status, CASE WHEN hit THEN '' ELSE supersedes_id END AS supersedes_id, CASE WHEN hit THEN {_AT} ELSE updated_at END AS updated_at, hit AS told
FROM (SELECT *, coalesce(importance < 0.4, false) AND coalesce(lifecycle, '') <> 'archived' AS hit FROM memories)""",
        "review_decisions": f"""SELECT id, CASE WHEN review_status = 'pending' THEN CASE WHEN substr(id, 5, 1) < '8' THEN 'rejected' ELSE 'auto' END ELSE review_status END AS review_status, CASE WHEN review_status = 'pending' THEN CASE WHEN substr(id, 5, 1) < '8' THEN 'archived' ELSE 'stable_memory' END ELSE lifecycle END AS lifecycle,
CASE WHEN review_status = 'pending' THEN CASE WHEN substr(id, 5, 1) < '8' THEN 'archived' ELSE 'active' END ELSE validity_status END AS validity_status, CASE WHEN review_status = 'pending' THEN {_AT} ELSE updated_at END AS updated_at FROM memories""",
        "lifecycle_change": "SELECT CASE WHEN memory_type = 'open_loop' THEN 'archived' ELSE lifecycle END AS lifecycle, CASE WHEN memory_type = 'open_loop' THEN 'archived' ELSE validity_status END AS validity_status, count(*) AS n FROM memories GROUP BY 1, 2",
        "usage_marks": f"""WITH k AS (SELECT *, ('0x' || substr(id, 13, 4))::BIGINT % 5 AS k FROM memories), c AS (SELECT *, CASE WHEN k = 0 THEN 1 ELSE (k + 1) // 2 END AS n, k // 2 AS m FROM k)
SELECT id, (coalesce(access_count, 0) + n)::BIGINT AS access_count, {_AT} + to_hours(CASE WHEN k = 0 THEN 1 ELSE k - (k + 1) % 2 END) AS last_accessed_at, (coalesce(injection_count, 0) + m)::BIGINT AS injection_count,
CASE WHEN m > 0 THEN {_AT} + to_hours(k - k % 2) ELSE last_injected_at END AS last_injected_at, round(CASE WHEN m > 0 THEN least(1.0, coalesce(reinforcement_score, 0) + 0.025 * m) ELSE reinforcement_score END, 6) AS reinforcement_score FROM c""",
        "prune_timeline": "SELECT id FROM timeline WHERE summarized_at IS NOT NULL AND coalesce(retention_class, '') <> 'historical_archive' AND coalesce(occurred_at, created_at) < '2026-05-12'::TIMESTAMPTZ",
        "summary_marks": f"SELECT event_type, count(CASE WHEN event_type = 'user_message' THEN {_AT} ELSE summarized_at END) AS n_done, max(CASE WHEN event_type = 'user_message' THEN {_AT} ELSE summarized_at END) AS last_at FROM timeline GROUP BY event_type",
        "event_keys": f"SELECT id, {_KEY} AS key FROM timeline",
        "ingest_events": f"""WITH k AS (SELECT id, {_KEY} AS key, created_at AS seen, coalesce(created_at < '2026-05-15'::TIMESTAMPTZ, false) AS early FROM timeline), h AS (SELECT key, min(id) AS held FROM k WHERE early AND key <> '' GROUP BY key), f AS (SELECT key, first(id ORDER BY seen NULLS FIRST, id) AS first FROM k WHERE NOT early AND key <> '' GROUP BY key)
SELECT k.id, CASE WHEN key = '' THEN k.id ELSE coalesce(held, first) END AS stored_id, key = '' OR (held IS NULL AND first = k.id) AS fresh FROM k LEFT JOIN h USING (key) LEFT JOIN f USING (key) WHERE NOT early""",
        "summary_failures": """SELECT session_id, count(*) AS retry_count, last(event_type ORDER BY created_at NULLS FIRST, id) AS last_error, min(created_at) AS created_at, max(created_at) AS updated_at, least(1800, 60 * pow(2, least(8, count(*) - 1)))::BIGINT AS wait_seconds
FROM timeline WHERE event_type NOT IN ('user_message', 'bot_response') AND session_id IS NOT NULL GROUP BY session_id""",
        "event_append": f"""WITH {_EV}, h AS (SELECT * FROM e WHERE n % 11 = 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seen, revision, scope, owner) = 1), a AS (SELECT event_id, revision, scope, owner, min(seen) AS seen FROM e WHERE n % 11 <> 0 GROUP BY 1, 2, 3, 4),
b AS (SELECT event_id, 0 AS late, NULL AS seen, revision, scope, owner FROM h UNION ALL SELECT event_id, 1, seen, revision, scope, owner FROM a), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY late, seen, revision, scope, owner) = 1)
SELECT CASE WHEN a.scope <> o.scope OR a.owner <> o.owner THEN 'conflict' WHEN EXISTS (SELECT 1 FROM h WHERE h.event_id = a.event_id AND h.revision = a.revision) THEN 'duplicate' ELSE 'added' END AS result, count(*) AS n FROM a JOIN o USING (event_id) GROUP BY 1""",
        "delivery_acks": f"WITH {_DELIVERED} SELECT event_id, revision, consumer_id, acked_at FROM s",
        "event_trace": f"WITH {_DELIVERED} SELECT event_id, revision, count(*) AS n_delivered, count(acked_at) AS n_acked FROM s WHERE split_part(event_id, '/', 1) = 'click' GROUP BY 1, 2 ORDER BY revision, event_id LIMIT 50",
        "namespace_erase": f"WITH {_SCOPED}, h AS (SELECT *, namespace = 'group|bot_1' AND NOT deleted AS hit FROM s) SELECT namespace, record_kind, record_id, revision + hit::INT AS revision, CASE WHEN hit OR deleted THEN 2 ELSE length(payload) END AS n_chars, deleted OR hit AS deleted FROM h",
        "namespace_list": f"WITH {_SCOPED} SELECT record_id, revision FROM s WHERE namespace = 'private|bot_2' AND record_kind = 'preference' AND NOT deleted ORDER BY revision, record_id LIMIT 50",
    }
