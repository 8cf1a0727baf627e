"""Queries of the bounded reads, gates and text functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import text as X
from ..operators import gates, scans
from ..operators.scans import Context
from ..runtime import table

NOW = "2026-05-24 00:00:00"
def _at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


GROUP = Context("group", "qq:GroupMessage:880000001", "qq", "u100062", "880000001", "bot_1")
PRIVATE = Context("private", "telegram:FriendMessage:u100060", "telegram", "u100060", None, "bot_1")
TERMS = ["lantern", "violin", "望远镜", "guitarra", "bakery"]


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memories")


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "timeline")


def priority_scan(spark, sf_dir):
    return scans.priority(_memories(spark, sf_dir)).select("id", "importance")


def current_window_scan(spark, sf_dir):
    return scans.current_window(_memories(spark, sf_dir), GROUP).select("id", "scope", "session_id")


def private_window_scan(spark, sf_dir):
    return scans.current_window(_memories(spark, sf_dir), PRIVATE).select("id", "scope", "session_id")


def time_window_scan(spark, sf_dir):
    return scans.time_window(_memories(spark, sf_dir), _at("2026-05-10"), _at("2026-05-14")).select("id", "occurred_at")


def keyword_scan(spark, sf_dir):
    return scans.containing(_memories(spark, sf_dir), TERMS).select("id", "hits")


def top_n_per_type(spark, sf_dir):
    return scans.top_per_type(_memories(spark, sf_dir), 7).select("id", "memory_type", F.col("nth").cast("bigint").alias("nth"))


def validity_as_of(spark, sf_dir):
    return scans.as_of(_memories(spark, sf_dir), _at("2026-05-15"), ("active", "superseded")).select("id", "validity_status")


def owner_validity_page(spark, sf_dir):
    return scans.as_of(_memories(spark, sf_dir), _at(NOW), owner="bot_2", limit=40).select("id", "salience")


def filtered_page(spark, sf_dir):
    filters = {"memory_type": "preference", "scope": "private"}
    return scans.page(_memories(spark, sf_dir), filters, 25, ("mem_5",)).select("id", "content")


def memory_page(spark, sf_dir):
    return scans.matching_page(_memories(spark, sf_dir), "TeleGram", "u100060", {"scope": "private", "lifecycle": None}, 30, 1).select("id", "memory_type")


def pending_rows(spark, sf_dir):
    return scans.pending_rows(_timeline(spark, sf_dir), GROUP.session_id, 60, ("2026-05-04 01:30:00", "tl_5")).select("id", "occurred_at")


def multi_get(spark, sf_dir):
    ids = _memories(spark, sf_dir).where("supersedes_id is not null").select(F.col("supersedes_id").alias("id"))
    return scans.by_ids(_memories(spark, sf_dir), ids).select("id", "memory_type")


def recent_timeline(spark, sf_dir):
    return scans.recent_timeline(_timeline(spark, sf_dir), 50, scope="group").select("id", "session_id", "occurred_at")


def timeline_window(spark, sf_dir):
    return scans.recent_timeline(_timeline(spark, sf_dir), 500, session_id=GROUP.session_id, start=_at("2026-05-04"), end=_at("2026-05-06")).select("id", "occurred_at")


def cross_window_recent(spark, sf_dir):
    return scans.cross_window(_timeline(spark, sf_dir), "private", GROUP.session_id, _at("2026-05-20")).select("id", "session_id")


def pending_windows(spark, sf_dir):
    return scans.pending_windows(_timeline(spark, sf_dir))


def summary_trigger(spark, sf_dir):
    return scans.ready_windows(_timeline(spark, sf_dir), _at(NOW)).select("session_id", "n_pending")


def missing_embeddings_antijoin(spark, sf_dir):
    memories = _memories(spark, sf_dir)
    text = X.embedding_text(F.col("content"), F.col("evidence"), F.col("memory_type"))
    hashed = memories.select("id", F.sha1(text).alias("text_hash"))
    # Vectors of every third record; of these every other is of an older text.
    number = F.conv(F.substring("id", 13, 8), 16, 10).cast("bigint")
    vectors = hashed.where(number % 3 == 0).select(F.col("id").alias("memory_id"), F.when(number % 2 == 0, F.sha1(F.lit("older"))).otherwise(F.col("text_hash")).alias("text_hash"))
    return scans.without_vector(hashed, vectors).select("id", "state")


def review_queue(spark, sf_dir):
    memories = _memories(spark, sf_dir)
    queue = memories.where("review_status = 'pending'").select(F.col("id").alias("memory_id"), F.concat(F.lit("review:"), "memory_type").alias("reason"))
    return queue.join(memories.select(F.col("id").alias("memory_id"), "importance"), "memory_id", "left")


def visibility_gate(spark, sf_dir):
    return _memories(spark, sf_dir).select("id", gates.visibility(GROUP).alias("v")).select("id", "v.visible", "v.reason")


def visibility_gate_private(spark, sf_dir):
    return _memories(spark, sf_dir).select("id", gates.visibility(PRIVATE, raw_events=True, hide_pending=False).alias("v")).select("id", "v.visible", "v.reason")


def blocked_reasons(spark, sf_dir):
    reasons = _memories(spark, sf_dir).select(gates.visibility(GROUP).alias("v")).where("not v.visible")
    return reasons.groupBy(F.col("v.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def lifecycle_gate(spark, sf_dir):
    state = _memories(spark, sf_dir).select("id", gates.lifecycle(PRIVATE, _at(NOW)).alias("s"))
    return state.select("id", "s.eligible", "s.reason", F.round("s.decay", 6).alias("decay"))


def acl_gate(spark, sf_dir):
    memories = _memories(spark, sf_dir)
    owners = memories.select(gates.owner_window().alias("o")).where("o is not null").select("o.*").distinct()
    number = F.pmod(F.conv(F.substring(F.sha1("id"), 1, 8), 16, 10).cast("bigint"), F.lit(5))
    rules = owners.where(number < 2).select(
        F.col("scope").alias("owner_scope"), F.col("id").alias("owner_id"), F.lit("group").alias("reader_scope"), F.lit("880000001").alias("reader_id"), F.when(number == 0, "deny").otherwise("allow").alias("effect"), F.lit(True).alias("enabled")
    )
    policies = owners.where(number == 2).select(F.col("scope").alias("window_scope"), F.col("id").alias("window_id"), F.lit("blacklist").alias("read_mode"), F.lit("whitelist").alias("share_mode"))
    return gates.access(memories, rules, policies, "group", "880000001").select("id", "acl")


def interval_overlap(spark, sf_dir):
    span = F.coalesce("valid_to", F.col("valid_from") + F.expr("INTERVAL 1 SECOND"))
    start, end = _at("2026-05-10"), _at("2026-05-12")
    return _memories(spark, sf_dir).where((F.col("valid_from") < end) & (span > start)).select("id")


def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.clean_text(F.col("text"), 80).alias("cleaned"))


def fingerprint(spark, sf_dir):
    m = _memories(spark, sf_dir)
    parts = [F.col("memory_type"), F.col("subject.id"), F.col("evidence"), F.col("content")]
    return m.select("id", X.stable_fingerprint(*parts).alias("fingerprint"))


def scoped_keys(spark, sf_dir):
    domain = [F.col(c) for c in ("owner_bot_id", "platform", "scope", "session_id", "group_id")]
    return _memories(spark, sf_dir).select("id", X.scoped_key(domain, [F.lit("canonical"), F.col("memory_type"), F.col("id")]).alias("key"), X.scoped_key(domain, [F.lit("x")], F.col("canonical_key")).alias("rekeyed"))


def cjk_bigrams(spark, sf_dir):
    rows = _memories(spark, sf_dir).select("id", F.posexplode(X.cjk_bigrams(F.col("content"))).alias("place", "bigram"))
    return rows.select("id", "place", "bigram")


def query_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "known_strings", "ref_id", "known_text")
    return rows.select("ref_id", F.posexplode(X.query_terms(F.col("known_text"))).alias("place", "term"))


#: Assigned secrets, a password in an address, a bearer token and a name that hides nothing, each as it may be written.
SECRETS = """ api_key="ab c" and Access-Token: x7z, see https://user:pass@host/x with bearer abcdef123456 or client_secret='q w'; token=kept"""


def redact_text(spark, sf_dir):
    return _timeline(spark, sf_dir).select("id", X.redact_secrets(F.concat("content", F.lit(SECRETS), F.lit(" PASSWORD="), "id")).alias("clean"))


def redact_metadata(spark, sf_dir):
    """Metadata with a secret added to it under a name that shows so, and one inside a text."""
    given = F.concat(F.substring_index("metadata", "}", 1), F.lit(', "db_password": "s3", "remark": "password: '), F.substring("id", 1, 4), F.lit('"}'))
    clean = _timeline(spark, sf_dir).where("metadata like '{\"%'").select("id", F.from_json(X.redact_fields(given), "map<string,string>").alias("m"))
    return clean.select("id", F.col("m")["trace"].alias("trace"), F.col("m")["message_id"].alias("message_id"), F.col("m")["db_password"].alias("db_password"), F.col("m")["remark"].alias("remark"))


def session_scopes(spark, sf_dir):
    """The timeline's session keys, as they are and in the other notations that name a scope or none."""
    key = F.col("session_id")
    last = F.substring_index(key, ":", -1)
    forms = [key, F.concat(F.lit("x:Group:y:"), last), F.concat(F.lit("x:PrivateMessage:"), last), F.concat(F.lit("x:friend:"), last), F.concat(F.lit("x:MyGroup:"), last), F.concat(F.lit("p:GroupMessage:friend:"), last)]
    rows = _timeline(spark, sf_dir).where("session_id is not null").select(F.explode(F.array(*forms)).alias("key")).select(X.session_scope(F.col("key")).alias("s"))
    return rows.groupBy("s.scope", "s.target").agg(F.count(F.lit(1)).alias("n"))


def normalised_status(spark, sf_dir):
    """Statuses as they are and in forms that are empty, padded, of other case or unknown."""
    m = _memories(spark, sf_dir)
    forms = lambda c: F.explode(F.array(F.col(c), F.lit(None).cast("string"), F.lit(""), F.lit(" Deleted "), F.lit("PRIVATE"), F.upper(c), F.lit("odd")))
    validity = m.select(F.lit("validity").alias("field"), forms("validity_status").alias("v")).select("field", X.validity_status(F.col("v")).alias("value"))
    secrecy = m.select(F.lit("sensitivity").alias("field"), forms("sensitivity").alias("v")).select("field", X.sensitivity(F.col("v")).alias("value"))
    return validity.unionByName(secrecy).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def durability_levels(spark, sf_dir):
    m = _memories(spark, sf_dir).select(F.explode(F.array(F.col("memory_type"), F.lit("Open_Loop"), F.lit("current_state"))).alias("memory_type"), "durability")
    return m.groupBy(X.durability_of_type(F.col("memory_type"), F.col("durability")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


# Questions that name each kind of window, and one that names none.
QUESTIONS = ("前天 聊了什么", "昨日如何", "今天", "上个月的事", "本月 总结", "过去一个月", "上周过得怎么样", "这周", "最近7天", "最近15天", "过去99天", "近三天", "这几天", "最近怎么样", "最近", "hello")


def time_windows(spark, sf_dir):
    """Each question as of the export of each batch."""
    batches = table(spark, sf_dir, "chat_import_batches", "id", "exported_at").where("exported_at is not null")
    asked = batches.select("id", "exported_at", F.posexplode(F.array(*[F.lit(q) for q in QUESTIONS])).alias("n", "question"))
    return asked.select("id", "n", P.time_window(F.col("question"), F.col("exported_at")).alias("w")).select("id", "n", "w.source", "w.start_at", "w.end_at", "w.summary_like")


def dated_texts(spark, sf_dir):
    rows = _memories(spark, sf_dir).where("content is not null and created_at is not null")
    return rows.select("id", P.dated(F.concat(F.lit("昨晚和今天下午，明天早上；昨天"), "content"), F.to_date("created_at")).alias("text"))


def merged_tags(spark, sf_dir):
    extra = F.array(F.upper(F.get("tags", F.lit(0))), F.lit(" Extra "), F.lit(""), F.col("memory_type"))
    return _memories(spark, sf_dir).select("id", F.concat_ws("|", P.merged_terms(F.col("tags"), extra, limit=4)).alias("terms"))


def queries() -> dict:
    named = (
        memory_page, pending_rows, time_windows, dated_texts, merged_tags,
        priority_scan, current_window_scan, private_window_scan, time_window_scan, keyword_scan, top_n_per_type, validity_as_of, owner_validity_page, filtered_page, multi_get, recent_timeline, timeline_window, cross_window_recent,
        pending_windows, summary_trigger, missing_embeddings_antijoin, review_queue, visibility_gate, visibility_gate_private, blocked_reasons, lifecycle_gate, acl_gate, interval_overlap, clean_text, fingerprint, scoped_keys,
        cjk_bigrams, query_terms, redact_text, redact_metadata, session_scopes, normalised_status, durability_levels,
    )
    return {f.__name__: f for f in named}


_FINDABLE = "coalesce(lifecycle, '') <> 'archived' AND coalesce(review_status, '') <> 'pending'"
_SEEN = "coalesce(occurred_at, updated_at, created_at)"
_HAY = "lower(concat_ws(' ', content, evidence, array_to_string(tags, ' '), metadata, subject.id, subject.name, object.id, object.name, session_id, group_id))"
_HITS = " + ".join(f"contains({_HAY}, '{t}')::INT" for t in TERMS)
_BOTS = "list_filter([CASE WHEN subject.kind = 'bot' THEN subject.id END, CASE WHEN object.kind = 'bot' THEN object.id END, owner_bot_id], lambda b: b IS NOT NULL AND b <> '' AND b <> 'self')"
_OWNER = f"""CASE WHEN len({_BOTS}) = 0 THEN CASE WHEN memory_type = 'conversation_summary' AND scope = 'group' THEN 'ambiguous_bot_owner' ELSE 'no_specific_bot_owner' END
  WHEN list_contains({_BOTS}, 'bot_1') THEN 'same_bot_owner' ELSE 'other_bot_owner' END"""
_PASSES = "('bot_self', 'shareable', 'same_private_session', 'same_private_user', 'same_private_session_target', 'same_group')"
_GROUP_REASON = f"""CASE WHEN lifecycle = 'archived' THEN 'archived' WHEN review_status = 'pending' THEN 'pending_review' WHEN lifecycle = 'raw_event' THEN 'raw_event_disabled' WHEN visibility = 'internal' THEN 'internal'
  WHEN visibility = 'bot_self' THEN CASE WHEN o IN ('other_bot_owner', 'ambiguous_bot_owner') THEN o ELSE 'bot_self' END WHEN visibility = 'shareable' THEN 'shareable'
  WHEN visibility = 'private_pair' THEN CASE WHEN o IN ('other_bot_owner', 'ambiguous_bot_owner') THEN o WHEN lower(platform) <> 'qq' AND lower(platform) NOT IN ('', 'unknown') THEN 'other_platform'
    WHEN session_id = 'qq:GroupMessage:880000001' THEN 'same_private_session' ELSE 'private_pair_not_current_private' END
  WHEN visibility = 'group_public' THEN CASE WHEN group_id = '880000001' THEN CASE WHEN o IN ('other_bot_owner', 'ambiguous_bot_owner') THEN o ELSE 'same_group' END ELSE 'other_group_public' END
  ELSE 'unknown_visibility:' || coalesce(visibility, '') END"""
_PRIVATE_REASON = f"""CASE WHEN lifecycle = 'archived' THEN 'archived' WHEN visibility = 'internal' THEN 'internal'
  WHEN visibility = 'bot_self' THEN CASE WHEN o IN ('other_bot_owner', 'ambiguous_bot_owner') THEN o ELSE 'bot_self' END WHEN visibility = 'shareable' THEN 'shareable'
  WHEN visibility = 'private_pair' THEN CASE WHEN o IN ('other_bot_owner', 'ambiguous_bot_owner') THEN o WHEN lower(platform) <> 'telegram' AND lower(platform) NOT IN ('', 'unknown') THEN 'other_platform'
    WHEN session_id = 'telegram:FriendMessage:u100060' THEN 'same_private_session' WHEN subject.id = 'u100060' OR object.id = 'u100060' THEN 'same_private_user' WHEN session_id LIKE '%:FriendMessage:%' AND session_id LIKE '%:u100060' THEN 'same_private_session_target' ELSE 'other_private_pair' END
  WHEN visibility = 'group_public' THEN 'other_group_public' ELSE 'unknown_visibility:' || coalesce(visibility, '') END"""
_OWNER_WINDOW = """CASE WHEN scope = 'group' AND coalesce(group_id, CASE WHEN lower(session_id) LIKE '%:groupmessage:%' THEN split_part(session_id, ':', 3) END) IS NOT NULL THEN 'group'
    WHEN scope = 'private' AND coalesce(CASE WHEN subject.kind = 'user' THEN subject.id END, CASE WHEN object.kind = 'user' THEN object.id END) IS NOT NULL THEN 'private' END AS os,
  CASE WHEN scope = 'group' THEN coalesce(group_id, CASE WHEN lower(session_id) LIKE '%:groupmessage:%' THEN split_part(session_id, ':', 3) END)
    WHEN scope = 'private' THEN coalesce(CASE WHEN subject.kind = 'user' THEN subject.id END, CASE WHEN object.kind = 'user' THEN object.id END) END AS oi"""


def _clean(column: str, limit: int) -> str:
    flat = rf"trim(regexp_replace(coalesce({column}, ''), '[\s\x{{3000}}]+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) > {limit} THEN rtrim(left({flat}, {limit - 1})) || '…' ELSE {flat} END"


def _redacted(text: str) -> str:
    """Patterns of secrets replaced one after the other."""
    out = f"regexp_replace({text}, '-----BEGIN [^-\\r\\n]+ PRIVATE KEY-----.*?-----END [^-\\r\\n]+ PRIVATE KEY-----', '[REDACTED]', 'gis')"
    out = f"regexp_replace({out}, '\\bbearer\\s+[A-Za-z0-9._~+/=-]{{8,}}', 'Bearer [REDACTED]', 'gi')"
    out = f"regexp_replace({out}, '(https?://[^:/\\s]+:)[^@/\\s]+(@)', '\\1[REDACTED]\\2', 'gi')"
    names = "password|passwd|api[_-]?key|access[_-]?token|refresh[_-]?token|authorization|client[_-]?secret|private[_-]?key"
    return f"""regexp_replace({out}, '\\b({names})\\b(\\s*[:=]\\s*)(?:"[^"\\r\\n]*"|''[^''\\r\\n]*''|[^\\s,;\\r\\n]+)', '\\1\\2[REDACTED]', 'gi')"""


def _dated() -> str:
    """Words relative to d written as dates, one pattern after the other."""
    out = "text"
    for pattern, shift, part in P.RELATIVE:
        out = f"regexp_replace({out}, '{pattern}', strftime(d + {shift}, '%Y-%m-%d') || '{part}', 'g')"
    return out


def oracle_sql() -> dict[str, str]:
    by_importance = "importance DESC NULLS LAST"
    domain = "left(sha1(lower(concat_ws('|', 'domain', owner_bot_id, platform, scope, session_id, group_id))), 24)"
    return {
        "priority_scan": f"SELECT id, importance FROM memories WHERE {_FINDABLE} ORDER BY {by_importance}, occurred_at DESC NULLS LAST, id LIMIT 2000",
        "current_window_scan": f"SELECT id, scope, session_id FROM memories WHERE {_FINDABLE} AND (session_id = 'qq:GroupMessage:880000001' OR (scope = 'group' AND group_id = '880000001')) ORDER BY {by_importance}, {_SEEN} DESC NULLS LAST, id LIMIT 600",
        "private_window_scan": f"SELECT id, scope, session_id FROM memories WHERE {_FINDABLE} AND (session_id = 'telegram:FriendMessage:u100060' OR (scope = 'private' AND (subject.id = 'u100060' OR object.id = 'u100060'))) ORDER BY {by_importance}, {_SEEN} DESC NULLS LAST, id LIMIT 600",
        "time_window_scan": f"""SELECT id, occurred_at FROM memories WHERE {_FINDABLE} AND ({" OR ".join(f"({c} >= '2026-05-10'::TIMESTAMPTZ AND {c} < '2026-05-14'::TIMESTAMPTZ)" for c in ("occurred_at", "created_at", "updated_at"))})
ORDER BY {by_importance}, {_SEEN} DESC NULLS LAST, id LIMIT 1600""",
        "keyword_scan": f"SELECT id, {_HITS} AS hits FROM memories WHERE {_FINDABLE} AND ({_HITS}) > 0 ORDER BY session_id IS NULL, {by_importance}, id LIMIT 1200",
        "top_n_per_type": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY {_SEEN} DESC NULLS LAST, {by_importance}, id) AS nth FROM memories WHERE {_FINDABLE})
SELECT id, memory_type, nth FROM r WHERE nth <= 7 ORDER BY {_SEEN} DESC NULLS LAST, {by_importance}, id LIMIT 120""",
        "validity_as_of": "SELECT id, validity_status FROM memories WHERE validity_status IN ('active', 'superseded') AND (valid_from IS NULL OR valid_from <= '2026-05-15'::TIMESTAMPTZ) AND (valid_to IS NULL OR '2026-05-15'::TIMESTAMPTZ < valid_to)",
        "owner_validity_page": f"""SELECT id, salience FROM memories WHERE validity_status = 'active' AND (valid_from IS NULL OR valid_from <= '2026-05-24'::TIMESTAMPTZ) AND (valid_to IS NULL OR '2026-05-24'::TIMESTAMPTZ < valid_to) AND owner_bot_id = 'bot_2'
ORDER BY salience DESC NULLS LAST, {by_importance}, coalesce(valid_from, occurred_at) DESC NULLS LAST, id LIMIT 40""",
        "filtered_page": "SELECT id, content FROM memories WHERE memory_type = 'preference' AND scope = 'private' AND id > 'mem_5' ORDER BY id LIMIT 25",
        "memory_page": f"SELECT id, memory_type FROM memories WHERE scope = 'private' AND ({' OR '.join(f"contains(lower(coalesce({c}, '')), 'telegram')" for c in ('content', 'evidence', 'subject.id', 'subject.name', 'object.id', 'object.name', 'session_id', 'group_id', 'metadata'))}) AND (coalesce(subject.id = 'u100060', false) OR coalesce(object.id = 'u100060', false) OR coalesce(group_id = 'u100060', false)) ORDER BY created_at DESC NULLS LAST, id LIMIT 30 OFFSET 1",
        "pending_rows": "SELECT id, occurred_at FROM timeline WHERE summarized_at IS NULL AND event_type IN ('user_message', 'bot_response') AND session_id = 'qq:GroupMessage:880000001' AND (occurred_at > '2026-05-04 01:30:00+00'::TIMESTAMPTZ OR (occurred_at = '2026-05-04 01:30:00+00'::TIMESTAMPTZ AND id > 'tl_5')) ORDER BY occurred_at, id LIMIT 60",
        "multi_get": "SELECT id, memory_type FROM memories WHERE id IN (SELECT supersedes_id FROM memories WHERE supersedes_id IS NOT NULL)",
        "recent_timeline": "SELECT id, session_id, occurred_at FROM timeline WHERE scope = 'group' ORDER BY occurred_at DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 50",
        "timeline_window": "SELECT id, occurred_at FROM timeline WHERE session_id = 'qq:GroupMessage:880000001' AND occurred_at >= '2026-05-04'::TIMESTAMPTZ AND occurred_at < '2026-05-06'::TIMESTAMPTZ ORDER BY occurred_at DESC, created_at DESC, id LIMIT 500",
        "cross_window_recent": "SELECT id, session_id FROM timeline WHERE scope = 'private' AND session_id <> 'qq:GroupMessage:880000001' AND event_type IN ('user_message', 'bot_response') AND occurred_at >= '2026-05-20'::TIMESTAMPTZ ORDER BY occurred_at DESC NULLS LAST, id LIMIT 240",
        "pending_windows": "SELECT session_id, count(*) AS n_pending, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM timeline WHERE summarized_at IS NULL AND event_type IN ('user_message', 'bot_response') AND session_id IS NOT NULL GROUP BY session_id",
        "summary_trigger": """SELECT session_id, count(*) AS n_pending FROM timeline WHERE summarized_at IS NULL AND event_type IN ('user_message', 'bot_response') AND session_id IS NOT NULL GROUP BY session_id
HAVING count(*) >= 12 OR (count(*) >= 8 AND min(occurred_at) <= '2026-05-23 23:00:00+00'::TIMESTAMPTZ)""",
        "missing_embeddings_antijoin": f"""WITH h AS (SELECT id, sha1({_clean("concat_ws(chr(10), memory_type, nullif(content, ''), nullif(evidence, ''))", 1200)}) AS h, ('0x' || substr(id, 13, 8))::BIGINT AS n FROM memories),
v AS (SELECT id, CASE WHEN n % 2 = 0 THEN sha1('older') ELSE h END AS vh FROM h WHERE n % 3 = 0)
SELECT h.id, CASE WHEN vh IS NULL THEN 'missing' ELSE 'stale' END AS state FROM h LEFT JOIN v USING (id) WHERE vh IS NULL OR vh <> h""",
        "review_queue": "SELECT id AS memory_id, 'review:' || memory_type AS reason, importance FROM memories WHERE review_status = 'pending'",
        "visibility_gate": f"WITH m AS (SELECT *, {_OWNER} AS o FROM memories), r AS (SELECT id, {_GROUP_REASON} AS reason FROM m) SELECT id, reason IN {_PASSES} AS visible, reason FROM r",
        "visibility_gate_private": f"WITH m AS (SELECT *, {_OWNER} AS o FROM memories), r AS (SELECT id, {_PRIVATE_REASON} AS reason FROM m) SELECT id, reason IN {_PASSES} AS visible, reason FROM r",
        "blocked_reasons": f"WITH m AS (SELECT *, {_OWNER} AS o FROM memories), r AS (SELECT {_GROUP_REASON} AS reason FROM m) SELECT reason, count(*) AS n FROM r WHERE reason NOT IN {_PASSES} GROUP BY reason",
        "lifecycle_gate": f"""WITH r AS (SELECT *, CASE WHEN lower(coalesce(validity_status, 'active')) <> 'active' THEN 'validity=' || lower(validity_status) WHEN '2026-05-24'::TIMESTAMPTZ < valid_from THEN 'validity=not_started' WHEN '2026-05-24'::TIMESTAMPTZ >= valid_to THEN 'validity=expired'
  WHEN sensitivity = 'restricted' THEN 'sensitivity=restricted' WHEN owner_bot_id <> '' AND owner_bot_id <> 'bot_1' THEN 'owner_bot_mismatch' ELSE 'eligible' END AS reason,
  greatest(0.0, (epoch_us('2026-05-24'::TIMESTAMPTZ) - epoch_us({_SEEN})) / 86400000000.0) AS age FROM memories)
SELECT id, reason = 'eligible' AS eligible, reason, round(CASE WHEN reason <> 'eligible' THEN 0.0 WHEN durability = 'pinned' THEN 1.0 ELSE greatest(0.05, least(1.0, pow(2.0, -age / CASE durability WHEN 'ephemeral' THEN 1.0 WHEN 'short' THEN 14.0 WHEN 'durable' THEN 730.0 ELSE 120.0 END))) END, 6) AS decay FROM r""",
        "acl_gate": f"""WITH m AS (SELECT id, {_OWNER_WINDOW} FROM memories), w AS (SELECT DISTINCT os, oi, ('0x' || left(sha1(oi), 8))::BIGINT % 5 AS n FROM m WHERE os IS NOT NULL)
SELECT m.id, CASE WHEN n = 0 THEN 'deny' WHEN n = 1 THEN 'allow'
  WHEN m.os IS NOT NULL AND (CASE WHEN n = 2 THEN 'whitelist' WHEN m.os = 'group' THEN 'blacklist' ELSE 'whitelist' END) = 'blacklist' AND m.os <> 'private' THEN 'open' ELSE 'closed' END AS acl
FROM m LEFT JOIN w ON m.os = w.os AND m.oi = w.oi""",
        "interval_overlap": "SELECT id FROM memories WHERE valid_from < '2026-05-12'::TIMESTAMPTZ AND coalesce(valid_to, valid_from + INTERVAL 1 SECOND) > '2026-05-10'::TIMESTAMPTZ",
        "clean_text": f"SELECT doc_id, {_clean('text', 80)} AS cleaned FROM documents",
        "fingerprint": rf"""WITH p AS (SELECT id, lower({_clean('memory_type', 1000)}) AS a, lower({_clean('subject.id', 1000)}) AS b, CASE WHEN evidence IS NOT NULL THEN lower({_clean('evidence', 1000)}) END AS c,
  CASE WHEN content IS NOT NULL THEN lower({_clean("content", 1000)}) END AS d FROM memories)
SELECT id, sha1(concat_ws('|', a, b, c, d)) AS fingerprint FROM p""",
        "scoped_keys": f"""SELECT id, concat_ws(':', 'mav2', {domain}, sha1(lower(concat_ws('|', 'canonical', memory_type, id)))) AS key,
  concat_ws(':', 'mav2', {domain}, CASE WHEN regexp_matches(lower(coalesce(canonical_key, '')), '^mav2:[0-9a-f]{{24}}:[0-9a-f]{{40}}$') THEN split_part(lower(canonical_key), ':', 3) ELSE sha1('x') END) AS rekeyed FROM memories""",
        "cjk_bigrams": r"""WITH r AS (SELECT id, unnest(regexp_extract_all(content, '[\x{4e00}-\x{9fff}]{2,}')) AS run, generate_subscripts(regexp_extract_all(content, '[\x{4e00}-\x{9fff}]{2,}'), 1) AS k FROM memories),
g AS (SELECT id, k, unnest(list_transform(range(1, length(run)), lambda i: substr(run, i, 2))) AS bigram, unnest(range(1, length(run))) AS i FROM r),
f AS (SELECT id, bigram, min(k * 100000 + i) AS pos FROM g GROUP BY 1, 2), n AS (SELECT id, bigram, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS place FROM f)
SELECT id, CAST(place AS INT) AS place, bigram FROM n WHERE place < 512""",
        "query_terms": r"""WITH w AS (SELECT ref_id, unnest(regexp_extract_all(lower(known_text), '[a-z0-9_]+|[\x{4e00}-\x{9fff}]{2,}')) AS w, generate_subscripts(regexp_extract_all(lower(known_text), '[a-z0-9_]+|[\x{4e00}-\x{9fff}]{2,}'), 1) AS k FROM known_strings),
s AS (SELECT ref_id, k, unnest(CASE WHEN regexp_matches(w, '^[\x{4e00}-\x{9fff}]{4,}$') THEN list_append(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), w) ELSE [w] END) AS term,
  generate_subscripts(CASE WHEN regexp_matches(w, '^[\x{4e00}-\x{9fff}]{4,}$') THEN list_append(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), w) ELSE [w] END, 1) AS i FROM w),
f AS (SELECT ref_id, term, min(k * 100000 + i) AS pos FROM s WHERE length(term) >= 2 GROUP BY 1, 2), n AS (SELECT ref_id, term, row_number() OVER (PARTITION BY ref_id ORDER BY pos) - 1 AS place FROM f)
SELECT ref_id, CAST(place AS INT) AS place, term FROM n WHERE place < 24""",
        "redact_text": f"""SELECT id, {_redacted("content || '" + SECRETS.replace("'", "''") + " PASSWORD=' || id")} AS clean FROM timeline""",
        "time_windows": f"""WITH q AS (SELECT id, (exported_at AT TIME ZONE 'Asia/Shanghai')::DATE AS d, unnest(range({len(QUESTIONS)})) AS n FROM chat_import_batches WHERE exported_at IS NOT NULL),
w AS (SELECT id, n::INT AS n, d, CASE n WHEN 0 THEN 'day_before_yesterday' WHEN 1 THEN 'yesterday' WHEN 2 THEN 'today' WHEN 3 THEN 'previous_month' WHEN 4 THEN 'current_month' WHEN 5 THEN 'recent_month' WHEN 6 THEN 'previous_week' WHEN 7 THEN 'current_week' WHEN 8 THEN 'recent_week' WHEN 9 THEN 'recent_15_days' WHEN 10 THEN 'recent_60_days'
  WHEN 11 THEN 'recent_3_days' WHEN 12 THEN 'recent_few_days' WHEN 13 THEN 'recent_default_summary' END AS source, n IN (0, 1, 4, 6, 13) AS summary_like FROM q),
e AS (SELECT *, CASE n WHEN 0 THEN d - 2 WHEN 1 THEN d - 1 WHEN 2 THEN d WHEN 3 THEN date_trunc('month', d) - INTERVAL 1 MONTH WHEN 4 THEN date_trunc('month', d) WHEN 5 THEN d - 30 WHEN 6 THEN date_trunc('week', d) - INTERVAL 7 DAY WHEN 7 THEN date_trunc('week', d) WHEN 8 THEN d - 7 WHEN 9 THEN d - 15 WHEN 10 THEN d - 60 WHEN 11 THEN d - 3 WHEN 12 THEN d - 3 WHEN 13 THEN d - 7 END::TIMESTAMP AS s,
  CASE WHEN n = 0 THEN d - 1 WHEN n = 1 THEN d WHEN n = 3 THEN date_trunc('month', d) WHEN n = 6 THEN date_trunc('week', d) WHEN n <= 13 THEN d + 1 END::TIMESTAMP AS t FROM w)
SELECT id, n, source, s AT TIME ZONE 'Asia/Shanghai' AS start_at, t AT TIME ZONE 'Asia/Shanghai' AS end_at, summary_like FROM e""",
        "dated_texts": f"SELECT id, {_dated()} AS text FROM (SELECT id, '昨晚和今天下午，明天早上；昨天' || content AS text, created_at::DATE AS d FROM memories WHERE content IS NOT NULL AND created_at IS NOT NULL)",
        "merged_tags": """WITH t AS (SELECT id, list_concat(coalesce(tags, []), [upper(tags[1]), 'Extra', memory_type]) AS l FROM memories), u AS (SELECT id, trim(unnest(l)) AS t, unnest(range(1, len(l) + 1)) AS i FROM t),
f AS (SELECT id, lower(t) AS low, first(t ORDER BY i) AS t, min(i) AS i FROM u WHERE t <> '' GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM f) SELECT id, string_agg(t, '|' ORDER BY i) FILTER (k <= 4) AS terms FROM n GROUP BY id""",
        "redact_metadata": f"""SELECT id, metadata->>'trace' AS trace, metadata->>'message_id' AS message_id, '[REDACTED]' AS db_password, 'password: [REDACTED]' AS remark FROM timeline WHERE metadata LIKE '{{"%'""",
        "session_scopes": """WITH k AS (SELECT unnest([session_id, 'x:Group:y:' || p, 'x:PrivateMessage:' || p, 'x:friend:' || p, 'x:MyGroup:' || p, 'p:GroupMessage:friend:' || p]) AS k FROM (SELECT session_id, split_part(session_id, ':', -1) AS p FROM timeline WHERE session_id IS NOT NULL)),
l AS (SELECT k, lower(k) AS l FROM k), s AS (SELECT CASE WHEN contains(l, ':groupmessage:') OR contains(l, ':group:') THEN 'group' WHEN contains(l, ':friendmessage:') OR contains(l, ':privatemessage:') OR contains(l, ':friend:') OR contains(l, ':private:') THEN 'private' ELSE 'unknown' END AS scope,
  CASE WHEN contains(l, ':groupmessage:') THEN regexp_extract(k, '(?i)^.*:groupmessage:(.*)$', 1) WHEN contains(l, ':group:') THEN split_part(k, ':', -1) WHEN contains(l, ':friendmessage:') THEN regexp_extract(k, '(?i)^.*:friendmessage:(.*)$', 1)
    WHEN contains(l, ':privatemessage:') THEN regexp_extract(k, '(?i)^.*:privatemessage:(.*)$', 1) WHEN contains(l, ':friend:') OR contains(l, ':private:') THEN split_part(k, ':', -1) ELSE '' END AS target FROM l)
SELECT scope, target, count(*) AS n FROM s GROUP BY 1, 2""",
        "normalised_status": """WITH v AS (SELECT 'validity' AS field, lower(trim(unnest([validity_status, NULL, '', ' Deleted ', 'PRIVATE', upper(validity_status), 'odd']))) AS v FROM memories), s AS (SELECT 'sensitivity' AS field, lower(trim(unnest([sensitivity, NULL, '', ' Deleted ', 'PRIVATE', upper(sensitivity), 'odd']))) AS v FROM memories),
r AS (SELECT field, CASE WHEN coalesce(v, '') = '' THEN 'active' WHEN v IN ('active', 'superseded', 'expired', 'archived', 'deleted', 'quarantined') THEN v ELSE 'quarantined' END AS value FROM v
UNION ALL SELECT field, CASE WHEN coalesce(v, '') = '' THEN 'private' WHEN v IN ('public', 'internal', 'private', 'restricted') THEN v ELSE 'restricted' END FROM s) SELECT field, value, count(*) AS n FROM r GROUP BY 1, 2""",
        "durability_levels": """WITH k AS (SELECT lower(trim(unnest([memory_type, 'Open_Loop', 'current_state']))) AS k, lower(trim(durability)) AS d FROM memories)
SELECT CASE WHEN k IN ('manual_memory', 'explicit_memory') THEN 'pinned' WHEN k IN ('user_profile', 'user_preference', 'relationship_claim', 'promise', 'open_loop', 'creative_work') THEN 'durable' WHEN k IN ('emotion_state', 'current_state', 'schedule_fragment', 'bot_detail_fragment', 'proactive_message') THEN 'short'
  WHEN k IN ('raw_event', 'timeline_event') THEN 'ephemeral' WHEN d IN ('ephemeral', 'short', 'normal', 'durable', 'pinned') THEN d ELSE 'normal' END AS level, count(*) AS n FROM k GROUP BY 1""",
    }
