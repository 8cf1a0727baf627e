"""Queries of the text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import conversations as talks
from . import neardup
from .canonical import canonicalise, recognise
from .mixing import mix, mix_report
from .packing import fill_report, pack_documents
from .personal import personal_kinds, redact
from .sentences import sentences
from .tokens import with_token_counts

TIMELINE = ("id", "event_type", "session_id", "content", "message_id", "occurred_at", "created_at", "source_sequence")


#: Similarity of memories that restate the same note: 0.6, in integers.
NOTE_SIMILARITY = (3, 5)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, "memories", "id", "content"), "id", "content", *NOTE_SIMILARITY)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "memories", "id", "content"), "id", "content", *NOTE_SIMILARITY)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By its statement only rows with a session count."""
    rows = table(spark, sf_dir, "timeline", *TIMELINE).where("session_id is not null")
    found = talks.rebuild(rows)[0].where("usable")
    return found.select("session_id", F.floor(F.col("start_us") / 1000).alias("start_ms"), F.floor(F.col("end_us") / 1000).alias("end_ms"))


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations, turns = talks.rebuild(table(spark, sf_dir, "timeline", *TIMELINE))
    usable = conversations.where("usable").select("conversation", "session_id", "start_us")
    return turns.join(usable, "conversation").select("session_id", F.floor(F.col("start_us") / 1000).alias("start_ms"), "id", "role", "block", "turn")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "identities", "display_name")
    found = [personal_kinds(table(spark, sf_dir, name, "id", "content"), "id", "content", people).select(F.lit(name).alias("table_name"), "id", "kind") for name in ("timeline", "memories")]
    return found[0].unionByName(found[1])


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "identities", "display_name")
    clean = [redact(table(spark, sf_dir, name, "id", "content"), "content", people).select(F.lit(name).alias("table_name"), "id", "content") for name in ("timeline", "memories")]
    return clean[0].unionByName(clean[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(table(spark, sf_dir, "staged_messages", "row_id", "content", "speaker"), table(spark, sf_dir, "known_strings"), ["content", "speaker"])


def p7_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalise(table(spark, sf_dir, "staged_messages", "row_id", "content", "speaker"), ["content", "speaker"])


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    specs = table(spark, sf_dir, "pack_specs", "spec_id", "capacity_tokens")
    return pack_documents(with_token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), "text"), specs), specs


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(*_packed(spark, sf_dir))


# What a source's texts are about.
DOMAINS = {"chat_summary": "talk", "group_digest": "talk", "voice_memo": "talk", "diary_note": "self", "persona_card": "self", "dream_log": "self", "import_note": "reference", "help_article": "reference"}
#: A total above the reachable one, so that sources run short and others of their domain stand in.
STRETCH = 1.5


def _mixed(spark: SparkSession, sf_dir: str, stretch: float = 1.0) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mix(with_token_counts(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), "text"), targets, domains=DOMAINS, stretch=stretch), targets


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(*_mixed(spark, sf_dir))


def p9_shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(*_mixed(spark, sf_dir, STRETCH))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_turns, p4_found, p4_redacted, p7_found, p7_canonical, p8_pack, p8_report, p9_mix, p9_report, p9_shortage, p10_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
WITH r AS (
  SELECT id, unnest(regexp_extract_all(regexp_replace(lower(content), '([\x{4e00}-\x{9fff}]+)', ' \1 ', 'g'), '[\p{L}\p{N}]+')) AS run FROM memories
), t AS (
  SELECT DISTINCT id, tok FROM (
    SELECT id, unnest(list_transform(range(1, length(run)), lambda i: substr(run, i, 2))) AS tok
    FROM r WHERE regexp_matches(run, '^[\x{4e00}-\x{9fff}]{2,}$')
    UNION ALL SELECT id, run FROM r WHERE NOT regexp_matches(run, '^[\x{4e00}-\x{9fff}]{2,}$'))
), n AS (SELECT id, count(*) AS n FROM t GROUP BY id
), s AS (
  SELECT x.id AS a, y.id AS b, count(*) AS shared FROM t x JOIN t y ON x.tok = y.tok AND x.id < y.id GROUP BY 1, 2
)
SELECT a AS id_a, b AS id_b FROM s JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE shared * 5 >= (p.n + q.n - shared) * 3""",
        "p2_found": r"""
WITH m AS (
  SELECT *, epoch_us(occurred_at) AS us FROM timeline
  WHERE session_id IS NOT NULL AND event_type IN ('user_message', 'bot_response', 'proactive_message')
    AND regexp_matches(content, '[^\s\p{Z}\p{Cc}\p{Cf}]') AND occurred_at IS NOT NULL
), f AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 7200000000 THEN 0 ELSE 1 END AS new
  FROM m WINDOW w AS (PARTITION BY session_id ORDER BY us, source_sequence NULLS LAST, created_at, id)
), s AS (
  SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY us, source_sequence NULLS LAST, created_at, id ROWS UNBOUNDED PRECEDING) AS n FROM f
), c AS (
  SELECT session_id, min(us) // 1000 AS start_ms, max(us) // 1000 AS end_ms, bool_or(event_type = 'user_message') AS asked,
         first(event_type ORDER BY us, source_sequence NULLS LAST, created_at, id) AS head,
         last(event_type ORDER BY us, source_sequence NULLS LAST, created_at, id) AS tail
  FROM s GROUP BY session_id, n
)
SELECT session_id, start_ms, end_ms FROM c WHERE asked AND tail = 'bot_response' AND head <> 'bot_response'""",
        "p2_turns": r"""
WITH RECURSIVE m AS (
  SELECT *, epoch_us(occurred_at) AS us, epoch_us(occurred_at) // 7200000000 AS block FROM timeline
  WHERE event_type IN ('user_message', 'bot_response', 'proactive_message') AND regexp_matches(content, '[^\s\p{Z}\p{Cc}\p{Cf}]') AND occurred_at IS NOT NULL
), f AS (
  SELECT *, CASE WHEN session_id IS NOT NULL AND us - lag(us) OVER w <= 7200000000 THEN 0 ELSE 1 END AS new
  FROM m WINDOW w AS (PARTITION BY session_id ORDER BY us, source_sequence NULLS LAST, created_at, id)
), s AS (
  SELECT *, CASE WHEN session_id IS NULL THEN 'row ' || id ELSE session_id || ' ' || sum(new) OVER (PARTITION BY session_id ORDER BY us, source_sequence NULLS LAST, created_at, id ROWS UNBOUNDED PRECEDING) END AS node FROM f
), w AS (
  SELECT node, session_id, us, lag(node) OVER q AS was, lag(us) OVER q AS was_us, lag(session_id) OVER q AS was_session FROM s
  WHERE message_id IN (SELECT message_id FROM m WHERE session_id IS NULL) WINDOW q AS (PARTITION BY message_id ORDER BY us, source_sequence NULLS LAST, created_at, id)
), l AS (
  SELECT was AS x, node AS y FROM w WHERE us - was_us <= 7200000000 AND (session_id IS NULL OR was_session IS NULL)
), b AS (SELECT x, y FROM l UNION SELECT y, x FROM l), r AS (
  SELECT DISTINCT node AS x, node AS y FROM s UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y
), c AS (SELECT x AS node, min(y) AS conversation FROM r GROUP BY x), t AS (
  SELECT s.*, conversation FROM s JOIN c USING (node)
), g AS (
  SELECT conversation, max(session_id) AS session, min(us) // 1000 AS start_ms, bool_or(event_type = 'user_message') AS asked,
         first(event_type ORDER BY us, source_sequence NULLS LAST, created_at, id) AS head, last(event_type ORDER BY us, source_sequence NULLS LAST, created_at, id) AS tail
  FROM t GROUP BY conversation
)
SELECT g.session AS session_id, start_ms, t.id, CASE WHEN event_type = 'user_message' THEN 'user' ELSE 'bot' END AS role, block,
       row_number() OVER (PARTITION BY conversation, block ORDER BY us, source_sequence NULLS LAST, created_at, id)::INT AS turn
FROM t JOIN g USING (conversation) WHERE asked AND tail = 'bot_response' AND head <> 'bot_response'""",
    }
