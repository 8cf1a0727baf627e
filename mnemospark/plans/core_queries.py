"""Queries of the general data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import redelivered, seen_ranges
from ..operators.sessions import activity_sessions
from ..operators.timestamps import repairs, resolve_times
from ..runtime import cut, table


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "staged_messages", "row_id", "import_batch_id", "sequence", "raw_time", "occurred_at")
    batches = table(spark, sf_dir, "chat_import_batches", "id", "locale", "source_timezone", "base_year", "exported_at")
    return rows, resolve_times(rows, batches)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, resolved = _resolved(spark, sf_dir)
    return repairs(rows, resolved)


def p3_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[1].select("row_id", F.timestamp_micros("utc_us").alias("utc"), F.col("utc_us").isNotNull().alias("resolved"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "timeline", "id", "event_type", "session_id", "subject_id", "message_id", "dedupe_key", "created_at")
    return redelivered(rows).select("id")


def p5_seen_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "timeline", "event_type", "session_id", "subject_id", "message_id")
    ranges = seen_ranges(rows)
    return ranges.groupBy("producer").agg(F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n_numbers")).groupBy("n_ranges").agg(
        F.count(F.lit(1)).alias("n_producers"), F.sum("n_numbers").alias("n_numbers")
    )


#: Between the two batches of p5_batches.
BATCH_EDGE = "2026-05-15 00:00:00"


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to drop where the rows that arrived before an instant are one batch and the others a second, which knows the first by its ledger only."""
    rows = table(spark, sf_dir, "timeline", "id", "event_type", "session_id", "subject_id", "message_id", "dedupe_key", "created_at")
    early = F.coalesce(F.col("created_at") < F.lit(BATCH_EDGE).cast("timestamp"), F.lit(False))
    first, second = rows.where(early), rows.where(~early)
    ledger = cut(seen_ranges(first, dedupe="dedupe_key"))
    told = redelivered(first).withColumn("batch", F.lit(1)).unionByName(redelivered(second, ledger=ledger).withColumn("batch", F.lit(2)))
    return told.select("id", "batch", F.col("kept_id").isNull().alias("seen_before"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_messages", "import_batch_id", "speaker", "occurred_at")
    sessions = activity_sessions(rows.where("speaker is not null"), ["import_batch_id", "speaker"], "occurred_at")
    return sessions.select("import_batch_id", "speaker", F.floor(F.col("start_us") / 1000).alias("start_ms"), F.floor(F.col("end_us") / 1000).alias("end_ms"))


def p6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_messages", "import_batch_id", "speaker", "occurred_at")
    return activity_sessions(rows, ["import_batch_id", "speaker"], "occurred_at").select("import_batch_id", "speaker", "session_no", "duration_us", "n_events")


SESSION_SQL = """
WITH m AS (
  SELECT import_batch_id, speaker, epoch_us(occurred_at) AS us FROM parsed_messages
  WHERE import_batch_id IS NOT NULL AND speaker IS NOT NULL AND occurred_at IS NOT NULL
), f AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 7200000000 THEN 0 ELSE 1 END AS new
  FROM m WINDOW w AS (PARTITION BY import_batch_id, speaker ORDER BY us)
), s AS (
  SELECT *, sum(new) OVER (PARTITION BY import_batch_id, speaker ORDER BY us ROWS UNBOUNDED PRECEDING) AS session_no FROM f
)
"""


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_times, p5_found, p5_batches, p5_seen_ranges, p6_found, p6_sessions)}


def oracle_sql() -> dict[str, str]:
    whole = "session_id || chr(31) || subject_id || chr(31) || event_type || chr(31) || message_id"
    return {
        "p5_batches": f"""
WITH RECURSIVE r AS (
  SELECT id, created_at, dedupe_key AS a, CASE WHEN coalesce(created_at < '{BATCH_EDGE}'::TIMESTAMPTZ, false) THEN 1 ELSE 2 END AS batch, {whole} AS b FROM timeline
), link AS (
  SELECT x.id AS x, y.id AS y FROM r x JOIN r y ON x.a = y.a AND x.batch = y.batch WHERE x.id <> y.id
  UNION SELECT x.id, y.id FROM r x JOIN r y ON x.b = y.b AND x.batch = y.batch WHERE x.id <> y.id
), reach AS (
  SELECT id AS s, id AS t FROM r UNION SELECT reach.s, link.y FROM reach JOIN link ON link.x = reach.t
), seen AS (
  SELECT id FROM r WHERE batch = 2 AND (a IN (SELECT a FROM r WHERE batch = 1 AND a IS NOT NULL) OR b IN (SELECT b FROM r WHERE batch = 1 AND b IS NOT NULL))
), best AS (
  SELECT reach.s, r.batch, first(r.id ORDER BY r.created_at, r.id) AS keep, bool_or(seen.id IS NOT NULL) AS seen_before
  FROM reach JOIN r ON r.id = reach.t LEFT JOIN seen ON seen.id = r.id GROUP BY reach.s, r.batch
)
SELECT s AS id, batch, seen_before FROM best WHERE seen_before OR s <> keep""",
        "p5_seen_ranges": r"""
WITH m AS (
  SELECT session_id, subject_id, event_type, regexp_extract(message_id, '^((?:.*[g-zG-Z_:\-])?)([0-9a-f]{1,13})$', 1) AS stem, regexp_extract(message_id, '^((?:.*[g-zG-Z_:\-])?)([0-9a-f]{1,13})$', 2) AS digits
  FROM timeline WHERE session_id IS NOT NULL AND subject_id IS NOT NULL AND event_type IS NOT NULL AND message_id IS NOT NULL
), n AS (
  SELECT DISTINCT session_id, subject_id, event_type, stem, ('0x' || digits)::BIGINT AS n FROM m WHERE digits = '0' OR (digits <> '' AND digits[1] <> '0')
), i AS (
  SELECT *, n - row_number() OVER (PARTITION BY session_id, subject_id, event_type, stem, n // 65536 ORDER BY n) AS island FROM n
), g AS (
  SELECT session_id, subject_id, event_type, stem, n // 65536 AS block, island, count(*) AS k FROM i GROUP BY ALL
), p AS (
  SELECT session_id, subject_id, event_type, stem, count(*) AS n_ranges, sum(k)::BIGINT AS k FROM g GROUP BY 1, 2, 3, 4
)
SELECT n_ranges, count(*) AS n_producers, sum(k)::BIGINT AS n_numbers FROM p GROUP BY n_ranges""",
        "p5_found": """
WITH RECURSIVE r AS (
  SELECT id, created_at, dedupe_key AS a,
         CASE WHEN session_id IS NOT NULL AND subject_id IS NOT NULL AND message_id IS NOT NULL AND event_type IS NOT NULL
              THEN session_id || chr(31) || subject_id || chr(31) || event_type || chr(31) || message_id END AS b
  FROM timeline
), link AS (
  SELECT x.id AS x, y.id AS y FROM r x JOIN r y ON x.a = y.a WHERE x.id <> y.id
  UNION SELECT x.id, y.id FROM r x JOIN r y ON x.b = y.b WHERE x.id <> y.id
), reach AS (
  SELECT x AS s, x AS t FROM link
  UNION SELECT reach.s, link.y FROM reach JOIN link ON link.x = reach.t
), best AS (
  SELECT reach.s, first(r.id ORDER BY r.created_at, r.id) AS keep FROM reach JOIN r ON r.id = reach.t GROUP BY reach.s
)
SELECT s AS id FROM best WHERE s <> keep""",
        "p6_found": SESSION_SQL + """SELECT import_batch_id, speaker, min(us) // 1000 AS start_ms, max(us) // 1000 AS end_ms
FROM s GROUP BY import_batch_id, speaker, session_no""",
        "p6_sessions": SESSION_SQL + """SELECT import_batch_id, speaker, CAST(session_no AS BIGINT) AS session_no,
  max(us) - min(us) AS duration_us, count(*) AS n_events
FROM s GROUP BY import_batch_id, speaker, session_no""",
    }
