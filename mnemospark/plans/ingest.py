"""Queries of sources, archives and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ensure_checkpoint_dir, table
from ..sources import archive, chatlog
from ..streaming import ingest


def jsonl_counts(spark, sf_dir):
    names = ("memories", "identities", "timeline")
    return archive.counts(archive.records({n: table(spark, sf_dir, n) for n in names}))


def jsonl_round_trip(spark, sf_dir):
    """Three whole tables written to an archive in the shared folder and read again after its header has been checked."""
    ensure_checkpoint_dir(spark)
    tables = {n: table(spark, sf_dir, n) for n in ("memories", "identities", "chat_import_batches")}
    path = f"{spark.sparkContext.getCheckpointDir()}/archive-{uuid.uuid4().hex}"
    archive.write(tables, path)
    rows = archive.read(spark, path)
    back = {n: archive.table_of(rows, n, df.schema) for n, df in tables.items()}
    out = [
        back["memories"].select(F.lit("memories").alias("name"), "id", F.col("subject.name").alias("text"), F.concat_ws("|", "tags").alias("list"), "confidence", "created_at"),
        back["identities"].select(F.lit("identities").alias("name"), "id", F.col("display_name").alias("text"), F.concat_ws("|", "aliases").alias("list"), "confidence", "created_at"),
        back["chat_import_batches"].select(F.lit("batches").alias("name"), "id", F.col("stats").alias("text"), F.lit("").alias("list"), F.col("base_year").cast("double").alias("confidence"), "created_at"),
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _logs(spark, sf_dir):
    """The parsed histories written as text logs in local time: two lines and a blank one per message, of which every other has a short header without year."""
    rows = table(spark, sf_dir, "parsed_messages").where("import_batch_id is not null and speaker is not null and occurred_at is not null")
    local = F.from_utc_timestamp("occurred_at", "Asia/Shanghai")
    rows = rows.select(F.col("import_batch_id").alias("file"), "speaker", "content", "occurred_at", "row_id", local.alias("local"), F.unix_date(F.to_date(local)).alias("day"))
    # Numbered within a day, so that no task holds a history; the first message of a day has a full header.
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("file", "day").orderBy("occurred_at", "row_id")))
    stamp = F.when(F.col("nth") % 2 == 0, F.date_format("local", "MM-dd HH:mm:ss")).otherwise(F.date_format("local", "yyyy-MM-dd HH:mm:ss"))
    lines = F.array(F.concat("speaker", F.lit(": "), stamp), F.regexp_replace(F.coalesce("content", F.lit("")), r"[\r\n]+", " "), F.lit(""))
    return rows.select("file", "day", "nth", F.posexplode(lines).alias("p", "line")).select("file", ((F.col("day").cast("bigint") * 1_000_000 + F.col("nth")) * 3 + F.col("p")).alias("line_no"), "line")


def chat_parse(spark, sf_dir):
    parsed = chatlog.parse_lines(_logs(spark, sf_dir))
    return parsed.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"), F.countDistinct("speaker").alias("n_speakers"), F.count("utc_us").alias("n_resolved"), F.count_if("inferred_year").alias("n_inferred"), F.sum(F.floor(F.col("utc_us") / 1_000_000)).alias("seconds")
    )


def schema_roles(spark, sf_dir):
    rows = [(n, role, column) for n in ("timeline", "memories", "parsed_messages", "documents") for role, column in chatlog.choose_columns(table(spark, sf_dir, n)).items()]
    return spark.createDataFrame(rows, "table_name string, role string, column_name string")


def _drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and reads what it wrote; both folders are in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _stream(spark, sf_dir, name, *columns):
    """A table as a stream of files: the single file or the directory it is."""
    base = table(spark, sf_dir, name)
    return spark.readStream.schema(base.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet").select(*columns)


def stream_ingest(spark, sf_dir):
    rows = _stream(spark, sf_dir, "timeline", "id", "dedupe_key", "created_at").where("dedupe_key is not null")
    return _drain(spark, ingest.deduplicated(rows, ["dedupe_key"], "created_at", "30 days")).select("dedupe_key")


def queries() -> dict:
    named = (jsonl_counts, jsonl_round_trip, chat_parse, schema_roles, stream_ingest)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "jsonl_counts": "SELECT 'memories' AS record_type, count(*) AS n FROM memories UNION ALL SELECT 'identities', count(*) FROM identities UNION ALL SELECT 'timeline', count(*) FROM timeline",
        "jsonl_round_trip": """SELECT 'memories' AS name, id, subject.name AS text, coalesce(array_to_string(tags, '|'), '') AS list, confidence, created_at FROM memories UNION ALL SELECT 'identities', id, display_name, coalesce(array_to_string(aliases, '|'), ''), confidence, created_at FROM identities
UNION ALL SELECT 'batches', id, stats, '', base_year::DOUBLE, created_at FROM chat_import_batches""",
        "chat_parse": r"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY import_batch_id, (occurred_at AT TIME ZONE 'Asia/Shanghai')::DATE ORDER BY occurred_at, row_id) AS nth FROM parsed_messages WHERE import_batch_id IS NOT NULL AND speaker IS NOT NULL AND occurred_at IS NOT NULL)
SELECT import_batch_id AS file, count(*) AS n, sum(length(rtrim(regexp_replace(coalesce(content, ''), '[\r\n]+', ' ', 'g'))))::BIGINT AS n_chars, count(DISTINCT trim(speaker)) AS n_speakers, count(*) AS n_resolved, count(*) FILTER (nth % 2 = 0) AS n_inferred, sum(epoch_us(occurred_at) // 1000000)::BIGINT AS seconds FROM m GROUP BY 1""",
        "stream_ingest": "SELECT DISTINCT dedupe_key FROM timeline WHERE dedupe_key IS NOT NULL",
    }
