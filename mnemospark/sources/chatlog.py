"""Readers of chat exports: text logs, JSON exports and already structured rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timestamps import resolve_times

LINE_BLOCK = 8192
MAX_CONTENT = 16_000
#: A header line: a speaker, a colon and a full or short date with time.
HEADER = r"^(.{1,80}?)[:：]\s*((?:\d{4}-)?\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2})\s*$"

JSON_EXPORT = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("type", T.StringType()),
        T.StructField("sender", T.StructType([T.StructField("uid", T.StringType()), T.StructField("uin", T.StringType()), T.StructField("name", T.StringType())])),
        T.StructField("content", T.StructType([T.StructField("text", T.StringType())])), T.StructField("recalled", T.BooleanType()), T.StructField("system", T.BooleanType()),
    ]))),
])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, each split where it is read."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "line"))


def parse_lines(lines: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Messages of text logs: file, sequence, speaker, raw_time, content, source_line, utc_us, message_id, inferred_year.

    A header line opens a message, the lines up to the next are its body; lines
    before the first header belong to none. Bodies above ``MAX_CONTENT``
    characters are cut to it, and n_cut tells how many characters that took. Times without year are the nearest to the message
    before. A file's lines are numbered in blocks, the last header of each
    block being carried on, so a file of any length is many tasks.
    """
    rows = lines.select("file", F.col("line_no").cast("bigint").alias("line_no"), F.regexp_extract("line", HEADER, 1).alias("speaker"), F.regexp_extract("line", HEADER, 2).alias("raw_time"), "line").withColumn("block", F.floor(F.col("line_no") / LINE_BLOCK))
    inner = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("head", F.last(F.when(F.col("raw_time") != "", F.col("line_no")), ignorenulls=True).over(inner))
    tails = marked.groupBy("file", "block").agg(F.max("head").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("carried", F.max("last").over(before)).select(F.col("file").alias("f"), F.col("block").alias("b"), "carried")
    joined = marked.join(carried, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn("head", F.coalesce("head", "carried")).where("head is not null")
    body = F.array_sort(F.collect_list(F.when(F.col("line_no") > F.col("head"), F.struct("line_no", "line"))))
    messages = joined.groupBy("file", "head").agg(F.max(F.when(F.col("line_no") == F.col("head"), F.col("speaker"))).alias("speaker"), F.max(F.when(F.col("line_no") == F.col("head"), F.col("raw_time"))).alias("raw_time"), body.alias("body"))
    whole = F.regexp_replace(F.array_join(F.transform("body", lambda x: x["line"]), "\n"), r"\s+$", "")
    content, beyond = F.substring(whole, 1, MAX_CONTENT), F.greatest(F.lit(0), F.length(whole) - MAX_CONTENT)
    messages = messages.select("file", F.col("head").alias("sequence"), F.trim("speaker").alias("speaker"), "raw_time", content.alias("content"), beyond.alias("n_cut"), F.col("head").alias("source_line"), (F.length("raw_time") < 17).alias("inferred_year"))
    keyed = messages.withColumn("row_id", F.concat_ws("#", "file", "sequence"))
    spark = lines.sparkSession
    known = batches if batches is not None else spark.createDataFrame([], "id string, locale string, source_timezone string, base_year int, exported_at timestamp")
    times = resolve_times(keyed.withColumnRenamed("file", "import_batch_id"), known, "row_id").withColumnRenamed("row_id", "__r")
    return keyed.join(times, F.col("row_id") == F.col("__r")).drop("row_id", "__r").withColumn("message_id", F.concat(F.lit("hist_"), F.substring(F.sha1(F.concat_ws("|", "file", "source_line", "speaker", "raw_time", "content")), 1, 16)))


def parse_report(messages: DataFrame) -> DataFrame:
    """Per file: messages, empty ones, inferred years, unresolved times and how many messages share their time with another."""
    per = messages.groupBy("file", "utc_us").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("content") == "").alias("e"), F.count_if("inferred_year").alias("y"))
    return per.groupBy("file").agg(F.sum("n").alias("n"), F.sum("e").alias("n_empty"), F.sum("y").alias("n_inferred"), F.sum(F.when(F.col("utc_us").isNull(), F.col("n")).otherwise(0)).alias("n_unresolved"), F.count_if((F.col("n") > 1) & F.col("utc_us").isNotNull()).alias("n_shared_times"))


def read_json_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON exports, one document per file: recalled and system rows and those without text left out."""
    docs = spark.read.schema(JSON_EXPORT).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("messages").alias("sequence", "m"))
    rows = docs.where(~F.coalesce("m.recalled", F.lit(False)) & ~F.coalesce("m.system", F.lit(False)) & (F.trim(F.coalesce("m.content.text", F.lit(""))) != ""))
    return rows.select("file", F.col("sequence").cast("bigint").alias("sequence"), F.coalesce("m.sender.name", "m.sender.uin", "m.sender.uid").alias("speaker"), (F.col("m.timestamp") * 1000).alias("utc_us"), F.col("m.content.text").alias("content"), F.col("m.id").alias("message_id"))


def structured(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Already structured rows under our names; absent columns are null."""
    wanted = {"file": "string", "sequence": "bigint", "speaker": "string", "utc_us": "bigint", "content": "string", "message_id": "string"}
    return rows.select(*[(F.col(mapping[n]) if n in mapping else F.lit(None)).cast(t).alias(n) for n, t in wanted.items()])


def choose_columns(df: DataFrame) -> dict[str, str]:
    """Which of a foreign table's columns hold content, session, speaker and time, by name; absent roles are left out."""
    roles = {"content": ("content", "text", "message", "body", "summary", "memory"), "session_id": ("session_id", "session", "conversation_id", "chat_id"), "speaker": ("speaker", "sender", "author", "persona_id", "user_name"), "occurred_at": ("occurred_at", "created_at", "timestamp", "time", "date")}
    names = {c.lower(): c for c in df.columns}
    return {role: next(names[n] for n in options if n in names) for role, options in roles.items() if any(n in names for n in options)}
