"""A portable archive: one JSON record per line, a header with counts first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, VERSION = "conversation-archive", 1


def records(tables: dict[str, DataFrame]) -> DataFrame:
    """(record_type, data) of all tables, data as JSON."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("record_type"), F.to_json(F.struct(*df.columns)).alias("data"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no tables")
    return out


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Writes records and, beside them, a header with the counts. Counts are few; records are written by all tasks."""
    rows = records(tables)
    rows.select(F.to_json(F.struct("record_type", "data")).alias("value")).write.mode("error").text(f"{path}/records")
    head = F.to_json(F.struct(F.lit("header").alias("record_type"), F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_type", "n")))).alias("counts")))
    counts(rows).agg(head.alias("value")).coalesce(1).write.mode("error").text(f"{path}/header")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, data) of an archive, after its format, version and counts have been checked."""
    head = spark.read.schema("record_type string, format string, version int, counts map<string,bigint>").json(f"{path}/header").first()
    if head is None or head.format != FORMAT or head.version != VERSION:
        raise ValueError(f"{path} is no {FORMAT} of version {VERSION}")
    rows = spark.read.schema("record_type string, data string").json(f"{path}/records")
    found = {r.record_type: r.n for r in counts(rows).collect()}
    if found != dict(head.counts):
        raise ValueError(f"{path} declares {dict(head.counts)} and holds {found}")
    return rows


def table_of(rows: DataFrame, name: str, schema) -> DataFrame:
    """One record type as a table again; fields that don't fit the schema are null."""
    return rows.where(F.col("record_type") == name).select(F.from_json("data", schema).alias("x")).select("x.*")
