"""Session building, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension that does not grow with the data is broadcast.
BROADCAST_ROWS = 20_000


def build_session(app: str = "mnemospark", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints whose frames are gone are deleted.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of a data directory, pruned to ``columns`` if given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session may fall back to a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.split("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mnemospark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage and its estimated size.

    A checkpoint inherits the size that the planner guessed for the plan it came
    from, in which arrays, exploded rows and pruned scans count far too little,
    so that joins would broadcast sides that grow with the data. Without an
    estimate only sizes that AQE has measured may broadcast. Partitioning and
    order of the rows stay known.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    held = df.checkpoint(eager=True)
    jvm, plan, session = spark.sparkContext._jvm, held._jdf.queryExecution().analyzed(), held._jdf.sparkSession()
    none = jvm.scala.Option.empty()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), spark)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` after counting that it has at most ``limit`` rows; else leave the join to AQE."""
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, floored."""
    return F.floor(F.unix_micros(ts) / 1000).cast("bigint")


def fingerprint(*parts: Column) -> Column:
    """128-bit key of several columns as struct<a,b: bigint>; nulls and '' stay apart."""
    packed = [x for p in parts for x in (p.isNull(), p)]
    return F.struct(F.xxhash64(F.lit(17), *packed).alias("a"), F.xxhash64(F.lit(9173), *reversed(packed)).alias("b"))


def bench_threads() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
