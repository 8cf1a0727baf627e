"""Copy-on-write tables in plain Parquet: each change is a new version, the version is the revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merging import upsert


class VersionedTable:
    """A directory of versions v=1, v=2, ...; a version is complete once its _SUCCESS is there.

    Readers see the newest complete version, so a failed write changes
    nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    @property
    def revision(self) -> int:
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        number = self.revision if version is None else version
        if not number:
            raise ValueError(f"{self.path} has no version")
        return self.spark.read.parquet(f"{self.path}/v={number}")

    def write(self, df: DataFrame) -> int:
        number = self.revision + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        return number

    def upsert(self, changes: DataFrame, keys: list[str], order: str) -> int:
        return self.write(upsert(self.read(), changes, keys, order))

    def delete(self, where: Column) -> int:
        return self.write(self.read().where(~F.coalesce(where, F.lit(False))))

    def update(self, where: Column, values: dict[str, Column]) -> int:
        return self.write(self.read().withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()}))

    def restore(self, version: int) -> int:
        return self.write(self.read(version))
