"""One entry to the engine: named tables and the common reads over them."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import query_terms
from .operators import gates, graph, ranking, reports, scans
from .operators.scans import Context
from .runtime import table


#: Answers that are kept, the oldest going first.
KEPT_ANSWERS = 256


@dataclass
class Engine:
    """Tables of one data directory and the reads that users make."""

    spark: SparkSession
    directory: str
    cache: OrderedDict[tuple, list[str]] = field(default_factory=OrderedDict)

    def table(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.directory, name, *columns)

    def terms(self, query: str) -> list[str]:
        row = self.spark.range(1).select(query_terms(F.lit(query)).alias("t")).first()
        return list(row.t) if row else []

    def recall(self, query: str, ctx: Context, now: Column, limit: int = 5, start: Column | None = None, end: Column | None = None) -> DataFrame:
        """The best memories that the context may see for a query."""
        found = ranking.search(self.table("memories"), self.terms(query), query, ctx, now, start, end)
        return found.select("id", "content", "score", ranking.slot(ctx).alias("slot")).orderBy(F.col("score").desc(), "id").limit(limit)

    def revision(self, name: str = "memories") -> tuple:
        """What tells one state of a table from another: its files with their lengths and times."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{name}.parquet")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))

    def recall_ids(self, query: str, ctx: Context, now: Column, limit: int = 5) -> list[str]:
        """Ids of :meth:`recall`, best first, kept per question, asker and state of the table.

        A kept answer is looked at again before it is given: what the asker may
        not see now, or what is no longer eligible at ``now``, is left out.
        """
        key = (query, ctx, limit, self.revision())
        if key not in self.cache:
            self.cache[key] = [r.id for r in self.recall(query, ctx, now, limit).collect()]
            while len(self.cache) > KEPT_ANSWERS:
                self.cache.popitem(last=False)
            return self.cache[key]
        ids = self.cache[key]
        rows = self.table("memories").where(F.col("id").isin(ids))
        still = {r.id for r in rows.where(gates.visibility(ctx)["visible"] & gates.lifecycle(ctx, now)["eligible"]).select("id").collect()}
        return [i for i in ids if i in still]

    def recall_by_slots(self, query: str, ctx: Context, now: Column, limits: dict[str, int], total: int) -> DataFrame:
        found = ranking.search(self.table("memories"), self.terms(query), query, ctx, now)
        return ranking.allot(found.select("id", "score", ranking.slot(ctx).alias("slot")), limits, total)

    def navigate(self, labels: list[str], hops: int = 2) -> DataFrame:
        """What the memory graph holds within a few steps of nodes with these labels."""
        nodes, edges = graph.build(self.table("memories"))
        starts = nodes.where(F.lower("label").isin([x.lower() for x in labels]))
        return graph.walk(edges, starts, min(hops, 3)).join(nodes, "node", "left")

    def timeline(self, limit: int = 50, **where: str) -> DataFrame:
        return scans.recent_timeline(self.table("timeline"), limit, **where)

    def stats(self) -> DataFrame:
        return reports.counts_with_total(self.table("memories"), "scope")

    def buckets(self) -> DataFrame:
        return reports.buckets(self.table("memories"))
