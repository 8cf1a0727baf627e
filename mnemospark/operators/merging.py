"""Keyed merges: records, identities, relationships and edges, all combinable map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(value: str, at: Column) -> Column:
    """The value of the row seen last; nulls never win over values."""
    return F.max_by(value, F.struct(F.col(value).isNotNull(), at, F.col("id")))


def merge_records(records: DataFrame, key: str = "content_fingerprint") -> DataFrame:
    """One row per key: best importance and confidence, newest text, first and last time, copies; rows without key stay alone."""
    rows = records.withColumn("__key", F.coalesce(F.col(key), F.concat(F.lit("id:"), "id")))
    at = F.coalesce("updated_at", "created_at")
    return rows.groupBy("__key").agg(
        F.min("id").alias("id"), latest("content", at).alias("content"), F.max("importance").alias("importance"), F.max("confidence").alias("confidence"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
        F.sum(F.coalesce("merged_count", F.lit(1))).alias("merged_count"), F.count(F.lit(1)).alias("n_rows"),
    ).drop("__key")


def repair_duplicates(records: DataFrame, key: str) -> DataFrame:
    """(id, keep_id) of rows that repeat another's key; the row merged most, most important and oldest stays."""
    best = F.min_by("id", F.struct(-F.coalesce("merged_count", F.lit(0)), -F.coalesce("importance", F.lit(0.0)), F.col("created_at").isNull(), F.col("created_at"), F.col("id")))
    keyed = records.where(F.col(key).isNotNull())
    keep = keyed.groupBy(F.col(key).alias("__k")).agg(best.alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(keep, F.col(key) == F.col("__k")).where("id <> keep_id").select("id", "keep_id")


def merge_identities(identities: DataFrame) -> DataFrame:
    """One row per (platform, entity_kind, entity_id): all aliases, the newest name and role, best confidence."""
    at = F.coalesce("updated_at", "created_at")
    alias = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("display_name")), lambda a: a.isNotNull())))))
    return identities.groupBy("platform", "entity_kind", "entity_id").agg(latest("display_name", at).alias("display_name"), latest("role", at).alias("role"), F.max("confidence").alias("confidence"), alias.alias("aliases"))


#: What a relationship is told apart by.
RELATION = ("subject_kind", "subject_id", "object_kind", "object_id", "relation_type", "scope", "session_id")


def merge_relationships(observed: DataFrame, order: str = "seen_at") -> DataFrame:
    """One row per relationship (``RELATION``; null counts as ''): the greatest confidence, held to [0, 1], and everything else of the observation seen last.

    ``observed`` further has subject_name, object_name, visibility, evidence,
    confidence, review_status, source_memory_id, metadata (a flat JSON object),
    id and ``order``. Metadata are merged field by field, the later value
    winning; group_id, created_at and id stay those of the first observation.
    All aggregates combine map-side; no array of a key's rows is built.
    """
    rows = observed.withColumns({c: F.coalesce(c, F.lit("")) for c in RELATION}).withColumn("__at", F.struct(order, "id"))
    told = ("subject_name", "object_name", "visibility", "evidence", "review_status", "source_memory_id")
    merged = rows.groupBy(*RELATION).agg(
        F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))).alias("confidence"), F.max_by(F.struct(*told), "__at").alias("told"), F.min_by(F.struct("id", "group_id", F.col(order).alias("created_at")), "__at").alias("first"), F.max(order).alias("updated_at"), F.count(F.lit(1)).alias("n_observed")
    )
    fields = rows.select(*RELATION, "__at", F.explode(F.from_json("metadata", "map<string,string>")).alias("field", "value"))
    fields = fields.groupBy(*RELATION, "field").agg(F.max_by("value", "__at").alias("value")).groupBy(*RELATION).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("metadata"))
    return merged.join(fields, list(RELATION), "left").select("first.*", *RELATION, "told.*", "confidence", "updated_at", "n_observed", F.to_json(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("metadata"))


def single_value_conflicts(records: DataFrame, domain: list[str], value: str) -> DataFrame:
    """Domains that hold more than one active value."""
    active = records.where("validity_status = 'active' and lifecycle <> 'archived'")
    return active.groupBy(*domain).agg(F.countDistinct(value).alias("n_values"), F.count(F.lit(1)).alias("n_rows")).where("n_values > 1")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` with the last change per key in place of, or beside, its rows; both have the same columns."""
    nth = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    last = changes.withColumn("__n", F.row_number().over(nth)).where("__n = 1").drop("__n")
    return current.join(last.select(*keys), keys, "left_anti").select(*current.columns).unionByName(last)


def fold_reactions(reactions: DataFrame, low: float = 0.0, high: float = 1.0, start: float = 0.5) -> DataFrame:
    """(key, level) after all bounded deltas in order, each source once: the level is held to [low, high] at every step.

    Composed bounded additions stay of the form min(c, max(b, x + a)), so a
    stretch of deltas is three numbers. Rows are put into stretches by range,
    which divides a busy key, each stretch is folded by itself, and then the
    stretches of a key, of which there is at most one per partition.
    """
    once = reactions.groupBy("key", "source_id").agg(F.min(F.struct("at", "delta")).alias("e")).select("key", F.col("e.at").alias("at"), "source_id", F.col("e.delta").alias("delta"))
    placed = once.repartitionByRange("key", "at", "source_id").withColumn("part", F.spark_partition_id())
    nothing = F.struct(F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("b"), F.lit(float("inf")).alias("c"))
    held = lambda x, f: F.least(f["c"], F.greatest(f["b"], x + f["a"]))

    def after(f: Column, g: Column) -> Column:
        return F.struct((f["a"] + g["a"]).alias("a"), held(f["b"], g).alias("b"), held(f["c"], g).alias("c"))

    bounded = lambda e: F.struct(e["delta"].alias("a"), F.lit(low).alias("b"), F.lit(high).alias("c"))
    stretch = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "source_id", "delta"))), nothing, lambda f, e: after(f, bounded(e)))
    stretches = placed.groupBy("key", "part").agg(stretch.alias("f"))
    return stretches.groupBy("key").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("part", "f"))), F.lit(start), lambda x, s: held(x, s["f"])).alias("level"))
