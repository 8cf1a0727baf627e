"""The memory graph as two DataFrames, and bounded walks over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

TOPIC_LIMIT = 12


def _node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key)


def build(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of memories, their people, bots, windows and topics.

    nodes: node, node_type, label. edges: source, target, relation, memory_id,
    confidence. Null parts make no node; a repeated edge of a memory counts
    once; at most ``TOPIC_LIMIT`` tags of a memory become topics.
    """
    memory = _node("memory", F.col("id"))
    person = lambda side: F.concat(F.col(f"{side}.kind"), F.lit(":"), F.col(f"{side}.id"))
    window = _node("window", F.col("session_id"))
    topics = memories.select("id", "confidence", F.explode(F.slice(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), 1, TOPIC_LIMIT)).alias("tag")).where("tag is not null")
    edge = lambda df, s, t, r: df.select(s.alias("source"), t.alias("target"), F.lit(r).alias("relation"), F.col("id").alias("memory_id"), "confidence")
    edges = [
        edge(memories, window, memory, "contains_memory"), edge(memories, person("subject"), memory, "subject_of"), edge(memories, person("object"), memory, "object_of"),
        edge(memories, person("subject"), window, "participated_in"), edge(topics, _node("memory", F.col("id")), _node("topic", F.col("tag")), "has_topic"),
    ]
    every = reduce(DataFrame.unionByName, edges).where("source is not null and target is not null").dropDuplicates(["source", "target", "relation", "memory_id"])
    node = lambda df, key, kind, label: df.select(key.alias("node"), kind.alias("node_type"), label.alias("label"))
    nodes = [
        node(memories, memory, F.lit("memory"), F.substring("content", 1, 80)), node(memories, window, F.lit("window"), F.col("session_id")), node(memories, person("subject"), F.col("subject.kind"), F.col("subject.name")),
        node(memories, person("object"), F.col("object.kind"), F.col("object.name")), node(topics, _node("topic", F.col("tag")), F.lit("topic"), F.col("tag")),
    ]
    found = reduce(DataFrame.unionByName, nodes).where("node is not null").groupBy("node", "node_type").agg(F.max("label").alias("label"))
    return found, every


def neighbours(edges: DataFrame, starts: DataFrame, node: str = "node") -> DataFrame:
    """(start, node, relation, memory_id) one edge away, in either direction."""
    there = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "relation", "memory_id")
    both = there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation", "memory_id"))
    return starts.select(F.col(node).alias("start")).distinct().join(both, F.col("start") == F.col("a")).select("start", F.col("b").alias("node"), "relation", "memory_id")


def edge_page(edges: DataFrame, memories: DataFrame, filters: dict[str, str | None], limit: int) -> DataFrame:
    """The surest edges of the memories that pass ``filters`` (scope, session_id, group_id and the like)."""
    rows = memories.select(F.col("id").alias("__m"), *[F.col(c).alias(f"__{c}") for c in filters])
    for column, value in filters.items():
        if value:
            rows = rows.where(F.col(f"__{column}") == value)
    met = edges.join(rows.select("__m"), F.col("memory_id") == F.col("__m"), "left_semi")
    return met.orderBy(F.col("confidence").desc_nulls_last(), "source", "target", "relation", "memory_id").limit(limit)


def paths(nodes: DataFrame, edges: DataFrame, terms: list[str], limit: int = 200) -> DataFrame:
    """Edges an end of whose label contains a term, with both labels; surest first."""
    any_of = reduce(lambda a, b: a | b, [F.lower("label").contains(t.lower()) for t in terms])
    starts = nodes.where(any_of).select(F.col("node").alias("hit"))
    met = edges.join(starts, (F.col("source") == F.col("hit"))).unionByName(edges.join(starts, F.col("target") == F.col("hit"))).drop("hit").dropDuplicates(["source", "target", "relation", "memory_id"])
    s, t = nodes.select(F.col("node").alias("source"), F.col("label").alias("source_label")), nodes.select(F.col("node").alias("target"), F.col("label").alias("target_label"))
    return met.orderBy(F.col("confidence").desc_nulls_last(), "source", "target", "relation", "memory_id").limit(limit).join(s, "source", "left").join(t, "target", "left")


def walk(edges: DataFrame, starts: DataFrame, hops: int, relations: list[str] | None = None) -> DataFrame:
    """(start, node, hops) reached within ``hops`` steps, each at its fewest. Edges and each front are cut, so a step costs one step."""
    if relations:
        edges = edges.where(F.col("relation").isin(relations))
    edges = cut(edges.select("source", "target", "relation", "memory_id"))
    reached = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("hops", F.lit(0))
    front = reached
    for h in range(1, hops + 1):
        step = neighbours(edges, front).select(F.col("start").alias("via"), "node").distinct()
        front = front.select("start", F.col("node").alias("via")).join(step, "via").select("start", "node").distinct().join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(h))
        front = cut(front)
        reached = reached.unionByName(front)
    return reached
