"""Mixing sources to target shares by hierarchical budgets and seeded epochs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut

SEED = 7
#: Leaves of the tree that the driver budgets at most.
LEAF_LIMIT = 100_000
#: Documents in one bucket of the seeded order, on average over a leaf that held them all.
BUCKET_DOCS = 20_000
#: Ends near a leaf's budget among which the driver chooses.
ENDS = 8


@dataclass
class Node:
    """A node of the tree: its weight among its siblings, and what it can give at most."""

    weight: float
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0


def share_out(total: float, weights: list[float], capacities: list[float]) -> list[float]:
    """``total`` by weight; what exceeds a capacity goes to the others by weight until all are full."""
    given = [0.0] * len(weights)
    open_ = [i for i, c in enumerate(capacities) if c > 0 and weights[i] > 0]
    left = min(total, sum(capacities[i] for i in open_))
    while open_ and left > 1e-9:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if capacities[i] - given[i] <= unit * weights[i]]
        if not full:
            for i in open_:
                given[i] += unit * weights[i]
            break
        for i in full:
            left -= capacities[i] - given[i]
            given[i] = capacities[i]
        open_ = [i for i in open_ if i not in set(full)]
    return given


def budget(node: Node, total: float) -> None:
    """Propagate ``total`` down the tree: a child's shortage goes to its siblings, and to the ancestors only what they can't take."""
    node.budget = min(total, node.capacity)
    children = list(node.children.values())
    for child, part in zip(children, share_out(node.budget, [c.weight for c in children], [c.capacity for c in children]), strict=True):
        budget(child, part)


def _sum_up(node: Node) -> float:
    if node.children:
        node.capacity = sum(map(_sum_up, node.children.values()))
    return node.capacity


def reachable_total(sources: Iterable[Node]) -> float:
    """The largest total at which every source with a weight and any tokens gets its share."""
    able = [c for c in sources if c.weight > 0 and c.capacity > 0]
    whole = sum(c.weight for c in able)
    return min((c.capacity * whole / c.weight for c in able), default=0.0)


def _stops(leaves: list[tuple[tuple, int, list[int]]]) -> list[tuple]:
    """Where each leaf's prefix stops: leaves with coarse ends choose first, and each makes up for its source's error so far."""
    error: dict[str, float] = {}
    out = []
    for key, rest, reaches in sorted(leaves, key=lambda x: (-min(abs(r - x[1]) for r in x[2]), x[0])):
        so_far = error.get(key[0], 0.0)
        stop = min(sorted(reaches), key=lambda r: abs(so_far + r - rest))
        error[key[0]] = so_far + stop - rest
        out.append((*key, stop))
    return out


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, levels: tuple[str, ...] = ("source", "lang"), seed: int = SEED, domains: dict[str, str] | None = None, stretch: float = 1.0) -> DataFrame:
    """doc_id, the ``levels``, n_tokens and uses of every document that the mix contains.

    ``sizes`` has a unique doc_id, the level columns and n_tokens; ``targets``
    has the first level's column, target_share and max_repeats. The tree has
    the ``domains`` of the sources on top, if given (sources without one are a
    domain together), then the ``levels``. A domain weighs what its sources
    do, and below the sources nodes weigh what they hold. Without
    ``total_tokens`` the total is ``stretch`` times the largest at which every
    source keeps its share within max_repeats; a larger total gives shortages
    to siblings of the same domain first, then to other domains. Null levels are
    one value of their own; sources without target, targets that are null or
    not positive, and documents without tokens are not in the mix. Targets
    repeated for a source are added up, with the least max_repeats. Empty
    tables give no rows.

    A leaf's budget is full epochs of all its documents and a prefix of one
    more, in an order seeded by epoch. The prefix is found over buckets of
    that order, and row by row only inside the bucket in which it ends, so no
    task holds a leaf. A prefix ends between documents, so a leaf misses its
    budget by part of one; among the ends near its budget each leaf takes the
    one that makes up for its source's error. Budgets and ends are settled on
    the driver from one row per leaf, of which there may be ``LEAF_LIMIT``.
    """
    top = levels[0]
    spark: SparkSession = sizes.sparkSession
    wanted = targets.where("target_share > 0 and max_repeats > 0").groupBy(top).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats"))
    targeted = wanted.limit(LEAF_LIMIT + 1).collect()
    if len(targeted) > LEAF_LIMIT:
        raise ValueError(f"more than {LEAF_LIMIT} targets")
    goals = {r[0]: (float(r.share), int(r.repeats)) for r in targeted}
    leaf = [f"__l{i}" for i in range(len(levels))]
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(x) for c, x in zip(levels, leaf, strict=True)]
    docs = cut(sizes.where("n_tokens > 0").select(F.col("doc_id"), *[F.col(c) for c in levels], F.col("n_tokens").cast("bigint").alias("n_tokens"), *named))
    leaves = docs.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")).limit(LEAF_LIMIT + 1).collect()
    if len(leaves) > LEAF_LIMIT:
        raise ValueError(f"more than {LEAF_LIMIT} leaves")
    root = Node(1.0)
    above = lambda source: (domains.get(source, ""),) if domains else ()
    tops: dict[str, Node] = {}
    repeats = {}
    for r in leaves:
        source = r[0][1:] if r[0] else None
        if source not in goals:
            continue
        node = root
        for domain in above(source):
            node = node.children.setdefault(domain, Node(0.0))
            node.weight += 0.0 if source in tops else goals[source][0]
        for depth in range(len(levels)):
            node = node.children.setdefault(r[depth], Node(goals[source][0] if depth == 0 else 0.0))
            tops.setdefault(source, node)
            if depth:
                node.weight += float(r.tokens)
        node.capacity, repeats[tuple(r[: len(levels)])] = float(r.tokens) * goals[source][1], goals[source][1]
    _sum_up(root)
    budget(root, stretch * reachable_total(tops.values()) if total_tokens is None else float(total_tokens))
    rows = []
    for r in leaves:
        key, node = tuple(r[: len(levels)]), root
        if key not in repeats:
            continue
        for part in (*above(key[0][1:]), *key):
            node = node.children[part]
        epochs = min(int((node.budget + 1e-6) // r.tokens), repeats[key])
        rest = 0 if epochs == repeats[key] else int(node.budget + 1e-6 - epochs * r.tokens)
        rows.append((*key, epochs, rest))
    schema = ", ".join([*(f"b{x} string" for x in leaf), "epochs int", "rest bigint"])
    plan = F.broadcast(spark.createDataFrame(rows, schema))
    same = [F.col(x) == F.col(f"b{x}") for x in leaf]
    on = same[0]
    for s in same[1:]:
        on = on & s
    planned = docs.join(plan, on).drop(*[f"b{x}" for x in leaf])
    planned = planned.withColumn("order", F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(max(1, docs.count() // BUCKET_DOCS))))
    loads = planned.groupBy(*leaf, "rest", "bucket").agg(F.sum("n_tokens").alias("load"))
    upto = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = loads.withColumn("reach", F.sum("load").over(upto)).where("rest > 0 and reach > rest").groupBy(*leaf).agg(F.min("bucket").alias("ends"), F.min_by(F.col("reach") - F.col("load"), "bucket").alias("before"))
    ends = F.broadcast(ends.select(*[F.col(x).alias(f"b{x}") for x in leaf], "ends", "before"))
    placed = planned.join(ends, on, "left").drop(*[f"b{x}" for x in leaf])
    inside = Window.partitionBy(*leaf, "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = cut(placed.where("bucket = ends").withColumn("reach", F.sum("n_tokens").over(inside) + F.col("before")))
    nearest = Window.partitionBy(*leaf).orderBy(F.abs(F.col("reach") - F.col("rest")), "reach")
    near = last.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= ENDS).groupBy(*leaf).agg(F.first("rest").alias("rest"), F.first("before").alias("before"), F.collect_list("reach").alias("reaches")).collect()
    stops = F.broadcast(spark.createDataFrame(_stops([(tuple(r[: len(levels)]), r.rest, [r.before, *r.reaches]) for r in near]), ", ".join([*(f"b{x} string" for x in leaf), "stop bigint"])))
    last = last.join(stops, on).drop(*[f"b{x}" for x in leaf]).withColumn("extra", (F.col("reach") <= F.col("stop")).cast("int"))
    others = placed.where("ends is null or bucket <> ends").withColumn("extra", F.coalesce(F.col("bucket") < F.col("ends"), F.lit(False)).cast("int"))
    columns = ["doc_id", *levels, "n_tokens", "epochs", "extra"]
    used = last.select(*columns).unionByName(others.select(*columns)).withColumn("uses", F.col("epochs") + F.col("extra")).where("uses > 0")
    return used.select("doc_id", *levels, "n_tokens", "uses")


def mix_report(mixed: DataFrame, targets: DataFrame, top: str = "source") -> DataFrame:
    """Per target: its share, the share reached, tokens with repeats, documents and the most uses of one."""
    got = mixed.groupBy(F.col(top).alias("__top")).agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    joined = targets.select(top, "target_share", "max_repeats").join(got, F.col(top) == F.col("__top"), "left").crossJoin(F.broadcast(whole))
    return joined.select(
        top, "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.col("whole"), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats"
    )
