"""Fusing routes, scoring, diversifying and allotting slots."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from . import gates, lexical, scans
from .scans import Context

RANK_CONSTANT = 60
FAMILIES = {"fts": "lexical", "keyword": "lexical", "vector": "vector", "time_window": "time"}
SLOTS = ("open_loop", "self_timeline", "user_profile", "current_window", "conversation_summary", "stable_memory")
PROFILE_TYPES = ("user_fact", "preference", "user_profile", "user_preference", "user_habit", "relationship_claim", "explicit_memory", "manual_memory")


def ranked(rows: DataFrame, route: str, *order: Column, key: str = "id") -> DataFrame:
    """(id, route, rank) of one route's rows in its order."""
    return rows.select(F.col(key).alias("id"), F.lit(route).alias("route"), F.row_number().over(Window.orderBy(*order, F.col(key))).alias("rank"))


def fuse(routes: list[DataFrame], constant: int = RANK_CONSTANT) -> DataFrame:
    """(id, rrf, routes): reciprocal ranks summed over routes, a row's first place in each; the order of routes does not matter."""
    every = reduce(DataFrame.unionByName, routes)
    first = every.groupBy("id", "route").agg(F.min("rank").alias("rank"))
    return first.groupBy("id").agg(F.sum(1.0 / (F.lit(float(constant)) + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("route")).alias("routes"))


def families(routes: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.array_sort(F.array_distinct(F.filter(F.transform(routes, lambda r: mapping[r]), lambda f: f.isNotNull())))


def agreement(found: Column) -> Column:
    """Bonus of independent channels that agree."""
    return F.when(F.size(found) < 2, 0.0).otherwise(F.least(F.lit(0.12), 0.08 * (F.size(found) - 1)))


def recency(now: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.coalesce("occurred_at", "created_at"))) / F.lit(86_400_000_000.0))
    return F.coalesce(0.2 * F.exp(-days / 14.0), F.lit(0.0))


def score(memories: DataFrame, fused: DataFrame, terms: list[str], phrase: str | None, ctx: Context, now: Column) -> DataFrame:
    """Fused candidates with their score, best first: term, scope, weight and time evidence, then lifecycle.

    A row needs a hit of a term or the phrase if there are terms. idf is taken
    over the candidates. Rows that score 0 or aren't eligible are left out.
    """
    # Routes are bounded, and so is the pool; it is read twice, for idf and for the scores.
    pool = cut(memories.join(fused, "id").withColumn("hay", lexical.haystack()))
    idf = {r.term: r.idf for r in lexical.containment_idf(pool, F.col("hay"), terms).collect()} if terms else {}
    hits = sum([F.col("hay").contains(t).cast("int") for t in terms], F.lit(0))
    exact = F.regexp_replace("hay", r"\s+", "").contains(re.sub(r"\s+", "", phrase.lower())) if phrase else F.lit(False)
    pool = pool.withColumns({"hits": hits, "exact": exact, "bm25": lexical.containment_score(F.col("hay"), idf), "state": gates.lifecycle(ctx, now)})
    if terms:
        pool = pool.where("hits > 0 or exact")
    same = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False)) if v else F.lit(False)
    scope = F.when(same("session_id", ctx.session_id), 0.25).otherwise(0.0) + F.when(same("subject.id", ctx.user_id) | same("object.id", ctx.user_id), 0.15).otherwise(0.0)
    scope = scope + F.when(same("group_id", ctx.group_id), 0.15).otherwise(0.0) + F.when(F.coalesce(F.col("visibility") == "bot_self", F.lit(False)), 0.08).otherwise(0.0)
    bonus = recency(now) + agreement(families(F.col("routes"))) + F.least(F.lit(0.55), 12.0 * F.col("rrf"))
    importance, confidence = F.coalesce("importance", F.lit(0.0)), F.coalesce("confidence", F.lit(0.0))
    if terms:
        base = F.when(F.col("exact"), 0.42).otherwise(0.24) + F.least(F.lit(0.72), 0.18 * F.col("bm25")) + scope + importance * F.when(F.col("exact"), 0.55).otherwise(0.28) + 0.25 * confidence + bonus
    else:
        base = scope + 0.8 * importance + bonus
    return pool.withColumn("score", gates.with_lifecycle(base, F.col("state"))).where("score > 0")


def search(memories: DataFrame, terms: list[str], phrase: str | None, ctx: Context, now: Column, start: Column | None = None, end: Column | None = None, extra_routes: list[DataFrame] | None = None) -> DataFrame:
    """Ranked memories that the asking context may see, over the priority, window, keyword and time routes and any further ones."""
    important = F.col("importance").desc_nulls_last()
    routes = [
        ranked(scans.priority(memories), "priority", important, F.col("occurred_at").desc_nulls_last()),
        ranked(scans.current_window(memories, ctx), "current_window", important, scans.last_seen().desc_nulls_last()),
        ranked(scans.containing(memories, terms), "keyword", F.col("session_id").isNull(), important),
    ]
    if start is not None:
        routes.append(ranked(scans.time_window(memories, start, end), "time_window", important, scans.last_seen().desc_nulls_last()))
    seen = memories.where(gates.visibility(ctx)["visible"])
    return score(seen, fuse(routes + (extra_routes or [])), terms, phrase, ctx, now)


# Rows of the full-text and vector routes at most, and the least cosine of the latter.
FTS_ROWS, VECTOR_ROWS, LEAST_COSINE = 240, 240, 0.34


def text_route(memories: DataFrame, terms: list[str], limit: int = FTS_ROWS) -> DataFrame:
    """(id, route, rank) of the best rows by BM25 over the search text of memories that may be found."""
    rows = scans.candidates(memories)
    hay = lexical.haystack()
    index = lexical.postings(rows, "id", hay)
    found = lexical.bm25(index, terms, *lexical.corpus_totals(rows, hay)).select(F.col("key").alias("id"), F.round("score", 9).alias("score"))
    return ranked(scans.top(found, limit, F.col("score").desc()), "fts", F.col("score").desc())


def vector_route(memories: DataFrame, near: DataFrame, limit: int = VECTOR_ROWS, least: float = LEAST_COSINE) -> DataFrame:
    """(id, route, rank) of memories whose vectors are near: ``near`` has id and cosine."""
    found = scans.candidates(memories).select("id").join(near.where(F.col("cosine") >= least).select("id", F.round("cosine", 9).alias("cosine")), "id")
    return ranked(scans.top(found, limit, F.col("cosine").desc()), "vector", F.col("cosine").desc())


def candidate_pool(memories: DataFrame, terms: list[str], ctx: Context, start: Column | None = None, end: Column | None = None, near: DataFrame | None = None) -> DataFrame:
    """(id, rrf, routes) over all routes that a search has."""
    important = F.col("importance").desc_nulls_last()
    seen = scans.last_seen().desc_nulls_last()
    routes = [
        ranked(scans.priority(memories), "priority", important, F.col("occurred_at").desc_nulls_last()), ranked(scans.current_window(memories, ctx), "current_window", important, seen),
        ranked(scans.containing(memories, terms), "keyword", F.col("session_id").isNull(), important), text_route(memories, terms),
    ]
    if start is not None:
        routes.append(ranked(scans.time_window(memories, start, end), "time_window", important, seen))
    if near is not None:
        routes.append(vector_route(memories, near))
    return fuse(routes)


def gated(memories: DataFrame, pool: DataFrame, ctx: Context, now: Column, rules: DataFrame, policies: DataFrame, reader: tuple[str, str]) -> DataFrame:
    """The pool's memories with rrf, routes and blocked: why a memory may not be told, by the first gate that holds it back, or null.

    Gates are visibility, access rules (a rule that allows opens what only
    another window hides, one that denies closes everything) and lifecycle.
    """
    rows = gates.access(memories.join(pool, "id"), rules, policies, *reader)
    rows = rows.withColumns({"__v": gates.visibility(ctx), "__s": gates.lifecycle(ctx, now)})
    window = F.col("__v.reason").isin("other_group_public", "private_pair_not_current_private", "other_private_pair")
    blocked = (
        F.when(F.col("acl") == "deny", "acl_deny").when(~F.col("__v.visible") & ~(window & F.col("acl").isin("allow", "open")), F.col("__v.reason"))
        .when(~F.col("__s.eligible"), F.col("__s.reason"))
    )
    return rows.withColumn("blocked", blocked).drop("__v", "__s")


def retrieve(
    memories: DataFrame, terms: list[str], phrase: str | None, ctx: Context, now: Column, rules: DataFrame, policies: DataFrame, reader: tuple[str, str], limits: dict[str, int], total: int,
    start: Column | None = None, end: Column | None = None, near: DataFrame | None = None, reranked: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(chosen, blocked) of one search, all its steps in one plan over a pool that is bounded by the routes' limits.

    Routes are fused, gates tell what is blocked and why, the rest is scored,
    combined with ``reranked`` (id, relevance) if given, in which strong lexical
    matches keep their place, diversified, brought down to the newest of each
    fact and the best of each import and type, and allotted to slots. chosen:
    id, slot, round, place, score; blocked: id, reason.
    """
    pool = cut(gated(memories, candidate_pool(memories, terms, ctx, start, end, near), ctx, now, rules, policies, reader))
    blocked = pool.where("blocked is not null").select("id", F.col("blocked").alias("reason"))
    free = pool.where("blocked is null")
    fused = free.select("id", "rrf", "routes")
    found = cut(score(free.drop("rrf", "routes", "blocked", "acl"), fused, terms, phrase, ctx, now))
    if reranked is not None:
        both = found.join(reranked.select(F.col("id").alias("__id"), "relevance"), F.col("id") == F.col("__id"), "left").drop("__id").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
        merged = convex(both, "score", "relevance")
        anchors = merged.select("id", "combined", (F.col("exact") | (F.col("hits") >= 2)).alias("anchor"))
        placed = anchor_floor(anchors, total).select("id", (-F.col("place")).cast("double").alias("score"))
        found = found.drop("score").join(placed, "id")
    order = diversify(found.select(F.lit(1).alias("query_id"), "id", "score", "hay", "tags", "source_plugin"), total).select("id", (-F.col("place")).cast("double").alias("order"))
    rows = found.join(order, "id").withColumns({"subject_id": F.col("subject.id"), "slot": slot(ctx)})
    facts = latest_only(rows.where(F.col("memory_type").isin(*PROFILE_TYPES)), ["owner_bot_id", "subject_id", "memory_type"], scans.last_seen().desc_nulls_last(), F.col("order").desc())
    others = latest_only(rows.where(~F.col("memory_type").isin(*PROFILE_TYPES) | F.col("memory_type").isNull()), ["import_batch_id", "memory_type"], F.col("order").desc())
    kept = facts.select("id", "slot", "order").unionByName(others.select("id", "slot", "order"))
    chosen = allot(kept.select("id", "slot", F.col("order").alias("score")), limits, total)
    return chosen.join(found.select("id", "score"), "id"), blocked


def convex(pool: DataFrame, local: str, other: str, group: list[str] | None = None) -> DataFrame:
    """``pool`` with combined: both scores brought to [0, 1] per group and averaged; a flat local score counts 0.5, a flat other one 1.

    The extremes are aggregated map-side and joined back, so no task holds a group.
    """
    keys = group or []
    edges = [f(c).alias(f"__{n}_{i}") for i, c in enumerate((local, other)) for n, f in (("min", F.min), ("max", F.max))]
    bounds = pool.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*edges)
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.lit(True))
    joined = pool.join(bounds if keys else F.broadcast(bounds), on)
    unit = lambda i, c, flat: F.when(F.col(f"__max_{i}") > F.col(f"__min_{i}"), (F.col(c) - F.col(f"__min_{i}")) / (F.col(f"__max_{i}") - F.col(f"__min_{i}"))).otherwise(flat)
    return joined.withColumn("combined", 0.5 * unit(0, local, F.lit(0.5)) + 0.5 * unit(1, other, F.lit(1.0))).select(*pool.columns, "combined")


# How relevance and redundancy weigh against each other, the picks' share of the head and its least size, and the pairs of characters that are looked at.
RELEVANCE, REDUNDANCY, HEAD_FACTOR, HEAD_LEAST, MOST_PAIRS = 0.84, 0.16, 4, 16, 180


def diversity_features(hay: Column, tags: Column, source: Column) -> Column:
    """Hashes of what two memories may have in common: the first pairs of characters in order of code point, latin words, tags and source."""
    flat = F.regexp_replace(F.coalesce(hay, F.lit("")), r"\s+", "")
    pairs = F.when(F.length(flat) > 1, F.transform(F.sequence(F.lit(1), F.length(flat) - 1), lambda i: F.substring(flat, i, 2)))
    few = F.slice(F.sort_array(F.array_distinct(F.coalesce(pairs, F.array().cast("array<string>")))), 1, MOST_PAIRS)
    words = F.regexp_extract_all(flat, F.lit("([a-z0-9_]{2,})"), 1)
    marked = F.transform(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t) != ""), lambda t: F.concat(F.lit("tag:"), F.lower(F.trim(t))))
    origin = F.when(F.trim(source) != "", F.array(F.concat(F.lit("source:"), F.lower(F.trim(source))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(few, words, marked, origin), lambda f: F.xxhash64(f)))


def diversify(pool: DataFrame, limit: int, query: str = "query_id") -> DataFrame:
    """Maximal marginal relevance per query: adds place, the order after diversifying.

    ``pool`` has query, id, score, hay, tags, source_plugin. Of the head, the
    first max(4 * limit, 16) rows by score, ``limit`` are picked one by one,
    weighing a row's relevance in the head against its greatest overlap with
    those picked; all other rows follow in their order, and every row stays.
    Features are made by columns for the head alone. Its overlaps are one
    product of a 0/1 matrix with itself.
    """
    size = max(HEAD_FACTOR * limit, HEAD_LEAST)

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", ignore_index=True)
        n = len(part)
        lengths = part["features"].map(len).to_numpy()
        codes, columns = np.unique(np.concatenate([np.asarray(f, np.int64) for f in part["features"]]), return_inverse=True)
        has = np.zeros((n, max(1, len(codes))), np.float32)
        has[np.repeat(np.arange(n), lengths), columns] = 1
        shared = has @ has.T
        either = lengths[:, None] + lengths[None, :] - shared
        overlap = np.divide(shared, either, out=np.zeros_like(shared, np.float64), where=either > 0)
        scores = part["score"].to_numpy(np.float64)
        span = scores.max() - scores.min()
        value = (scores - scores.min()) / span if span > 0 else np.ones(n)
        worst, place = np.zeros(n), np.zeros(n, np.int64)
        latest = 0
        for nth in range(1, min(limit, n) + 1):
            place[latest] = nth
            worst = np.maximum(worst, overlap[latest])
            latest = int(np.where(place > 0, -np.inf, RELEVANCE * value - REDUNDANCY * worst).argmax())
        place[place == 0] = np.arange(min(limit, n) + 1, n + 1)
        return part[[query, "id", "score"]].assign(place=place)

    kind = pool.schema[query].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc_nulls_last(), "id"))
    ranked = pool.select(query, "id", "score", "hay", "tags", "source_plugin", rank.alias("place"))
    head = ranked.where(F.col("place") <= size).select(query, "id", F.coalesce("score", F.lit(0.0)).alias("score"), "place", diversity_features(F.col("hay"), F.col("tags"), F.col("source_plugin")).alias("features"))
    picked = head.groupBy(query).applyInPandas(pick, f"{query} {kind}, id string, score double, place int")
    return picked.unionByName(ranked.where(F.col("place") > size).select(query, "id", "score", "place"))


def slot(ctx: Context) -> Column:
    """The slot of a memory: the bot's own, open loops, profile, summaries, the current window, or the rest."""
    own = (F.col("visibility") == "bot_self") | F.col("reality_level").isin("bot_action", "persona_life", "fictional_content") | ((F.col("subject.kind") == "bot") & (F.col("subject.id").isNull() | F.col("subject.id").isin("", "self", ctx.bot_id or "")))
    window = (F.col("visibility") == "private_pair") | (F.col("scope") == "private") if ctx.scope == "private" else (F.col("visibility") == "group_public") | (F.col("scope") == "group")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(own) | yes(F.col("memory_type") == "bot_detail"), "self_timeline").when(yes(F.col("memory_type") == "open_loop"), "open_loop")
        .when(yes(F.col("memory_type").isin(*PROFILE_TYPES)), "user_profile").when(yes(F.col("memory_type") == "conversation_summary"), "conversation_summary").when(yes(window), "current_window").otherwise("stable_memory")
    )


def allot(ranked_rows: DataFrame, limits: dict[str, int], total: int, capped: tuple[str, ...] = ()) -> DataFrame:
    """(id, slot, round, place) of the rows chosen within ``total``.

    ``ranked_rows``: id, slot, score. First each slot gets its best row, then
    slots are filled to their limits, then what is left goes by score to slots
    that have a limit, of which those in ``capped`` stay inside it. All but
    the last round follow from ranks within slots; no more than ``total`` rows
    per slot are ever looked at.
    """
    names = [s for s in SLOTS if limits.get(s, 0) > 0]
    place = F.create_map(*[F.lit(x) for i, s in enumerate(SLOTS) for x in (s, i)])
    bound = F.create_map(*[F.lit(x) for s in names for x in (s, limits[s])]) if names else F.lit(None)
    rows = ranked_rows.where(F.col("slot").isin(*names)).withColumns({"nth": F.row_number().over(Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")), "at": place[F.col("slot")], "bound": bound[F.col("slot")]})
    rows = rows.where(F.col("nth") <= total).withColumn("round", F.when(F.col("nth") == 1, 1).when(F.col("nth") <= F.col("bound"), 2).otherwise(3)).where((F.col("round") < 3) | ~F.col("slot").isin(*capped) if capped else F.lit(True))
    order = Window.orderBy("round", F.when(F.col("round") < 3, F.col("at")).otherwise(0), F.col("score").desc(), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= total).select("id", "slot", "round", "place")


def latest_only(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in ``order``; rows with a null key all stay."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "id"))
    return rows.withColumn("__nth", F.when(whole, nth).otherwise(1)).where("__nth = 1").drop("__nth")


def anchor_floor(rows: DataFrame, limit: int) -> DataFrame:
    """Puts strong lexical matches that fell below ``limit`` back in: rows (id, combined, anchor) with place.

    Each such anchor takes the place of the lowest row inside that is none.
    """
    order = Window.orderBy(F.col("combined").desc(), "id")
    placed = rows.withColumn("was", F.row_number().over(order))
    lost = Window.orderBy("was")
    outside = placed.where((F.col("was") > limit) & F.col("anchor")).withColumn("nth", F.row_number().over(lost))
    inside = placed.where((F.col("was") <= limit) & ~F.col("anchor")).withColumn("nth", F.row_number().over(Window.orderBy(F.col("was").desc())))
    swaps = outside.select("nth", F.col("id").alias("in_id"), F.col("was").alias("in_was")).join(inside.select("nth", F.col("id").alias("out_id"), F.col("was").alias("out_was")), "nth")
    moves = swaps.select(F.col("in_id").alias("mid"), F.col("out_was").alias("place")).unionByName(swaps.select(F.col("out_id").alias("mid"), F.col("in_was").alias("place")))
    return placed.join(moves, F.col("id") == F.col("mid"), "left").select("id", "combined", "anchor", F.coalesce("place", "was").alias("place"))


def retrieval_metrics(cases: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """recall@k, mean reciprocal rank over the queries with a hit, and hit@1.

    ``cases``: query, key of each relevant row; ``found``: query, key, rank.
    """
    hits = cases.join(found.where(F.col("rank") <= k), ["query", "key"]).groupBy("query").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("hit"))
    return _averages(cases.groupBy("query").agg(F.count(F.lit(1)).alias("relevant")).join(hits, "query", "left"), k)


def _averages(per: DataFrame, k: int) -> DataFrame:
    return per.agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.coalesce("hit", F.lit(0)) / F.least("relevant", F.lit(k))), 6).alias("recall_at_k"), F.round(F.avg(1.0 / F.col("best")), 6).alias("mrr"), F.round(F.avg(F.coalesce((F.col("best") == 1).cast("double"), F.lit(0.0))), 6).alias("hit_at_1")
    )


def label_metrics(asked: DataFrame, rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """:func:`retrieval_metrics` where all other rows of a query's label are relevant: (query, label), (key, label) and (query, key, rank).

    Relevant rows are only counted per label, so the work grows with what was
    found and not with the size of a label.
    """
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    per = asked.join(sizes, "label").where("n > 1").select("query", "label", (F.col("n") - 1).alias("relevant"))
    near = found.where((F.col("rank") <= k) & (F.col("query") != F.col("key"))).join(rows.select("key", F.col("label").alias("found_label")), "key")
    hits = near.join(per.select("query", "label"), "query").where("label = found_label").groupBy("query").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("hit"))
    return _averages(per.join(hits, "query", "left"), k)
