"""Aggregate reports over memories, sessions and logs, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import owner_window
from .scans import last_seen


def buckets(memories: DataFrame) -> DataFrame:
    """Per owner window: records, active ones, summaries, latest time, best sample and its name; aliases are merged by id."""
    rows = memories.withColumn("w", owner_window()).where("w is not null")
    rank = F.struct(F.coalesce("importance", F.lit(-1.0)), last_seen(), F.col("id"))
    return rows.groupBy(F.col("w.scope").alias("scope"), F.col("w.id").alias("target_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lifecycle") == "stable_memory").alias("n_stable"), F.count_if(F.col("memory_type") == "conversation_summary").alias("n_summaries"),
        F.max(last_seen()).alias("latest"), F.max_by("id", rank).alias("best_id"), F.countDistinct("owner_bot_id").alias("n_bots"), F.max(F.when(F.col("subject.id") == F.col("w.id"), F.col("subject.name"))).alias("name"),
    )


def preferred_session(memories: DataFrame) -> DataFrame:
    """Per private user the session with most records, then the latest, then the least name."""
    rows = memories.where("scope = 'private' and subject.kind = 'user' and session_id is not null and subject.id is not null")
    per = rows.groupBy(F.col("subject.id").alias("user_id"), "session_id").agg(F.count(F.lit(1)).alias("n"), F.max(last_seen()).alias("latest"))
    nth = Window.partitionBy("user_id").orderBy(F.col("n").desc(), F.col("latest").desc_nulls_last(), "session_id")
    return per.withColumn("nth", F.row_number().over(nth)).where("nth = 1").select("user_id", "session_id", "n")


def counts_with_total(df: DataFrame, column: str) -> DataFrame:
    """(value, n) per value and, with a null value and total true, over all, in one pass."""
    return df.groupingSets([[], [F.col(column)]], F.col(column)).agg(F.count(F.lit(1)).alias("n"), (F.grouping(column) == 1).alias("total")).select(F.col(column).alias("value"), "n", "total")


def raw_retention(memories: DataFrame, before: Column, limit: int | None = None) -> DataFrame:
    """Ids of raw events older than an instant, oldest first."""
    rows = memories.where((F.col("lifecycle") == "raw_event") & (last_seen() < before)).select("id", last_seen().alias("seen"))
    return rows if limit is None else rows.orderBy("seen", "id").limit(limit)


# What is never offered to decay, by type and tag.
KEPT_TYPES = ("manual_memory", "explicit_memory", "companion_note")
KEPT_TAGS = ("manual", "needs_review", "protected", "no_decay", "keep")
# By durability, how many times the least age and the least idle time are needed.
AGE_FACTOR = {"ephemeral": 0.05, "short": 0.35, "normal": 1.0, "durable": 4.0}
IDLE_FACTOR = {"ephemeral": 0.05, "short": 0.35, "normal": 1.0, "durable": 3.0}
# Days of age and idleness, the importance above which records are spared, and the score from which one is a candidate.
DECAY_AGE_DAYS, DECAY_IDLE_DAYS, DECAY_SOFT_IMPORTANCE, DECAY_THRESHOLD = 180, 90, 0.74, 0.75
# Metadata fields that weigh on durability.
WEIGHTS = ("promise_weight", "open_loop_weight", "creative_weight", "scar_weight", "emotional_debt_weight")


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def decay_owner() -> Column:
    """Whose window a fading record belongs to."""
    filled = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    person = F.coalesce(*[F.when((F.col(f"{s}.kind") == "user") & ~F.col(f"{s}.id").isin("", "self"), F.col(f"{s}.id")) for s in ("subject", "object")])
    yes = lambda c: F.coalesce(c, F.lit(False))
    other = filled("session_id", "group_id", "object.id", "subject.id")
    return F.coalesce(
        F.when(yes(F.col("scope") == "group") | yes(F.col("visibility") == "group_public"), filled("group_id", "object.id", "subject.id", "session_id")).when(yes(F.col("scope") == "private") | yes(F.col("visibility") == "private_pair"), F.coalesce(person, other)).otherwise(other), F.lit("")
    )


def decay_candidates(memories: DataFrame, now: Column, threshold: float = DECAY_THRESHOLD, kept_plugins: tuple[str, ...] = ()) -> DataFrame:
    """``memories`` that may be archived, with age_days, idle_days and score.

    Old and idle enough for the durability, which importance and metadata
    weights stretch; then .35 of the age and of the idleness against those
    limits (at most three times each), .2 of what lacks in importance and .1 in
    confidence, eased by decay mode, phase and freshness, less a quarter of
    what recalls still hold. Records without any time, pinned ones and those
    protected by type, tag, mode, their plugin (one of ``kept_plugins``, such as
    those by which users write) or as the bot's own are none.
    """
    meta = lambda name: F.get_json_object("metadata", f"$.{name}")
    weight = lambda name: _unit(meta(name).try_cast("double"))
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rows = memories.withColumns({
        "__mode": text(meta("decay_mode")), "__phase": text(meta("relationship_phase")), "__durability": F.coalesce(F.nullif(text(F.col("durability")), F.lit("")), F.lit("normal")), "__anchor": F.coalesce("occurred_at", "created_at"), "__weight": F.greatest(*[weight(w) for w in WEIGHTS]), "__fresh": weight("freshness_weight"),
        "__importance": _unit(F.col("importance")), "__confidence": _unit(F.col("confidence")), "__tags": F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: text(t)),
    })
    rows = rows.where((F.col("__mode") != "no_decay") & ~text(F.col("memory_type")).isin(*KEPT_TYPES) & ~F.arrays_overlap("__tags", F.array(*[F.lit(t) for t in KEPT_TAGS])) & ~F.coalesce(F.col("visibility") == "bot_self", F.lit(False)) & ~F.coalesce(F.col("source_plugin").isin(list(kept_plugins)) if kept_plugins else F.lit(False), F.lit(False)) & F.col("__anchor").isNotNull() & (F.col("__durability") != "pinned"))
    days = lambda c: F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(c)) / F.lit(86_400_000_000.0))
    factor = lambda table: F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("__durability")], F.lit(1.0))
    spared = F.when(F.col("__importance") > DECAY_SOFT_IMPORTANCE, 1.0 + F.least(F.lit(3.0), (F.col("__importance") - DECAY_SOFT_IMPORTANCE) / (1.0 - DECAY_SOFT_IMPORTANCE) * 3.0)).otherwise(1.0)
    least = lambda base, f: F.greatest(F.lit(1), F.floor(base * f)).cast("double")
    rows = rows.withColumns({
        "__age": days(F.col("__anchor")), "__idle": days(F.coalesce("last_injected_at", "last_accessed_at", "__anchor")),
        "__least_age": least(DECAY_AGE_DAYS, factor(AGE_FACTOR) * spared * (1.0 + F.col("__weight") * 2.0)), "__least_idle": least(DECAY_IDLE_DAYS, factor(IDLE_FACTOR) * F.greatest(F.lit(1.0), F.when(F.col("__importance") > DECAY_SOFT_IMPORTANCE, spared * 0.75).otherwise(1.0)) * (1.0 + F.col("__weight") * 1.5)),
    }).where("__age >= __least_age and __idle >= __least_idle")
    ratio = lambda a, b: F.least(F.lit(3.0), F.col(a) / F.col(b))
    raw = ratio("__age", "__least_age") * 0.35 + ratio("__idle", "__least_idle") * 0.35 + (1.0 - F.col("__importance")) * 0.2 + (1.0 - F.col("__confidence")) * 0.1
    eased = raw * F.when(F.col("__mode") == "slow_decay", 0.72).when(F.col("__mode") == "summary_decay", 0.86).otherwise(1.0)
    eased = eased * F.when(F.col("__mode").isin("scar_slow_decay", "creative_milestone") | F.col("__phase").isin("conflict", "repair", "comfort"), 0.62).otherwise(1.0) * F.when(F.col("__fresh") >= 0.45, 0.82).otherwise(1.0)
    held = F.coalesce(F.nullif(F.col("reinforcement_score"), F.lit(0.0)), meta("reinforcement_score").try_cast("double"), F.lit(0.0))
    score = F.greatest(F.lit(0.0), eased - 0.25 * _unit(held) * F.pow(F.lit(2.0), -F.col("__idle") / 60.0))
    out = rows.withColumns({"score": score, "age_days": F.round("__age", 1), "idle_days": F.round("__idle", 1), "persona_id": F.coalesce(F.nullif(meta("persona_id"), F.lit("")), F.lit("legacy_persona")), "owner_id": decay_owner()}).where(F.col("score") >= threshold)
    return out.withColumn("score", F.round("score", 3)).drop(*[c for c in rows.columns if c.startswith("__")])


DECAY_GROUP = ("platform", "owner_bot_id", "persona_id", "scope", "owner_id", "visibility")


def grouped_candidates(candidates: DataFrame) -> DataFrame:
    """``candidates`` with the parts of their group's name filled in where they are null or empty."""
    filled = {"platform": "unknown_platform", "owner_bot_id": "legacy_bot_owner", "persona_id": "legacy_persona", "scope": "unknown", "visibility": ""}
    return candidates.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v)) for c, v in filled.items()})


def decay_groups(candidates: DataFrame) -> DataFrame:
    """Per group of candidates its size and top score."""
    return grouped_candidates(candidates).groupBy(*DECAY_GROUP).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top_score"))


def summarise_groups(candidates: DataFrame, at_least: int = 4, most: int = 24, quoted: int = 8) -> DataFrame:
    """One row per group of at least ``at_least`` candidates, made of its ``most`` highest: span, bounded importance, members and the ids of the first ``quoted``."""
    nth = Window.partitionBy(*DECAY_GROUP).orderBy(F.col("score").desc(), "id")
    rows = grouped_candidates(candidates).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most)
    seen = F.coalesce("occurred_at", "created_at")
    out = rows.groupBy(*DECAY_GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.min(seen).alias("start_at"), F.max(seen).alias("end_at"), F.round(F.greatest(F.lit(0.45), F.least(F.lit(0.78), F.max("importance") + 0.05)), 6).alias("importance"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= quoted, F.struct("nth", "id")))), lambda x: x["id"]).alias("evidence"),
    )
    return out.where(F.col("n") >= at_least)


def usage(logs: DataFrame, task: str, amount: str) -> DataFrame:
    """Calls, total, mean and largest amount per task, and over all with a null task."""
    return logs.groupingSets([[], [F.col(task)]], F.col(task)).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(amount), 4).alias("total"), F.round(F.avg(amount), 6).alias("mean"), F.max(amount).alias("largest")).select(F.col(task).alias("task"), "calls", "total", "mean", "largest")


def scoped_clear(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(table_name, n) of the rows that clearing a scope would delete; nothing is deleted."""
    counts = [df.where(where).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, (df, where) in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` less the rows whose key is among ``gone`` (column id): one step of a cascade delete."""
    return df.join(gone.select(F.col("id").alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def near_quantile(df: DataFrame, group: str, value: str, share: float = 0.95, margin: float = 0.001, few: int = 4096) -> DataFrame:
    """(group, p) the value at index int(n * share) - 1 of a group's sorted values, at least the first; nulls are left out.

    A bounded digest per group tells between which values it lies, rows below
    are only counted, and the few between are counted by value and gone through
    in order, so no task sorts a group. Groups of up to ``few`` rows are gone
    through whole.
    """
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    near = F.percentile_approx("v", [max(0.0, share - margin), min(1.0, share + margin)], F.lit(10_000))
    bounds = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), near.alias("near"), F.min("v").alias("least"), F.max("v").alias("most"))
    bounds = bounds.select(F.col(group).alias("__g"), F.greatest(F.lit(1), F.floor(F.col("n") * share)).alias("k"), *[F.when(F.col("n") <= few, edge).otherwise(F.col("near")[i]).alias(name) for i, (name, edge) in enumerate((("lo", F.col("least")), ("hi", F.col("most"))))])
    met = rows.join(bounds, F.col(group).eqNullSafe(F.col("__g"))).where(F.col("v") <= F.col("hi"))
    counted = met.groupBy(group, "k", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("upto", upto).where(F.col("v").isNotNull() & (F.col("upto") >= F.col("k"))).groupBy(group).agg(F.min("v").alias("p"))
