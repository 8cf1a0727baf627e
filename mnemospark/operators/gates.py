"""Row-level gates: visibility, access rules and lifecycle, each with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_life_days
from ..runtime import small
from .scans import Context, last_seen, valid_at


def _owner(ctx: Context) -> Column:
    """Reason of bot ownership: which bots a row names, against the asking one."""
    bots = F.filter(
        F.array(F.when(F.col("subject.kind") == "bot", F.col("subject.id")), F.when(F.col("object.kind") == "bot", F.col("object.id")), F.col("owner_bot_id")),
        lambda b: b.isNotNull() & (b != "") & (b != "self"),
    )
    legacy = (F.col("memory_type") == "conversation_summary") & (F.col("scope") == "group")
    none = F.when(legacy & F.lit(bool(ctx.bot_id)), "ambiguous_bot_owner").otherwise("no_specific_bot_owner")
    same = F.array_contains(bots, ctx.bot_id) if ctx.bot_id else F.lit(False)
    return F.when(F.size(bots) == 0, none).when(same, "same_bot_owner").otherwise("other_bot_owner")


def visibility(ctx: Context, hide_pending: bool = True, raw_events: bool = False, admin: bool = False, groups_in_private: bool = False) -> Column:
    """struct(visible, reason); the first rule that applies decides."""
    owner = _owner(ctx)
    barred = owner.isin("other_bot_owner", "ambiguous_bot_owner")
    here = F.col("session_id").eqNullSafe(ctx.session_id) & F.lit(ctx.session_id is not None)
    reason = F.when(F.col("lifecycle").eqNullSafe("archived"), "archived")
    if hide_pending:
        reason = reason.when(F.col("review_status").eqNullSafe("pending"), "pending_review")
    if not raw_events:
        reason = reason.when(F.col("lifecycle").eqNullSafe("raw_event"), "raw_event_disabled")
    reason = reason.when(F.col("visibility").eqNullSafe("internal"), "internal")
    if ctx.strict_session:
        reason = reason.when(F.lit(ctx.session_id is None), "strict_session_missing").when(~here, "strict_session_mismatch")
    if admin:
        reason = reason.when(F.lit(True), "admin_search")
    kind = F.col("visibility")
    user = ctx.user_id
    reason = reason.when((kind == "bot_self") & barred, owner).when(kind == "bot_self", "bot_self").when(kind == "shareable", "shareable")
    pair = kind == "private_pair"
    elsewhere = (F.lower(F.col("platform")) != (ctx.platform or "").lower()) & ~F.lower(F.col("platform")).isin("", "unknown") if ctx.platform and ctx.platform != "unknown" else F.lit(False)
    mine = (F.col("subject.id") == user) | (F.col("object.id") == user) if user else F.lit(False)
    target = F.col("session_id").endswith(f":{user}") & F.lower(F.col("session_id")).contains(":friendmessage:") if user else F.lit(False)
    reason = (
        reason.when(pair & barred, owner).when(pair & elsewhere, "other_platform").when(pair & here, "same_private_session")
        .when(pair & F.lit(ctx.scope != "private"), "private_pair_not_current_private").when(pair & mine, "same_private_user").when(pair & target, "same_private_session_target").when(pair, "other_private_pair")
    )
    group = kind == "group_public"
    same_group = F.col("group_id").eqNullSafe(ctx.group_id) & F.lit(ctx.scope == "group" and ctx.group_id is not None)
    open_here = F.lit(groups_in_private and ctx.scope == "private")
    reason = reason.when(group & (same_group | open_here) & barred, owner).when(group & same_group, "same_group").when(group & open_here, "group_public_allowed_in_private").when(group, "other_group_public")
    reason = reason.otherwise(F.concat(F.lit("unknown_visibility:"), F.coalesce(kind, F.lit(""))))
    seen = reason.isin("admin_search", "bot_self", "shareable", "same_private_session", "same_private_user", "same_private_session_target", "same_group", "group_public_allowed_in_private")
    return F.struct(seen.alias("visible"), reason.alias("reason"))


def owner_window() -> Column:
    """struct(scope, id) of the window a record belongs to; null if it has none."""
    group = F.coalesce("group_id", F.when(F.lower(F.col("session_id")).contains(":groupmessage:"), F.split_part("session_id", F.lit(":"), F.lit(3))))
    person = F.coalesce(F.when(F.col("subject.kind") == "user", F.col("subject.id")), F.when(F.col("object.kind") == "user", F.col("object.id")))
    return F.when((F.col("scope") == "group") & group.isNotNull(), F.struct(F.lit("group").alias("scope"), group.alias("id"))).when(
        (F.col("scope") == "private") & person.isNotNull(), F.struct(F.lit("private").alias("scope"), person.alias("id"))
    )


def access(memories: DataFrame, rules: DataFrame, policies: DataFrame, reader_scope: str, reader_id: str) -> DataFrame:
    """``memories`` with acl: 'deny', 'allow', 'open' or 'closed' for one reading window.

    ``rules``: owner_scope, owner_id, reader_scope, reader_id, effect, enabled;
    ``policies``: window_scope, window_id, read_mode, share_mode. A deny rule
    beats everything and an allow rule the policies. Otherwise a row is open
    where both windows are blacklisted by default (groups are, private windows
    are not), but never from a private window to a group.
    """
    mine = rules.where(F.col("enabled") & (F.col("reader_scope") == reader_scope) & (F.col("reader_id") == reader_id))
    effects = mine.groupBy(F.col("owner_scope").alias("__os"), F.col("owner_id").alias("__oi")).agg(F.bool_or(F.col("effect") == "deny").alias("__deny"), F.bool_or(F.col("effect") == "allow").alias("__allow"))
    modes = policies.select(F.col("window_scope").alias("__ws"), F.col("window_id").alias("__wi"), F.col("share_mode").alias("__share"))
    reading = policies.where((F.col("window_scope") == reader_scope) & (F.col("window_id") == reader_id)).select(F.first("read_mode").alias("__read"))
    default = lambda scope: F.when(scope == "group", "blacklist").otherwise("whitelist")
    rows = memories.withColumn("__owner", owner_window())
    rows = rows.join(small(effects), (F.col("__owner.scope") == F.col("__os")) & (F.col("__owner.id") == F.col("__oi")), "left")
    rows = rows.join(small(modes), (F.col("__owner.scope") == F.col("__ws")) & (F.col("__owner.id") == F.col("__wi")), "left").join(F.broadcast(reading), how="left")
    both = (F.coalesce("__share", default(F.col("__owner.scope"))) == "blacklist") & (F.coalesce("__read", default(F.lit(reader_scope))) == "blacklist")
    crossing = (F.col("__owner.scope") == "private") & F.lit(reader_scope == "group")
    acl = F.when(F.coalesce("__deny", F.lit(False)), "deny").when(F.coalesce("__allow", F.lit(False)), "allow").when(F.coalesce(both & ~crossing, F.lit(False)), "open").otherwise("closed")
    return rows.withColumn("acl", acl).drop("__owner", "__os", "__oi", "__deny", "__allow", "__ws", "__wi", "__share", "__read")


def lifecycle(ctx: Context, now: Column) -> Column:
    """struct(eligible, reason, decay): status, validity, sensitivity and owner, and how far the record has faded.

    decay is 2^(-age/half-life) of the durability, at least 0.05, 1 where
    nothing decays and 0 where the record isn't eligible.
    """
    owner = F.col("owner_bot_id")
    other = owner.isNotNull() & (owner != "") & ((owner != ctx.bot_id) if ctx.bot_id else F.lit(True))
    status = F.lower(F.coalesce("validity_status", F.lit("active")))
    reason = (
        F.when(status != "active", F.concat(F.lit("validity="), status)).when(F.coalesce(now < F.col("valid_from"), F.lit(False)), "validity=not_started").when(F.coalesce(now >= F.col("valid_to"), F.lit(False)), "validity=expired")
        .when(F.col("sensitivity").eqNullSafe("restricted"), "sensitivity=restricted").when(other, "owner_bot_mismatch").otherwise("eligible")
    )
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(last_seen())) / F.lit(86_400_000_000.0))
    faded = F.coalesce(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.pow(F.lit(2.0), -F.coalesce(age, F.lit(0.0)) / half_life_days(F.col("durability"))))), F.lit(1.0))
    ok = reason == "eligible"
    return F.struct(ok.alias("eligible"), reason.alias("reason"), F.when(ok, faded).otherwise(0.0).alias("decay"))


def with_lifecycle(score: Column, state: Column) -> Column:
    """A score weakened by decay and raised by salience and reinforcement; 0 for records that aren't eligible."""
    value = score * (0.65 + 0.35 * state["decay"]) + 0.12 * F.coalesce("salience", "importance", F.lit(0.0)) + F.least(F.lit(0.12), 0.12 * F.coalesce("reinforcement_score", F.lit(0.0)))
    return F.when(state["eligible"], F.greatest(F.lit(0.0), value)).otherwise(0.0)


__all__ = ["access", "lifecycle", "owner_window", "valid_at", "visibility", "with_lifecycle"]
