"""Queries of merging, graphs, revisions, segments and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, merging, reports, revisions, scans, segments
from ..runtime import table
from .reading import _SEEN, NOW, _at, _memories, _timeline

TOPICS = ["lantern", "violin", "bakery"]


def dedupe_merge(spark, sf_dir):
    out = merging.merge_records(_memories(spark, sf_dir))
    return out.select("id", "content", "importance", "confidence", "created_at", "updated_at", "merged_count", "n_rows")


def maintenance_dedupe(spark, sf_dir):
    return merging.repair_duplicates(_memories(spark, sf_dir), "content")


def identity_merge(spark, sf_dir):
    out = merging.merge_identities(table(spark, sf_dir, "identities"))
    return out.select("platform", "entity_kind", "entity_id", "display_name", "role", "confidence", F.concat_ws("|", "aliases").alias("aliases"))


def relationship_edges(spark, sf_dir):
    """Each memory is an observation that its type relates its subject and object."""
    m = _memories(spark, sf_dir)
    ends = [F.col(f"{s}.{p}").alias(f"{s}_{p}") for s in ("subject", "object") for p in ("kind", "id", "name")]
    observed = m.select("id", *ends, F.col("memory_type").alias("relation_type"), "scope", "session_id", "group_id", "visibility", "evidence", "confidence", "review_status", F.col("id").alias("source_memory_id"), "metadata", F.coalesce("updated_at", "created_at").alias("seen_at"))
    out = merging.merge_relationships(observed)
    return out.select(*merging.RELATION, "id", "group_id", "subject_name", "visibility", "evidence", "source_memory_id", F.round("confidence", 9).alias("confidence"), "updated_at", "n_observed", F.size(F.from_json("metadata", "map<string,string>")).alias("n_fields"))


def single_value_conflicts(spark, sf_dir):
    rows = _memories(spark, sf_dir).where("memory_type = 'preference'").withColumn("subject_id", F.col("subject.id"))
    return merging.single_value_conflicts(rows, ["owner_bot_id", "subject_id"], "canonical_key")


def keyed_upsert(spark, sf_dir):
    m = _memories(spark, sf_dir).select("id", "importance", "updated_at")
    changes = m.where("importance > 0.5").select("id", F.lit(1.0).alias("importance"), "updated_at").unionByName(m.where("importance > 0.8").select("id", F.lit(2.0).alias("importance"), (F.col("updated_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at")))
    return merging.upsert(m, changes, ["id"], "updated_at").select("id", "importance")


def feedback_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    reactions = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("source_id"), F.col("ts").alias("at"), ((F.col("value") % 10 - 5) / 40).alias("delta"))
    return merging.fold_reactions(reactions).select("key", F.round("level", 6).alias("level"))


def graph_nodes(spark, sf_dir):
    return graph.build(_memories(spark, sf_dir))[0].groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def graph_edges(spark, sf_dir):
    return graph.build(_memories(spark, sf_dir))[1].select("source", "target", "relation", "memory_id")


def graph_edge_page(spark, sf_dir):
    m = _memories(spark, sf_dir)
    return graph.edge_page(graph.build(m)[1], m, {"scope": "group", "group_id": "880000001", "session_id": None}, 150).select("source", "target", "relation", "memory_id")


def graph_paths(spark, sf_dir):
    nodes, edges = graph.build(_memories(spark, sf_dir))
    return graph.paths(nodes.where("node_type = 'topic'"), edges, TOPICS).select("source", "target", "relation", "memory_id")


def graph_expand(spark, sf_dir):
    nodes, edges = graph.build(_memories(spark, sf_dir))
    return graph.neighbours(edges, nodes.where(F.col("label").isin(TOPICS) & (F.col("node_type") == "topic"))).select("start", "node")


def graph_two_hop(spark, sf_dir):
    nodes, edges = graph.build(_memories(spark, sf_dir))
    starts = nodes.where(F.col("label").isin(TOPICS) & (F.col("node_type") == "topic"))
    return graph.walk(edges, starts, 2, ["has_topic", "subject_of"])


def _revised(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts", "value")
    return events.withColumn("revision", F.expr("cast(row_number() over (partition by user_id, event_type, date(ts) order by ts, event_id) as bigint)")).withColumn("day", F.to_date("ts"))


def latest_revision_antijoin(spark, sf_dir):
    return revisions.latest_revision(_revised(spark, sf_dir), ["user_id", "event_type", "day"]).select("user_id", "event_type", "day", "revision", "event_id")


def delivery_keyset(spark, sf_dir):
    events = _revised(spark, sf_dir)
    acks = events.where("event_id % 3 = 0").select("event_id", "revision", F.lit("c1").alias("consumer_id"))
    return revisions.undelivered(events, acks, "c1", (_at("2024-01-05"), F.lit(0).cast("bigint")), 200, ["ts", "event_id"]).select("event_id", "revision")


def revision_gaps(spark, sf_dir):
    kept = _revised(spark, sf_dir).where("event_id % 7 <> 0").select(F.concat_ws("/", "user_id", "event_type", "day").alias("stream"), "revision")
    return revisions.gaps(kept, "stream")


def compare_and_set(spark, sf_dir):
    number = F.expr("row_number() over (partition by user_id order by ts, event_id)").cast("bigint").alias("revision")
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    changes = events.select(F.col("user_id").alias("key"), "event_id", F.col("ts").alias("at"), number, (F.col("event_type") == "error").alias("tombstone"))
    return revisions.compare_and_set(changes, "key").select("key", "revision", "applied", "deleted")


def _turns(spark, sf_dir):
    rows = table(spark, sf_dir, "parsed_messages", "row_id", "import_batch_id", "speaker", "occurred_at", "content")
    return segments.turns(rows, "import_batch_id", "occurred_at", "speaker", "content", "row_id")


def burst_merge(spark, sf_dir):
    return _turns(spark, sf_dir).drop("closes", "opens")


def segment_limits(spark, sf_dir):
    """Speakers whose name has an 'a' are the users, so that both sides talk; limits are small, so that they act."""
    return segments.limited_segments(_turns(spark, sf_dir), "import_batch_id", F.lower("speaker").contains("a"), max_turns=6, max_chars=400)


def package_prefix(spark, sf_dir):
    rows = _turns(spark, sf_dir).groupBy("import_batch_id", "piece").agg(F.sum("n_chars").alias("chars"))
    return segments.first_package(rows, "import_batch_id", "piece", "chars").select("import_batch_id", "piece", "used")


def ack_asof_join(spark, sf_dir):
    return segments.first_reply(_timeline(spark, sf_dir), "session_id", "occurred_at")


def bucket_report(spark, sf_dir):
    return reports.buckets(_memories(spark, sf_dir))


def preferred_session(spark, sf_dir):
    return reports.preferred_session(_memories(spark, sf_dir))


def stats_by_scope(spark, sf_dir):
    return reports.counts_with_total(_memories(spark, sf_dir), "scope")


def raw_retention(spark, sf_dir):
    return reports.raw_retention(_memories(spark, sf_dir), _at("2026-05-12"))


#: When the memories are old enough for some to fade.
LATER = "2027-03-01 00:00:00"
#: Whose memories don't fade.
KEPT_PLUGINS = ("diary_bridge",)


def decay_score(spark, sf_dir):
    return reports.decay_candidates(_memories(spark, sf_dir), _at(LATER), kept_plugins=KEPT_PLUGINS).select("id", "age_days", "idle_days", "score")


def decay_groups(spark, sf_dir):
    return reports.decay_groups(reports.decay_candidates(_memories(spark, sf_dir), _at(LATER), kept_plugins=KEPT_PLUGINS))


def decay_summary(spark, sf_dir):
    out = reports.summarise_groups(reports.decay_candidates(_memories(spark, sf_dir), _at(LATER), kept_plugins=KEPT_PLUGINS))
    return out.select(*reports.DECAY_GROUP, "n", "start_at", "end_at", "importance", F.concat_ws("|", "evidence").alias("evidence"))


def usage_report(spark, sf_dir):
    return reports.usage(table(spark, sf_dir, "events", "event_type", "value"), "event_type", "value")


def _hanging(spark, sf_dir) -> dict:
    """What hangs on memories: edges and relationships, reviews, vectors and the log of what was told."""
    m = _memories(spark, sf_dir)
    return {
        "knowledge_edges": graph.build(m)[1].select("memory_id"), "relationship_edges": m.where("subject.id is not null and object.id is not null").select(F.col("id").alias("memory_id")), "review_queue": m.where("review_status = 'pending'").select(F.col("id").alias("memory_id")),
        "memory_embeddings": m.where("content is not null").select(F.col("id").alias("memory_id")), "injection_logs": m.where("last_injected_at is not null").select(F.col("id").alias("memory_id")),
    }


def scoped_clear_preview(spark, sf_dir):
    """What clearing a group would delete from the tables that name it and from those that hang on its memories."""
    group = "880000001"
    m = _memories(spark, sf_dir)
    ids = m.where(F.col("group_id") == group).select(F.col("id").alias("memory_id"))
    own = {"memories": (m, F.col("group_id") == group), "timeline": (_timeline(spark, sf_dir), F.col("session_id").endswith(f":{group}")), "knowledge_nodes": (graph.build(m)[0], (F.col("node_type") == "window") & F.col("label").endswith(f":{group}"))}
    hanging = {n: (df.join(ids, "memory_id", "left_semi"), F.lit(True)) for n, df in _hanging(spark, sf_dir).items()}
    return reports.scoped_clear(own | hanging)


def cascade_delete(spark, sf_dir):
    """What is left of each table after the expired memories and all that hangs on them are gone."""
    m = _memories(spark, sf_dir)
    gone = m.where("validity_status = 'expired'").select("id")
    tables = {"memories": (m, "id")} | {n: (df, "memory_id") for n, df in _hanging(spark, sf_dir).items()}
    left = {n: (reports.without(df, gone, key), F.lit(True)) for n, (df, key) in tables.items()}
    return reports.scoped_clear(left)


def union_name_lookup(spark, sf_dir):
    m = _memories(spark, sf_dir).where("subject.kind = 'user' and subject.name is not null").select(F.col("subject.id").alias("entity_id"), F.col("subject.name").alias("name"), scans.last_seen().alias("at"))
    listed = table(spark, sf_dir, "identities").where("display_name is not null").select("entity_id", F.col("display_name").alias("name"), F.col("updated_at").alias("at"))
    names = m.unionByName(listed)
    return names.groupBy("entity_id").agg(F.max_by("name", F.struct("at", "name")).alias("name"))


def queries() -> dict:
    named = (
        dedupe_merge, maintenance_dedupe, identity_merge, relationship_edges, single_value_conflicts, keyed_upsert, feedback_fold, graph_nodes, graph_edges, graph_edge_page, graph_paths, graph_expand, graph_two_hop, latest_revision_antijoin, delivery_keyset, revision_gaps,
        compare_and_set, burst_merge, segment_limits, package_prefix, ack_asof_join, bucket_report, preferred_session, stats_by_scope, raw_retention, decay_score, decay_groups, decay_summary, usage_report, scoped_clear_preview, cascade_delete, union_name_lookup,
    )
    return {f.__name__: f for f in named}


_EDGES = """e AS (SELECT DISTINCT source, target, relation, memory_id FROM (
  SELECT 'window:' || session_id AS source, 'memory:' || id AS target, 'contains_memory' AS relation, id AS memory_id FROM memories
  UNION ALL SELECT subject.kind || ':' || subject.id, 'memory:' || id, 'subject_of', id FROM memories UNION ALL SELECT object.kind || ':' || object.id, 'memory:' || id, 'object_of', id FROM memories
  UNION ALL SELECT subject.kind || ':' || subject.id, 'window:' || session_id, 'participated_in', id FROM memories
  UNION ALL SELECT 'memory:' || id, 'topic:' || tag, 'has_topic', id FROM (SELECT id, unnest(tags) AS tag FROM memories) WHERE tag IS NOT NULL) WHERE source IS NOT NULL AND target IS NOT NULL)"""
_HANGING = """h AS (SELECT 'knowledge_edges' AS table_name, memory_id FROM e UNION ALL SELECT 'relationship_edges', id FROM memories WHERE subject.id IS NOT NULL AND object.id IS NOT NULL UNION ALL SELECT 'review_queue', id FROM memories WHERE review_status = 'pending'
  UNION ALL SELECT 'memory_embeddings', id FROM memories WHERE content IS NOT NULL UNION ALL SELECT 'injection_logs', id FROM memories WHERE last_injected_at IS NOT NULL)"""
_BOTH = "b AS (SELECT source AS a, target AS z, relation FROM e UNION ALL SELECT target, source, relation FROM e)"
_STARTS = "('topic:lantern'), ('topic:violin'), ('topic:bakery')"
_REVISED = "r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS revision, ts::DATE AS day FROM events)"
_TURNS = """m AS (SELECT *, epoch_us(occurred_at) AS us FROM parsed_messages WHERE import_batch_id IS NOT NULL AND occurred_at IS NOT NULL), p AS (SELECT *, sum(new) OVER (PARTITION BY import_batch_id ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS piece FROM (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY import_batch_id ORDER BY us, row_id) <= 7200000000 THEN 0 ELSE 1 END AS new FROM m)), q AS (SELECT * EXCLUDE (new), CASE WHEN row_number() OVER w > 1 AND speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND us - lag(us) OVER w <= 120000000 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY import_batch_id, piece ORDER BY us, row_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY import_batch_id, piece ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS turn FROM q),
t AS (SELECT import_batch_id, piece::BIGINT AS piece, turn::BIGINT AS turn, any_value(speaker) AS speaker, min(us) AS start_us, max(us) AS end_us, count(*) AS n_messages, sum(length(coalesce(content, '')))::BIGINT AS n_chars,
  bool_or(regexp_matches(regexp_replace(coalesce(content, ''), '\\s+', '', 'g'), '晚安|睡吧|先这样|回聊|不聊了|下次聊|拜拜|再见')) AS closes, bool_or(regexp_matches(regexp_replace(coalesce(content, ''), '\\s+', '', 'g'), '早|在吗|醒了吗|新年快乐')) AS opens, coalesce(contains(lower(any_value(speaker)), 'a'), false) AS mine FROM s GROUP BY 1, 2, 3)"""
_OW = """w AS (SELECT *, CASE WHEN scope = 'group' AND coalesce(group_id, CASE WHEN lower(session_id) LIKE '%:groupmessage:%' THEN split_part(session_id, ':', 3) END) IS NOT NULL THEN 'group' WHEN scope = 'private' AND coalesce(CASE WHEN subject.kind = 'user' THEN subject.id END, CASE WHEN object.kind = 'user' THEN object.id END) IS NOT NULL THEN 'private' END AS ws,
  CASE WHEN scope = 'group' THEN coalesce(group_id, CASE WHEN lower(session_id) LIKE '%:groupmessage:%' THEN split_part(session_id, ':', 3) END) WHEN scope = 'private' THEN coalesce(CASE WHEN subject.kind = 'user' THEN subject.id END, CASE WHEN object.kind = 'user' THEN object.id END) END AS wi FROM memories)"""
def _json(name: str) -> str:
    return f"(metadata->>'{name}')"


_UNIT = "greatest(0.0, least(1.0, coalesce({0}, 0.0)))"
_DECAY = f"""d AS (SELECT *, lower(trim(coalesce({_json("decay_mode")}, ''))) AS dmode, lower(trim(coalesce({_json("relationship_phase")}, ''))) AS phase, coalesce(nullif(lower(trim(durability)), ''), 'normal') AS dur, coalesce(occurred_at, created_at) AS anchor,
  greatest({", ".join(_UNIT.format(f"TRY_CAST({_json(w)} AS DOUBLE)") for w in ("promise_weight", "open_loop_weight", "creative_weight", "scar_weight", "emotional_debt_weight"))}) AS weight, {_UNIT.format(f"TRY_CAST({_json('freshness_weight')} AS DOUBLE)")} AS fresh, {_UNIT.format("importance")} AS imp, {_UNIT.format("confidence")} AS conf FROM memories),
a AS (SELECT *, greatest(0.0, (epoch_us('{LATER}'::TIMESTAMPTZ) - epoch_us(anchor)) / 86400000000.0) AS age, greatest(0.0, (epoch_us('{LATER}'::TIMESTAMPTZ) - epoch_us(coalesce(last_injected_at, last_accessed_at, anchor))) / 86400000000.0) AS idle,
  CASE WHEN imp > 0.74 THEN 1.0 + least(3.0, (imp - 0.74) / (1.0 - 0.74) * 3.0) ELSE 1.0 END AS spared, CASE dur WHEN 'ephemeral' THEN 0.05 WHEN 'short' THEN 0.35 WHEN 'durable' THEN 4.0 ELSE 1.0 END AS fa, CASE dur WHEN 'ephemeral' THEN 0.05 WHEN 'short' THEN 0.35 WHEN 'durable' THEN 3.0 ELSE 1.0 END AS fi FROM d
  WHERE dmode <> 'no_decay' AND lower(coalesce(memory_type, '')) NOT IN ('manual_memory', 'explicit_memory', 'companion_note') AND NOT list_has_any(list_transform(coalesce(tags, []), lambda t: lower(trim(coalesce(t, '')))), ['manual', 'needs_review', 'protected', 'no_decay', 'keep'])
  AND coalesce(visibility, '') <> 'bot_self' AND coalesce(source_plugin, '') <> 'diary_bridge' AND anchor IS NOT NULL AND dur <> 'pinned'),
l AS (SELECT *, greatest(1, floor(180 * (fa::DOUBLE * spared * (1.0 + weight * 2.0)))) AS la, greatest(1, floor(90 * (fi::DOUBLE * greatest(1.0, CASE WHEN imp > 0.74 THEN spared * 0.75 ELSE 1.0 END) * (1.0 + weight * 1.5)))) AS li FROM a),
r AS (SELECT *, (least(3.0, age / la) * 0.35 + least(3.0, idle / li) * 0.35 + (1.0 - imp) * 0.2 + (1.0 - conf) * 0.1) * CASE dmode WHEN 'slow_decay' THEN 0.72 WHEN 'summary_decay' THEN 0.86 ELSE 1.0 END * CASE WHEN dmode IN ('scar_slow_decay', 'creative_milestone') OR phase IN ('conflict', 'repair', 'comfort') THEN 0.62 ELSE 1.0 END
  * CASE WHEN fresh >= 0.45 THEN 0.82 ELSE 1.0 END AS eased, {_UNIT.format(f"coalesce(nullif(reinforcement_score, 0.0), TRY_CAST({_json('reinforcement_score')} AS DOUBLE), 0.0)")} AS held FROM l WHERE age >= la AND idle >= li),
f AS (SELECT *, greatest(0.0, eased - 0.25 * held * pow(2.0, -idle / 60.0)) AS exact FROM r),
c AS (SELECT id, round(age, 1) AS age_days, round(idle, 1) AS idle_days, round(exact, 3) AS score, importance, coalesce(occurred_at, created_at) AS seen, coalesce(nullif(trim(platform), ''), 'unknown_platform') AS platform, coalesce(nullif(trim(owner_bot_id), ''), 'legacy_bot_owner') AS owner_bot_id, coalesce(nullif({_json("persona_id")}, ''), 'legacy_persona') AS persona_id,
  coalesce(nullif(trim(scope), ''), 'unknown') AS scope, coalesce(CASE WHEN scope = 'group' OR visibility = 'group_public' THEN coalesce(nullif(group_id, ''), nullif(object.id, ''), nullif(subject.id, ''), nullif(session_id, ''))
    WHEN scope = 'private' OR visibility = 'private_pair' THEN coalesce(CASE WHEN subject.kind = 'user' AND subject.id NOT IN ('', 'self') THEN subject.id END, CASE WHEN object.kind = 'user' AND object.id NOT IN ('', 'self') THEN object.id END, nullif(session_id, ''), nullif(group_id, ''), nullif(object.id, ''), nullif(subject.id, ''))
    ELSE coalesce(nullif(session_id, ''), nullif(group_id, ''), nullif(object.id, ''), nullif(subject.id, '')) END, '') AS owner_id, coalesce(trim(visibility), '') AS visibility FROM f WHERE exact >= 0.75)"""


def oracle_sql() -> dict[str, str]:
    newest = "ORDER BY ({0} IS NOT NULL) DESC, coalesce(updated_at, created_at) DESC NULLS LAST, id DESC"
    return {
        "dedupe_merge": f"""SELECT min(id) AS id, first(content {newest.format("content")}) AS content, max(importance) AS importance, max(confidence) AS confidence, min(created_at) AS created_at, max(updated_at) AS updated_at, sum(coalesce(merged_count, 1))::BIGINT AS merged_count, count(*) AS n_rows
FROM memories GROUP BY coalesce(content_fingerprint, 'id:' || id)""",
        "maintenance_dedupe": """WITH k AS (SELECT content AS k, first(id ORDER BY coalesce(merged_count, 0) DESC, coalesce(importance, 0) DESC, created_at ASC NULLS LAST, id) AS keep_id FROM memories WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT id, keep_id FROM memories JOIN k ON content = k WHERE id <> keep_id""",
        "identity_merge": f"""WITH a AS (SELECT platform, entity_kind, entity_id, array_to_string(list_sort(list(DISTINCT alias)), '|') AS aliases FROM (SELECT platform, entity_kind, entity_id, unnest(list_append(coalesce(aliases, []), display_name)) AS alias FROM identities) WHERE alias IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT platform, entity_kind, entity_id, first(display_name {newest.format("display_name")}) AS display_name, first(role {newest.format("role")}) AS role, max(confidence) AS confidence FROM identities GROUP BY 1, 2, 3)
SELECT g.*, coalesce(aliases, '') AS aliases FROM g LEFT JOIN a ON a.entity_id = g.entity_id AND a.platform IS NOT DISTINCT FROM g.platform AND a.entity_kind IS NOT DISTINCT FROM g.entity_kind""",
        "relationship_edges": """WITH o AS (SELECT coalesce(subject.kind, '') AS subject_kind, coalesce(subject.id, '') AS subject_id, coalesce(object.kind, '') AS object_kind, coalesce(object.id, '') AS object_id, coalesce(memory_type, '') AS relation_type, coalesce(scope, '') AS scope, coalesce(session_id, '') AS session_id,
  id, group_id, subject.name AS subject_name, visibility, evidence, confidence, metadata, coalesce(updated_at, created_at) AS seen FROM memories),
f AS (SELECT subject_kind, subject_id, object_kind, object_id, relation_type, scope, session_id, count(DISTINCT k) AS n_fields FROM (SELECT *, unnest(json_keys(metadata)) AS k FROM o WHERE metadata IS NOT NULL) GROUP BY ALL),
g AS (SELECT subject_kind, subject_id, object_kind, object_id, relation_type, scope, session_id, first(id ORDER BY seen NULLS FIRST, id) AS id, first(group_id ORDER BY seen NULLS FIRST, id) AS group_id, last(subject_name ORDER BY seen NULLS FIRST, id) AS subject_name, last(visibility ORDER BY seen NULLS FIRST, id) AS visibility,
  last(evidence ORDER BY seen NULLS FIRST, id) AS evidence, last(id ORDER BY seen NULLS FIRST, id) AS source_memory_id, round(max(greatest(0.0, least(1.0, coalesce(confidence, 0.0)))), 9) AS confidence, max(seen) AS updated_at, count(*) AS n_observed
  FROM o GROUP BY subject_kind, subject_id, object_kind, object_id, relation_type, scope, session_id)
SELECT g.*, coalesce(n_fields, 0)::INT AS n_fields FROM g LEFT JOIN f USING (subject_kind, subject_id, object_kind, object_id, relation_type, scope, session_id)""",
        "single_value_conflicts": "SELECT owner_bot_id, subject.id AS subject_id, count(DISTINCT canonical_key) AS n_values, count(*) AS n_rows FROM memories WHERE memory_type = 'preference' AND validity_status = 'active' AND lifecycle <> 'archived' GROUP BY 1, 2 HAVING count(DISTINCT canonical_key) > 1",
        "keyed_upsert": "SELECT id, CASE WHEN importance > 0.8 THEN 2.0 WHEN importance > 0.5 THEN 1.0 ELSE importance END AS importance FROM memories",
        "feedback_fold": """WITH RECURSIVE o AS (SELECT user_id, (value % 10 - 5) / 40 AS delta, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, 0::BIGINT AS n, 0.5::DOUBLE AS level FROM o GROUP BY user_id UNION ALL SELECT f.user_id, o.n, greatest(0.0, least(1.0, level + delta)) FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id AS key, round(arg_max(level, n), 6) AS level FROM f GROUP BY user_id""",
        "graph_nodes": """SELECT node_type, count(DISTINCT node) AS n FROM (SELECT 'memory:' || id AS node, 'memory' AS node_type FROM memories UNION ALL SELECT 'window:' || session_id, 'window' FROM memories UNION ALL SELECT subject.kind || ':' || subject.id, subject.kind FROM memories
UNION ALL SELECT object.kind || ':' || object.id, object.kind FROM memories UNION ALL SELECT 'topic:' || tag, 'topic' FROM (SELECT unnest(tags) AS tag FROM memories)) WHERE node IS NOT NULL GROUP BY node_type""",
        "graph_edges": f"WITH {_EDGES} SELECT * FROM e",
        "graph_edge_page": f"WITH {_EDGES} SELECT e.* FROM e JOIN memories m ON m.id = e.memory_id WHERE m.scope = 'group' AND m.group_id = '880000001' ORDER BY m.confidence DESC NULLS LAST, source, target, relation, memory_id LIMIT 150",
        "graph_paths": f"WITH {_EDGES}, s AS (SELECT DISTINCT 'topic:' || tag AS node FROM (SELECT unnest(tags) AS tag FROM memories) WHERE contains(lower(tag), 'lantern') OR contains(lower(tag), 'violin') OR contains(lower(tag), 'bakery')) SELECT e.* FROM e JOIN memories m ON m.id = e.memory_id WHERE source IN (SELECT node FROM s) OR target IN (SELECT node FROM s) ORDER BY m.confidence DESC NULLS LAST, source, target, relation, memory_id LIMIT 200",
        "graph_expand": f"WITH {_EDGES}, {_BOTH}, s AS (SELECT * FROM (VALUES {_STARTS}) v(node)) SELECT a AS start, z AS node FROM b JOIN s ON s.node = b.a",
        "graph_two_hop": f"""WITH {_EDGES}, {_BOTH}, k AS (SELECT DISTINCT a, z FROM b WHERE relation IN ('has_topic', 'subject_of')), s AS (SELECT v.node FROM (VALUES {_STARTS}) v(node) WHERE v.node IN (SELECT a FROM k)),
h AS (SELECT node AS start, node, 0 AS hops FROM s UNION ALL SELECT s.node, k.z, 1 FROM s JOIN k ON k.a = s.node UNION ALL SELECT s.node, j.z, 2 FROM s JOIN k ON k.a = s.node JOIN k j ON j.a = k.z)
SELECT start, node, min(hops) AS hops FROM h GROUP BY 1, 2""",
        "latest_revision_antijoin": f"WITH {_REVISED} SELECT user_id, event_type, day, revision, event_id FROM r WHERE NOT EXISTS (SELECT 1 FROM r n WHERE n.user_id = r.user_id AND n.event_type = r.event_type AND n.day = r.day AND n.revision > r.revision)",
        "delivery_keyset": f"WITH {_REVISED} SELECT event_id, revision FROM r WHERE event_id % 3 <> 0 AND (ts > '2024-01-05' OR (ts = '2024-01-05' AND event_id > 0)) ORDER BY ts, event_id LIMIT 200",
        "revision_gaps": f"WITH {_REVISED}, k AS (SELECT concat_ws('/', user_id, event_type, day) AS stream, revision FROM r WHERE event_id % 7 <> 0), g AS (SELECT stream, lag(revision) OVER (PARTITION BY stream ORDER BY revision) AS after, revision AS before FROM k) SELECT * FROM g WHERE before > after + 1",
        "compare_and_set": """WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, min(n) FILTER (event_type = 'error') AS stop, max(n) AS last FROM o GROUP BY user_id)
SELECT user_id AS key, coalesce(stop, last) AS revision, coalesce(stop, last) AS applied, stop IS NOT NULL AS deleted FROM f""",
        "burst_merge": f"WITH {_TURNS} SELECT * EXCLUDE (closes, opens, mine) FROM t",
        "segment_limits": f"""WITH RECURSIVE {_TURNS}, o AS MATERIALIZED (SELECT *, lag(end_us) OVER w AS was, lag(closes) OVER w AS closed, lag(mine) OVER w AS asked FROM t WINDOW w AS (PARTITION BY import_batch_id, piece ORDER BY turn)),
x AS MATERIALIZED (SELECT *, coalesce(start_us - was > 1800000000 AND ((start_us + 28800000000) // 86400000000 <> (was + 28800000000) // 86400000000 OR closed OR opens), false) AS soft, (mine OR NOT coalesce(asked, false) OR start_us - was > 300000000) AS free FROM o),
g AS (SELECT import_batch_id, piece, turn, 0 AS segment, 1 AS k, n_chars AS chars FROM x WHERE turn = 1 UNION ALL
  SELECT x.import_batch_id, x.piece, x.turn, g.segment + CASE WHEN soft OR (free AND (k >= 6 OR chars + x.n_chars > 400)) THEN 1 ELSE 0 END, CASE WHEN soft OR (free AND (k >= 6 OR chars + x.n_chars > 400)) THEN 1 ELSE k + 1 END,
    CASE WHEN soft OR (free AND (k >= 6 OR chars + x.n_chars > 400)) THEN x.n_chars ELSE chars + x.n_chars END FROM g JOIN x ON x.import_batch_id = g.import_batch_id AND x.piece = g.piece AND x.turn = g.turn + 1)
SELECT x.import_batch_id, x.piece, x.turn, start_us, end_us, n_messages, n_chars, segment FROM x JOIN g USING (import_batch_id, piece, turn)""",
        "package_prefix": f"""WITH {_TURNS}, g AS (SELECT import_batch_id, piece, sum(n_chars) AS chars FROM t GROUP BY 1, 2), u AS (SELECT import_batch_id, piece, (sum(chars + 300) OVER w)::BIGINT AS used, row_number() OVER w AS nth FROM g WINDOW w AS (PARTITION BY import_batch_id ORDER BY piece ROWS UNBOUNDED PRECEDING))
SELECT import_batch_id, piece, used FROM u WHERE nth = 1 OR (nth <= 6 AND used <= 4600)""",
        "ack_asof_join": """WITH x AS (SELECT session_id, id, event_type, epoch_us(occurred_at) AS us FROM timeline WHERE session_id IS NOT NULL AND occurred_at IS NOT NULL), j AS (SELECT a.id, a.us, b.id AS reply_id, b.us AS rus, row_number() OVER (PARTITION BY a.id ORDER BY b.us, b.id) AS n
FROM x a JOIN x b ON a.session_id = b.session_id AND a.event_type = 'user_message' AND b.event_type = 'bot_response' AND b.us BETWEEN a.us AND a.us + 600000000) SELECT id, reply_id, rus - us AS wait_us FROM j WHERE n = 1""",
        "bucket_report": f"""WITH {_OW} SELECT ws AS scope, wi AS target_id, count(*) AS n, count(*) FILTER (lifecycle = 'stable_memory') AS n_stable, count(*) FILTER (memory_type = 'conversation_summary') AS n_summaries, max({_SEEN}) AS latest, first(id ORDER BY coalesce(importance, -1) DESC, {_SEEN} DESC NULLS LAST, id DESC) AS best_id,
count(DISTINCT owner_bot_id) AS n_bots, max(CASE WHEN subject.id = wi THEN subject.name END) AS name FROM w WHERE ws IS NOT NULL GROUP BY 1, 2""",
        "preferred_session": f"WITH g AS (SELECT subject.id AS user_id, session_id, count(*) AS n, max({_SEEN}) AS latest FROM memories WHERE scope = 'private' AND subject.kind = 'user' AND session_id IS NOT NULL AND subject.id IS NOT NULL GROUP BY 1, 2) SELECT user_id, session_id, n FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, latest DESC NULLS LAST, session_id) = 1",
        "stats_by_scope": "SELECT scope AS value, count(*) AS n, false AS total FROM memories GROUP BY scope UNION ALL SELECT NULL, count(*), true FROM memories",
        "raw_retention": f"SELECT id, {_SEEN} AS seen FROM memories WHERE lifecycle = 'raw_event' AND {_SEEN} < '2026-05-12'::TIMESTAMPTZ",
        "decay_score": f"WITH {_DECAY} SELECT id, age_days, idle_days, score FROM c",
        "decay_groups": f"WITH {_DECAY} SELECT platform, owner_bot_id, persona_id, scope, owner_id, visibility, count(*) AS n, max(score) AS top_score FROM c GROUP BY ALL",
        "decay_summary": f"""WITH {_DECAY}, n AS (SELECT *, row_number() OVER (PARTITION BY platform, owner_bot_id, persona_id, scope, owner_id, visibility ORDER BY score DESC, id) AS nth FROM c)
SELECT platform, owner_bot_id, persona_id, scope, owner_id, visibility, count(*) AS n, min(seen) AS start_at, max(seen) AS end_at, round(greatest(0.45, least(0.78, max(importance) + 0.05)), 6) AS importance, string_agg(id, '|' ORDER BY nth) FILTER (nth <= 8) AS evidence
FROM n WHERE nth <= 24 GROUP BY platform, owner_bot_id, persona_id, scope, owner_id, visibility HAVING count(*) >= 4""",
        "usage_report": "SELECT event_type AS task, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS largest FROM events GROUP BY GROUPING SETS ((), (event_type))",
        "scoped_clear_preview": f"""WITH {_EDGES}, {_HANGING}, g AS (SELECT id FROM memories WHERE group_id = '880000001'), n AS (SELECT DISTINCT session_id FROM memories WHERE session_id LIKE '%:880000001')
SELECT 'memories' AS table_name, count(*) AS n FROM g UNION ALL SELECT 'timeline', count(*) FROM timeline WHERE session_id LIKE '%:880000001' UNION ALL SELECT 'knowledge_nodes', count(*) FROM n UNION ALL SELECT table_name, count(*) FILTER (memory_id IN (SELECT id FROM g)) FROM h GROUP BY table_name""",
        "cascade_delete": f"""WITH {_EDGES}, {_HANGING}, x AS (SELECT id FROM memories WHERE validity_status = 'expired') SELECT 'memories' AS table_name, count(*) AS n FROM memories WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT table_name, count(*) FILTER (memory_id NOT IN (SELECT id FROM x)) FROM h GROUP BY table_name""",
        "union_name_lookup": f"""WITH n AS (SELECT subject.id AS entity_id, subject.name AS name, {_SEEN} AS seen FROM memories WHERE subject.kind = 'user' AND subject.name IS NOT NULL UNION ALL SELECT entity_id, display_name, updated_at FROM identities WHERE display_name IS NOT NULL)
SELECT entity_id, first(name ORDER BY seen DESC NULLS LAST, name DESC) AS name FROM n GROUP BY entity_id""",
    }
