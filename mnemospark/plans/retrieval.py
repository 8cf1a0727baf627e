"""Queries of retrieval and ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, lexical, ranking, reports, scans, vectors
from ..runtime import table
from .reading import _FINDABLE, _GROUP_REASON, _OWNER, _OWNER_WINDOW, _PASSES, _SEEN, GROUP, NOW, TERMS, _at, _memories

DIMENSION = 64
PHRASE = "spare violin"
WINDOW = ("2026-05-10", "2026-05-14")


def _search(spark, sf_dir):
    return ranking.search(_memories(spark, sf_dir), TERMS, PHRASE, GROUP, _at(NOW), *map(_at, WINDOW))


def search_ranked(spark, sf_dir):
    return _search(spark, sf_dir).select("id", "hits", F.round("bm25", 6).alias("bm25"), F.round("rrf", 6).alias("rrf"), F.round("score", 5).alias("score"))


def term_idf(spark, sf_dir):
    return lexical.containment_idf(_memories(spark, sf_dir), lexical.haystack(), TERMS).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_postings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    index = lexical.postings(docs, "doc_id", F.col("text"))
    return lexical.bm25(index, ["lantern", "violin", "koffer", "guitarra"], *lexical.corpus_totals(docs, F.col("text"))).select(F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


def rrf_fusion(spark, sf_dir):
    return ranking.fuse(_routes(spark, sf_dir)).select("id", F.round("rrf", 8).alias("rrf"))


def candidate_merge(spark, sf_dir):
    return ranking.fuse(_routes(spark, sf_dir)).select("id", F.concat_ws("+", "routes").alias("routes"), F.round(ranking.agreement(ranking.families(F.col("routes"))), 4).alias("bonus"))


def _routes(spark, sf_dir):
    m = _memories(spark, sf_dir)
    important = F.col("importance").desc_nulls_last()
    return [
        ranking.ranked(scans.priority(m), "priority", important, F.col("occurred_at").desc_nulls_last()),
        ranking.ranked(scans.containing(m, TERMS), "keyword", F.col("session_id").isNull(), important),
        ranking.ranked(scans.time_window(m, *map(_at, WINDOW)), "time_window", important, scans.last_seen().desc_nulls_last()),
    ]


def rerank_convex(spark, sf_dir):
    pool = _memories(spark, sf_dir).select("id", "memory_type", "importance", "confidence")
    return ranking.convex(pool, "importance", "confidence", ["memory_type"]).select("id", F.round("combined", 6).alias("combined"))


def anchor_floor(spark, sf_dir):
    pool = scans.priority(_memories(spark, sf_dir), 32).select("id", F.col("importance").alias("combined"), (F.col("memory_type") == "preference").alias("anchor"))
    return ranking.anchor_floor(pool, 8).withColumn("place", F.col("place").cast("bigint"))


def mmr(spark, sf_dir):
    pool = _memories(spark, sf_dir)
    return ranking.diversify(pool.select(F.col("memory_type").alias("query_id"), "id", F.col("importance").alias("score"), lexical.haystack().alias("hay"), "tags", "source_plugin"), 8)


def slot_classify(spark, sf_dir):
    return _memories(spark, sf_dir).select("id", ranking.slot(GROUP).alias("slot"))


LIMITS = {"open_loop": 2, "self_timeline": 2, "user_profile": 3, "conversation_summary": 2, "current_window": 3, "stable_memory": 2}


def slot_allocation(spark, sf_dir):
    rows = _memories(spark, sf_dir).select("id", ranking.slot(GROUP).alias("slot"), F.col("importance").alias("score"))
    return ranking.allot(rows, LIMITS, 20, ("conversation_summary", "self_timeline")).withColumn("place", F.col("place").cast("bigint"))


def collapse_source(spark, sf_dir):
    return ranking.latest_only(_memories(spark, sf_dir), ["import_batch_id", "memory_type"], F.col("importance").desc_nulls_last(), scans.last_seen().desc_nulls_last()).select("id")


def collapse_latest_fact(spark, sf_dir):
    rows = _memories(spark, sf_dir).where("memory_type in ('user_fact', 'preference')").select("id", "owner_bot_id", F.col("subject.id").alias("subject_id"), "memory_type", scans.last_seen().alias("seen"), "importance")
    return ranking.latest_only(rows, ["owner_bot_id", "subject_id", "memory_type"], F.col("seen").desc_nulls_last(), F.col("importance").desc_nulls_last()).select("id")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


def knn_cosine(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = vectors.knn_exact(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", DIMENSION)
    return found.select("query", "key", F.round("cosine", 5).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def knn_cells(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    centres = vectors.fit_cells(rows, "vec_id", "embedding", DIMENSION, 16)
    return vectors.knn_cells(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", DIMENSION, centres, 12).select("query", "key", F.round("cosine", 5).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def recall_metrics(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vec_id % 50 = 0")
    found = vectors.knn_exact(rows, asked, "vec_id", "embedding", DIMENSION)
    return ranking.label_metrics(asked.select(F.col("vec_id").alias("query"), "label"), rows.select(F.col("vec_id").alias("key"), "label"), found, 10)


def p95_by_type(spark, sf_dir):
    return reports.near_quantile(table(spark, sf_dir, "events", "event_type", "value"), "event_type", "value").withColumnRenamed("p", "p95")


def _acl(spark, sf_dir):
    """Rules that deny a fifth of the windows and allow another to the reading group, and a policy that opens a third one."""
    owners = _memories(spark, sf_dir).select(gates.owner_window().alias("o")).where("o is not null").select("o.*").distinct()
    number = F.pmod(F.conv(F.substring(F.sha1("id"), 1, 8), 16, 10).cast("bigint"), F.lit(5))
    rules = owners.where(number < 2).select(F.col("scope").alias("owner_scope"), F.col("id").alias("owner_id"), F.lit("group").alias("reader_scope"), F.lit(GROUP.group_id).alias("reader_id"), F.when(number == 0, "deny").otherwise("allow").alias("effect"), F.lit(True).alias("enabled"))
    policies = owners.where(number == 2).select(F.col("scope").alias("window_scope"), F.col("id").alias("window_id"), F.lit("blacklist").alias("read_mode"), F.lit("whitelist").alias("share_mode"))
    return rules, policies


def _near(spark, sf_dir):
    """Memories stand for the vectors that their number falls on; what is near is near to the first vector."""
    rows = _vectors(spark, sf_dir)
    n = rows.count() or 1
    found = vectors.knn_exact(rows, rows.where("vec_id = 0"), "vec_id", "embedding", DIMENSION, 200, ranking.LEAST_COSINE)
    number = F.pmod(F.conv(F.substring("id", 13, 8), 16, 10).cast("bigint"), F.lit(n))
    return _memories(spark, sf_dir).select("id", number.alias("key")).join(found.select("key", "cosine"), "key").select("id", "cosine")


def _retrieved(spark, sf_dir, reranked=None):
    return ranking.retrieve(_memories(spark, sf_dir), TERMS, PHRASE, GROUP, _at(NOW), *_acl(spark, sf_dir), ("group", GROUP.group_id), LIMITS, 20, *map(_at, WINDOW), _near(spark, sf_dir), reranked)


def search_routes(spark, sf_dir):
    pool = ranking.candidate_pool(_memories(spark, sf_dir), TERMS, GROUP, *map(_at, WINDOW), _near(spark, sf_dir))
    return pool.select("id", F.concat_ws("+", "routes").alias("routes"), F.round("rrf", 8).alias("rrf"))


def search_blocked(spark, sf_dir):
    return _retrieved(spark, sf_dir)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def search_by_slots(spark, sf_dir):
    return _retrieved(spark, sf_dir)[0].select("id", "slot", "round", "place", F.round("score", 5).alias("score"))


def search_reranked(spark, sf_dir):
    """A reranker that prefers short texts."""
    m = _memories(spark, sf_dir)
    return _retrieved(spark, sf_dir, m.select("id", (1.0 / (1.0 + F.length(F.coalesce("content", F.lit(""))))).alias("relevance")))[0].select("id", "slot", "round", "place")


def queries() -> dict:
    named = (
        search_routes, search_blocked, search_by_slots, search_reranked,
        search_ranked, term_idf, bm25_postings, rrf_fusion, candidate_merge, rerank_convex, anchor_floor, mmr, slot_classify, slot_allocation, collapse_source, collapse_latest_fact, knn_cosine, knn_cells, recall_metrics, p95_by_type,
    )
    return {f.__name__: f for f in named}


_HAYSTACK = "lower(concat_ws(' ', content, evidence, array_to_string(tags, ' '), subject.name, subject.id, object.name, object.id, group_id))"
_WIDE = "lower(concat_ws(' ', content, evidence, array_to_string(tags, ' '), metadata, subject.id, subject.name, object.id, object.name, session_id, group_id))"
_IN_WINDOW = " OR ".join(f"({c} >= '{WINDOW[0]}'::TIMESTAMPTZ AND {c} < '{WINDOW[1]}'::TIMESTAMPTZ)" for c in ("occurred_at", "created_at", "updated_at"))
_SLOT = """CASE WHEN visibility = 'bot_self' OR reality_level IN ('bot_action', 'persona_life', 'fictional_content') OR (subject.kind = 'bot' AND (subject.id IS NULL OR subject.id IN ('', 'self', 'bot_1'))) OR memory_type = 'bot_detail' THEN 'self_timeline'
  WHEN memory_type = 'open_loop' THEN 'open_loop' WHEN memory_type IN ('user_fact', 'preference') THEN 'user_profile' WHEN memory_type = 'conversation_summary' THEN 'conversation_summary'
  WHEN visibility = 'group_public' OR scope = 'group' THEN 'current_window' ELSE 'stable_memory' END"""


def _any_of(hay: str) -> str:
    return " + ".join(f"contains({hay}, '{t}')::INT" for t in TERMS)


def _routes_sql(n: int, window: bool) -> str:
    parts = [
        f"SELECT id, 'priority' AS route, row_number() OVER (ORDER BY importance DESC NULLS LAST, occurred_at DESC NULLS LAST, id) AS rank FROM memories WHERE {_FINDABLE} QUALIFY rank <= {n}",
        f"SELECT id, 'keyword', row_number() OVER (ORDER BY session_id IS NULL, importance DESC NULLS LAST, id) AS rank FROM memories WHERE {_FINDABLE} AND ({_any_of(_WIDE)}) > 0 QUALIFY rank <= 1200",
        f"SELECT id, 'time_window', row_number() OVER (ORDER BY importance DESC NULLS LAST, {_SEEN} DESC NULLS LAST, id) AS rank FROM memories WHERE {_FINDABLE} AND ({_IN_WINDOW}) QUALIFY rank <= 1600",
    ]
    if window:
        parts.append(f"SELECT id, 'current_window', row_number() OVER (ORDER BY importance DESC NULLS LAST, {_SEEN} DESC NULLS LAST, id) AS rank FROM memories WHERE {_FINDABLE} AND (session_id = '{GROUP.session_id}' OR (scope = 'group' AND group_id = '{GROUP.group_id}')) QUALIFY rank <= 600")
    return " UNION ALL ".join(f"({p})" for p in parts)


def _pool_sql() -> str:
    """The six routes of a search."""
    terms = ", ".join(f"'{t}'" for t in TERMS)
    text = rf"""hw AS (SELECT id, regexp_extract_all({_HAYSTACK}, '[\p{{L}}\p{{N}}_]+') AS words FROM memories WHERE {_FINDABLE}), hd AS (SELECT * FROM hw WHERE len(words) > 0), hs AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM hd),
ht AS (SELECT id, n_terms, term, count(*) AS tf FROM (SELECT id, len(words) AS n_terms, unnest(words) AS term FROM hd) WHERE term IN ({terms}) GROUP BY ALL), hf AS (SELECT term, count(*) AS df FROM ht GROUP BY term),
hb AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))), 9) AS score FROM ht JOIN hf USING (term), hs GROUP BY id),
vq AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), vs AS (SELECT vec_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 9) AS cosine FROM embeddings, vq WHERE vec_id <> 0 AND len(embedding) = 64), vk AS (SELECT * FROM vs WHERE cosine >= 0.34 QUALIFY row_number() OVER (ORDER BY cosine DESC, vec_id) <= 200),
vm AS (SELECT id, cosine FROM memories JOIN vk ON vec_id = ('0x' || substr(id, 13, 8))::BIGINT % (SELECT count(*) FROM embeddings) WHERE {_FINDABLE})"""
    more = "(SELECT id, 'fts', row_number() OVER (ORDER BY score DESC, id) AS rank FROM hb QUALIFY rank <= 240) UNION ALL (SELECT id, 'vector', row_number() OVER (ORDER BY cosine DESC, id) AS rank FROM vm QUALIFY rank <= 240)"
    return f"{text}, routes AS ({_routes_sql(2000, True)} UNION ALL {more})"


_KNN = """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0 AND len(embedding) = 64), s AS (
  SELECT q.vec_id AS query, e.vec_id AS key, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cosine FROM q JOIN embeddings e ON q.vec_id <> e.vec_id AND len(e.embedding) = 64
), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, key) AS rank FROM s QUALIFY rank <= 10)"""


def oracle_sql() -> dict[str, str]:
    n = lambda t: f"((length(hay) - length(replace(hay, '{t}', ''))) / {len(t)})::BIGINT"
    bm25 = " + ".join(f"coalesce((SELECT idf FROM idf WHERE term = '{t}'), 0) * ({n(t)} * 2.2) / ({n(t)} + 1.2)" for t in TERMS)
    terms = ", ".join(f"('{t}')" for t in TERMS)
    bounds = " ".join(f"WHEN '{s}' THEN {b}" for s, b in LIMITS.items())
    places = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(ranking.SLOTS))
    return {
        "search_ranked": f"""WITH routes AS ({_routes_sql(2000, True)}), fused AS (SELECT id, sum(1.0 / (60.0 + rank)) AS rrf, list_sort(list(DISTINCT route)) AS routes FROM routes GROUP BY id),
seen AS (SELECT m.*, {_OWNER} AS o FROM memories m), pool AS (SELECT s.*, fused.rrf, fused.routes, {_HAYSTACK} AS hay FROM seen s JOIN fused USING (id) WHERE ({_GROUP_REASON}) IN {_PASSES}),
t AS (SELECT * FROM (VALUES {terms}) v(term)), idf AS (SELECT term, ln(1 + (total - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df, (SELECT count(*) FROM pool) AS total FROM t JOIN pool ON contains(hay, term) GROUP BY term)),
x AS (SELECT *, {_any_of("hay")} AS hits, contains(regexp_replace(hay, '\\s+', '', 'g'), '{PHRASE.replace(" ", "")}') AS exact, {bm25} AS bm25,
  greatest(0.0, (epoch_us('{NOW}'::TIMESTAMPTZ) - epoch_us(coalesce(occurred_at, created_at))) / 86400000000.0) AS days, greatest(0.0, (epoch_us('{NOW}'::TIMESTAMPTZ) - epoch_us({_SEEN})) / 86400000000.0) AS age FROM pool),
y AS (SELECT *, CASE WHEN exact THEN 0.42 ELSE 0.24 END + least(0.72, 0.18 * bm25) + CASE WHEN session_id = '{GROUP.session_id}' THEN 0.25 ELSE 0 END + CASE WHEN subject.id = '{GROUP.user_id}' OR object.id = '{GROUP.user_id}' THEN 0.15 ELSE 0 END
  + CASE WHEN group_id = '{GROUP.group_id}' THEN 0.15 ELSE 0 END + CASE WHEN visibility = 'bot_self' THEN 0.08 ELSE 0 END + coalesce(importance, 0) * CASE WHEN exact THEN 0.55 ELSE 0.28 END + 0.25 * coalesce(confidence, 0)
  + coalesce(0.2 * exp(-days / 14.0), 0) + CASE WHEN list_contains(routes, 'keyword') AND list_contains(routes, 'time_window') THEN 0.08 ELSE 0 END + least(0.55, 12.0 * rrf) AS base,
  CASE WHEN durability = 'pinned' THEN 1.0 ELSE greatest(0.05, least(1.0, pow(2.0, -coalesce(age, 0) / CASE durability WHEN 'ephemeral' THEN 1.0 WHEN 'short' THEN 14.0 WHEN 'durable' THEN 730.0 ELSE 120.0 END))) END AS decay
  FROM x WHERE (hits > 0 OR exact) AND lower(coalesce(validity_status, 'active')) = 'active' AND coalesce('{NOW}'::TIMESTAMPTZ >= valid_from, true) AND coalesce('{NOW}'::TIMESTAMPTZ < valid_to, true) AND coalesce(sensitivity, '') <> 'restricted' AND coalesce(owner_bot_id, '') IN ('', 'bot_1'))
SELECT id, hits, round(bm25, 6) AS bm25, round(rrf, 6) AS rrf, round(base * (0.65 + 0.35 * decay) + 0.12 * coalesce(salience, importance, 0) + least(0.12, 0.12 * coalesce(reinforcement_score, 0)), 5) AS score FROM y""",
        "search_routes": f"WITH {_pool_sql()} SELECT id, array_to_string(list_sort(list(DISTINCT route)), '+') AS routes, round(sum(1.0 / (60.0 + rank)), 8) AS rrf FROM routes GROUP BY id",
        "search_blocked": f"""WITH {_pool_sql()}, c AS (SELECT DISTINCT id FROM routes), seen AS (SELECT m.*, {_OWNER} AS o, {_OWNER_WINDOW} FROM memories m), r AS (SELECT s.*, {_GROUP_REASON} AS reason FROM seen s SEMI JOIN c USING (id)),
w AS (SELECT DISTINCT os, oi, ('0x' || left(sha1(oi), 8))::BIGINT % 5 AS n FROM seen WHERE os IS NOT NULL), a AS (SELECT r.*, CASE WHEN n = 0 THEN 'deny' WHEN n = 1 THEN 'allow' WHEN r.os = 'group' AND n <> 2 THEN 'open' ELSE 'closed' END AS acl FROM r LEFT JOIN w ON r.os = w.os AND r.oi = w.oi),
b AS (SELECT CASE WHEN acl = 'deny' THEN 'acl_deny' WHEN reason NOT IN {_PASSES} AND NOT (reason IN ('other_group_public', 'private_pair_not_current_private', 'other_private_pair') AND acl IN ('allow', 'open')) THEN reason
  WHEN lower(coalesce(validity_status, 'active')) <> 'active' THEN 'validity=' || lower(validity_status) WHEN '{NOW}'::TIMESTAMPTZ < valid_from THEN 'validity=not_started' WHEN '{NOW}'::TIMESTAMPTZ >= valid_to THEN 'validity=expired'
  WHEN sensitivity = 'restricted' THEN 'sensitivity=restricted' WHEN owner_bot_id <> '' AND owner_bot_id <> 'bot_1' THEN 'owner_bot_mismatch' END AS blocked FROM a)
SELECT blocked AS reason, count(*) AS n FROM b WHERE blocked IS NOT NULL GROUP BY 1""",
        "term_idf": f"""WITH t AS (SELECT * FROM (VALUES {terms}) v(term)) SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM memories) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t JOIN memories ON contains({_HAYSTACK}, term) GROUP BY term""",
        "bm25_postings": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents), d AS (SELECT * FROM w WHERE len(words) > 0), s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d),
p AS (SELECT doc_id, len(words) AS n_terms, unnest(words) AS term FROM d), tf AS (SELECT doc_id, n_terms, term, count(*) AS tf FROM p WHERE term IN ('lantern', 'violin', 'koffer', 'guitarra') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))), 5) AS score FROM tf JOIN f USING (term), s GROUP BY doc_id""",
        "rrf_fusion": f"WITH r AS ({_routes_sql(2000, False)}) SELECT id, round(sum(1.0 / (60.0 + rank)), 8) AS rrf FROM r GROUP BY id",
        "candidate_merge": f"WITH r AS ({_routes_sql(2000, False)}) SELECT id, array_to_string(list_sort(list(DISTINCT route)), '+') AS routes, CASE WHEN bool_or(route = 'keyword') AND bool_or(route = 'time_window') THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM r GROUP BY id",
        "rerank_convex": """WITH w AS (SELECT id, importance, confidence, min(importance) OVER p AS a, max(importance) OVER p AS b, min(confidence) OVER p AS c, max(confidence) OVER p AS d FROM memories WINDOW p AS (PARTITION BY memory_type))
SELECT id, round(0.5 * CASE WHEN b > a THEN (importance - a) / (b - a) ELSE 0.5 END + 0.5 * CASE WHEN d > c THEN (confidence - c) / (d - c) ELSE 1.0 END, 6) AS combined FROM w""",
        "anchor_floor": f"""WITH p AS (SELECT id, importance AS combined, memory_type = 'preference' AS anchor FROM memories WHERE {_FINDABLE} ORDER BY importance DESC NULLS LAST, occurred_at DESC NULLS LAST, id LIMIT 32),
w AS (SELECT *, row_number() OVER (ORDER BY combined DESC, id) AS was FROM p), o AS (SELECT *, row_number() OVER (ORDER BY was) AS nth FROM w WHERE was > 8 AND anchor), i AS (SELECT *, row_number() OVER (ORDER BY was DESC) AS nth FROM w WHERE was <= 8 AND NOT anchor),
s AS (SELECT o.id AS a, o.was AS aw, i.id AS b, i.was AS bw FROM o JOIN i USING (nth))
SELECT w.id, combined, anchor, coalesce((SELECT bw FROM s WHERE a = w.id), (SELECT aw FROM s WHERE b = w.id), was) AS place FROM w""",
        "mmr": rf"""WITH RECURSIVE p AS (SELECT memory_type AS t, id, importance AS score, regexp_replace({_HAYSTACK}, '\s+', '', 'g') AS flat, tags, source_plugin, row_number() OVER (PARTITION BY memory_type ORDER BY importance DESC NULLS LAST, id) AS place FROM memories),
h AS MATERIALIZED (SELECT t, id, place, coalesce(score, 0) AS score, list_distinct(list_concat(list_sort(list_distinct(list_transform(range(1, length(flat)), lambda i: substr(flat, i, 2))))[1:180], regexp_extract_all(flat, '[a-z0-9_]{{2,}}'),
  list_transform(list_filter(coalesce(tags, []), lambda x: trim(x) <> ''), lambda x: 'tag:' || lower(trim(x))), CASE WHEN trim(source_plugin) <> '' THEN ['source:' || lower(trim(source_plugin))] ELSE [] END)) AS f FROM p WHERE place <= 32),
v AS MATERIALIZED (SELECT t, id, place, f, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS rel FROM h WINDOW w AS (PARTITION BY t)),
s AS MATERIALIZED (SELECT a.t, a.id AS a, b.id AS b, len(list_intersect(a.f, b.f)) / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f)))::DOUBLE AS sim FROM v a JOIN v b ON a.t = b.t AND a.id <> b.id),
r AS (SELECT t, 1 AS k, [id] AS chosen FROM v WHERE place = 1 UNION ALL SELECT t, k + 1, list_append(chosen, best) FROM (
  SELECT r.t, r.k, any_value(r.chosen) AS chosen, first(v.id ORDER BY 0.84 * v.rel - 0.16 * m.worst DESC, v.place) AS best FROM r JOIN v ON v.t = r.t AND NOT list_contains(r.chosen, v.id)
  JOIN LATERAL (SELECT max(s.sim) AS worst FROM s WHERE s.t = r.t AND s.a = v.id AND list_contains(r.chosen, s.b)) m ON true WHERE r.k < 8 GROUP BY r.t, r.k)),
c AS (SELECT t, arg_max(chosen, k) AS chosen FROM r GROUP BY t), o AS (SELECT p.*, list_position(chosen, id) AS pick, len(chosen) AS n FROM p JOIN c USING (t))
SELECT t AS query_id, id, score, CASE WHEN pick > 0 THEN pick WHEN place > 32 THEN place ELSE n + row_number() OVER (PARTITION BY t, coalesce(pick, 0) > 0, place > 32 ORDER BY place) END::INT AS place FROM o""",
        "slot_classify": f"SELECT id, {_SLOT} AS slot FROM memories",
        "slot_allocation": f"""WITH c AS (SELECT id, {_SLOT} AS slot, importance AS score FROM memories), r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, id) AS nth, CASE slot {bounds} END AS bound, CASE slot {places} END AS pos FROM c),
f AS (SELECT *, CASE WHEN nth = 1 THEN 1 WHEN nth <= bound THEN 2 ELSE 3 END AS round FROM r WHERE nth <= 20), g AS (SELECT *, row_number() OVER (ORDER BY round, CASE WHEN round < 3 THEN pos ELSE 0 END, score DESC, id) AS place FROM f WHERE round < 3 OR slot NOT IN ('conversation_summary', 'self_timeline'))
SELECT id, slot, round, place FROM g WHERE place <= 20""",
        "collapse_source": f"SELECT id FROM memories QUALIFY import_batch_id IS NULL OR row_number() OVER (PARTITION BY import_batch_id, memory_type ORDER BY importance DESC NULLS LAST, {_SEEN} DESC NULLS LAST, id) = 1",
        "collapse_latest_fact": f"SELECT id FROM memories WHERE memory_type IN ('user_fact', 'preference') QUALIFY owner_bot_id IS NULL OR subject.id IS NULL OR row_number() OVER (PARTITION BY owner_bot_id, subject.id, memory_type ORDER BY {_SEEN} DESC NULLS LAST, importance DESC NULLS LAST, id) = 1",
        "knn_cosine": _KNN + " SELECT query, key, round(cosine, 5) AS cosine, rank FROM k",
        "recall_metrics": _KNN + """, c AS (SELECT q.vec_id AS query, e.vec_id AS key FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id), h AS (SELECT query, min(rank) AS best, count(*) AS hit FROM c JOIN k USING (query, key) GROUP BY query),
p AS (SELECT query, count(*) AS relevant FROM c GROUP BY query) SELECT count(*) AS n_queries, round(avg(coalesce(hit, 0) / least(relevant, 10)), 6) AS recall_at_k, round(avg(1.0 / best), 6) AS mrr, round(avg(CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1 FROM p LEFT JOIN h USING (query)""",
        "p95_by_type": "SELECT event_type, list_sort(list(value))[greatest(1, floor(count(value) * 0.95))::INT] AS p95 FROM events GROUP BY event_type",
    }
