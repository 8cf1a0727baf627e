"""Operators that must not hold a key in one task: against loops, and by their plans."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from mnemospark.operators import merging, ranking, records, reports, revisions, segments, vectors
from mnemospark.plans import retrieval
from mnemospark.runtime import cut

T0 = datetime(2026, 5, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_frames_have_no_estimated_size(spark):
    held = cut(spark.range(100).select("id", F.sequence(F.lit(0), F.col("id")).alias("many")))
    assert held.count() == 100 and held.select("id").join(held.select("id", F.explode("many")), "id").count() == 5050
    assert "Broadcast" not in plan(held.select("id").join(held.select(F.col("id").alias("k"), "many"), F.col("id") == F.col("k")))


def test_quantile_against_sorting(spark):
    r = random.Random(1)
    rows = [(g, v) for g, n in (("a", 9000), ("b", 10), ("c", 1), ("d", 5000)) for v in [None if r.random() < 0.01 else float(r.choice([r.randrange(50), r.random() * 1000])) if g != "d" else 7.0 for _ in range(n)]] + [(None, 3.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in "abcd":
        mine = sorted(v for h, v in rows if h == g and v is not None)
        want[g] = mine[max(1, int(len(mine) * 0.95)) - 1]
    for few in (4096, 100):
        got = {x.g: x.p for x in reports.near_quantile(df, "g", "v", few=few).collect()}
        assert got == want | {None: 3.0}
    assert "collect_list" not in plan(reports.near_quantile(df, "g", "v")) and reports.near_quantile(df.limit(0), "g", "v").count() == 0


def test_folds_against_loops(spark):
    r = random.Random(2)
    rows = [(k, i, T0 + timedelta(seconds=r.randrange(500)), r.choice([-0.6, -0.1, 0.2, 0.5])) for k in ("hot", "x") for i in range(2000 if k == "hot" else 7)]
    level = {}
    for k, _, _, d in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        level[k] = min(1.0, max(0.0, level.get(k, 0.5) + d))
    got = {x.key: x.level for x in merging.fold_reactions(spark.createDataFrame(rows, "key string, source_id int, at timestamp, delta double")).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in level.items()) and len(got) == 2
    changes = [(k, T0 + timedelta(seconds=i), f"{k}{i}", r.randrange(1, 30), r.random() < 0.01) for k in ("p", "q", None) for i in range(400)]
    want = {}
    for k, _, _, rev, dead in changes:
        s = want.setdefault(k, [0, 0, False])
        if not s[2] and rev == s[0] + 1:
            want[k] = [rev, s[1] + 1, dead]
    got = {x.key: [x.revision, x.applied, x.deleted] for x in revisions.compare_and_set(spark.createDataFrame(changes, "key string, at timestamp, event_id string, revision bigint, tombstone boolean"), "key").collect()}
    assert got == {k: v for k, v in want.items() if k}


def test_turns_and_replies_cross_blocks(spark):
    r = random.Random(3)
    at, rows = T0, []
    for i in range(600):
        at += timedelta(seconds=r.choice([0, 5, 60, 119, 121, 400, 9000]))
        rows.append((i, "c", r.choice(["a", "a", "b", None]), at, r.choice(["hi", "晚 安", "在吗？", None])))
    want, last = [], None
    for i, _, who, t, text in rows:
        gap = (t - last[1]).total_seconds() if last else None
        if last and gap <= 7200 and who == last[0] and gap <= 120:
            want[-1][2] += 1
        else:
            want.append([who, t, 1])
        last = (who, t)
    got = segments.turns(spark.createDataFrame(rows, "row_id bigint, conv string, who string, at timestamp, content string"), "conv", "at", "who", "content", "row_id").orderBy("piece", "turn").collect()
    us = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    assert [(x.speaker, x.start_us, x.n_messages) for x in got] == [(w, us(t), n) for w, t, n in want]
    events = [(f"m{i:03}", "s", r.choice(["user_message", "bot_response"]), T0 + timedelta(seconds=r.randrange(20_000))) for i in range(300)]
    first = {}
    for i, _, kind, t in events:
        later = sorted((u, j) for j, _, k, u in events if k == "bot_response" and t <= u <= t + timedelta(minutes=10))
        if kind == "user_message" and later:
            first[i] = later[0][1]
    df = spark.createDataFrame(events, "id string, session string, event_type string, at timestamp")
    assert {x.id: x.reply_id for x in segments.first_reply(df, "session", "at").collect()} == first


def test_cells_are_split_without_loss(spark, monkeypatch):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(400)], "k bigint, v array<double>")
    asked = df.where("k % 50 = 0")
    exact = sorted((x["query"], x["key"], x["rank"]) for x in vectors.knn_exact(df, asked, "k", "v", 8).collect())
    centres = vectors.fit_cells(df, "k", "v", 8, 3)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    split = vectors.knn_cells(df, asked, "k", "v", 8, centres, 3)
    assert sorted((x["query"], x["key"], x["rank"]) for x in split.collect()) == exact
    assert all("NestedLoop" not in plan(x) and "Cartesian" not in plan(x) for x in (split, vectors.knn_exact(df, asked, "k", "v", 8)))


def test_diversifying_against_a_loop(spark):
    r = random.Random(6)
    rows = [("q", f"m{i:02}", r.random(), " ".join(r.choice(["tea", "sea", "bee", "oak"]) for _ in range(3)), [r.choice(["x", "y"])], None) for i in range(30)]
    ranked = sorted(rows, key=lambda x: (-x[2], x[1]))

    def features(row):
        flat = row[3].replace(" ", "")
        return {flat[i : i + 2] for i in range(len(flat) - 1)} | {flat} | {f"tag:{t}" for t in row[4]}

    head, low, high = ranked[:16], ranked[15][2], ranked[0][2]
    picked, left = [head[0]], head[1:]
    while len(picked) < 4:
        worth = [0.84 * (x[2] - low) / (high - low) - 0.16 * max(len(features(x) & features(p)) / len(features(x) | features(p)) for p in picked) for x in left]
        picked.append(left.pop(worth.index(max(worth))))
    want = [x[1] for x in picked + left + ranked[16:]]
    got = ranking.diversify(spark.createDataFrame(rows, "query_id string, id string, score double, hay string, tags array<string>, source_plugin string"), 4)
    assert [x.id for x in got.orderBy("place").collect()] == want


def test_search_tells_nothing_that_is_blocked(spark, sf_dir):
    chosen, blocked = retrieval._retrieved(spark, sf_dir)
    ids = {x.id for x in chosen.collect()}
    assert not ids & {x.id for x in blocked.collect()} and len(ids) <= 20
    again = {x.id for x in retrieval.search_reranked(spark, sf_dir).collect()}
    assert not again & {x.id for x in blocked.collect()} and len(again) <= 20


def test_record_writes_on_edges(spark):
    held = spark.createDataFrame([("h1", "k1")], "id string, key string")
    arriving = spark.createDataFrame([("a1", "k1", T0), ("a2", "k2", T0 + timedelta(seconds=1)), ("a3", "k2", T0), ("a4", "", T0), ("a5", "", T0)], "id string, key string, at timestamp")
    assert {(x.id, x.stored_id, x.fresh) for x in records.ingest(held, arriving).collect()} == {("a1", "h1", False), ("a2", "a3", False), ("a3", "a3", True), ("a4", "a4", True), ("a5", "a5", True)}
    assert records.ingest(held.limit(0), arriving.limit(0)).count() == 0
    deliveries = spark.createDataFrame([("e", 1, "c", None), ("e", 1, "d", T0), ("old", 1, "c", None)], "event_id string, revision bigint, consumer_id string, acked_at timestamp")
    events = spark.createDataFrame([("e", 1, None), ("old", 1, T0)], "event_id string, revision bigint, expires_at timestamp")
    acks = deliveries.select("event_id", "revision", "consumer_id")
    later = T0 + timedelta(days=1)
    got = {(x.event_id, x.consumer_id): x.acked_at for x in records.acknowledge(deliveries, acks, events, F.lit(later)).collect()}
    assert got == {("e", "c"): later, ("e", "d"): T0, ("old", "c"): None}
    space = spark.createDataFrame([("n", "k", "r1", 1, "{x}", False), ("n", "k", "r2", 4, "{y}", True), ("m", "k", "r3", 1, "{z}", False)], "namespace string, record_kind string, record_id string, revision bigint, payload string, deleted boolean")
    assert {tuple(x)[2:] for x in records.erase_namespace(space, F.col("namespace") == "n").collect()} == {("r1", 2, "{}", True), ("r2", 4, "{}", True), ("r3", 1, "{z}", False)}
