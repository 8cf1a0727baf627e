"""Operators without SQL, small-case semantics, stores and streams."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from mnemospark.engine import Engine
from mnemospark.functions import text as X
from mnemospark.operators import merging, ranking, revisions, segments, vectors
from mnemospark.operators.scans import Context
from mnemospark.plans import retrieval
from mnemospark.sources import archive, chatlog
from mnemospark.sources.tables import VersionedTable
from mnemospark.streaming import ingest

T0 = datetime(2026, 5, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, X.clean_text(F.lit("  a　 b\n"), 10)) == "a b" and one(spark, X.clean_text(F.lit("abcdef"), 4)) == "abc…" and one(spark, X.clean_text(F.lit(None), 4)) == ""
    assert one(spark, X.clamp(F.lit("7"))) == 1.0 and one(spark, X.clamp(F.lit("x"), default=0.3)) == 0.3
    assert one(spark, X.query_terms(F.lit("Ab c 相机镜头 ok ok"))) == ["ab", "相机", "机镜", "镜头", "相机镜头", "ok"]
    assert one(spark, X.count_of(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(spark, X.redact_secrets(F.lit("https://a:b@h password: x1 Bearer abcdefghij"))) == "https://a:[REDACTED]@h password: [REDACTED] Bearer [REDACTED]"


def test_fusion_ignores_route_order_and_counts_first_places(spark):
    a = spark.createDataFrame([("x", "r1", 1), ("y", "r1", 2), ("x", "r1", 9)], "id string, route string, rank int")
    b = spark.createDataFrame([("y", "r2", 1)], "id string, route string, rank int")
    get = lambda routes: {r.id: (round(r.rrf, 9), tuple(r.routes)) for r in ranking.fuse(routes).collect()}
    assert get([a, b]) == get([b, a]) == {"x": (round(1 / 61, 9), ("r1",)), "y": (round(1 / 62 + 1 / 61, 9), ("r1", "r2"))}


def test_route_bonus(spark):
    bonus = lambda routes: one(spark, ranking.agreement(ranking.families(F.array(*[F.lit(r) for r in routes]))))
    assert [bonus(["fts", "keyword"]), bonus(["fts", "vector"]), round(bonus(["fts", "vector", "time_window"]), 6)] == [0.0, 0.08, 0.12]


def test_diversifying_keeps_every_row(spark):
    rows = [("q", f"m{i}", 1 - i / 50, f"text number {i % 5}", [f"t{i % 3}"], "core") for i in range(40)]
    got = ranking.diversify(spark.createDataFrame(rows, "query_id string, id string, score double, hay string, tags array<string>, source_plugin string"), 6).collect()
    assert {r.id for r in got} == {r[1] for r in rows} and sorted(r.place for r in got) == list(range(1, 41))
    assert [r.id for r in sorted(got, key=lambda r: r.place)][0] == "m0"


def test_registered_diversifying_keeps_every_memory(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    got = retrieval.mmr(spark, d).collect()
    assert sorted(r.id for r in got) == sorted(r.id for r in spark.read.parquet(f"{d}/memories.parquet").select("id").collect())
    assert len({(r.query_id, r.place) for r in got}) == len(got)


def test_slots_hold_caps(spark):
    r = random.Random(1)
    rows = [(f"m{i:03}", r.choice(ranking.SLOTS), r.random()) for i in range(200)]
    limits = {s: 2 for s in ranking.SLOTS}
    got = ranking.allot(spark.createDataFrame(rows, "id string, slot string, score double"), limits, 18, ("open_loop",)).collect()
    assert len(got) == 18 and sum(x.slot == "open_loop" for x in got) == 2 and {x.slot for x in got if x.round == 1} == set(ranking.SLOTS)


def test_cells_find_nine_in_ten(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.6 * r.normal(size=16)).tolist()) for i in range(1200)] + [(5000, None), (5001, [1.0]), (5002, [0.0] * 16)]
    df = spark.createDataFrame(rows, "k bigint, v array<double>").cache()
    asked = df.where("k % 50 = 0")
    exact = {(x["query"], x["key"]) for x in vectors.knn_exact(df, asked, "k", "v", 16).collect()}
    cells = vectors.fit_cells(df, "k", "v", 16, 12)
    found = {(x["query"], x["key"]) for x in vectors.knn_cells(df, asked, "k", "v", 16, cells, 4).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_registered_cells_find_nine_in_ten(spark, sf_dir):
    pairs = lambda df: {(x["query"], x["key"]) for x in df.collect()}
    for d in (sf_dir, sf_dir.replace("sf0.001", "sf0.01"), sf_dir.replace("sf0.001", "sf0.1")):
        exact = pairs(retrieval.knn_cosine(spark, d))
        assert len(exact & pairs(retrieval.knn_cells(spark, d))) / len(exact) >= 0.9


def test_folds(spark):
    rows = [("k", i, T0 + timedelta(seconds=i), d) for i, d in enumerate([0.4, 0.4, -2.0, 0.1])] + [("k", 0, T0 + timedelta(days=1), 9.0)]
    assert round(merging.fold_reactions(spark.createDataFrame(rows, "key string, source_id int, at timestamp, delta double")).first().level, 6) == 0.1
    changes = [("k", T0 + timedelta(seconds=i), f"e{i}", rev, dead) for i, (rev, dead) in enumerate([(1, False), (3, False), (2, False), (3, True), (4, False)])]
    got = revisions.compare_and_set(spark.createDataFrame(changes, "key string, at timestamp, event_id string, revision bigint, tombstone boolean"), "key").first()
    assert (got.revision, got.applied, got.deleted) == (3, 3, True)


def test_segments_partition_turns(spark):
    rows = [(i, "c", "ab"[i // 3 % 2], T0 + timedelta(seconds=40 * i), "x" * 30) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id bigint, conv string, who string, at timestamp, content string")
    turns = segments.turns(df, "conv", "at", "who", "content", "row_id")
    got = segments.limited_segments(turns, "conv", max_turns=10, max_chars=500).collect()
    assert sum(x.n_messages for x in got) == 300
    for s in {x.segment for x in got}:
        inside = [x for x in got if x.segment == s]
        assert len(inside) <= 10 and sum(x.n_chars for x in inside) <= 500


def test_chat_log(spark, tmp_path):
    (tmp_path / "a.txt").write_text("preface\nAnn: 2025-12-31 23:59:50\nhello\nsecond line\n\nBob: 01-01 00:00:03\nhi\nAnn: 01-01 00:00:03\n", encoding="utf-8")
    got = chatlog.parse_lines(chatlog.read_lines(spark, str(tmp_path / "a.txt"))).orderBy("sequence").collect()
    assert [(x.speaker, x.content, x.inferred_year) for x in got] == [("Ann", "hello\nsecond line", False), ("Bob", "hi", True), ("Ann", "", True)]
    assert [datetime.utcfromtimestamp(x.utc_us / 1e6).isoformat() for x in got][1] == "2025-12-31T16:00:03"
    report = chatlog.parse_report(spark.createDataFrame(got)).first()
    assert (report.n, report.n_empty, report.n_inferred, report.n_shared_times) == (3, 1, 2, 1)


def test_log_headers_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(chatlog, "LINE_BLOCK", 2)
    lines = [("f", 0, "Ann: 2025-01-01 10:00:00")] + [("f", i, f"l{i}") for i in range(1, 8)]
    assert chatlog.parse_lines(spark.createDataFrame(lines, "file string, line_no int, line string")).first().content == "\n".join(f"l{i}" for i in range(1, 8))


def test_json_export(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"metadata": {"name": "x", "version": "5"}, "messages": [{"id": "1", "timestamp": 1700000000000, "sender": {"name": "A"}, "content": {"text": "hi"}}, {"id": "2", "recalled": true, "content": {"text": "no"}}, {"id": "3", "content": {"text": " "}}]}')
    got = chatlog.read_json_export(spark, str(tmp_path / "e.json")).collect()
    assert [(x.message_id, x.speaker, x.utc_us) for x in got] == [("1", "A", 1_700_000_000_000_000)]


def test_archive_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, ["x", None]), ("b", None, None)], "id string, v double, tags array<string>")
    archive.write({"things": df}, str(tmp_path / "arc"))
    rows = archive.read(spark, str(tmp_path / "arc"))
    assert sorted(map(tuple, archive.table_of(rows, "things", df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.revision == 0
    t.write(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "id string, v int, at int"))
    t.upsert(spark.createDataFrame([("b", 2, 2), ("b", 3, 3), ("c", 1, 1)], "id string, v int, at int"), ["id"], "at")
    assert sorted((x.id, x.v) for x in t.read().collect()) == [("a", 1), ("b", 3), ("c", 1)]
    t.delete(F.col("id") == "a")
    t.update(F.col("id") == "b", {"v": F.lit(9)})
    assert sorted((x.id, x.v) for x in t.read().collect()) == [("b", 9), ("c", 1)]
    t.restore(1)
    assert t.revision == 5 and t.read().count() == 2


def run_stream(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams(spark, tmp_path):
    rows = [("k1", T0), ("k1", T0 + timedelta(minutes=1)), ("k2", T0), (None, T0), (None, T0)]
    spark.createDataFrame(rows, "key string, at timestamp").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in"))
    run_stream(ingest.deduplicated(source(), ["key"], "at"), "dedup")
    assert sorted(str(x.key) for x in spark.table("dedup").collect()) == ["None", "None", "k1", "k2"]
    spark.createDataFrame([("a", T0)] * 25 + [("b", T0)] * 3, "key string, at timestamp").write.parquet(str(tmp_path / "many"))
    many = spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "many"))
    run_stream(ingest.triggered(many, "key"), "trig")
    assert [(x.key, x.n) for x in spark.table("trig").collect()] == [("a", 12)] * 2
    target = VersionedTable(spark, str(tmp_path / "sink"))
    q = source().where("key is not null").writeStream.foreachBatch(ingest.upsert_into(target, ["key"], "at")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(x.key for x in target.read().collect()) == ["k1", "k2"]


def test_engine(spark, sf_dir):
    engine = Engine(spark, sf_dir)
    ctx = Context("private", None, None, "u100060", None, "bot_1")
    now = F.lit("2026-05-24").cast("timestamp")
    hits = engine.recall("the bakery", ctx, now, 5).collect()
    assert len(hits) <= 5 and [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    assert engine.stats().where("total").first().n == engine.table("memories").count()
    assert engine.navigate(["bakery"], 1).count() >= 0 and engine.timeline(5).count() == 5


def test_kept_answers_follow_the_table_and_the_time(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/memories.parquet")
    source.write.parquet(str(tmp_path / "memories.parquet"))
    engine = Engine(spark, str(tmp_path))
    ctx, now = Context("private", None, None, "u100060", None, "bot_1"), F.lit("2026-05-24").cast("timestamp")
    first = engine.recall_ids("", ctx, now)
    assert first and engine.recall_ids("", ctx, now) == first and len(engine.cache) == 1
    assert engine.recall_ids("", ctx, F.lit("1990-01-01").cast("timestamp")) != first or source.where(F.col("id").isin(first) & F.col("valid_from").isNotNull()).count() == 0
    source.where(F.col("id") != first[0]).write.mode("overwrite").parquet(str(tmp_path / "memories.parquet"))
    spark.catalog.refreshByPath(str(tmp_path))
    assert first[0] not in engine.recall_ids("", ctx, now) and len(engine.cache) == 2
