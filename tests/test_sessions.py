import random
from datetime import datetime, timedelta

from mnemospark.operators.components import connected_components
from mnemospark.operators.sessions import activity_sessions

T0 = datetime(2025, 1, 1)
SCHEMA = "batch string, who string, at timestamp, session_no int, __n int"


def test_against_a_loop(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None, ""]), r.choice(["x", "y", None]), None if r.random() < 0.02 else T0 + timedelta(minutes=r.choice([0, 120, 240, r.randrange(20000)]), microseconds=r.choice([0, 1]))) for _ in range(600)]
    want = {}
    for b, w, at in sorted((x for x in rows if None not in x), key=lambda x: x[2]):
        runs = want.setdefault((b, w), [])
        if runs and at - runs[-1][-1] <= timedelta(minutes=120):
            runs[-1].append(at)
        else:
            runs.append([at])
    got = activity_sessions(spark.createDataFrame([(*x, 0, 0) for x in rows], SCHEMA), ["batch", "who"], "at").collect()
    us = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    assert {(x.batch, x.who, x.start_us, x.end_us, x.n_events) for x in got} == {(b, w, us(run[0]), us(run[-1]), len(run)) for (b, w), runs in want.items() for run in runs}
    assert all(x.duration_us == x.end_us - x.start_us for x in got)


def test_edges(spark):
    one = spark.createDataFrame([("a", "x", T0, 1, 1)] * 3, SCHEMA)
    assert [(x.n_events, x.duration_us) for x in activity_sessions(one, ["batch", "who"], "at").collect()] == [(3, 0)]
    exact = spark.createDataFrame([("a", "x", T0, 1, 1), ("a", "x", T0 + timedelta(minutes=120), 1, 1), ("a", "x", T0 + timedelta(minutes=240, microseconds=1), 1, 1)], SCHEMA)
    assert sorted(x.n_events for x in activity_sessions(exact, ["batch", "who"], "at").collect()) == [1, 2]
    assert activity_sessions(one.limit(0), ["batch", "who"], "at").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 500), (None, 3), (7, 6), (7, 6)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 400)}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
