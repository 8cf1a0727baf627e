import random
from datetime import datetime, timedelta

from mnemospark.operators.delivery import drop_redelivered, numbered, redelivered, seen_ranges

SCHEMA = "id string, event_type string, session_id string, subject_id string, message_id string, dedupe_key string, created_at timestamp, ka int, producer string"
T0 = datetime(2026, 5, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def brute(rows):
    """Union-find over shared keys."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, (_, kind, session, subject, message, key, _) in enumerate(rows):
        for k in ([("a", key)] if key is not None else []) + ([("b", session, subject, kind, message)] if None not in (session, subject, kind, message) else []):
            if k in seen:
                parent[find(i)] = find(seen[k])
            seen[k] = i
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    gone = set()
    for g in groups.values():
        keep = min(g, key=lambda i: (rows[i][6] is None, rows[i][6] or T0, rows[i][0]))
        gone |= {rows[i][0] for i in g if i != keep}
    return gone


def test_random_rows_against_union_find(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        at = None if r.random() < 0.03 else T0 + timedelta(seconds=r.randrange(50))
        rows.append((f"t{i:03}", r.choice(["user_message", "bot_response", None]), r.choice(["s1", "s2", None]), r.choice(["u1", "u2", None]), r.choice([None, "", "m07", "xyz"] + [f"q{n:x}" for n in range(25)]), r.choice([None, None, ""] + [f"k{n}" for n in range(120)]), at))
    assert {x.id for x in redelivered(frame(spark, rows)).collect()} == brute(rows)


def test_long_chain_carries_over(spark):
    rows = []
    for i in range(40):
        rows += [(f"a{i:02}", "user_message", "s", "u", f"q{i}", f"k{i}", T0 + timedelta(seconds=i)), (f"b{i:02}", "user_message", "s", "u", f"q{i}", f"k{i + 1}", T0 + timedelta(seconds=i))]
    kept = drop_redelivered(frame(spark, rows)).collect()
    assert [x.id for x in kept] == ["a00"]


def test_hot_key_ties_and_rows_without_keys(spark):
    rows = [(f"h{i:04}", "user_message", "s", "u", "q1", "k", T0) for i in range(3000)] + [(f"n{i}", "x", None, None, None, None, T0) for i in range(3)]
    assert {x.id for x in drop_redelivered(frame(spark, rows)).collect()} == {"h0000", "n0", "n1", "n2"}


def test_empty_table(spark):
    assert redelivered(frame(spark, [])).count() == 0 and seen_ranges(frame(spark, [])).count() == 0


def test_numbers_of_ids(spark):
    rows = [(m, "e", "s", "u", m, None, T0) for m in ["q1a", "q01a", "1300000013967032320", "w", "", "q-ff", "0"]]
    got = {x.id: x.number for x in numbered(frame(spark, rows)).collect()}
    assert got["q1a"] == 0x1A and got["q01a"] is None and got["w"] is None and got[""] is None and got["q-ff"] == 255 and got["0"] == 0


def test_ranges_merge_over_batches(spark):
    rows = lambda ns: frame(spark, [(f"i{n}", "e", "s", "u", f"q{n:x}", None, T0) for n in ns])
    first = seen_ranges(rows([1, 2, 3, 7, 7]))
    both = seen_ranges(rows([4, 5, 9]), first)
    assert sorted((x.lo, x.hi) for x in first.collect()) == [(1, 3), (7, 7)]
    assert sorted((x.lo, x.hi) for x in both.collect()) == [(1, 5), (7, 7), (9, 9)]


def test_a_later_batch_knows_earlier_ones_by_their_ledger(spark):
    """Numbers, malformed ids and dedupe keys of a first batch are covered; of the others the first copy stays."""
    row = lambda i, m, k, s=0: (i, "e", "s", "u", m, k, T0 + timedelta(seconds=s))
    first = frame(spark, [row("a1", "q5", None), row("a2", "q6", None), row("a3", "m07", None), row("a4", None, "k1"), row("a5", "q6", "k2", 1)])
    ledger = seen_ranges(first, dedupe="dedupe_key")
    later = [row("b1", "q5", "k9"), row("b2", "q7", None), row("b3", "q7", None, 1), row("b4", "m07", None), row("b5", "m7", None), row("b6", None, "k1"), row("b7", "q20", "k9"), row("b8", "q20", None), row("b9", None, None), row("c0", None, "k2")]
    got = {(x.id, x.kept_id) for x in redelivered(frame(spark, later), ledger=ledger).collect()}
    assert got == {("b1", None), ("b3", "b2"), ("b4", None), ("b6", None), ("b7", None), ("b8", None), ("c0", None)}


def test_a_message_delivered_often_under_two_keys(spark):
    rows = [(f"r{i:02}", "e", "s", "u", "q1", "k", T0 + timedelta(seconds=i % 7)) for i in range(20)] + [("z", "e", "s", "u", "q1", "other", T0 - timedelta(seconds=1)), ("y", "e", None, None, None, "other", None)]
    got = {(x.id, x.kept_id) for x in redelivered(frame(spark, rows)).collect()}
    assert got == {(f"r{i:02}", "z") for i in range(20)} | {("y", "z")}


def test_few_exchanges(spark):
    """The plan that is left after the cuts shuffles the pairs of keys, not the rows again."""
    rows = [(f"a{i:03}", "user_message", "s", "u", f"q{i // 2:x}", f"k{i // 3}", T0) for i in range(60)]
    plan = redelivered(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6
