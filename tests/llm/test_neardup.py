import random

from pyspark.sql import functions as F

from mnemospark.llm import neardup

SCHEMA = "id string, content string, rep string, a int, hashes int"


def tokens(text):
    """The statement's tokens, by hand."""
    out, run = set(), ""
    is_han = lambda c: "一" <= c <= "鿿"
    for c in (text or "").lower() + " ":
        if c.isalnum() and (not run or is_han(run[0]) == is_han(c)):
            run += c
            continue
        if run:
            out |= {run[i : i + 2] for i in range(len(run) - 1)} if is_han(run[0]) and len(run) > 1 else {run}
        run = c if c.isalnum() else ""
    return out


def brute(rows):
    sets = {i: tokens(t) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 3}


def corpus():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(120):
        base = [word() for _ in range(r.choice([12, 30, 45]))] + ["keeps", "the", "and", "相机很好"]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            edit = [w if r.random() > 0.12 else word() for w in base]
            r.shuffle(edit)
            texts.append(" ".join(edit))
    texts += ["", None, "...", "a", "a", "相", "相机", "Straße 5", "x " * 30000 + "y"] + [texts[0]] * 3
    return [(f"m{i:04}", t) for i, t in enumerate(texts)]


def test_pairs_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA)
    got = [tuple(x) for x in neardup.similar_pairs(df, "id", "content", 3, 5).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.99 * len(want)


def test_large_class_of_copies_is_a_star(spark):
    rows = [(f"c{i:03}", "one two three four five six seven", "", 1, 1) for i in range(200)] + [("d", "one two three four five six eight", "", 1, 1)]
    got = {tuple(x) for x in neardup.similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", "content", 3, 5).collect()}
    assert got == {("c000", f"c{i:03}") for i in range(1, 200)} | {("c000", "d")}
    groups = neardup.groups(spark.createDataFrame(rows, SCHEMA), "id", "content", 3, 5).collect()
    assert len(groups) == 201 and {g.group_id for g in groups} == {"c000"} and {g.rep for g in groups} == {"c000", "d"}


def test_empty(spark):
    assert neardup.similar_pairs(spark.createDataFrame([], SCHEMA), "id", "content", 3, 5).count() == 0
    assert neardup.groups(spark.createDataFrame([("a", None, "", 1, 1)], SCHEMA), "id", "content", 3, 5).count() == 0


def test_pruning_limits_keep_similar_pairs():
    limits = neardup.least_matches(0.6)
    assert tuple(n for n, _ in limits) == neardup.STEPS and all(m < 0.6 * n for n, m in limits) and limits[-1][1] > 0.3 * neardup.SIGNATURE


def test_token_hashes_are_sets(spark):
    df = spark.createDataFrame([("A b a B 相机相机",)], "t string").select(F.size(neardup.token_hashes(F.col("t"))).alias("n"))
    assert df.first().n == 4


def test_large_group_of_similar_texts_is_found_whole(spark):
    """A third of all rows are variants of one text, so all their common words are common in the corpus too."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(40)]
    rows = [(f"v{i:03}", " ".join(w if r.random() > 0.08 else word() for w in base)) for i in range(130)] + [(f"w{i:03}", " ".join(word() for _ in range(40))) for i in range(260)]
    got = {tuple(x) for x in neardup.similar_pairs(spark.createDataFrame(rows, "id string, content string"), "id", "content", 3, 5).collect()}
    want = brute(rows)
    assert len(want) > 7000 and got <= want and len(got) >= 0.98 * len(want)


def test_large_group_with_inserted_words_is_found_whole(spark):
    """Words of the note are common, inserted ones rare and unshared: a fifth of the tokens in some versions, two fifths in others."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(40)]
    more = lambda n: " ".join(base + [word() for _ in range(n)])
    rows = [("b", " ".join(base))] + [(f"v{i:03}", more(10)) for i in range(130)] + [(f"w{i:03}", more(26)) for i in range(40)] + [(f"x{i:03}", " ".join(word() for _ in range(40))) for i in range(200)]
    got = {tuple(x) for x in neardup.similar_pairs(spark.createDataFrame(rows, "id string, content string"), "id", "content", 3, 5).collect()}
    want = brute(rows)
    assert len(want) == 131 * 130 // 2 + 40 and got <= want and len(got) >= 0.98 * len(want)


def test_different_texts_of_one_token_set_are_linked_each_with_each(spark):
    r = random.Random(5)
    words = "one two three four five six seven eight nine ten".split()
    texts = set()
    while len(texts) < 100:
        texts.add(" ".join(r.sample(words, len(words))))
    rows = [(f"c{i:03}", t) for i, t in enumerate(sorted(texts))] + [("d", " ".join([*words, "more"]))]
    copies = [(f"e{i:03}", rows[3][1]) for i in range(80)]
    got = [tuple(x) for x in neardup.similar_pairs(spark.createDataFrame(rows + copies, "id string, content string"), "id", "content", 3, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) | {("c003", i) for i, _ in copies}


def test_exact_candidates_find_every_pair(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(neardup, "BUCKET", 16)
    got = [tuple(x) for x in neardup.similar_pairs(spark.createDataFrame(rows, "id string, content string"), "id", "content", 3, 5, exact=True).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, content string")
    whole = sorted(tuple(x) for x in neardup.similar_pairs(df, "id", "content", 3, 5).collect())
    monkeypatch.setattr(neardup, "BUCKET", 8)
    monkeypatch.setattr(neardup, "PROBE", 1)
    assert sorted(tuple(x) for x in neardup.similar_pairs(df, "id", "content", 3, 5).collect()) == whole


def test_rows_of_a_band_follow_from_the_collection():
    import numpy as np

    near, far = np.full(1000, 0.3), np.full(1000, 0.02)
    assert neardup.choose_rows(near, 10_000, 0.6) < neardup.choose_rows(near, 100_000_000, 0.6)
    assert neardup.choose_rows(far, 100_000, 0.6) <= neardup.choose_rows(near, 100_000, 0.6)
    assert all((1 - 0.6**r) ** neardup.band_count(r, 0.6) <= neardup.MISS for r in range(2, 9))


def test_no_side_that_grows_is_broadcast_unmeasured(spark):
    df = spark.createDataFrame(corpus(), "id string, content string")
    plan = neardup.similar_pairs(df, "id", "content", 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan.split("== Initial Plan ==")[-1] and "NestedLoop" not in plan and "Cartesian" not in plan
