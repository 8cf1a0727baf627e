"""Token counts, packing and mixing."""

import os
import random

import numpy as np
import pytest

from mnemospark.llm import mixing, packing
from mnemospark.llm.tokens import VOCABULARY, encoding, with_token_counts

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
def test_token_counts(spark):
    texts = ["hello world", "", None, "数据" * 5000, "a" * 20_000]
    df = with_token_counts(spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int"), "text")
    got = {r.doc_id: r.n_tokens for r in df.collect()}
    assert got == {i: len(encoding().encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)} and df.columns == ["doc_id", "n_tokens"]


def test_differencing():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 400, 300)
    containers, highest = packing.difference(sizes, 40)
    loads = np.bincount(containers, sizes, 40)
    assert loads.max() == highest and highest - loads.min() <= 12
    places = packing.pack(sizes, 512)
    assert np.bincount(places, sizes).max() <= 512 and places.max() + 1 <= 1.06 * sizes.sum() / 512 + 1


def test_packing(spark):
    r = random.Random(6)
    sizes = [(i, r.choice([0, None, 1, 40, 200, 511, 512, 513, 2000, r.randrange(1, 900)]), 1) for i in range(2000)]
    specs = spark.createDataFrame([(1, "s", 512), (2, "m", 2048), (3, "bad", None)], "spec_id int, spec_name string, capacity_tokens int")
    packed = packing.pack_documents(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int, container int"), specs)
    rows = packed.collect()
    for spec, capacity in ((1, 512), (2, 2048)):
        mine = [x for x in rows if x.spec_id == spec]
        loads = {}
        for x in mine:
            if x.container:
                loads[x.container] = loads.get(x.container, 0) + x.n_tokens
        assert max(loads.values()) <= capacity and sum(loads.values()) == sum(s or 0 for _, s, _ in sizes)
        for doc, size, _ in sizes:
            parts = sorted((x.token_start, x.token_end) for x in mine if x.doc_id == doc)
            assert parts[0][0] == 0 and parts[-1][1] == (size or 0) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
            assert len(parts) == max(1, -(-(size or 0) // capacity))
    report = {x.spec_id: x.filled for x in packing.fill_report(packed, specs).collect()}
    assert report[2] > 0.9
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, n_tokens int"), specs).count() == 0


def test_shortages_go_to_siblings_first():
    assert mixing.share_out(100, [1, 1, 2], [10, 100, 100]) == [10, 30, 60]
    assert mixing.share_out(100, [1, 1], [10, 20]) == [10, 20] and mixing.share_out(5, [0, 1], [9, 9]) == [0, 5]
    leaf = lambda w, c: mixing.Node(w, c)
    a = mixing.Node(1, 0, {"x": leaf(1, 10), "y": leaf(1, 90)})
    b = mixing.Node(1, 0, {"z": leaf(1, 500)})
    root = mixing.Node(1, 0, {"a": a, "b": b})
    mixing._sum_up(root)
    mixing.budget(root, 160)
    assert [n.budget for n in (a.children["x"], a.children["y"], b.children["z"])] == [10, 70, 80]
    mixing.budget(root, 300)
    assert [a.budget, b.budget] == [100, 200]


def mixed(spark, sizes, targets, **more):
    df = spark.createDataFrame(sizes, "doc_id bigint, source string, lang string, n_tokens bigint, uses int")
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    out = mixing.mix(df, goals, **more)
    return out.collect(), {x.source: x for x in mixing.mix_report(out, goals).collect()}


def test_mix_reaches_shares_and_holds_repeats(spark):
    r = random.Random(8)
    sizes = [(i, s, r.choice(["en", "de", None]), r.randrange(1, 400), 5) for i, s in enumerate(r.choices(["big", "mid", "small", "other", None], [60, 25, 5, 10, 5], k=4000))]
    rows, report = mixed(spark, sizes, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)])
    assert {x.source for x in rows} == {"big", "mid", "small"} and len({x.doc_id for x in rows}) == len(rows)
    assert all(abs(x.actual_share - x.target_share) < 0.002 and x.most_uses <= x.max_repeats for x in report.values())
    again, _ = mixed(spark, sizes, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)])
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_mix_with_too_large_total_and_edges(spark):
    sizes = [(i, "a" if i < 10 else "b", "en", 10, 0) for i in range(1000)] + [(5000, "a", "en", 0, 0)]
    rows, report = mixed(spark, sizes, [("a", 0.5, 2), ("b", 0.5, 1), ("gone", 0.1, 1), ("never", 0.0, 1)], total_tokens=5000)
    assert report["a"].tokens == 200 and abs(report["b"].tokens - 4800) <= 10 and report["gone"].tokens == 0 and all(x.uses <= 2 for x in rows)
    assert mixed(spark, [], [("a", 1.0, 1)])[0] == []


def test_shortages_go_to_sources_of_the_same_domain(spark):
    """Source a holds 1,000 tokens once; b of its domain takes what a lacks, c of the other domain keeps its share."""
    sizes = [(i, "abc"[i % 3], "en" if i % 2 else "de", 10, 0) for i in range(300)] + [(1000 + i, "bc"[i % 2], "en", 10, 0) for i in range(2000)]
    goals = [("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.4, 1)]
    _, plain = mixed(spark, sizes, goals, domains={"a": "x", "b": "x", "c": "y"})
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in plain.values())
    _, report = mixed(spark, sizes, goals, domains={"a": "x", "b": "x", "c": "y"}, stretch=2.0)
    whole = sum(r.tokens for r in report.values())
    assert report["a"].tokens == 1000 and abs(report["c"].tokens / whole - 0.4) < 0.01 and abs(report["b"].tokens / whole - 0.45) < 0.01


def test_too_many_targets_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_LIMIT", 2)
    sizes = [(i, "ab"[i % 2], "en", 10, 0) for i in range(10)]
    with pytest.raises(ValueError):
        mixed(spark, sizes, [("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 1)])


def test_many_small_items_make_more_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN_ITEMS", 100)
    specs = spark.createDataFrame([(1, 100_000)], "spec_id int, capacity_tokens int")
    rows = packing.pack_documents(spark.createDataFrame([(i, 1) for i in range(1000)], "doc_id bigint, n_tokens int"), specs).collect()
    assert len(rows) == 1000 and len({x.container.split("-")[0] for x in rows}) == 10


def test_too_many_specs_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPEC_LIMIT", 1)
    specs = spark.createDataFrame([(1, 10), (2, 20)], "spec_id int, capacity_tokens int")
    with pytest.raises(ValueError):
        packing.pack_documents(spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens int"), specs)
