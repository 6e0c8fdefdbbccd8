from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from diffmill.llm import mixing as m


def rows_of(seed, n):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "\U0001f600", "￿", None]
    return [(i, rng.choice([None, "", *["w " * rng.choice([1, 5, 200, 900])] * 6]), rng.choice([*sources, *["b"] * 6])) for i in range(n)]


def brute_targets(sizes, weights, share=1.5, passes=2):
    """As the rule says: share by weight, stop those above, deal the rest again."""
    out, left, open_ = {}, share * sum(sizes.values()), {s for s, n in sizes.items() if n}
    while open_:
        part = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if part[s] > passes * sizes[s]}
        if not above:
            return {s: 0.0 for s in sizes} | out | part
        for s in above:
            out[s] = float(passes * sizes[s])
            left -= out[s]
        open_ -= above
    return {s: 0.0 for s in sizes} | out


def test_against_brute_force(spark):
    rows = [*rows_of(1, 150), (7, "same row " * 30, "b"), (7, "same row " * 30, "b"), (None, "x y z", "a"), (999, "tiny one", "zz"), (1000, None, "empty"), (1001, "long\t\n" * 60_000, "￿")]
    docs = spark.createDataFrame([(a, b, c, 0, 1) for a, b, c in rows], "doc_id long, text string, source string, size int, block int")
    found, slots = m.mix(docs)
    got = found.collect()
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, words(t)) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goal = brute_targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    times = Counter((r.source_no, r.block) for r in slots.collect())
    streams = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and order[r.source_no] == r.source
        if r.size:
            at = range(r.first, r.first + r.size)
            streams.setdefault(r.source, []).extend(at)
            assert r.taken == sum(times[r.source_no, w // m.BLOCK] for w in at) <= 2 * r.size
        else:
            assert r.taken == 0
    assert all(sorted(x) == list(range(sizes[s])) for s, x in streams.items())
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= m.BLOCK for s in order), (taken, goal)
    again, _ = m.mix(docs.repartition(3))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_targets_of_odd_sizes():
    assert m.targets(np.array([], np.int64), np.array([])).tolist() == []
    assert m.targets(np.array([0, 0]), np.array([3.0, 1.0])).tolist() == [0, 0]
    assert m.targets(np.array([10, 0, 1000]), np.array([3.0, 1.0, 2.0])).tolist() == pytest.approx([20, 0, 1495])


def test_permutations_are_permutations():
    for n in (1, 2, 3, 5, 64, 1000):
        got = m.permuted(np.arange(n), n, [1, 2])
        assert sorted(got.tolist()) == list(range(n))
    assert m.permuted(np.arange(1000), 1000, [1]).tolist() != m.permuted(np.arange(1000), 1000, [2]).tolist()


def test_shards_take_each_quota_and_fill_their_places():
    quotas = [1000, 0, 37, 5000, 1]
    shards = [m.shard_counts(quotas, 7, i, 900, 5) for i in range(7)]
    assert [sum(c[s] for _, c in shards) for s in range(5)] == quotas
    assert [sum(c) for _, c in shards] == [900] * 6 + [sum(quotas) - 5400]
    for s in range(5):
        at = 0
        for before, counts in shards:
            assert before[s] == at
            at += counts[s]
    assert 50 < m._draw(np.random.default_rng(1), 10**12, 10**12, 200) < 150


def test_empty_table_and_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    found, slots = m.mix(docs)
    assert found.collect() == [] and slots.collect() == []
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted(r.taken for r in m.mix(docs)[0].collect()) == [0, 0]


def mixed(spark, rows):
    """(words of each source in the stage's output, its targets, copies of each id)."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = m.mixed_documents(docs)
    assert got.columns == docs.columns
    out = [tuple(r) for r in got.collect()]
    assert set(out) <= set(rows)
    words = Counter()
    for r in out:
        words[r[3]] += len((r[1] or "").split())
    found = m.mix(docs)[0].collect()
    return words, {r.source: r.target for r in found}, Counter(r[0] for r in out), found


def test_mixed_documents_meet_the_targets(spark):
    rng = random.Random(3)
    rows = [(i, "a b " * 1000, "en", f"s{i % 3}", 3) for i in range(600)]
    words, goal, copies, found = mixed(spark, rows)
    assert all(abs(words[s] - t) <= 0.02 * t for s, t in goal.items()), (words, goal)
    assert max(copies.values()) <= 2 and {round(t / 400_000, 3) for t in goal.values()} == {2.0, 0.833, 1.667}
    rows = [(i, "w " * rng.choice([10, 300, 2000, 9000, rng.randrange(1, 5000)]), "en", f"s{i % 4}", 3) for i in range(1500)] + [(9999, "", "en", None, 0), (9998, None, "en", "s1", None)]
    words, goal, copies, found = mixed(spark, rows)
    assert all(abs(words[s] - t) <= 0.02 * t for s, t in goal.items() if t), (words, goal)
    assert copies[9999] == copies[9998] == 1 and all(copies[r.doc_id] in (r.taken // r.size, -(-r.taken // r.size)) for r in found if r.size)


def test_repeated_rows_and_names_that_clash(spark):
    names = "__id __source __size __words __each __more __copy".split()
    rows = [(i, "a b c " * 50, f"s{i % 2}", *range(7)) for i in range(40)] + [(7, "a b c " * 50, "s1", *range(7))] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    got = m.mixed_documents(docs)
    assert got.columns == docs.columns
    out = Counter(map(tuple, got.collect()))
    assert set(out) <= set(rows) and all(n <= 2 * rows.count(r) for r, n in out.items())
    n = Counter()
    for r, k in out.items():
        n[r[2]] += 150 * k
    goal = {r.source: r.target for r in m.mix(docs)[0].collect()}
    assert all(abs(n[s] - t) <= 300 for s, t in goal.items())


def test_draws_say_which_shard_holds_what(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_SLOTS", 20)
    docs = spark.createDataFrame([(i, "w " * 100, f"s{i % 3}") for i in range(150)], "doc_id long, text string, source string")
    one, two = ({r.doc_id: (r.taken, r.first_shard) for r in m.mix(docs, seed=s)[0].collect()} for s in (1, 2))
    again = {r.doc_id: (r.taken, r.first_shard) for r in m.mix(docs.repartition(3), seed=1)[0].collect()}
    assert one == again != two and len({f for _, f in one.values()}) > 5
    counts = Counter((r.shard, r.source_no) for r in m.mix(docs, seed=1)[1].collect())
    assert len({counts[s, 0] for s in range(10)}) > 2  # shards differ, as draws do
