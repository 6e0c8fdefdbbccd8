from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from diffmill.llm import sharding as s


def check(spark, rows, shards):
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, shard string, bin int")
    got = s.shard(docs, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        of[r.size, r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in of.values())
    load, group = Counter(), Counter()
    for r in got:
        load[r.shard] += r.size
        group[r.size, r.text_crc32] += r.size
    return got, [load[i] for i in range(shards)], max(group.values(), default=0)


def test_rows_stay_whole_and_sizes_are_near(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["é", "ab", "x"]) * rng.choice([1, 50, 999]) + str(rng.randrange(90))) for i in range(600)]
    rows += [(900, None), (901, ""), (901, ""), (None, "n"), (902, "y" * 5000), (3, rows[3][1])]
    got, load, largest = check(spark, rows, 5)
    assert max(load) - min(load) <= largest
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, s.shard(docs.repartition(3), 5).collect())) == Counter(map(tuple, got))


def test_small_groups_go_by_bins(spark, monkeypatch):
    monkeypatch.setattr(s, "PARTS", 2)
    monkeypatch.setattr(s, "BINS", 64)
    _, load, _ = check(spark, [(i, f"text {i}") for i in range(900)] + [(1000 + i, "copy") for i in range(300)], 3)
    assert max(load) - min(load) < 0.1 * sum(load) / 3


def test_one_group_and_no_rows(spark):
    _, load, _ = check(spark, [(i, "same") for i in range(50)], 4)
    assert sorted(load) == [0, 0, 0, 600]
    assert s.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_schedule_is_longest_first():
    assert s.schedule([(3, "a"), (7, "b"), (5, "c"), (4, "d")], 2) == {"b": 0, "c": 1, "d": 1, "a": 0}
