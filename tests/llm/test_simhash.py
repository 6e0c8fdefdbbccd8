from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from diffmill.llm import simhash as s


def brute_fp(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    fps = [brute_fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{fp:016x}", least.get(root(i))) for i, ((d, _), fp) in enumerate(zip(rows, fps, strict=True))]


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(["Alpha", "béta", "c", "d\x0be", "F"]) + str(rng.randrange(50)) for _ in range(rng.choice([1, 3, 4, 60, 300]))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 3])):
            words = list(words)
            words[rng.randrange(len(words))] = "changed"
            out.append("\n".join(words))
    return out


def test_against_brute_force(spark):
    rows = [*enumerate(texts(1, 60)), (500, None), (501, ""), (502, " \n"), (503, "ONE two"), (504, "one\ttwo"), (504, "one two"), (None, "one two"), (505, "nb sp ÀB"), (506, "long word " * 40_000)]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, fp int, component_id string")
    got = s.simhash_dedup(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_components(rows), key=str)


def test_null_ids_alone_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert [r.component_id for r in s.simhash_dedup(docs).collect()] == [None, None]
    assert s.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bit_slices_count_distances():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 300, np.uint64)
    fps[50:100] = fps[:50] ^ (np.uint64(1) << rng.integers(0, 64, 50, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 50, np.uint64))
    for radius in (0, 1, 2, 3, 4, 7, 30):
        near = s.within(fps, s.planes(fps), radius, list(range(64)), 300)
        got = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little", count=300)
        want = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        assert (got.astype(bool) == want).all()
    far = np.array([0, 2**64 - 1], np.uint64)
    assert s.within(far[:1], s.planes(far[1:]), 4, list(range(64)), 1) is None


def spanned(n, links):
    forest = s.Forest(n)
    for a, b in links:
        forest.join(a, b)
    return [forest.root(i) for i in range(n)]


def test_large_sets_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(6)
    fps = np.unique((rng.integers(0, 2**16, 3000, np.uint64) << np.uint64(7)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, np.uint64)))
    whole = s.spanning_links(fps, 4, list(range(64)))
    monkeypatch.setattr(s, "HOT", 16)
    monkeypatch.setattr(s, "BLOCK", 128)
    cut = s.spanning_links(fps, 4, list(range(64)))
    want = [(a, b) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps[a] ^ fps) <= 4).tolist() if a < b]
    assert spanned(len(fps), whole) == spanned(len(fps), cut) == spanned(len(fps), want)
    assert len(cut) == len(whole) == len(fps) - len(set(spanned(len(fps), want)))


def test_sets_are_cut_where_that_saves_comparisons(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 400, np.uint64)
    near = [base ^ np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (k, 400), np.uint64), axis=0) for k in (1, 2, 4, 6)]
    spread, close = np.unique(np.concatenate([base, *near])), np.unique(base & np.uint64(2**12 - 1))
    calls, whole = [], s.spanning_links
    want = [(a, b) for a in range(len(spread)) for b in np.flatnonzero(np.bitwise_count(spread[a] ^ spread) <= 4).tolist() if a < b]
    monkeypatch.setattr(s, "HOT", 16)
    monkeypatch.setattr(s, "spanning_links", lambda *args: calls.append(1) or whole(*args))
    assert spanned(len(spread), s.spanning_links(spread, 4, list(range(64)))) == spanned(len(spread), want) and len(calls) > 400
    calls.clear()
    links = s.spanning_links(close, 4, list(range(64)))
    want = [(a, b) for a in range(len(close)) for b in np.flatnonzero(np.bitwise_count(close[a] ^ close) <= 4).tolist() if a < b]
    assert spanned(len(close), links) == spanned(len(close), want) and len(calls) == 1


def test_hot_keys_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT", 5)
    rng = np.random.default_rng(7)
    fps = np.unique(rng.integers(0, 2**12, 400, np.uint64) * np.uint64(2**40) ^ rng.integers(0, 2**10, 400, np.uint64))
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = [(at[r.a], at[r.b]) for r in s.links(distinct).collect()]
    want = [(a, b) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps[a] ^ fps) <= 4).tolist() if a < b]
    assert spanned(len(fps), got) == spanned(len(fps), want)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60)] + [(-5, 200), (200, 140)]
    got = {r.node: r.root for r in s.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: -5 for i in [-5, 200, *range(100, 141)]}


def test_one_row_of_each_component_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", 1), (1, "A b c d e f", 2), (2, "something else here now", 3), (None, "a b c d e f", 4)], "doc_id long, text string, n int")
    got = s.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == [(1, "A b c d e f", 2), (2, "something else here now", 3), (None, "a b c d e f", 4)]


def test_links_are_checked_by_similarity(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    near, far = [*base], [*base]
    near[100] = "other"
    for i in range(0, 200, 20):
        far[i] = f"x{i}"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "alone in here"), (None, " ".join(base)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in s.simhash_dedup(docs, radius=30, least=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, None: 1, 5: 5}
    assert s.simhash_dedup(docs.where("false"), radius=30, least=0.8).collect() == []


def similar_components(rows, least=0.8, k=5):
    """Least id of each row's component over all pairs of texts that are similar enough."""
    sets = [set(s.shingle_hashes(t, k).tolist()) for _, t in rows]
    forest = s.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= least * (len(sets[i]) + len(sets[j]) - n):
                forest.join(j, i)
    return {d: rows[forest.root(i)][0] for i, (d, _) in enumerate(rows)}


def edited(base, n, rng):
    words = list(base)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_of_many_near_copies_against_brute_force(spark):
    rng = random.Random(11)
    bases = [[f"w{rng.randrange(10_000)}" for _ in range(n)] for n in (300, 300, 120)]
    rows = [(500, " ".join(bases[0]))] + [(i, edited(bases[0], 5, rng)) for i in range(300)]
    rows += [(600 + i, edited(bases[1], 4 + i % 7, rng)) for i in range(150)] + [(800 + i, edited(bases[2], 1 + i % 3, rng)) for i in range(60)]
    rows.sort()
    want = similar_components(rows)
    assert {want[i] for i in range(300)} == {0} and len(set(want.values())) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in s.simhash_dedup(docs, radius=9, least=0.8).collect()}
    assert got == want


def test_texts_of_one_fingerprint_are_checked_too(spark):
    rows = [(i, "x " * 200 + tail) for i, tail in enumerate(["a b c d e", "p q r s t", "A b\tc d e", "y z"])]
    assert len({brute_fp(t) for _, t in rows}) == 1
    got = {r.doc_id: r.component_id for r in s.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least=0.8).collect()}
    assert got == similar_components(rows) == {0: 0, 1: 1, 2: 0, 3: 3}
