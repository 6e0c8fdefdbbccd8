from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from diffmill.llm import packing as p

WORD = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, rows):
    return spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, length int, sequence_id string")


def test_pieces_and_sequences_against_the_library(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "c,", "Déjà", "12"]) for _ in range(rng.choice([0, 1, 7, 90, 400, 700])))) for i in range(200)]
    rows += [(900, None), (901, ""), (901, ""), (None, "null id"), (902, "word " * 30_000), (7, rows[7][1]), (903, "<|endoftext|> x")]
    tok = Tokenizer.from_file(WORD)
    got = p.pack(docs_of(spark, rows), WORD).collect()
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    want = Counter()
    for (d, _), x in zip(rows, ids, strict=True):
        for a in range(0, len(x), 2048):
            want[d, a, min(2048, len(x) - a), zlib.crc32(np.array(x[a : a + 2048], "<u4").tobytes()), len(x)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    assert sorted(held) == list(range(len(held)))
    for spans in held.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    total = sum(map(len, ids))
    assert len(held) * 2048 <= total * 1.1 + 2 * 2048


def test_no_rows(spark):
    assert p.pack(docs_of(spark, []), WORD).collect() == []
    with pytest.raises(ValueError):
        p.pack(docs_of(spark, []), WORD, grain=3)


def best(values, sizes, room):
    value = [0.0] * (room + 1)
    for r in range(1, room + 1):
        value[r] = max([value[r - 1], *(value[r - s] + v for v, s in zip(values, sizes, strict=True) if s <= r)])
    return value[room]


def test_pricing_and_plans():
    rng = random.Random(5)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(1, 33), rng.randrange(1, 12))))
        values = np.array([rng.random() for _ in sizes])
        worth, pattern = p.best_pattern(values, sizes, 32, np.full(len(sizes), 32))
        assert worth == pytest.approx(best(values, sizes, 32)) == pytest.approx(float(values @ pattern)) and pattern @ sizes <= 32
        demand = {int(s): rng.randrange(0, 500) for s in sizes}
        made = p.plan(demand, 256, 8)
        held = Counter()
        for copies, pattern in made:
            assert sum(c * n for c, n in pattern.items()) <= 32
            for c, n in pattern.items():
                held[c] += copies * n
        assert held == Counter({c: n for c, n in demand.items() if n})
        asked = {c: n for c, n in demand.items() if n}
        bound = sum(x for _, x in p.column_generation(np.array(list(asked)), np.array(list(asked.values())), 32))
        assert bound >= sum(c * n for c, n in asked.items()) / 32 - 1e-6
        assert bound - 1e-6 <= sum(n for n, _ in made) <= bound + len(asked)


def test_plan_of_a_usual_histogram_pads_little():
    rng = np.random.default_rng(1)
    demand = Counter(np.minimum(np.ceil(rng.lognormal(6, 1, 100_000) % 2047 / 16).astype(int) + 1, 128).tolist())
    made = p.plan(demand)
    assert sum(n for n, _ in made) * 128 <= 1.005 * sum(c * n for c, n in demand.items())


def test_inverse_by_elimination():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 128):
        a = rng.integers(0, 5, (n, n)) + 20 * np.eye(n)[rng.permutation(n)]
        assert np.abs((a[:, :, None] * p.inverted(a)[None, :, :]).sum(axis=1) - np.eye(n)).max() < 1e-8
