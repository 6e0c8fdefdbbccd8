from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
from diffmill.llm import mixing, simhash
from diffmill.llm.quality_rules import figures

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    word = lambda: rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + str(rng.randrange(400))
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(" ".join(word() for _ in range(rng.randrange(20, 60))) for _ in range(4)), f"src{i % 3}"))
    base = rows[10][1].split(" ")
    near = [*base]
    near[5] = "edited"
    rows += [(100, rows[3][1], "src1"), (101, rows[3][1].replace("\n", "  "), "src2"), (102, " ".join(near), "src0"), (103, "too short", "src0"), (104, "again and again it says " * 30, "src1"), (105, None, None), (106, "", "src0")]
    return [(i, t, "en", s, len(t or "")) for i, t, s in rows]


def test_stages_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = simhash.written(stage(spark, docs, ""), f"test-{name}")
        out[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: sorted(r.doc_id for r in out[name].collect())
    clean = [r for r in rows if (f := figures(r[1] or ""))[0] >= 10 and 100 * f[4] <= 20 * f[0]]
    assert ids("quality_rules") == sorted(r[0] for r in clean) and 104 not in ids("quality_rules")
    first = {}
    for r in clean:
        key = re.sub("[\x20\x09-\x0d]+", " ", r[1])
        first[key] = min(r[0], first.get(key, r[0]))
    assert ids("exact_dedup") == sorted(first.values())
    assert ids("simhash_near_dedup") == sorted(set(first.values()) - {102})
    found, _ = mixing.mix(out["simhash_near_dedup"])
    found = found.collect()
    times = Counter(ids("mixing"))
    assert all(times[r.doc_id] in (r.taken // r.size, -(-r.taken // r.size)) for r in found)
    for source in ("src0", "src1", "src2"):
        own = [r for r in found if r.source == source]
        assert abs(sum(times[r.doc_id] * r.size for r in own) - own[0].target) <= max(r.size for r in own)
    packed = out["packing"].collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == +times
    assert max(r.offset + r.length for r in packed) <= 2048


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame(corpus()[:12], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_near_copies_far_apart_in_bits(spark):
    rng = random.Random(13)
    rows = []
    for i in range(80):
        words = [f"w{rng.randrange(10_000)}" for _ in range(60)]
        rows.append((2 * i, " ".join(words), "en", "s", 1))
        words[20], words[21] = f"edit{i}", "more"
        rows.append((2 * i + 1, " ".join(words), "en", "s", 1))
    far = [(simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1])).bit_count() for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert sum(x > corpus_pipeline.NEAR_RADIUS for x in far) > 5
    got = corpus_pipeline.drop_near(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(r.doc_id for r in got.collect()) == [r[0] for r in rows[::2]]


def test_repeated_rows_and_clashing_names(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(80)), "en", f"s{i % 2}", 1) for i in range(30)]
    extra = "__id __t __h __kept __bad __text __host __gone_id __gone_sha __sha __row __gone __gone_raw"
    rows = [(*r, *range(13)) for r in [*rows, rows[3], rows[3], (50, rows[3][1].replace(" ", "\t"), *rows[3][2:]), (None, rows[4][1], "en", None, 1), (None, rows[4][1], "en", None, 1), (5, rows[6][1] + " x", "en", "s0", 1)]]
    docs = spark.createDataFrame(rows, COLUMNS + "".join(f", {n} long" for n in extra.split()))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = simhash.written(stage(spark, docs, ""), f"clash-{name}")
        assert docs.columns[5:] == extra.split() and {tuple(r)[5:] for r in docs.collect()} == {tuple(range(13))}
        if name == "exact_dedup":
            assert Counter(r.doc_id for r in docs.collect()) == Counter([*range(30), 5])
        if name == "simhash_near_dedup":
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert Counter(i for i, _ in kept) == Counter([*(i for i in range(30) if i != 6), 5])
