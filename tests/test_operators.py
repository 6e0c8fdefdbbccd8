"""Rules of single operators on small rows, and what has to hold of any result."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from diffmill.functions import replies
from diffmill.operators import clones, diffs, feedback, findings, review, similarity
from diffmill.sources import repository, seams
from diffmill.streaming import feedback as stream

FINDING = "path string, line int, seq long, impact string, certainty string, category string, title string, body string, critic_exempt boolean, post_inline boolean"


def finding(line=1, seq=0, impact="high", certainty="likely", category="correctness", title="t", body="b", exempt=False, inline=True):
    return ("p", line, seq, impact, certainty, category, title, body, exempt, inline)


def rows(spark, *items):
    return spark.createDataFrame(list(items), FINDING)


@pytest.mark.parametrize(
    ("impact", "certainty", "category", "want"),
    [("high", "speculative", "correctness", "warning"), ("high", "confirmed", "correctness", "bug"), ("high", "speculative", "security", "security"), ("critical", "speculative", "perf", "bug"), ("medium", "likely", "security", "warning"), ("low", "likely", "x", "suggestion"), ("trivial", "likely", "x", "informational")],
)
def test_severity(spark, impact, certainty, category, want):
    assert rows(spark, finding(impact=impact, certainty=certainty, category=category)).select(findings.severity()).first()[0] == want


def test_gate_never_drops_exempt_and_marks_once(spark):
    df = rows(spark, finding(1, 1, "trivial"), finding(2, 2, "trivial", exempt=True), finding(3, 3, "low", "speculative"), finding(4, 4, "critical", "speculative"), finding(5, 5, "medium", "speculative"))
    once = findings.gate(df)
    assert [r.line for r in once.orderBy("line").collect()] == [2, 4, 5]
    assert sorted(map(tuple, findings.gate(once).collect())) == sorted(map(tuple, once.collect()))


def test_dedupe_is_unique_and_prefers_exempt_then_impact_then_first(spark):
    df = rows(spark, finding(1, 2, "high", title="later"), finding(1, 1, "high", title="first"), finding(2, 1, "critical"), finding(2, 2, "low", exempt=True, title="tool"), finding(3, 1, "low"), finding(3, 2, "critical", title="worse"))
    assert sorted((r.line, r.title) for r in findings.rule_dedupe(df).collect()) == [(1, "first"), (2, "tool"), (3, "worse")]
    assert findings.rule_dedupe(df.repartition(3)).count() == 3


def test_relabel_twice_is_as_once(spark):
    df = rows(spark, finding(body="![BUG](https://i/x) old", certainty="speculative"), finding(2, title="", body=""), finding(3, body="x", exempt=True))
    once = findings.relabel(df)
    assert sorted(map(tuple, findings.relabel(once).collect())) == sorted(map(tuple, once.collect()))
    assert "WARNING" in once.where("line = 1").first().body and once.where("line = 3").first().body == "x"


def test_scores_are_clamped(spark):
    events = spark.createDataFrame([(1, "reaction", "+1", None)] * 5 + [(2, "command", None, "not_helpful")] * 4 + [(3, "other", "+1", None), (4, "reaction", "odd", None)], "review_id int, event_type string, reaction_content string, command string")
    assert {r.review_id: r.score for r in feedback.quality(events, "review_id").collect()} == {1: 100, 2: 0, 3: 50, 4: 50}


def test_upsert_takes_the_last_and_the_new(spark):
    s = "k int, v string, seq int"
    old, new = spark.createDataFrame([(1, "a", 9), (2, "b", 9)], s), spark.createDataFrame([(1, "c", 1), (1, "d", 2), (3, "e", 1)], s)
    assert sorted((r.k, r.v) for r in feedback.upsert(old, new, ["k"], "seq").collect()) == [(1, "d"), (2, "b"), (3, "e")]


def test_one_event_of_reactions_to_a_summary_and_a_comment_of_one_id(spark):
    reviews = spark.createDataFrame([(1, "r", 1, 77, 1), (5, "s", 2, 88, 1)], "id long, repo string, pr_number int, comment_id long, created_at int")
    summary = spark.createDataFrame([("r", 1, "u", "+1"), ("s", 2, "w", "heart")], "repo string, pr_number int, actor string, content string")
    comments = spark.createDataFrame([("s", 2, 77, "me", "b"), ("r", 1, 88, "me", "b")], "repo string, pr_number int, comment_id long, user_login string, body string")
    inline = spark.createDataFrame([(77, "u", "+1"), (88, "w", "heart"), (88, "x", "eyes")], "comment_id long, actor string, content string")
    events = review.synced(reviews, summary, comments, inline, spark.createDataFrame([], "comment_id long, reaction_content string, actor string"), "me")[1]
    got = sorted((r.comment_id, r.actor, r.is_inline, r.repo, r.pr_number, r.review_id) for r in events.collect())
    assert got == [(77, "u", False, "s", 2, 5), (88, "w", False, "s", 2, 5), (88, "x", True, "r", 1, 1)]


def test_a_review_is_shuffled_once(spark):
    from diffmill.plans import registry

    plan = registry.queries()["P9_reviewed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_chain_of_a_review_on_small_rows(spark):
    schema = f"review_id long, {FINDING}"
    of = lambda path, *items: [(1, path, *x[1:]) for x in items]
    df = lambda items: spark.createDataFrame(items, schema)
    static = spark.createDataFrame([(*of("a", finding(1, 0))[0], "x.rule", "ERROR")], f"{schema}, check_id string, severity string")
    candidates = of("a", finding(1, 1, "critical"), finding(2, 2), finding(3, 3), finding(4, 4, "low"), finding(4, 5, "medium"), finding(9, 9, "critical"))
    verdicts = [(1, "a", 2, "drop", None, None), (1, "a", 3, "KEEP", "Low", None), (1, "a", 9, "drop", None, None), (1, "b", 4, "drop", None, None), (1, "a", 3, "drop", None, None), (2, "a", 5, "drop", None, None)]
    wide = of("a", finding(1, 11), finding(2, 12), finding(2, 13, "critical"), finding(3, 14, category="perf"), finding(7, 15)) + [(None, "a", *finding(7, 16)[1:]), (1, "a", *finding(None, 17)[1:])]
    clones = [(1, "a", *finding(7, 20, exempt=True)[1:]), (None, "a", *finding(7, 21, exempt=True)[1:])]
    said = spark.createDataFrame(verdicts, "review_id long, path string, idx long, verdict string, impact string, certainty string")
    got = review.reviewed(static, df(candidates), said, df(clones), df(wide)).collect()
    assert sorted((r.line or 0, r.seq, r.impact) for r in got) == [(0, 17, "high"), (1, -(1 << 40), "high"), (2, 13, "critical"), (3, 3, "low"), (3, 14, "high"), (4, 5, "medium"), (7, 16, "high"), (7, 20, "high"), (7, 21, "high"), (9, 9, "critical")]
    plain = review.reviewed(static, df(candidates), said, df(clones), df(wide), critic=False, holistic=False).collect()
    assert sorted((r.line, r.seq) for r in plain) == [(1, -(1 << 40)), (2, 2), (3, 3), (4, 5), (7, 20), (7, 21), (9, 9)]


def test_cache_rows_exactly_at_their_time_count(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00'), (2, timestamp_ntz'2023-12-31 23:59:59') t(id, created_at)")
    assert [r.id for r in feedback.fresh(df, F.expr("timestamp_ntz'2024-01-02 00:00:00'"), 24).collect()] == [1]


def test_old_lines_wait_for_the_first_added_line(spark):
    diff = "diff --git a/a b/a\n@@ -1,4 +1,4 @@\n-x\n ctx\n+y\n-z\n@@ -9 +9 @@\n+w\n"
    files = diffs.by_file(spark.createDataFrame([(1, diff)], "pr_id long, diff_text string"))
    lines = diffs.numbered(files)
    assert sorted((r.start_line, r.end_line, r.old) for r in diffs.old_lines(lines, diffs.added_ranges(lines)).collect()) == [(2, 2, "x"), (9, 9, "")]


def test_similar_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    base = [str(rng.randrange(30)) for _ in range(60)]
    texts = []
    for i in range(25):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(60)] = f"w{i}"
        texts.append((f"p{i % 3}", i, " ".join(words)))
    df = spark.createDataFrame(texts, "path string, seq long, text string")
    sets = {s: {tuple(t.split()[j : j + 5]) for j in range(56)} for _, s, t in texts}
    want = {(a, b) for pa, a, _ in texts for pb, b, _ in texts if a < b and pa != pb and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.seq_a, r.seq_b) for r in clones.similar_pairs(clones.shingles(df)).collect()} == want and want


def test_copies_are_expanded_in_the_result_alone(spark, monkeypatch):
    import random

    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join(base)] * 40
    for i in range(40):
        words = [f"t{i}_{j}" for j in range(rng.randrange(20, 60))] + base[: rng.randrange(40)]
        texts += [" ".join(words), " ".join([*words[:-1], "x"])]
    for i in range(20):
        words = list(base)
        words[rng.randrange(80)] = f"w{i}"
        texts.append(" ".join(words))
    items = [(f"p{i % 3}", i, t) for i, t in enumerate([*texts, "a b c", "a b c d e", "a b c d e", ""])]
    sets = {s: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, s, t in items}
    want = {(a, b) for pa, a, _ in items for pb, b, _ in items if a < b and pa != pb and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    seen = {}
    kept = clones.written
    monkeypatch.setattr(clones, "written", lambda df, name: seen.setdefault(name, kept(df, name)))
    for sample, cell in ((16, 1 << 22), (1, 200)):  # no common shingles and one cell; many of both
        seen.clear()
        monkeypatch.setattr(clones, "SAMPLE", sample)
        monkeypatch.setattr(clones, "CELL", cell)
        got = clones.similar_pairs(clones.shingle_sets(spark.createDataFrame(items, "path string, seq long, text string"))).collect()
        assert len(got) == len(want) and {(r.seq_a, r.seq_b) for r in got} == want
        assert seen["clone-pairs"].count() < 300 < len(want)


def test_shingles_are_those_of_the_sql(spark):
    import random

    import duckdb

    from diffmill.plans.code import SHINGLES

    rng = random.Random(5)
    parts = ["ab", "É", "_", "x1", "12", "١٢", "½", "ⅷ", "日本", "\U00011f04", "\U0002ebf0", "a\u0301", "\u200b", "\x0b", "\x85", "\xa0", "\u2028", " ", "\n", "\t", "--", "😀", "\0", "a\x0bb 1a _1 1_"]
    texts = ["", "a b c d", "a b c d e", " a b c d e ", "-----", "1a1a1a1a", None, "x " * 50]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]
    items = [("p", i, x) for i, x in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (source VARCHAR, doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", items)
    want = {}
    for seq, shingle in con.execute(f"WITH {SHINGLES} SELECT seq, shingle FROM sh").fetchall():
        want.setdefault(seq, set()).add(shingle)
    got = {r.seq: r for r in clones.shingle_sets(spark.createDataFrame(items, "path string, seq long, text string")).collect()}
    assert {k: len(x) for k, x in want.items()} == {k: r.n for k, r in got.items()} == {k: len(set(r.hashes)) for k, r in got.items()}
    # equal shingles of different texts are one hash, and different ones differ
    known = {x for k in want for x in want[k]}
    assert len(known) == len({h for r in got.values() for h in r.hashes})
    assert all(len(want[a] & want[b]) == len(set(got[a].hashes) & set(got[b].hashes)) for a in want for b in want)


def test_near_copies_in_blocks_and_few_sets_made_again(spark, monkeypatch):
    import random

    rng = random.Random(6)
    base, other = [f"b{i}" for i in range(60)], [f"c{i}" for i in range(60)]
    texts = []
    for i in range(120):
        words = list(base if i % 3 else other)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"w{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"t{i}_{j}" for j in range(60)) for i in range(300)]
    items = [(f"p{i % 3 if i % 7 else 0}", i, t) for i, t in enumerate(texts)]
    sets = {s: {tuple(t.split()[j : j + 5]) for j in range(56)} for _, s, t in items}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for pa, a, _ in items[:120] for pb, b, _ in items[:120] if a < b and pa != pb and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    chunks = spark.createDataFrame(items, "path string, seq long, text string")
    made, make = [], clones.shingle_sets
    monkeypatch.setattr(clones, "shingle_sets", lambda df, *a: made.append(df) or make(df, *a))
    for cell, rows, part in ((1 << 22, 256, 1 << 18), (300, 2, 500)):
        made.clear()
        monkeypatch.setattr(clones, "CELL", cell)
        monkeypatch.setattr(clones, "ROWS", rows)
        monkeypatch.setattr(clones, "PART", part)
        got = clones.similar_pairs(clones.shingle_sets(chunks), chunks=chunks).collect()
        assert len(got) == len(want) and {(r.seq_a, r.seq_b): r.jaccard for r in got} == want
        assert "Join" not in made[0]._jdf.queryExecution().executedPlan().toString() and made[1].count() < 100 and made[2].count() <= 120
    assert clones.similar_pairs(make(chunks.where("seq < 0")), chunks=chunks.where("seq < 0")).count() == 0


def test_greedy_pairs_use_each_once(spark):
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 1, 4)], "pr int, seq_a int, seq_b int")
    assert sorted((r.seq_a, r.seq_b) for r in clones.greedy(pairs, "pr").collect()) == [(1, 2), (3, 4)]


def test_greedy_pairs_settle_in_a_large_group_of_copies(spark):
    import random

    def walked(pairs):
        used, out = set(), set()
        for g, a, b in sorted(pairs):
            if not {(g, a), (g, b)} & used:
                used |= {(g, a), (g, b)}
                out.add((g, a, b))
        return out

    rng = random.Random(3)
    copies = [(1, a, b) for a in range(250) for b in range(a + 1, 250)]
    chain = [(1, a, a + 1) for a in range(1000, 1400)] + [(2, a, a + 3) for a in range(100)]
    other = sorted({(2, *sorted(rng.sample(range(500, 700), 2))) for _ in range(400)})
    pairs = copies + chain + other
    rng.shuffle(pairs)
    got = clones.greedy(spark.createDataFrame(pairs, "pr int, seq_a int, seq_b int"), "pr").collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == walked(pairs)


def test_python_clones_up_to_names(spark):
    df = spark.createDataFrame([("def f(a):\n return a + 1",), ("def g(b):\n return b + 1",), ("def g(b):\n return b + 2",), ("def (",)], "t string").select(clones.python_alpha_hash("t").alias("h"))
    h = [r.h for r in df.collect()]
    assert h[0] == h[1] != h[2] and h[3] is None


def test_nearest_has_no_score_for_zero_vectors(spark):
    df = spark.createDataFrame([(1, "r", "a", "h1", [1.0, 0.0]), (2, "r", "b", "h2", [0.0, 0.0]), (3, "r", "c", "h3", [2.0, 0.0]), (4, "r", "a", "h4", [1.0, 0.0])], "vec_id int, repo_id string, path string, content_hash string, embedding array<float>")
    got = similarity.nearest(df.where("vec_id = 1"), df).collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(3, 1.0)]


def test_nearest_in_blocks_against_all_pairs(spark, monkeypatch):
    import math
    import random

    rng = random.Random(5)
    vectors = [[float(rng.randrange(-2, 3)) for _ in range(6)] for _ in range(40)]
    items = [(i, f"r{i % 2}", f"p{i % 5}", f"h{i % 90}", rng.choice(vectors)) for i in range(300)]
    items += [(300, "r0", "p9", "x", [0.0] * 6), (301, "r0", "p9", "y", [1.0, 2.0]), (302, "r0", "p9", "z", None), (303, "r0", "p9", "w", [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, "r0", None, "v", vectors[0]), (305, None, "p9", "u", vectors[0])]
    df = spark.createDataFrame(items, "vec_id int, repo_id string, path string, content_hash string, embedding array<float>")
    queries = [x for x in items if x[0] % 10 == 0]
    whole = lambda v: bool(v) and None not in v and any(v)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))
    want = []
    for q in queries:
        near = [(-cos(q[4], c[4]), c[0]) for c in items if whole(q[4]) and whole(c[4]) and len(q[4]) == len(c[4]) and c[1] == q[1] and c[2] and c[2] != q[2] and c[3] != q[3]]
        want += [(q[0], v, r, round(-s, 9)) for r, (s, v) in enumerate(sorted(near)[:5], 1)]
    for size in (similarity.BLOCK, 300):  # one block, and many
        monkeypatch.setattr(similarity, "BLOCK", size)
        got = similarity.nearest(df.where("vec_id % 10 = 0"), df)
        assert sorted((r.query_id, r.vec_id, r.rank, round(r.score, 9)) for r in got.collect()) == sorted(want)


def test_nearest_meets_vectors_in_blocks_and_not_in_a_join_of_all_pairs(spark):
    df = spark.createDataFrame([(i, "r", f"p{i}", f"h{i}", [1.0, float(i)]) for i in range(4)], "vec_id int, repo_id string, path string, content_hash string, embedding array<float>")
    assert "FlatMapCoGroupsInArrow" in similarity.nearest(df, df)._jdf.queryExecution().toString()


def test_best_matches_come_from_the_search_in_blocks(spark, monkeypatch):
    from diffmill.plans import registry

    query = registry.queries()["K3_A15_best_matches"]
    whole = query(spark, "/root/testdata/sf0.001")
    assert "FlatMapCoGroupsInArrow" in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(similarity, "BLOCK", 1000)
    assert sorted(map(tuple, query(spark, "/root/testdata/sf0.001").collect())) == sorted(map(tuple, whole.collect()))


def test_vectors_are_shuffled_by_block_and_not_by_repository(spark):
    from diffmill.plans import registry

    plan = registry.queries()["K3_A15_best_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "dim#" in x]
    assert len(dealt) == 2 and all("qb#" in x and "cb#" in x for x in dealt)
    assert "SortMergeJoin" not in plan


def test_best_of_a_block_with_copies_and_odd_vectors(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    vectors += [[x + 1e-9 * rng.gauss(0, 1) for x in vectors[0]] for _ in range(20)]
    vectors += [[0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [x * 1e-140 for x in vectors[1]], [x * 1e140 for x in vectors[2]]]
    items = [(i, rng.choice(["p0", "p1", "p2", None]), f"h{rng.randrange(90)}", rng.choice(vectors)) for i in range(400)]
    names = ("vec_id", "path", "content_hash", "embedding")
    chunks = pa.table({n: [x[i] for x in items] for i, n in enumerate(names)}).append_column("repo_id", pa.array(["r"] * 400))
    queries = pa.table({n: [x[i] for x in items[::3]] for i, n in enumerate(("query_id", "q_path", "q_hash", "q"))})
    with np.errstate(all="ignore"):
        m = np.array([x[3] for x in items])
        norms = np.sqrt(similarity._dots(m, m))
        for others in (True, False):
            want = []
            for q in items[::3]:
                product = norms[q[0]] * norms
                score = similarity._dots(np.repeat(m[q[0]][None], 400, 0), m) / product
                near = [x for x in items if product[x[0]] != 0 and not (others and (q[1] is None or x[1] in (None, q[1]) or x[2] == q[2]))]
                best = sorted(near, key=lambda x: (not np.isnan(score[x[0]]), 0 if np.isnan(score[x[0]]) else -score[x[0]], x[0]))[:5]
                want += [(q[0], x[0], repr(float(score[x[0]]))) for x in best]
            for groups, scores in ((256, 1 << 20), (20, 1000)):
                monkeypatch.setattr(similarity, "GROUPS", groups)
                monkeypatch.setattr(similarity, "SCORES", scores)
                got = similarity._best(5, others)(queries, chunks).to_pylist()
                assert sorted((x["query_id"], x["vec_id"], repr(x["score"])) for x in got) == sorted(want)


def test_few_of_a_large_group_of_copies_are_scored(monkeypatch):
    import pyarrow as pa

    vectors = [[1.0, 0.5]] * 2000 + [[1.0, 0.1]] * 20
    chunks = pa.table({"vec_id": range(2020), "path": [f"p{i % 3}" for i in range(2020)], "content_hash": [f"h{i if i % 2 else i % 8}" for i in range(2020)], "embedding": vectors, "repo_id": ["r"] * 2020})
    queries = pa.table({"query_id": range(40), "q_path": [f"p{i % 3}" for i in range(40)], "q_hash": [f"h{i if i % 2 else i % 8}" for i in range(40)], "q": vectors[:40]})
    scored, dots = [], similarity._dots
    monkeypatch.setattr(similarity, "_dots", lambda a, b: scored.append(len(a)) or dots(a, b))
    got = similarity._best(5, True)(queries, chunks).to_pylist()
    items = chunks.to_pylist()
    want = [(q["query_id"], v) for q in queries.to_pylist() for v in [x["vec_id"] for x in items if x["path"] != q["q_path"] and x["content_hash"] != q["q_hash"]][:5]]
    assert sorted((x["query_id"], x["vec_id"]) for x in got) == sorted(want)
    assert sum(scored) < 2020 + 40 + 40 * 100


def test_replies_in_all_forms():
    assert [x["line"] for x in replies.parsed('<reasoning>[L10]</reasoning>[{"line": 10}, {"line": 11}, {"line": 25}]')] == [10, 11, 25]
    assert replies.parsed("") == replies.parsed(None) == replies.parsed("[]") == []
    assert replies.first_json('x {"a": "}"} y', "{", "}", dict) == '{"a": "}"}'


def test_secret_lines(spark):
    literal = "s" + "k-" + "a1" * 12
    df = spark.createDataFrame([(f"key = {literal}",), ("key = ${{ secrets.X }}",), ('token = os.environ["LONGNAMEX"]',), ('password: "hunter2hunter2"',)], "t string")
    assert [r[0] for r in df.select(replies.is_secret_line(F.col("t"))).collect()] == [True, False, False, True]


def test_paged_source_follows_links(spark):
    def fetch(url):
        return {"a1": ([{"n": 1}, {"n": 2}], "a2"), "a2": ([{"n": 3}], None), "b1": ([], None)}[url]

    spark.dataSource.register(repository.paged_source(fetch, "paged_test"))
    got = spark.read.format("paged_test").option("urls", json.dumps(["a1", "b1"])).load().collect()
    assert sorted(json.loads(r.item)["n"] for r in got) == [1, 2, 3]


def test_golden_files(spark, tmp_path):
    (tmp_path / "c1.json").write_text(json.dumps({"id": "c1", "path": "a.py", "diff_file": "c1.diff", "expected": [{"line_range": [1, 2], "category": "security", "min_impact": "high"}], "false_positives": []}))
    (tmp_path / "c1.diff").write_text("+x")
    cases, expected = repository.golden(spark, str(tmp_path))
    assert cases.first().diff_text == "+x" and tuple(expected.first())[2:5] == (1, 2, ["security"])


def test_stream_restarts_where_it_was(spark, tmp_path):
    schema = "comment_id int, reaction_content string, actor string, event_type string, created_at timestamp, event_id int"
    make = lambda *items: spark.createDataFrame([(c, "+1", a, "reaction", None, i) for c, a, i in items], schema)
    make((1, "u", 1), (1, "u", 2), (2, "u", 3)).write.parquet(f"{tmp_path}/in")
    read = lambda: stream.first_reactions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    stream.run_available(read(), f"{tmp_path}/state", f"{tmp_path}/out")
    make((1, "u", 4), (3, "v", 5)).write.mode("append").parquet(f"{tmp_path}/in")
    stream.run_available(read(), f"{tmp_path}/state", f"{tmp_path}/out")
    assert sorted(r.comment_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_stream_merges_batches_in_any_order(spark, tmp_path):
    schema = "k int, v string, n int"
    for i, rows in enumerate([[(1, "new", 9), (2, "a", 1)], [(1, "old", 3), (2, "b", 2)], [(3, "c", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append" if i else "overwrite").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    source.writeStream.foreachBatch(stream.keep_latest(spark, f"{tmp_path}/t", ["k"], "n")).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in stream.last_version(spark, f"{tmp_path}/t", f"{tmp_path}/s").collect()) == [(1, "new", 9), (2, "b", 2), (3, "c", 1)]
    assert not (tmp_path / "t" / "v=3").exists() and (tmp_path / "t" / "v=2").exists()


def test_unsigned_hooks_are_refused(spark):
    df = spark.createDataFrame([("pull_request", '{"action": "opened"}', s) for s in (True, False, None)], "event string, body string, signed boolean")
    assert [r.route for r in stream.routed(df).collect()] == ["review", "401", "401"]


def test_calls_are_tried_again_and_give_up():
    waits, left = [], [3]

    def call(x):
        left[0] -= 1
        if left[0] >= 0:
            raise seams.Limited
        return x

    assert seams.patiently(call, 7, sleep=waits.append) == 7 and waits == [1, 2, 4]
    left[0] = 99
    with pytest.raises(seams.Limited):
        seams.patiently(call, 7, sleep=waits.append)


def test_settings_tokens_and_providers():
    assert seams.Settings.read({"VECTOR_TOP_K": "9", "OXLINT_ENABLED": "no", "EFFORT": " "}) == seams.Settings(vector_top_k=9, oxlint_enabled=False)
    with pytest.raises(ValueError, match="vector_top_k"):
        seams.Settings.read({"VECTOR_TOP_K": "many"})
    assert seams.token(None, "t") == "t" and seams.token(lambda: "x", "t") == "x"
    with pytest.raises(ValueError):
        seams.token(lambda: None, "t")
    seams.register("forge-of-test", lambda x: x + 1)
    assert seams.provider("forge-of-test", 1) == 2
    with pytest.raises(KeyError):
        seams.provider("none")
    with pytest.raises(ValueError):
        seams.register("forge-of-test", int)


def test_rows_are_posted(spark, tmp_path):
    def post(row):
        (tmp_path / f"{row['id']}").write_text(row["body"])

    spark.dataSource.register(seams.posting_sink(post, "posting_test"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, body string").write.format("posting_test").mode("append").save()
    assert (tmp_path / "1").read_text() == "a" and (tmp_path / "2").read_text() == "b"


def test_scalars_have_to_be_there(spark):
    df = spark.createDataFrame([("x", "")], "a string, b string")
    assert seams.scalar(df, "a") == "x"
    with pytest.raises(ValueError):
        seams.scalar(df, "b")
