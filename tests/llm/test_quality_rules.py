from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from diffmill.llm import quality_rules as q

NAV = "Home | About\tUS | Contact"


def brute(rows, min_docs=3, max_share=0.3):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", t)
    norm = lambda x: " ".join(re.findall("[^\x20\x09-\x0d]+", x.lower()))
    texts, held = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        t = t or ""
        for line in t.split("\n"):
            if norm(line):
                texts[h].add(t)
                held[h, norm(line)].add(t)
    bad = {k for k, v in held.items() if len(v) >= min_docs and len(v) > max_share * len(texts[k[0]])}
    out = []
    for i, t, h in rows:
        t = t or ""
        w = words(t)
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        c = Counter(windows)
        covered = {j + d for j, x in enumerate(windows) if c[x] > 1 for d in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        gone = sum(len(words(x)) for x in lines if (h, norm(x)) in bad)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        left = len(w) - gone
        out.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), failed, not failed and left >= 10 and left >= 0.2 * len(w), gone))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        own = "\n".join(" ".join(rng.choice("abcdefgh") + str(rng.randrange(200)) for _ in range(rng.choice([1, 4, 30]))) for _ in range(rng.choice([1, 3, 8])))
        rows.append((i, rng.choice([own, NAV + "\n" + own, own + "\n home |  about us | contact\n\n" + own, NAV, "x # y\n" * 9]), rng.choice(["h1", "h1", "h2", None, ""])))
    return [*rows, (200, None, "h1"), (200, "", "h1"), (5, rows[5][1], rows[5][2]), (None, "one two three four five six seven eight nine ten nb sp", "h2"), (300, "tok " * 60_000, "h2"), (301, " ".join(f"w{i % 25_000}" for i in range(40_000)), "h2")]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, kept int, line string")
    got = q.quality(docs, min_docs=3).drop("__text", "__host")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert any(r[-1] and not r[-2] and not r[-3] for r in brute(rows)) and any(r[-2] for r in brute(rows))


def test_copies_alone_condemn_nothing(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(8)) for i in range(5))
    rows = [(i, text, "h") for i in range(50)] + [(100 + i, f"a line of its own {i} and ten words or so to be kept", "h") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r.kept for r in q.quality(docs, min_docs=2).collect())


def test_windows_by_numbers_are_those_by_tuples(monkeypatch):
    rng = random.Random(1)
    cases = [[rng.choice([b"a", b"b", b"cc"]) for _ in range(n)] for n in (0, 4, 5, 6, 30, 200)] + [[b"x%d" % (i % 40) for i in range(90)]]
    want = [q.repeat_words(c) for c in cases]
    monkeypatch.setattr(q, "LONG", 0)
    assert [q.repeat_words(c) for c in cases] == want


def test_no_rows_and_kept_columns(spark):
    assert q.quality(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    rows = corpus()
    docs = spark.createDataFrame([(a, b, "en", c, 1) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = q.drop_rejected(docs, min_docs=3)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in brute(rows) if r[7])


def test_lines_are_boilerplate_however_large_the_host(spark):
    own = lambda i: "\n".join(" ".join(f"w{i}x{j}x{k}" for k in range(10)) for j in range(2))
    rows = [(i, ("Read more  here\n" if i < 20 else "held by fewer\n" if i < 39 else "") + own(i), "h") for i in range(400)]
    got = {r.doc_id: r.n_removed_words for r in q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: 3 if i < 20 else 0 for i in range(400)}


def test_frequent_lines_leave_the_kept_texts(spark):
    own = lambda i: "\n".join(" ".join(f"w{i}x{j}x{k}" for k in range(10)) for j in range(2))
    rows = [(i, f"Read  MORE\there\n{own(i)}\n\n read more here \r\nÉnd {i}", "h", 1) for i in range(30)]
    rows += [(50, f"read more here\n{own(50)}", "other", 1), (3, rows[3][1], "h", 1), (None, rows[4][1], "h", 1), (51, own(51), None, 1)]
    got = q.drop_rejected(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"))
    cut = lambda i: f"{own(i)}\n\nÉnd {i}"
    want = [(i, cut(i), "h", len(cut(i))) for i in [*range(30), 3]] + [(None, cut(4), "h", len(cut(4))), rows[30], rows[33]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
