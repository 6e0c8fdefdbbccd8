from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from diffmill.llm.exact_dedup import drop_exact_copies, exact_dedup

ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (9, "a b"), (4, "a b "), (7, None), (8, ""), (None, ""), (1, "x" * 300 + "1"), (2, "x" * 300 + "2"), (6, "x" * 300 + "1"),
    (10, "nb sp"), (11, "nb sp"), (12, "long " * 50_000), (13, "long\n" * 50_000), (3, "a b"), (None, None),
]


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(i)
    out, seen = [], set()
    for (i, _), n in zip(rows, norm, strict=True):
        ids = [x for x in groups[n] if x is not None]
        keep = min(ids) if ids else None
        kept = i == keep and n not in seen
        if kept:
            seen.add(n)
        out.append((i, keep, len(groups[n]), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(a, b, "z", 1) for a, b in ROWS], "doc_id long, text string, sha string, group_size int")
    assert sorted(map(tuple, exact_dedup(docs).collect()), key=str) == brute(ROWS)
    found = exact_dedup(docs, digest=False).collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == sorted((x[:4] for x in brute(ROWS)), key=str)


def test_no_rows(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_all_rows_equal(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'same' AS text")
    rows = exact_dedup(docs).collect()
    assert len(rows) == 2000 and {(r.keep_id, r.group_size) for r in rows} == {(0, 2000)} and sum(r.kept for r in rows) == 1


def test_kept_documents_keep_their_columns(spark):
    rows = [r for r in ROWS if r[0] is not None]
    docs = spark.createDataFrame([(a, b, "l", f"s{a}", 0) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = drop_exact_copies(docs)
    assert got.columns == docs.columns
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    keep = {}
    for i, t in rows:
        keep[norm(t)] = min(i, keep.get(norm(t), i))
    assert sorted((r.doc_id, norm(r.text)) for r in got.collect()) == sorted((i, norm(t)) for i, t in rows if keep[norm(t)] == i)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.none() | st.text("ab \t\n", max_size=4)), min_size=1, max_size=12))
def test_any_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup(docs).collect()), key=str) == brute(rows)
