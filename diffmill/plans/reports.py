"""Queries over tool reports, context, model replies and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffmill.functions import replies as r
from diffmill.functions.paths import is_reliable
from diffmill.operators import context as x
from diffmill.operators import tools as t
from diffmill.plans import derived as d
from diffmill.plans.derived import sql

def _lit(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(rows, names) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, row)) + ')' for row in rows)}) t({names})"


def _spans(s, sf):
    return d.table(s, sf, "lineitem").selectExpr("concat('f', l_orderkey) AS path", "l_linenumber AS start_line", "l_linenumber + CAST(l_quantity AS INT) % 4 AS end_line", "l_partkey AS seq")


def _ranges(s, sf):
    return d.table(s, sf, "orders").selectExpr("concat('f', o_orderkey) AS path", "CAST(o_orderkey % 6 AS INT) AS start_line", "CAST(o_orderkey % 6 + 2 AS INT) AS end_line")


SPANS = "sp AS (SELECT 'f' || l_orderkey AS path, l_linenumber AS start_line, l_linenumber + CAST(l_quantity AS INT) % 4 AS end_line, l_partkey AS seq FROM lineitem), rg AS (SELECT 'f' || o_orderkey AS path, o_orderkey % 6 AS a, o_orderkey % 6 + 2 AS b FROM orders)"


def _changed(s, sf):
    return d.table(s, sf, "documents").selectExpr("doc_id % 20 AS pr_id", "concat('src/mod', doc_id % 40, IF(doc_id % 2 = 0, '.py', '/index.js')) AS path").distinct()


def _imports(s, sf):
    return _changed(s, sf).selectExpr("pr_id", "path", "CASE pr_id % 3 WHEN 0 THEN concat('src.mod', pr_id) WHEN 1 THEN concat('./mod', pr_id + 20) ELSE 'other' END AS name", "array('run', concat('f', pr_id), 'run') AS names")


REPLY = [
    (1, "<think>[L10] not [this]</think> Here: [ {\"line\": 10, \"severity\": \"bug\", \"title\": \"a ] b\", \"confidence\": 9} ] end"),
    (2, "```json\n[{\"line\": 3, \"title\": \"t\", \"confidence\": 4}, {\"line\": 0}, {\"line\": \"8\", \"body\": \"x\", \"confidence\": \"q\"}]\n```"),
    (3, "4\tfirst thing\nnoise\nLine 8: second\n"),
    (4, ""), (5, None), (6, "[]"), (7, "see [1] and [x] {\"a\": {\"b\": \"}\"}} tail"),
]
ITEMS = [(1, 10, "bug", "a ] b", None, 9), (2, 8, None, None, "x", 7), (3, 4, None, None, "first thing", 7), (3, 8, None, None, "second", 7)]


def _replies(s):
    return s.createDataFrame(REPLY, "id int, reply string")


def _items(s):
    return _replies(s).select("id", F.explode(r.review_items("reply")).alias("i")).select("id", "i.line", "i.severity", "i.title", "i.body", "i.confidence")


BLOCKS = [(1, "d" * 100, "v" * 100, "c" * 100, "k" * 100, "s" * 100, "t" * 100), (2, "d" * 100, "v" * 500, "c" * 500, "k" * 500, "s" * 100, "t" * 100), (3, "d" * 900, "v", "c", "k", "s", "t"), (4, "d", None, "", "k", None, "t")]

QUERIES = {
    "X31_audit_severity": lambda s, sf: d.table(s, sf, "events").select("event_id", t.audit_severity(F.expr("element_at(array('critical', 'High', 'moderate', 'low', NULL), CAST(event_id % 5 AS INT) + 1)")).alias("severity")),
    "J7_overlapping_spans": lambda s, sf: x.overlapping(_spans(s, sf), _ranges(s, sf)),
    "J8_contained_spans": lambda s, sf: x.contained(_spans(s, sf), _ranges(s, sf)),
    "J10_J19_T21_callers": lambda s, sf: x.callers(_imports(s, sf), _changed(s, sf)).select("pr_id", "importer", "target", F.array_join("names", ",").alias("names")),
    "J11_T22_callees": lambda s, sf: x.callees(s.createDataFrame([("a.py", "x = load(y) + if (z) + save (q)"), ("b.py", "load(1)")], "path string, text string"), s.createDataFrame([("b.py", "load", 2), ("c.py", "load", 1), ("a.py", "save", 3), ("d.py", "save", 5), ("e.py", "save", 4)], "path string, name string, seq int")),
    "J14_snippets": lambda s, sf: x.snippets(d.files(s, sf).select("path", F.expr("CAST(doc_id % 7 AS INT) AS line")), d.files(s, sf)).select("path", "line", F.md5(F.coalesce("snippet", F.lit("none"))).alias("snippet")),
    "W10_windows": lambda s, sf: x.windows(d.table(s, sf, "orders").selectExpr("concat('f', o_orderkey) AS path", "CAST(o_orderkey % 60 + 1 AS INT) AS start_line", "CAST(o_orderkey % 60 + 3 AS INT) AS end_line", "CAST(o_orderkey % 60 + 3 + o_orderkey % 37 AS INT) AS n_lines")).select("path", "start_line", "end_line"),
    "W11_trimmed": lambda s, sf: x.trimmed(s.createDataFrame(BLOCKS, "id int, diff string, vectors string, callees string, callers string, semantic string, static_tools string"), "diff", F.lit(800)).select("id", *(F.length(c).alias(c) for c in x.DROPPED)),
    "W12_rendered": lambda s, sf: x.rendered(s.createDataFrame([("a", 2, 3)], "path string, start_line int, end_line int"), s.createDataFrame([("a", "x\ny\nz")], "path string, content string")),
    "W13_first_findings": lambda s, sf: x.first_n(d.findings(s, sf), ["path"], 3, "line", "seq").select("path", "line", "seq"),
    "K4_A12_T35_digest": lambda s, sf: x.digest(d.findings(s, sf).withColumn("review_id", F.expr("CAST(substring(path, 2) AS BIGINT) DIV 100"))).select("review_id", F.md5("digest").alias("digest")),
    "T14_json_array": lambda s, sf: _replies(s).select("id", r.json_array("reply").alias("array")),
    "T15_json_object": lambda s, sf: _replies(s).where("id = 7").select("id", r.json_object("reply").alias("object")),
    "T16_T36_review_items": lambda s, sf: _items(s),
    "T18_without_marks": lambda s, sf: s.createDataFrame([("@@ -1 +1 @@\n+ a = 1\n b\n",)], "c string").select(r.without_marks(F.col("c")).alias("code")),
    "T12_secret_lines": lambda s, sf: d.files(s, sf).select("doc_id", F.explode(F.split("content", "\n")).alias("text")).where(r.is_secret_line(F.col("text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    "T29_plain_title": lambda s, sf: s.createDataFrame([("![BUG](https://x.y/z) Title here\nmore",)], "b string").select(F.substring(F.trim(F.regexp_extract(F.regexp_replace("b", r"!\[[A-Z]+\]\([^)]*\)\s*", ""), r"^([^\n]*)", 1)), 1, 80).alias("title")),
    "T31_clipped": lambda s, sf: d.files(s, sf).select("doc_id", F.md5(F.substring("content", 1, 300)).alias("body"), F.substring("path", 1, 60).alias("title")),
}
KEYS = r"list_distinct([b, s, regexp_extract(s, '([^/]*)$', 1)])"
BARE = r"regexp_replace(regexp_replace(regexp_replace({c}, '^[./]+', ''), '\.(?:py|js|jsx|ts|tsx|go|java|rb)$', ''), '/index$', '')"
ORACLE = {
    "X31_audit_severity": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS severity FROM events",
    "J7_overlapping_spans": f"WITH {SPANS} SELECT * FROM sp WHERE EXISTS (SELECT 1 FROM rg WHERE rg.path = sp.path AND start_line <= b AND end_line >= a)",
    "J8_contained_spans": f"WITH {SPANS} SELECT * FROM sp WHERE EXISTS (SELECT 1 FROM rg WHERE rg.path = sp.path AND start_line >= a AND end_line <= b)",
    "J10_J19_T21_callers": f"WITH ch AS (SELECT DISTINCT doc_id % 20 AS pr_id, 'src/mod' || (doc_id % 40) || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '/index.js' END AS path FROM documents), im AS (SELECT pr_id, path, CASE pr_id % 3 WHEN 0 THEN 'src.mod' || pr_id WHEN 1 THEN './mod' || (pr_id + 20) ELSE 'other' END AS name FROM ch), a AS (SELECT *, {BARE.format(c='name')} AS b FROM im), c AS (SELECT *, {BARE.format(c='path')} AS b FROM ch), ak AS (SELECT pr_id, path, unnest({KEYS}) AS k FROM (SELECT *, CASE WHEN contains(b, '/') THEN b ELSE replace(b, '.', '/') END AS s FROM a)), ckk AS (SELECT pr_id, path, unnest({KEYS}) AS k FROM (SELECT *, CASE WHEN contains(b, '/') THEN b ELSE replace(b, '.', '/') END AS s FROM c)) SELECT DISTINCT ak.pr_id, ak.path AS importer, ckk.path AS target, 'f' || ak.pr_id || ',run' AS names FROM ak JOIN ckk ON ak.pr_id = ckk.pr_id AND ak.k = ckk.k AND ak.path <> ckk.path AND ak.k <> ''",
    "J11_T22_callees": _values([("a.py", "load", "c.py"), ("a.py", "save", "e.py"), ("b.py", "load", "c.py")], "path, name, callee_path"),
    "J14_snippets": sql("fl", "SELECT path, CAST(doc_id % 7 AS INTEGER) AS line, md5(coalesce(CASE WHEN doc_id % 7 > 0 THEN trim(string_split(content, chr(10))[doc_id % 7]) END, 'none')) AS snippet FROM fl"),
    "W10_windows": "SELECT 'f' || o_orderkey AS path, CAST(greatest(1, o_orderkey % 60 - 19) AS INTEGER) AS start_line, CAST(o_orderkey % 60 + 3 + least(20, o_orderkey % 37) AS INTEGER) AS end_line FROM orders",
    "W11_trimmed": _values([(1, 100, 100, 100, 100, 100), (2, 0, 0, 500, 100, 100), (3, 0, 0, 0, 0, 0), (4, None, 0, 1, None, 1)], "id, vectors, callees, callers, semantic, static_tools"),
    "W12_rendered": "SELECT 'a' AS path, 2 AS start_line, 3 AS end_line, '   2 | y' || chr(10) || '   3 | z' AS text",
    "W13_first_findings": sql("fd", "SELECT path, line, seq FROM fd QUALIFY row_number() OVER (PARTITION BY path ORDER BY line, seq) <= 3"),
    "K4_A12_T35_digest": sql("fd", "x AS (SELECT *, CAST(substr(path, 2) AS BIGINT) // 100 AS review_id, CASE impact WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS r FROM fd), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY r, line, seq) <= 20) SELECT review_id, md5(string_agg('- ' || path || ':' || line || ' ' || title, chr(10) ORDER BY r, line, seq)) AS digest FROM y GROUP BY 1"),
    "T12_secret_lines": sql("fl", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(content, chr(10))) AS text FROM fl) WHERE regexp_matches(text, {_lit(r.SECRET)}) AND NOT regexp_matches(text, {_lit(r.REFERENCE)}) GROUP BY 1"),
    "T14_json_array": _values([(1, '[ {"line": 10, "severity": "bug", "title": "a ] b", "confidence": 9} ]'), (2, '[{"line": 3, "title": "t", "confidence": 4}, {"line": 0}, {"line": "8", "body": "x", "confidence": "q"}]'), (3, None), (4, None), (5, None), (6, "[]"), (7, "[1]")], 'id, "array"'),
    "T15_json_object": "SELECT 7 AS id, '{\"a\": {\"b\": \"}\"}}' AS object",
    "T16_T36_review_items": _values(ITEMS, "id, line, severity, title, body, confidence"),
    "T18_without_marks": "SELECT 'a = 1' || chr(10) || ' b' || chr(10) AS code",
    "T29_plain_title": "SELECT 'Title here' AS title",
    "T31_clipped": sql("fl", "SELECT doc_id, md5(substr(content, 1, 300)) AS body, substr(path, 1, 60) AS title FROM fl"),
}
