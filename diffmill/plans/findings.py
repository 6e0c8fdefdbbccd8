"""Queries over findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffmill.operators import findings as f
from diffmill.plans import derived as d
from diffmill.plans.derived import sql

COLS = "path, line, seq, impact, certainty, category, title, body, critic_exempt, post_inline"


def _tool(s, sf):
    return d.findings(s, sf).selectExpr("path", "line", "seq", "CASE impact WHEN 'critical' THEN 'ERROR' WHEN 'high' THEN 'warning' WHEN 'medium' THEN 'error' ELSE 'INFO' END AS severity", "CASE seq % 7 WHEN 0 THEN 'a.b.hardcoded-key' WHEN 1 THEN 'x.sqli' WHEN 2 THEN 'x.perf.loop' WHEN 3 THEN NULL ELSE 'lint.rule' END AS check_id", "CASE WHEN seq % 5 = 0 THEN title END AS title")


TOOL = "tl AS (SELECT path, line, seq, CASE impact WHEN 'critical' THEN 'ERROR' WHEN 'high' THEN 'warning' WHEN 'medium' THEN 'error' ELSE 'INFO' END AS severity, CASE seq % 7 WHEN 0 THEN 'a.b.hardcoded-key' WHEN 1 THEN 'x.sqli' WHEN 2 THEN 'x.perf.loop' WHEN 3 THEN NULL ELSE 'lint.rule' END AS check_id, CASE WHEN seq % 5 = 0 THEN title END AS title FROM fd)"


def _lines(s, sf):
    return d.table(s, sf, "orders").selectExpr("concat('f', o_orderkey) AS path", "explode(sequence(1, 3)) AS line")


LINES = "dl AS (SELECT 'f' || o_orderkey AS path, i AS line FROM orders, range(1, 4) t(i))"


def _items(s, sf):
    return d.table(s, sf, "events").selectExpr("event_id", "CASE event_id % 7 WHEN 0 THEN 'BUG' WHEN 1 THEN 'security' WHEN 2 THEN 'warning' WHEN 3 THEN '' WHEN 4 THEN 'informational' WHEN 5 THEN 'odd' END AS severity", "CASE event_id % 13 WHEN 12 THEN 'x' ELSE CAST(event_id % 13 AS STRING) END AS confidence", "CAST(event_id % 9 - 1 AS STRING) AS line", "CASE WHEN event_id % 3 = 0 THEN '  ' ELSE concat(' t', event_id) END AS title", "CASE WHEN event_id % 2 = 0 THEN concat('why ', event_id) END AS body", "CASE WHEN event_id % 4 = 0 THEN 'x = 1' END AS fix")


ITEMS = "it AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'BUG' WHEN 1 THEN 'security' WHEN 2 THEN 'warning' WHEN 3 THEN '' WHEN 4 THEN 'informational' WHEN 5 THEN 'odd' END AS severity, CASE event_id % 13 WHEN 12 THEN NULL ELSE event_id % 13 END AS confidence, event_id % 9 - 1 AS line, CASE WHEN event_id % 3 = 0 THEN 'Issue' ELSE 't' || event_id END AS title, CASE WHEN event_id % 2 = 0 THEN 'why ' || event_id END AS body, CASE WHEN event_id % 4 = 0 THEN 'x = 1' END AS fix FROM events)"
SEV = "CASE WHEN category = 'security' AND impact IN ('critical','high') THEN 'security' WHEN impact = 'critical' THEN 'bug' WHEN impact = 'high' THEN CASE WHEN certainty <> 'speculative' THEN 'bug' ELSE 'warning' END WHEN impact = 'medium' THEN 'warning' WHEN impact = 'low' THEN 'suggestion' ELSE 'informational' END"


def badge_sql(key: str) -> str:
    return f"('![' || upper({key}) || '](https://img.shields.io/badge/' || upper({key}) || '-' || CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in f.BADGE_COLORS.items()) + " END || ')')"


def _bodied(s, sf):
    """Findings of which a part already has a badge in its body."""
    return d.findings(s, sf).withColumn("body", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("see ![WARNING](https://x.y/z) and ![BUG](https://x.y/w) "), "body")).otherwise(F.col("body"))).withColumn("title", F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("title")))


BODIED = "bd AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN 'see ![WARNING](https://x.y/z) and ![BUG](https://x.y/w) ' || body ELSE body END AS body, CASE WHEN seq % 5 = 0 THEN '' ELSE title END AS title) FROM fd)"


def _verdicts(s, sf):
    return d.table(s, sf, "orders").selectExpr("concat('f', o_orderkey) AS path", "explode(array(1, 2, 5)) AS idx", "CASE o_orderkey % 4 WHEN 0 THEN 'DROP' WHEN 1 THEN 'keep' WHEN 2 THEN NULL ELSE 'drop' END AS verdict", "CASE o_orderkey % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'odd' END AS impact", "CASE WHEN o_orderkey % 2 = 0 THEN 'confirmed' END AS certainty")


VERDICTS = "vd AS (SELECT 'f' || o_orderkey AS path, i AS idx, CASE o_orderkey % 4 WHEN 0 THEN 'drop' WHEN 1 THEN 'keep' WHEN 2 THEN 'keep' ELSE 'drop' END AS verdict, CASE o_orderkey % 3 WHEN 0 THEN 'low' END AS vi, CASE WHEN o_orderkey % 2 = 0 THEN 'confirmed' END AS vc FROM orders, (VALUES (1), (2), (5)) t(i))"
DEDUPED = "dd AS (SELECT * FROM fd QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY critic_exempt DESC, CASE impact WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, seq) = 1)"


def _comments(s, sf):
    return f.merged(f.relabel(_bodied(s, sf)))


def _counts(s, sf):
    """Counts by severity of reviews, which are orders by a hundred."""
    return d.findings(s, sf).withColumn("severity", f.severity()).groupBy(F.expr("CAST(substring(path, 2) AS BIGINT) DIV 10 AS review_id"), "severity").agg(F.count(F.lit(1)).alias("n"))


BODIES = {
    1: "![BUG](https://i/b) Null **x**", 2: "**Issues:**\n- ![WARNING](https://i/w) slow\n- ![SECURITY](https://i/s) leak", 3: "**[SUGGESTION]** rename\nmore", 4: "<p><img src='a' alt=\"BUG\"></p>", 5: "plain first\nsecond", 6: "**Issues:**", 7: "", 8: "![bug](https://i/b) **Issues:**\n![Warning](https://i/w)", 9: "**[BUG]** a\n**[INFORMATIONAL]** b",
}
PARSED = {1: ("bug", "Null **x"), 2: ("security", "slow · leak"), 3: ("suggestion", "rename"), 4: ("bug", "bug"), 5: ("suggestion", "plain first"), 6: ("suggestion", ""), 7: ("suggestion", ""), 8: ("bug", "(2 issue(s): bug, warning)"), 9: ("bug", "a · b")}
q = lambda x: "'" + x.replace("'", "''") + "'"

QUERIES = {
    "F10_severity": lambda s, sf: d.findings(s, sf).select("path", "line", "seq", f.severity().alias("severity")),
    "F11_gate": lambda s, sf: f.gate(d.findings(s, sf)).select("path", "line", "seq", "body"),
    "F12_relabel": lambda s, sf: f.relabel(_bodied(s, sf)).select("path", "line", "seq", "body"),
    "F12_relabel_twice": lambda s, sf: f.relabel(f.relabel(_bodied(s, sf))).select("path", "line", "seq", "body"),
    "F13_clamp": lambda s, sf: f.clamp(d.findings(s, sf)).select("path", "line", "seq", "certainty"),
    "F14_J15_verdicts": lambda s, sf: f.apply_verdicts(d.findings(s, sf).withColumn("idx", F.col("line")), _verdicts(s, sf)).select("path", "line", "seq", "impact", "certainty"),
    "F15_F16_T34_legacy_items": lambda s, sf: f.from_legacy(_items(s, sf)).select("event_id", "impact", "category", "certainty", "title"),
    "F17_confident_items": lambda s, sf: f.confident(_items(s, sf)).select("event_id"),
    "F5_on_diff": lambda s, sf: f.on_diff(_tool(s, sf), _lines(s, sf)).select("path", "line", "seq", "critical_bypass"),
    "F8_F9_T33_promoted": lambda s, sf: f.promoted(_tool(s, sf)).select("path", "line", "seq", "impact", "category", "title"),
    "F18_final_lines": lambda s, sf: d.findings(s, sf).join(_lines(s, sf), ["path", "line"], "left_semi").select("path", "line", "seq"),
    "F19_inline_rows": lambda s, sf: _comments(s, sf).where("post_inline").select("path", "line"),
    "W7_U2_rule_dedupe": lambda s, sf: f.rule_dedupe(d.findings(s, sf)).select("path", "line", "seq", "impact", "title"),
    "X32_first_issue": lambda s, sf: f.first_issue(_tool(s, sf).selectExpr("path", "CASE WHEN seq % 11 = 0 THEN NULL ELSE line END AS line", "check_id AS rule_id", "seq")),
    "A8_merged_comments": lambda s, sf: f.merged(d.findings(s, sf).withColumn("body", F.when(F.col("seq") % 9 == 0, " ").otherwise(F.col("body")))),
    "J13_new_findings": lambda s, sf: f.without(d.findings(s, sf).where("seq % 2 = 0"), d.findings(s, sf).where("seq % 2 = 1")).select("path", "line", "seq"),
    "U1_union": lambda s, sf: f.promoted(_tool(s, sf)).select("path", "line", "seq", F.lit("tool").alias("origin")).unionByName(d.findings(s, sf).where("NOT critic_exempt").select("path", "line", "seq", F.lit("model").alias("origin"))),
    "U5_exempt_first": lambda s, sf: d.findings(s, sf).where("critic_exempt").selectExpr("path", "line", "seq", "0 AS part").union(f.gate(d.findings(s, sf).where("NOT critic_exempt")).selectExpr("path", "line", "seq", "1 AS part")),
    "A9_block_policy": lambda s, sf: f.block_policy(_counts(s, sf)),
    "A10_K6_summary": lambda s, sf: f.summary(_comments(s, sf)),
    "A11_counts_by_tool": lambda s, sf: _tool(s, sf).groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths")),
    "A16_T13_F30_comment_severity": lambda s, sf: s.createDataFrame(list(BODIES.items()), "id int, body string").withColumn("s", f.severity_of(F.col("body"))).select("id", "s.severity", "s.title"),
    "T17_structured_body": lambda s, sf: _items(s, sf).select("event_id", f.structured_body(None).alias("body")),
    "T19_count_badge": lambda s, sf: _counts(s, sf).select("review_id", "severity", f.count_badge(F.col("severity"), F.col("n")).alias("badge")),
}
ORACLE = {
    "F10_severity": sql("fd", f"SELECT path, line, seq, {SEV} AS severity FROM fd"),
    "F11_gate": sql("fd", f"SELECT path, line, seq, CASE WHEN NOT critic_exempt AND certainty = 'speculative' AND impact = 'critical' THEN {q(f.UNVERIFIED)} || body ELSE body END AS body FROM fd WHERE critic_exempt OR NOT (impact = 'trivial' OR (certainty = 'speculative' AND impact = 'low'))"),
    "F13_clamp": sql("fd", "SELECT path, line, seq, CASE WHEN certainty = 'speculative' AND category = 'security' THEN 'likely' ELSE certainty END AS certainty FROM fd"),
    "F14_J15_verdicts": sql("fd", f"{VERDICTS} SELECT fd.path, line, seq, CASE WHEN NOT critic_exempt AND vi IS NOT NULL THEN vi ELSE impact END AS impact, CASE WHEN NOT critic_exempt AND vc IS NOT NULL THEN vc ELSE certainty END AS certainty FROM fd LEFT JOIN vd ON vd.path = fd.path AND idx = line WHERE critic_exempt OR category = 'security' OR impact = 'critical' OR coalesce(verdict, 'keep') <> 'drop'"),
    "F15_F16_T34_legacy_items": f"WITH {ITEMS}, x AS (SELECT *, CASE WHEN coalesce(severity, '') = '' THEN 'suggestion' ELSE lower(severity) END AS k, coalesce(confidence, 7) AS c FROM it) SELECT event_id, title, CASE WHEN k IN ('bug','security') THEN 'high' WHEN k = 'warning' THEN 'medium' WHEN k = 'informational' THEN 'trivial' ELSE 'low' END AS impact, CASE WHEN k IN ('bug','warning') THEN 'correctness' WHEN k = 'security' THEN 'security' ELSE 'maintainability' END AS category, CASE WHEN k = 'informational' THEN 'speculative' WHEN c >= 8 THEN 'confirmed' WHEN c >= 7 THEN 'likely' ELSE 'speculative' END AS certainty FROM x",
    "F17_confident_items": f"WITH {ITEMS} SELECT event_id FROM it WHERE coalesce(confidence, 7) >= 5 AND line > 0",
    "F5_on_diff": sql("fd", f"{TOOL}, {LINES} SELECT tl.path, tl.line, seq, dl.path IS NULL AS critical_bypass FROM tl LEFT JOIN dl USING (path, line) WHERE upper(severity) = 'ERROR' OR (dl.path IS NOT NULL AND upper(severity) = 'WARNING')"),
    "F8_F9_T33_promoted": sql("fd", f"{TOOL} SELECT path, line, seq, CASE WHEN seq % 7 = 0 THEN 'critical' ELSE 'high' END AS impact, CASE WHEN seq % 7 IN (0, 1) THEN 'security' WHEN seq % 7 = 2 THEN 'perf' ELSE 'correctness' END AS category, coalesce(title, CASE seq % 7 WHEN 0 THEN 'hardcoded-key' WHEN 1 THEN 'sqli' WHEN 2 THEN 'loop' WHEN 3 THEN '' ELSE 'rule' END) AS title FROM tl WHERE upper(severity) = 'ERROR' OR seq % 7 = 0"),
    "F18_final_lines": sql("fd", f"{LINES} SELECT path, line, seq FROM fd WHERE (path, line) IN (SELECT path, line FROM dl)"),
    "F19_inline_rows": sql("fd", "SELECT path, line FROM fd GROUP BY 1, 2 HAVING bool_or(post_inline)"),
    "W7_U2_rule_dedupe": sql("fd", f"{DEDUPED} SELECT path, line, seq, impact, title FROM dd"),
    "X32_first_issue": sql("fd", f"{TOOL}, x AS (SELECT path, CASE WHEN seq % 11 = 0 THEN NULL ELSE line END AS line, check_id AS rule_id, seq FROM tl) SELECT * FROM x QUALIFY line IS NULL OR row_number() OVER (PARTITION BY path, line, rule_id ORDER BY seq) = 1"),
    "A8_merged_comments": sql("fd", "x AS (SELECT * FROM fd WHERE seq % 9 <> 0) SELECT path, line, CASE WHEN count(*) = 1 THEN any_value(body) ELSE '**Issues:**' || chr(10) || string_agg('- ' || body, chr(10) ORDER BY seq, body) END AS body, bool_or(post_inline) AS post_inline FROM x GROUP BY 1, 2"),
    "J13_new_findings": sql("fd", "SELECT path, line, seq FROM fd a WHERE seq % 2 = 0 AND NOT EXISTS (SELECT 1 FROM fd b WHERE b.seq % 2 = 1 AND a.path = b.path AND a.line = b.line AND a.category = b.category)"),
    "U1_union": sql("fd", f"{TOOL} SELECT path, line, seq, 'tool' AS origin FROM tl WHERE upper(severity) = 'ERROR' OR seq % 7 = 0 UNION ALL SELECT path, line, seq, 'model' FROM fd WHERE NOT critic_exempt"),
    "U5_exempt_first": sql("fd", "SELECT path, line, seq, 0 AS part FROM fd WHERE critic_exempt UNION ALL SELECT path, line, seq, 1 FROM fd WHERE NOT critic_exempt AND NOT (impact = 'trivial' OR (certainty = 'speculative' AND impact = 'low'))"),
    "A9_block_policy": sql("fd", f"c AS (SELECT CAST(substr(path, 2) AS BIGINT) // 10 AS review_id, count(*) FILTER ({SEV} = 'bug') AS b, count(*) FILTER ({SEV} = 'security') AS s, count(*) AS n FROM fd GROUP BY 1) SELECT review_id, b + s >= 1 AS blocked, CASE WHEN b + s >= 1 THEN 'Review found ' || concat_ws(', ', CASE WHEN b > 0 THEN b || ' bug' END, CASE WHEN s > 0 THEN s || ' security' END) || ' issue(s) — merge blocked' ELSE 'Review passed (' || n || ' non-blocking finding(s))' END AS description FROM c"),
    "A11_counts_by_tool": sql("fd", f"{TOOL} SELECT lower(severity) AS severity, count(*) AS n, count(DISTINCT path) AS paths FROM tl GROUP BY 1"),
    "A16_T13_F30_comment_severity": "SELECT CAST(id AS INTEGER) AS id, severity, title FROM (VALUES " + ", ".join(f"({k}, {q(a)}, {q(b)})" for k, (a, b) in PARSED.items()) + ") t(id, severity, title)",
    "T17_structured_body": f"WITH {ITEMS}, x AS (SELECT *, CASE WHEN lower(severity) IN ('bug','security','warning','informational') THEN lower(severity) ELSE 'suggestion' END AS k FROM it) SELECT event_id, {badge_sql('k')} || ' ' || title || CASE WHEN body IS NULL THEN '' ELSE chr(10) || chr(10) || body END || CASE WHEN fix IS NULL THEN '' ELSE chr(10) || chr(10) || '**Suggested fix:**' || chr(10) || chr(10) || '```' || chr(10) || fix || chr(10) || '```' END AS body FROM x",
    "T19_count_badge": sql("fd", f"c AS (SELECT CAST(substr(path, 2) AS BIGINT) // 10 AS review_id, {SEV} AS severity, count(*) AS n FROM fd GROUP BY 1, 2) SELECT review_id, severity, '![' || upper(severity[1]) || severity[2:] || ' ' || n || '](https://img.shields.io/badge/' || upper(severity[1]) || severity[2:] || '-' || n || '-' || CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in f.BADGE_COLORS.items()) + " END || '?style=flat)' AS badge FROM c"),
}
RELABELLED = f"SELECT path, line, seq, CASE WHEN critic_exempt THEN body WHEN seq % 3 = 0 THEN replace(body, '![WARNING](https://x.y/z)', {badge_sql(SEV)}) ELSE {badge_sql(SEV)} || CASE WHEN title <> '' THEN ' ' || title ELSE '' END || chr(10) || chr(10) || body END AS body FROM bd"
ORACLE["F12_relabel"] = ORACLE["F12_relabel_twice"] = sql("fd", f"{BODIED} {RELABELLED}")
