"""Queries over prompts, the chain of a review, signatures, reaction sync, and seams with calls that are the same in each run."""

from __future__ import annotations

import hmac
from hashlib import sha256

from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffmill.operators import findings as f
from diffmill.operators import prompts as p
from diffmill.operators import review as r
from diffmill.plans import derived as d
from diffmill.plans.derived import sql
from diffmill.plans.findings import SEV, TOOL, _tool
from diffmill.sources import seams

SECRET = "a key of the host"


def _tool_rows(s, sf):
    return _tool(s, sf).withColumns({"message": F.concat(F.lit(" m"), "line", F.lit(" ")), "critical_bypass": F.expr("IF(seq % 4 = 0, true, IF(seq % 4 = 1, false, NULL))"), "severity": F.expr("IF(seq % 6 = 0, NULL, severity)")})


def _issue_rows(s, sf):
    return d.findings(s, sf).selectExpr("path", "IF(seq % 11 = 0, NULL, line) AS line", "seq", "IF(seq % 3 = 0, NULL, 'ruff') AS source", "IF(seq % 2 = 0, ' R1 ', '') AS rule_id", "title AS message", "seq % 5 = 0 AS critical_bypass", "IF(seq % 4 = 0, concat(' ', body, ' '), '') AS snippet")


def _named_callers(s, sf):
    return d.findings(s, sf).selectExpr("path", "concat(title, '-', seq) AS target", "IF(seq % 3 = 0, array(), array(impact, category)) AS names")


def _similar(s, sf):
    """Matches of documents with their texts as code, of 1 to many lines."""
    return d.table(s, sf, "documents").selectExpr("doc_id % 50 AS q", "doc_id AS rank", "source AS path", "1 AS start_line", "9 AS end_line", "IF(doc_id % 2 = 0, concat('f', doc_id), '') AS func_name", "rtrim('\n', repeat(concat(lang, '\n'), CAST(doc_id % 40 AS INT) + 1)) AS chunk_text")


def _labelled(s, sf):
    return d.findings(s, sf).selectExpr("path", "seq AS rank", "CASE seq % 4 WHEN 0 THEN 'bug' WHEN 1 THEN 'Security' WHEN 2 THEN '' ELSE 'odd' END AS severity", "CASE seq % 5 WHEN 0 THEN '**Issues:**' WHEN 1 THEN repeat('t', 150) WHEN 2 THEN concat('a\n', title) ELSE title END AS title", "line AS positive", "2 AS negative", "line - 2 AS net")


def _reviewed_inputs(s, sf):
    """Findings of reviews: an order's lines are a review's, dealt out to tools, candidates, clones and the wider pass."""
    rows = d.findings(s, sf).withColumn("review_id", F.expr("CAST(substring(path, 2) AS BIGINT) DIV 7")).withColumn("turn", F.expr("CAST(seq % 5 AS INT)"))
    tools = rows.where("turn = 0").withColumns({"check_id": F.expr("IF(seq % 3 = 0, 'x.secret', 'x.rule')"), "severity": F.expr("IF(seq % 2 = 0, 'ERROR', 'INFO')")}).drop("impact", "certainty", "category")
    tools = tools.withColumns({"impact": F.lit(""), "certainty": F.lit(""), "category": F.lit("")})
    candidates = rows.where("turn IN (1, 2)").withColumn("critic_exempt", F.lit(False))
    verdicts = candidates.selectExpr("review_id", "path", "seq AS idx", "IF(seq % 3 = 0, 'drop', 'keep') AS verdict", "IF(seq % 4 = 0, 'LOW', NULL) AS impact", "CAST(NULL AS STRING) AS certainty")
    clones = rows.where("turn = 3").withColumns({"critic_exempt": F.lit(True), "category": F.lit("design")})
    return tools, candidates, verdicts, clones, rows.where("turn = 4").withColumn("critic_exempt", F.lit(False))


CHAIN = f"""rw AS (SELECT *, CAST(substr(path, 2) AS BIGINT) // 7 AS review_id, seq % 5 AS turn FROM fd),
pr AS (SELECT review_id, path, line, seq - (1::BIGINT << 40) AS seq, CASE WHEN seq % 3 = 0 THEN 'critical' ELSE 'high' END AS impact, 'confirmed' AS certainty, CASE WHEN seq % 3 = 0 THEN 'security' ELSE 'correctness' END AS category, title, body, TRUE AS critic_exempt FROM rw WHERE turn = 0 AND (seq % 2 = 0 OR seq % 3 = 0)),
ca AS (SELECT DISTINCT review_id, path, line, seq, CASE WHEN seq % 4 = 0 THEN 'low' ELSE impact END AS impact, certainty, category, title, body, FALSE AS critic_exempt FROM rw WHERE turn IN (1, 2) AND (seq % 3 <> 0 OR category = 'security' OR impact = 'critical')),
de AS (SELECT * FROM (SELECT * FROM pr UNION ALL SELECT * FROM ca) QUALIFY row_number() OVER (PARTITION BY review_id, path, line ORDER BY critic_exempt DESC, CASE impact WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, seq) = 1),
al AS (SELECT * FROM de UNION ALL SELECT review_id, path, line, seq, impact, certainty, 'design', title, body, TRUE FROM rw WHERE turn = 3),
wi AS (SELECT review_id, path, line, seq, impact, certainty, category, title, body, FALSE AS critic_exempt FROM rw WHERE turn = 4 AND NOT EXISTS (SELECT 1 FROM al WHERE al.review_id = rw.review_id AND al.path = rw.path AND al.line = rw.line AND al.category = rw.category) QUALIFY row_number() OVER (PARTITION BY review_id, path, line ORDER BY CASE impact WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, seq) = 1),
en AS (SELECT * FROM (SELECT * FROM al UNION ALL SELECT * FROM wi) WHERE critic_exempt OR NOT (impact = 'trivial' OR (certainty = 'speculative' AND impact = 'low')))"""


def _clones(s, sf):
    return d.findings(s, sf).selectExpr("CAST(substring(path, 2) AS BIGINT) DIV 20 AS review_id", "concat('c', line) AS clone", "seq", "path", "IF(line = 2, NULL, 'fn') AS name", "line AS start_line", "line + 3 AS end_line").distinct()


CLONES = "cl AS (SELECT DISTINCT CAST(substr(path, 2) AS BIGINT) // 20 AS review_id, 'c' || line AS clone, seq, path, CASE WHEN line = 2 THEN '<anonymous>' ELSE 'fn' END AS name, line AS a, line + 3 AS b FROM fd), ck AS (SELECT *, row_number() OVER w AS at, count(*) OVER (PARTITION BY review_id, clone) AS n FROM cl WINDOW w AS (PARTITION BY review_id, clone ORDER BY seq, path))"


def _sync(s, sf):
    """Reviews of pull requests with reactions to them, from the events."""
    e = d.feedback_events(s, sf)
    reviews = e.selectExpr("review_id AS id", "repo", "pr_number", "IF(review_id % 9 = 0, NULL, review_id + 1000000) AS comment_id", "review_id AS created_at").distinct()
    said = e.where("event_type = 'reaction'").withColumn("content", F.concat(F.lit(" "), F.upper("reaction_content")))
    summary = said.where("event_id % 3 = 0").select("repo", "pr_number", F.expr("IF(event_id % 10 = 0, '', actor)").alias("actor"), "content")
    comments = e.selectExpr("repo", "pr_number", "comment_id", "IF(comment_id % 4 = 0, 'me', 'you') AS user_login", "CASE comment_id % 3 WHEN 0 THEN '![BUG](https://x.y/z) broken' WHEN 1 THEN 'plain' ELSE NULL END AS body").distinct()
    inline = said.where("event_id % 3 = 1").select("comment_id", "actor", "content")
    return r.synced(reviews, summary, comments, inline, e.where("event_id % 6 = 1 AND event_type = 'reaction'"), "me")


SYNC = """rs AS (SELECT repo, pr_number, max(review_id) AS review_id FROM fe GROUP BY 1, 2), rl AS (SELECT * FROM rs WHERE review_id % 9 <> 0),
ow AS (SELECT DISTINCT fe.repo, fe.pr_number, comment_id, rl.review_id FROM fe JOIN rl ON rl.repo = fe.repo AND rl.pr_number = fe.pr_number WHERE comment_id % 4 = 0),
nw AS (SELECT review_id + 1000000 AS comment_id, reaction_content, actor, FALSE AS is_inline, review_id FROM (SELECT rl.review_id, reaction_content, CASE WHEN event_id % 10 = 0 THEN '' ELSE actor END AS actor FROM fe JOIN rl ON rl.repo = fe.repo AND rl.pr_number = fe.pr_number WHERE event_type = 'reaction' AND event_id % 3 = 0)
  UNION ALL SELECT fe.comment_id, reaction_content, actor, TRUE, ow.review_id FROM fe JOIN ow ON ow.comment_id = fe.comment_id WHERE event_type = 'reaction' AND event_id % 3 = 1)"""


def _diffs(s, sf):
    """Requests of documents, with a sha for a part, heads that miss for some."""
    docs = d.table(s, sf, "documents")
    requests = docs.selectExpr("doc_id AS pr_id", "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('b', doc_id) ELSE '' END AS before_sha")
    details = docs.selectExpr("doc_id AS pr_id", "IF(doc_id % 4 = 0, '', concat('h', doc_id)) AS head_sha")
    return r.chosen_diffs(requests, details, docs.selectExpr("doc_id AS pr_id", "concat('full', doc_id) AS diff_text"), docs.selectExpr("concat('b', doc_id) AS base_sha", "concat('h', doc_id) AS head_sha", "concat('delta', doc_id) AS diff_text"))


def _reply(system: str, prompt: str) -> str:
    return f" {system}:{len(prompt)} " if len(prompt) % 3 else ""


def _vectors(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("a"))] for t in texts]


def _agent(s, sf):
    docs = d.table(s, sf, "documents")
    calls = docs.selectExpr("doc_id % 20 AS review_id", "doc_id AS call_id", "element_at(array('get_file', 'get_function', 'get_function', 'other'), CAST(doc_id % 4 AS INT) + 1) AS name", "CASE WHEN doc_id % 9 = 0 THEN 'broken' ELSE concat('{\"path\":\"', IF(doc_id % 5 = 0, 'zz', concat('p', doc_id)), '\",\"name\":\"', IF(doc_id % 8 = 1, 'g', IF(doc_id % 8 = 2, 'line', 'none')), '\"}') END AS arguments")
    files = docs.selectExpr("doc_id % 20 AS review_id", "concat('p', doc_id) AS path", "rtrim('\n', repeat('line\n', CAST(doc_id % 150 AS INT))) AS content")
    functions = docs.selectExpr("doc_id % 20 AS review_id", "concat('p', doc_id) AS path", "'g' AS name", "concat('def g', doc_id) AS text", "doc_id AS seq")
    return seams.tool_results(calls, files, functions)


def _python(s, sf):
    """Python files with two functions, one within a class, and an added range in one of them; some do not parse."""
    docs = d.table(s, sf, "documents")
    files = docs.selectExpr("doc_id AS pr_id", "IF(doc_id % 7 = 0, 'a.go', 'a.py') AS path", "concat('import os\n\ndef one(x):\n    def inner(): pass\n    return x + ', doc_id, '\n\nclass C:\n    @staticmethod\n    def two(y):\n        return y\n', IF(doc_id % 11 = 0, '(', '')) AS content")
    ranges = docs.selectExpr("doc_id AS pr_id", "IF(doc_id % 7 = 0, 'a.go', 'a.py') AS path", "CAST(doc_id % 12 AS INT) AS start_line", "CAST(doc_id % 12 AS INT) AS end_line")
    return seams.changed_functions(files, ranges)


def _listed(s, sf):
    return d.feedback_events(s, sf).select(F.concat(F.lit("l"), "comment_id").alias("listing"), F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, None).otherwise(F.concat(F.lit("b"), "event_id")).alias("body"), F.col("reaction_content").alias("content"), F.struct(F.col("actor").alias("login")).alias("user"))).alias("item"))


WIDER = T.StructType([T.StructField("c_custkey", T.StringType()), T.StructField("c_name", T.StringType()), T.StructField("c_note", T.LongType())])
PROMPTS = "element_at(array('a', '', NULL), CAST(seq % 3 AS INT) + 1)"


def _assembled(s, sf):
    rows = d.findings(s, sf).withColumns({"one": F.expr(PROMPTS), "two": p.described(F.expr("IF(seq % 2 = 0, title, NULL)"), F.expr("IF(seq % 5 = 0, body, '')"))})
    return rows.select("path", "line", "seq", F.md5(p.prompt(F.col("one"), F.col("two"), p.introduced(F.col("path"), F.col("body")))).alias("prompt"))


def _summary_rows(s, sf):
    body = F.concat(F.lit("!["), F.upper(f.severity()), F.lit("](https://x.y/z) "), "title")
    return f.summary(d.findings(s, sf).withColumn("body", body).select("path", "line", "body")).select("path", "rows")


def _hooks(s, sf):
    """Bodies of documents with a signature that is right, wrong, of another key, or missing; keys longer than a block too."""
    rows = d.table(s, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    long = "k" * 100
    header = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("sha256="), r.signature(F.col("body"), "other"))).when(F.col("doc_id") % 5 == 1, None).when(F.col("doc_id") % 5 == 2, r.signature(F.col("body"), SECRET)).otherwise(F.concat(F.lit("sha256="), r.signature(F.col("body"), SECRET)))
    return rows.select("doc_id", r.is_signed(F.col("body"), header, SECRET).alias("signed"), r.signature(F.lit("what do ya want for nothing?"), "Jefe").alias("known"), r.signature(F.lit("x"), long).alias("long"))


REQUESTS = [("Bearer k", "t", None), ("bearer  k ", None, 5), ("Bearer k", None, None), ("Bearer k", "t", 5), ("Bearer z", "t", None), (None, "t", None), ("k", "t", None)]

QUERIES = {
    "T20_scanner_blocks": lambda s, sf: p.scanner_block(_tool_rows(s, sf), "path").select("path", F.md5("text").alias("text")),
    "T20_linter_blocks": lambda s, sf: p.linter_block(_issue_rows(s, sf), "path").select("path", F.md5("text").alias("text")),
    "T20_caller_blocks": lambda s, sf: p.callers_block(_named_callers(s, sf), "path").select("path", F.md5("text").alias("text")),
    "T20_similar_blocks": lambda s, sf: p.similar_block(_similar(s, sf), "q").select("q", F.md5("text").alias("text")),
    "T20_labelled_blocks": lambda s, sf: p.labelled_block(_labelled(s, sf), "path").select("path", F.md5("text").alias("text")),
    "P7_prompts": _assembled,
    "P9_reviewed": lambda s, sf: r.reviewed(*_reviewed_inputs(s, sf)).select("review_id", "path", "line", "seq", "impact", "category", "critic_exempt", F.col("body").contains("![").alias("badged")),
    "T32_duplicate_findings": lambda s, sf: r.duplicate_findings(_clones(s, sf)).select("review_id", "path", "line", "seq", "title", F.md5("body").alias("body")),
    "T25_signatures": _hooks,
    "E5_synced_comments": lambda s, sf: _sync(s, sf)[0].select("comment_id", "review_id", "severity", "title"),
    "E5_synced_events": lambda s, sf: _sync(s, sf)[1].select("comment_id", "reaction_content", "actor", "is_inline", "review_id"),
    "E7_accepted_requests": lambda s, sf: seams.accepted(s.createDataFrame(REQUESTS, "authorization string, github_token string, installation_id int"), "k").select("authorization", "github_token", "installation_id", "status"),
    "S2_chosen_diffs": _diffs,
    "S6_reactions": lambda s, sf: seams.reactions(_listed(s, sf)),
    "S6_review_comments": lambda s, sf: seams.review_comments(_listed(s, sf)),
    "S15_vectors": lambda s, sf: seams.vector_table(d.chunks(s, sf).withColumn("embedding", F.expr("IF(vec_id % 7 = 0, slice(embedding, 1, 3), embedding)")), len(d.chunks(s, sf).first()["embedding"])).select("vec_id", F.round("norm", 5).alias("norm")),
    "S16_evolved": lambda s, sf: seams.evolved(d.table(s, sf, "customer"), WIDER),
    "P3_P6_answered": lambda s, sf: seams.answered(d.table(s, sf, "documents").selectExpr("doc_id", "text AS prompt"), _reply, "sys").select("doc_id", "reply"),
    "P4_embedded": lambda s, sf: seams.embedded(d.table(s, sf, "documents").select("doc_id", "text"), _vectors).selectExpr("doc_id", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y"),
    "P5_tool_results": lambda s, sf: _agent(s, sf).select("review_id", "call_id", F.md5("result").alias("result")),
    "P8_changed_functions": lambda s, sf: _python(s, sf).select("pr_id", "name", "start_line", "end_line", F.md5("text").alias("text")),
    "K6_summary_rows": _summary_rows,
}
_h = lambda key: p.HEADS[key].replace("'", "''")
NL = "chr(10)"
ORACLE = {
    "T20_scanner_blocks": sql("fd", f"{TOOL} SELECT path, md5('{_h('semgrep')}' || {NL} || string_agg('Line ' || line || ': [' || coalesce(check_id, '') || '] m' || line || ' (severity: ' || CASE WHEN seq % 6 = 0 THEN 'WARNING' ELSE severity END || ')' || CASE WHEN seq % 4 = 0 THEN ' [FILE-WIDE]' ELSE '' END, {NL} ORDER BY seq)) AS text FROM tl GROUP BY 1"),
    "T20_linter_blocks": sql("fd", f"SELECT path, md5('{_h('linter')}' || {NL} || string_agg('Line ' || CASE WHEN seq % 11 = 0 THEN '?' ELSE line::VARCHAR END || ' [' || CASE WHEN seq % 3 = 0 THEN 'linter' ELSE 'ruff' END || CASE WHEN seq % 2 = 0 THEN ' / R1' ELSE '' END || ']: ' || title || CASE WHEN seq % 5 = 0 THEN ' [FILE-WIDE]' ELSE '' END || CASE WHEN seq % 4 = 0 THEN {NL} || '  Code:   ' || body ELSE '' END, {NL} ORDER BY seq)) AS text FROM fd GROUP BY 1"),
    "T20_caller_blocks": sql("fd", f"SELECT path, md5('{_h('callers')}' || {NL} || string_agg('- `' || title || '-' || seq || '` — ' || CASE WHEN seq % 3 = 0 THEN 'module was modified (verify imports and call compatibility)' ELSE 'modified symbols: `' || impact || '`, `' || category || '`' END, {NL} ORDER BY title || '-' || seq)) AS text FROM fd GROUP BY 1"),
    "T20_similar_blocks": f"SELECT doc_id % 50 AS q, md5('{_h('similar')}' || {NL} || string_agg('- ' || source || ' (lines 1-9)' || CASE WHEN doc_id % 2 = 0 THEN ', function `f' || doc_id || '`' ELSE '' END || {NL} || '```' || {NL} || rtrim(repeat(lang || {NL}, CAST(least(doc_id % 40 + 1, 30) AS INTEGER)), {NL}) || CASE WHEN doc_id % 40 >= 30 THEN {NL} || '... (truncated)' ELSE '' END || {NL} || '```', {NL} ORDER BY doc_id)) AS text FROM documents GROUP BY 1",
    "T20_labelled_blocks": sql("fd", f"SELECT path, md5('{_h('labelled')}' || {NL} || string_agg('- **Severity:** ' || CASE seq % 4 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Security' WHEN 2 THEN 'Suggestion' ELSE 'Odd' END || ' · **Title:** ' || CASE seq % 5 WHEN 0 THEN '(no extractable title; re-sync reactions to refresh)' WHEN 1 THEN repeat('t', 137) || '...' WHEN 2 THEN 'a ' || title ELSE title END || ' · **Reactions:** ' || line || ' positive, 2 negative (net ' || CASE WHEN line > 2 THEN '+' ELSE '' END || (line - 2) || ')', {NL} ORDER BY seq)) AS text FROM fd GROUP BY 1"),
    "P7_prompts": sql("fd", f"x AS (SELECT *, CASE WHEN seq % 2 = 0 THEN title ELSE '' END AS t, CASE WHEN seq % 5 = 0 THEN body ELSE '' END AS b FROM fd) SELECT path, line, seq, md5(concat_ws({NL} || {NL} || '---' || {NL} || {NL}, CASE WHEN seq % 3 = 0 THEN 'a' END, CASE WHEN t <> '' OR b <> '' THEN 'PR title: ' || t || {NL} || {NL} || 'PR description: ' || b END, 'File: ' || path || {NL} || {NL} || 'Diff (legend: ''-'' = old/removed, ''+'' = new/added). Each added line is annotated with [L<n>] — use that integer as \"line\" in your JSON.' || {NL} || {NL} || body)) AS prompt FROM x"),
    "P9_reviewed": sql("fd", f"{CHAIN} SELECT review_id, path, line, seq, impact, category, critic_exempt, NOT critic_exempt AS badged FROM en"),
    "T32_duplicate_findings": sql("fd", f"{CLONES} SELECT x.review_id, x.path, x.a AS line, x.seq, substr(CASE WHEN x.n = 2 THEN 'Duplicate logic: ' || x.name || ' also defined in ' || min(y.path) FILTER (y.at = 1) ELSE 'Duplicate logic: ' || x.name || ' defined in ' || x.n || ' locations' END, 1, 80) AS title, md5('The function `' || x.name || '` appears to be duplicated across multiple files in this PR:' || {NL} || {NL} || string_agg('  - `' || y.path || '` lines ' || y.a || '–' || y.b, {NL} ORDER BY CASE WHEN y.at = x.at THEN 0 ELSE y.at END) || {NL} || {NL} || 'Consider extracting the shared logic into a utility module to avoid divergence bugs when one copy is updated but others are not.') AS body FROM ck x JOIN ck y ON x.review_id = y.review_id AND x.clone = y.clone WHERE x.at > 1 GROUP BY x.review_id, x.path, x.a, x.seq, x.n, x.name, x.at"),
    "T25_signatures": f"SELECT doc_id, doc_id % 5 IN (3, 4) AS signed, '{hmac.new(b'Jefe', b'what do ya want for nothing?', sha256).hexdigest()}' AS known, '{hmac.new(b'k' * 100, b'x', sha256).hexdigest()}' AS long FROM documents",
    "E5_synced_comments": sql("fe", f"{SYNC} SELECT comment_id, review_id, CASE WHEN comment_id % 3 = 0 THEN 'bug' ELSE 'suggestion' END AS severity, CASE comment_id % 3 WHEN 0 THEN 'broken' WHEN 1 THEN 'plain' END AS title FROM ow"),
    "E5_synced_events": sql("fe", f"{SYNC} SELECT comment_id, reaction_content, actor, bool_and(is_inline) AS is_inline, max(review_id) AS review_id FROM nw WHERE actor <> '' AND reaction_content IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fe s WHERE s.event_type = 'reaction' AND s.event_id % 6 = 1 AND s.comment_id = nw.comment_id AND s.reaction_content = nw.reaction_content AND s.actor = nw.actor) GROUP BY 1, 2, 3"),
    "E7_accepted_requests": "SELECT * FROM (VALUES ('Bearer k', 't', NULL::INTEGER, 202), ('bearer  k ', NULL, 5, 202), ('Bearer k', NULL, NULL, 400), ('Bearer k', 't', 5, 400), ('Bearer z', 't', NULL, 401), (NULL, 't', NULL, 401), ('k', 't', NULL, 401)) t(\"authorization\", github_token, installation_id, status)",
    "S2_chosen_diffs": f"SELECT doc_id AS pr_id, CASE WHEN doc_id % 3 <> 1 THEN 'full' || doc_id WHEN doc_id % 4 <> 0 THEN 'delta' || doc_id END AS diff_text, CASE WHEN doc_id % 3 = 1 AND doc_id % 4 = 0 THEN '{r.MISSING_HEAD}' END AS error FROM documents",
    "S6_reactions": sql("fe", "SELECT 'l' || comment_id AS listing, actor, reaction_content AS content FROM fe"),
    "S6_review_comments": sql("fe", "SELECT 'l' || comment_id AS listing, event_id AS comment_id, actor AS user_login, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'b' || event_id END AS body FROM fe"),
    "S15_vectors": "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings WHERE vec_id % 7 <> 0",
    "S16_evolved": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(NULL AS BIGINT) AS c_note FROM customer",
    "P3_P6_answered": "SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN '' ELSE 'sys:' || length(text) END AS reply FROM documents",
    "P4_embedded": "SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS x, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'a', '')) AS DOUBLE) AS y FROM documents",
    "P5_tool_results": f"""WITH c AS (SELECT doc_id % 20 AS review_id, doc_id AS call_id, doc_id % 150 AS n, CASE WHEN doc_id % 9 = 0 OR doc_id % 5 = 0 THEN '{seams.NOT_THERE}' WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 150 = 0 THEN '[file is empty or unavailable]' ELSE array_to_string(list_transform(range(1, least(doc_id % 150, 120) + 1), lambda i: lpad(i::VARCHAR, 4, ' ') || ' | line'), {NL}) || CASE WHEN doc_id % 150 > 120 THEN {NL} || '... (' || (doc_id % 150 - 120) || ' more lines truncated)' ELSE '' END END
      WHEN doc_id % 4 = 3 THEN '[unknown tool: other]' WHEN doc_id % 8 = 1 THEN 'def g' || doc_id WHEN doc_id % 8 = 2 AND doc_id % 150 > 0 THEN '[function `line` not isolated by AST; showing file head]' || {NL} || array_to_string(list_transform(range(1, least(doc_id % 150, 120) + 1), lambda i: 'line'), {NL}) ELSE '[function `' || CASE WHEN doc_id % 8 = 2 THEN 'line' ELSE 'none' END || '` not found in p' || doc_id || ']' END AS result FROM documents) SELECT review_id, call_id, md5(result) AS result FROM c""",
    "P8_changed_functions": f"SELECT doc_id AS pr_id, CASE WHEN doc_id % 12 < 6 THEN 'one' ELSE 'two' END AS name, CAST(CASE WHEN doc_id % 12 < 6 THEN 3 ELSE 9 END AS INTEGER) AS start_line, CAST(CASE WHEN doc_id % 12 < 6 THEN 5 ELSE 10 END AS INTEGER) AS end_line, md5(CASE WHEN doc_id % 12 < 6 THEN 'def one(x):' || {NL} || '    def inner(): pass' || {NL} || '    return x + ' || doc_id ELSE 'def two(y):' || {NL} || '        return y' END) AS text FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 12 IN (3, 4, 5, 9, 10)",
    "K6_summary_rows": sql("fd", f"SELECT path, string_agg(line || ':' || {SEV}, ',' ORDER BY line, {SEV}, title) AS rows FROM fd GROUP BY 1"),
}
