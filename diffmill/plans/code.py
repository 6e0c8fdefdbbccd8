"""Queries over diffs, clones, vectors and golden cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffmill.functions.paths import diff_points
from diffmill.operators import clones as c
from diffmill.operators import diffs as g
from diffmill.operators import evaluation as v
from diffmill.operators import similarity as m
from diffmill.operators.feedback import upsert
from diffmill.plans import derived as d
from diffmill.plans.derived import sql
from diffmill.tables import spread

MARKS = "element_at(array('+', ' ', '-', '+'), CAST((i + doc_id) % 4 AS INT) + 1)"


def _diffs(s, sf):
    """A diff of one or two files from each document's lines."""
    body = F.expr(f"array_join(transform(split(coalesce(text, ''), '\n'), (x, i) -> concat({MARKS}, x)), '\n')")
    one = F.concat(F.lit("diff --git a/f b/src/f"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".js"), F.lit("\nnew file mode 100644\n--- a/f\n+++ b/f\n@@ -1,2 +"), F.col("doc_id") % 50 + 1, F.when(F.col("doc_id") % 3 == 0, "").otherwise(",4"), F.lit(" @@\n"), body)
    two = F.when(F.col("doc_id") % 4 == 0, F.lit("\ndiff --git a/g b/g.go\n@@ -0,0 +7,0 @@ x\n@@ -3 +9,2 @@\n+added\n ctx\n+++odd\n\n+more")).otherwise("")
    return spread(d.table(s, sf, "documents")).select(F.col("doc_id").alias("pr_id"), F.concat(F.lit("lost text\n"), one, two).alias("diff_text"))


DIFFS = """df0 AS (SELECT doc_id AS pr_id, 'diff --git a/f b/src/f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.js' END || chr(10) || 'new file mode 100644' || chr(10) || '--- a/f' || chr(10) || '+++ b/f' || chr(10) || '@@ -1,2 +' || (doc_id % 50 + 1) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ',4' END || ' @@' || chr(10)
  || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE (i - 1 + doc_id) % 4 WHEN 0 THEN '+' WHEN 1 THEN ' ' WHEN 2 THEN '-' ELSE '+' END || x), chr(10)) AS diff, 'src/f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.js' END AS path, 1 AS part FROM documents),
dfs AS (SELECT pr_id, part, path, CASE WHEN pr_id % 4 = 0 THEN diff || chr(10) ELSE diff END AS diff FROM df0 UNION ALL SELECT pr_id, 2, 'g.go', array_to_string(['diff --git a/g b/g.go', '@@ -0,0 +7,0 @@ x', '@@ -3 +9,2 @@', '+added', ' ctx', '+++odd', '', '+more'], chr(10)) FROM df0 WHERE pr_id % 4 = 0)"""
LINES = """ln AS (SELECT pr_id, part, path, pos - 1 AS pos, raw FROM (SELECT pr_id, part, path, unnest(string_split(diff, chr(10))) AS raw, generate_subscripts(string_split(diff, chr(10)), 1) AS pos FROM dfs)),
st AS (SELECT *, CAST(nullif(regexp_extract(raw, '^@@ -[0-9]+(?:,[0-9]+)? \\+([0-9]+)(?:,[0-9]+)? @@', 1), '') AS INTEGER) AS start, CASE WHEN starts_with(raw, '@@ ') OR starts_with(raw, '+++') OR starts_with(raw, '---') THEN '' ELSE substr(raw, 1, 1) END AS mark FROM ln),
hk AS (SELECT *, count(start) OVER w AS hunk, last_value(start IGNORE NULLS) OVER w AS base FROM st WINDOW w AS (PARTITION BY pr_id, part ORDER BY pos)),
nm AS (SELECT pr_id, part, path, pos, mark, substr(raw, 2) AS text, base + CAST(coalesce(sum(CASE WHEN mark IN ('+', ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id, part, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line, hunk FROM hk),
nb AS (SELECT * FROM nm WHERE hunk > 0 AND mark IN ('+', ' ', '-'))"""


def _chunks(s, sf):
    return spread(d.table(s, sf, "documents")).selectExpr("source AS path", "doc_id AS seq", "coalesce(text, '') AS text")


HASHED = rf"h AS (SELECT source AS path, doc_id AS seq, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS content_hash FROM documents)"
SHINGLES = r"""tk AS (SELECT doc_id AS seq, source AS path, regexp_extract_all(coalesce(text, ''), '[\p{L}_][\p{L}\p{N}_]*|\p{N}+|[^\s\p{L}\p{N}_]') AS t FROM documents),
sh AS (SELECT DISTINCT seq, path, array_to_string(t[i:i+4], chr(1)) AS shingle FROM (SELECT seq, path, t, unnest(range(1, len(t) - 3)) AS i FROM tk WHERE len(t) >= 5))"""
PAIRS = """nn AS (SELECT seq, path, count(*) AS n FROM sh GROUP BY 1, 2), bt AS (SELECT a.seq AS seq_a, b.seq AS seq_b, count(*) AS common FROM sh a JOIN sh b ON a.shingle = b.shingle AND a.seq < b.seq AND a.path <> b.path GROUP BY 1, 2),
pr AS (SELECT seq_a, seq_b, round(common / (x.n + y.n - common), 6) AS jaccard FROM bt JOIN nn x ON x.seq = seq_a JOIN nn y ON y.seq = seq_b WHERE common / (x.n + y.n - common) >= 0.8)"""


def _pairs(s, sf):
    chunks = _chunks(s, sf)
    return c.similar_pairs(c.shingle_sets(chunks), chunks=chunks)


def _near(s, sf, k=5):
    ck = d.chunks(s, sf)
    return m.nearest(ck.where("vec_id % 100 = 0"), ck, k)


COS = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))))"
NEAR = f"nr AS (SELECT q.vec_id AS query_id, c.repo_id, c.vec_id, c.path, c.content_hash, {COS} AS score FROM ck q JOIN ck c ON q.repo_id = c.repo_id AND q.content_hash <> c.content_hash AND q.path <> c.path WHERE q.vec_id % 100 = 0), tp AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM nr QUALIFY rank <= 5)"


def _cases(s, sf):
    found = d.findings(s, sf).selectExpr("CAST(substring(path, 2) AS BIGINT) DIV 8 AS case_id", "seq", "CAST(seq % 5 AS INT) AS run", "line", "category", "impact")
    ids = found.select("case_id").distinct()
    expected = ids.selectExpr("case_id", "explode(array(1, 2)) AS expected_id").selectExpr("case_id", "expected_id", "expected_id AS first", "expected_id + 1 AS last", "IF(expected_id = 1, array('correctness', 'design'), array('security')) AS categories", "IF(case_id % 2 = 0, 'medium', 'critical') AS min_impact")
    return found, expected, ids.selectExpr("case_id", "5 AS line"), ids.selectExpr("case_id", "explode(sequence(0, 4)) AS run")


CASES = """fc AS (SELECT CAST(substr(path, 2) AS BIGINT) // 8 AS case_id, seq, CAST(seq % 5 AS INTEGER) AS run, line, category, impact, CASE impact WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS r FROM fd),
ex AS (SELECT case_id, e AS expected_id, e AS first, e + 1 AS last, CASE WHEN case_id % 2 = 0 THEN 2 ELSE 0 END AS most FROM (SELECT DISTINCT case_id FROM fc), (VALUES (1), (2)) t(e)),
mt AS (SELECT fc.case_id, run, expected_id, seq, line FROM fc JOIN ex ON fc.case_id = ex.case_id AND line BETWEEN first AND last AND ((expected_id = 1 AND category IN ('correctness', 'design')) OR (expected_id = 2 AND category = 'security')) AND r <= most),
rn AS (SELECT case_id, i AS run FROM (SELECT DISTINCT case_id FROM fc), range(5) t(i)),
hi AS (SELECT case_id, run, count(DISTINCT expected_id) AS hits FROM mt GROUP BY 1, 2),
no AS (SELECT case_id, run, count(*) AS noise FROM fc WHERE line <> 5 AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.case_id = fc.case_id AND mt.run = fc.run AND mt.seq = fc.seq) GROUP BY 1, 2),
sd AS (SELECT case_id, run, count(*) AS findings FROM fc GROUP BY 1, 2),
sc AS (SELECT rn.case_id, CAST(rn.run AS INTEGER) AS run, CAST(2 AS BIGINT) AS expected, coalesce(findings, 0) AS findings, coalesce(hits, 0) AS hits, coalesce(noise, 0) AS noise FROM rn LEFT JOIN sd USING (case_id, run) LEFT JOIN hi USING (case_id, run) LEFT JOIN no USING (case_id, run)),
sr AS (SELECT *, expected - hits AS misses, CASE WHEN findings = 0 THEN 0 ELSE hits / findings END AS precision, hits / expected AS recall, CASE WHEN findings = 0 THEN 0 ELSE noise / findings END AS noise_rate FROM sc)"""
_r = lambda df, *cols: df.withColumns({x: F.round(x, 6) for x in cols})


def _scored(s, sf):
    return v.scored(*_cases(s, sf))


QUERIES = {
    "W1_files_of_diffs": lambda s, sf: g.by_file(_diffs(s, sf)).select("pr_id", "part", "path", F.length("diff").alias("chars")),
    "W2_hunk_lines": lambda s, sf: g.hunk_lines(g.by_file(_diffs(s, sf))),
    "W3_added_lines": lambda s, sf: g.numbered(g.by_file(_diffs(s, sf))).where("mark = '+'").select("pr_id", "part", "path", "line", "text"),
    "W4_added_ranges": lambda s, sf: g.added_ranges(g.numbered(g.by_file(_diffs(s, sf)))),
    "W5_T23_old_lines": lambda s, sf: g.old_lines(g.numbered(g.by_file(_diffs(s, sf))), g.added_ranges(g.numbered(g.by_file(_diffs(s, sf))))),
    "W6_annotated_diffs": lambda s, sf: g.annotated(g.by_file(_diffs(s, sf))).select("pr_id", "part", F.sha2("diff", 256).alias("sha")),
    "A13_T5_equal_diffs": lambda s, sf: g.first_of_equal(g.by_file(_diffs(s, sf))),
    "A14_T2_diff_points": lambda s, sf: g.stats(g.by_file(_diffs(s, sf))).select("pr_id", "part", "added", "deleted", "new_file", diff_points(F.col("added"), F.col("deleted"), F.col("new_file")).alias("points")),
    "T27_new_content": lambda s, sf: g.new_content(g.by_file(_diffs(s, sf))).select("pr_id", "part", F.sha2("content", 256).alias("sha")),
    "T4_content_hash": lambda s, sf: _chunks(s, sf).select("seq", c.content_hash(F.col("text")).alias("content_hash")),
    "F24_eligible": lambda s, sf: _chunks(s, sf).select("seq", c.is_eligible(F.col("text")).alias("eligible")),
    "W8_exact_clones": lambda s, sf: c.flagged(_chunks(s, sf).withColumn("content_hash", c.content_hash(F.col("text"))), "content_hash").select("seq", "path", "first_path", "first_seq"),
    "T8_tokens": lambda s, sf: _chunks(s, sf).select("seq", F.size(c.tokens(F.col("text"))).alias("n")),
    "T9_shingles": lambda s, sf: c.shingles(_chunks(s, sf)).groupBy("seq").agg(F.count(F.lit(1)).alias("n")),
    "T11_renamed_clones": lambda s, sf: c.flagged(_chunks(s, sf).withColumn("renamed", c.renamed_hash("text")), "renamed").select("seq", "path", "first_seq"),
    "J12_T10_U4_similar_pairs": lambda s, sf: _r(_pairs(s, sf), "jaccard"),
    "W9_greedy_pairs": lambda s, sf: c.greedy(_pairs(s, sf).withColumn("pr", F.lit(1)), "pr").select("seq_a", "seq_b"),
    "K1_J6_J17_nearest": lambda s, sf: _near(s, sf).select("query_id", "vec_id", "path", "rank", F.round("score", 6).alias("score")),
    "K3_A15_best_matches": lambda s, sf: m.best_matches(_near(s, sf), "repo_id").select("repo_id", "content_hash", "rank", F.round("score", 6).alias("score")),
    "S14_upsert_chunks": lambda s, sf: upsert(d.chunks(s, sf).selectExpr("repo_id", "content_hash", "path", "vec_id AS seq"), d.chunks(s, sf).where("vec_id % 3 = 0").selectExpr("repo_id", "content_hash", "concat('new/', path) AS path", "vec_id AS seq"), ["repo_id", "content_hash"], "seq"),
    "V1_J16_matches": lambda s, sf: v.matches(*_cases(s, sf)[:2]),
    "V2_V3_scores": lambda s, sf: _r(_scored(s, sf), "precision", "recall", "noise_rate"),
    "V4_consistency": lambda s, sf: _r(v.consistency(_scored(s, sf)), "mean_hits", "mean_noise", "flip_rate"),
    "V4_must_find": lambda s, sf: _r(v.must_find(*_cases(s, sf)[:2], _cases(s, sf)[3]), "hit_rate"),
    "V5_rolled_up": lambda s, sf: _r(v.rolled_up(_scored(s, sf)), "precision", "recall", "noise_rate"),
}
HUNKS = r"regexp_extract_all(diff, '@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@', {n})"
ORACLE = {
    "W1_files_of_diffs": f"WITH {DIFFS} SELECT pr_id, part, path, length(diff) AS chars FROM dfs",
    "W2_hunk_lines": f"WITH {DIFFS}, h AS (SELECT pr_id, path, CAST(unnest({HUNKS.format(n=1)}) AS INTEGER) AS s, CAST(coalesce(nullif(unnest({HUNKS.format(n=2)}), ''), '1') AS INTEGER) AS c FROM dfs) SELECT DISTINCT pr_id, path, CAST(unnest(range(s, s + c)) AS INTEGER) AS line FROM h",
    "W3_added_lines": f"WITH {DIFFS}, {LINES} SELECT pr_id, part, path, line, text FROM nb WHERE mark = '+'",
    "W4_added_ranges": f"WITH {DIFFS}, {LINES}, a AS (SELECT DISTINCT pr_id, path, line FROM nb WHERE mark = '+'), i AS (SELECT *, line - row_number() OVER (PARTITION BY pr_id, path ORDER BY line) AS g FROM a) SELECT pr_id, path, min(line) AS start_line, max(line) AS end_line FROM i GROUP BY pr_id, path, g",
    "W6_annotated_diffs": f"WITH {DIFFS}, {LINES} SELECT ln.pr_id, ln.part, sha256(string_agg(raw || CASE WHEN nb.line IS NULL THEN '' ELSE CASE WHEN ends_with(ln.path, '.py') THEN '  # [L' ELSE '  // [L' END || nb.line || ']' END, chr(10) ORDER BY ln.pos)) AS sha FROM ln LEFT JOIN nb ON nb.pr_id = ln.pr_id AND nb.part = ln.part AND nb.pos = ln.pos AND nb.mark = '+' GROUP BY 1, 2",
    "A13_T5_equal_diffs": rf"WITH {DIFFS}, k AS (SELECT *, sha256(regexp_replace(diff, '^\s+|\s+$', '', 'g')) AS diff_key FROM dfs) SELECT diff_key, min(pr_id) AS pr_id, CAST(arg_min(part, pr_id) AS INTEGER) AS part, arg_min(path, pr_id) AS path, count(*) AS n FROM k GROUP BY 1",
    "A14_T2_diff_points": f"WITH {DIFFS}, x AS (SELECT pr_id, part, CAST(len(list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS INTEGER) AS added, CAST(len(list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS INTEGER) AS deleted, contains(lower(substr(diff, 1, 200)), 'new file mode') AS new_file FROM dfs) SELECT *, CAST(CASE WHEN added > 200 THEN 8 WHEN added > 50 THEN 5 WHEN added > 10 THEN 3 ELSE 0 END + CASE WHEN new_file THEN 5 ELSE 0 END + CASE WHEN added + deleted > 0 AND deleted >= 0.8 * (added + deleted) THEN -5 ELSE 0 END AS INTEGER) AS points FROM x",
    "T27_new_content": f"WITH {DIFFS} SELECT pr_id, part, sha256(array_to_string(list_transform(list_filter(string_split(diff, chr(10)), lambda x: (starts_with(x, '+') AND NOT starts_with(x, '+++')) OR starts_with(x, ' ')), lambda x: substr(x, 2)), chr(10))) AS sha FROM dfs",
    "T4_content_hash": f"WITH {HASHED} SELECT seq, content_hash FROM h",
    "F24_eligible": r"SELECT doc_id AS seq, len(string_split(coalesce(text, ''), chr(10))) >= 3 OR len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) >= 20 AS eligible FROM documents",
    "W8_exact_clones": f"WITH {HASHED}, g AS (SELECT content_hash, min(seq) AS first_seq, arg_min(path, seq) AS first_path FROM h GROUP BY 1 HAVING count(DISTINCT path) > 1) SELECT seq, path, first_path, first_seq FROM h JOIN g USING (content_hash) WHERE seq <> first_seq",
    "T8_tokens": f"WITH {SHINGLES} SELECT seq, CAST(len(t) AS INTEGER) AS n FROM tk",
    "T9_shingles": f"WITH {SHINGLES} SELECT seq, count(*) AS n FROM sh GROUP BY 1",
    "W5_T23_old_lines": f"""WITH {DIFFS}, {LINES}, a AS (SELECT DISTINCT pr_id, path, line FROM nb WHERE mark = '+'), i AS (SELECT *, line - row_number() OVER (PARTITION BY pr_id, path ORDER BY line) AS g FROM a),
r AS (SELECT pr_id, path, min(line) AS start_line, max(line) AS end_line FROM i GROUP BY pr_id, path, g),
d AS (SELECT x.*, (SELECT arg_min(y.line, y.pos) FROM nb y WHERE y.pr_id = x.pr_id AND y.part = x.part AND y.hunk = x.hunk AND y.mark = '+' AND y.pos > x.pos) AS heir FROM nb x WHERE mark = '-')
SELECT r.pr_id, r.path, start_line, end_line, coalesce(string_agg(d.text, chr(10) ORDER BY part, pos), '') AS old FROM r LEFT JOIN d ON d.pr_id = r.pr_id AND d.path = r.path AND heir BETWEEN start_line AND end_line GROUP BY 1, 2, 3, 4""",
    "T11_renamed_clones": f"""WITH {SHINGLES}, w AS (SELECT seq, path, pos, tok, min(CASE WHEN regexp_matches(tok, '^[\\p{{L}}_]') THEN pos END) OVER (PARTITION BY seq, tok) AS first FROM (SELECT seq, path, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM tk)),
v AS (SELECT *, count(CASE WHEN first = pos THEN 1 END) OVER (PARTITION BY seq ORDER BY pos) AS n FROM w), nm AS (SELECT x.seq, x.path, x.pos, CASE WHEN x.first IS NULL THEN x.tok ELSE 'v' || (y.n - 1) END AS tok FROM v x LEFT JOIN v y ON y.seq = x.seq AND y.pos = x.first),
h AS (SELECT tk.seq, tk.path, md5(coalesce(string_agg(tok, ' ' ORDER BY pos), '')) AS renamed FROM tk LEFT JOIN nm USING (seq) GROUP BY 1, 2), g AS (SELECT renamed, min(seq) AS first_seq FROM h GROUP BY 1 HAVING count(DISTINCT path) > 1)
SELECT seq, path, first_seq FROM h JOIN g USING (renamed) WHERE seq <> first_seq""",
    "J12_T10_U4_similar_pairs": f"WITH {SHINGLES}, {PAIRS} SELECT * FROM pr",
    "K1_J6_J17_nearest": sql("ck", f"{NEAR} SELECT query_id, vec_id, path, rank, round(score, 6) AS score FROM tp"),
    "K3_A15_best_matches": sql("ck", f"{NEAR}, b AS (SELECT repo_id, content_hash, max(score) AS score FROM tp GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, content_hash) AS INTEGER) AS rank FROM b) SELECT repo_id, content_hash, rank, round(score, 6) AS score FROM k WHERE rank <= 5"),
    "S14_upsert_chunks": sql("ck", "SELECT repo_id, content_hash, CASE WHEN vec_id % 3 = 0 THEN 'new/' || path ELSE path END AS path, vec_id AS seq FROM ck"),
    "V1_J16_matches": sql("fd", f"{CASES} SELECT case_id, run, expected_id, seq FROM mt"),
    "V2_V3_scores": sql("fd", f"{CASES} SELECT case_id, run, expected, findings, hits, noise, misses, round(precision, 6) AS precision, round(recall, 6) AS recall, round(noise_rate, 6) AS noise_rate FROM sr"),
    "V4_consistency": sql("fd", f"{CASES}, mn AS (SELECT case_id, avg(hits) AS mh, avg(noise) AS mo FROM sr GROUP BY 1) SELECT case_id, round(mh, 6) AS mean_hits, round(mo, 6) AS mean_noise, round(avg(CASE WHEN hits <> round_even(mh, 0) THEN 1 ELSE 0 END), 6) AS flip_rate FROM sr JOIN mn USING (case_id) GROUP BY case_id, mh, mo"),
    "V4_must_find": sql("fd", f"{CASES}, f AS (SELECT case_id, expected_id, count(DISTINCT run) AS n FROM mt GROUP BY 1, 2) SELECT ex.case_id, ex.expected_id, round(coalesce(n, 0) / 5, 6) AS hit_rate, coalesce(n, 0) = 5 AS passed FROM ex LEFT JOIN f USING (case_id, expected_id)"),
    "V5_rolled_up": sql("fd", f"{CASES} SELECT round(avg(precision), 6) AS precision, round(avg(noise_rate), 6) AS noise_rate, round(CAST(sum(hits) AS DOUBLE) / sum(expected), 6) AS recall FROM sr"),
}
