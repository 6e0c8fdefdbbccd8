"""Queries over the feedback store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.operators import feedback as f
from diffmill.plans import derived as d
from diffmill.plans.derived import sql

POS, NEG = "reaction_content IN ('+1','heart','hooray','rocket')", "reaction_content IN ('-1','confused')"
PTS = "CASE WHEN event_type = 'command' THEN CASE command WHEN 'helpful' THEN 20 WHEN 'not_helpful' THEN -20 ELSE 0 END ELSE CASE reaction_content WHEN '+1' THEN 15 WHEN '-1' THEN -15 WHEN 'confused' THEN -10 WHEN 'heart' THEN 10 WHEN 'hooray' THEN 10 WHEN 'rocket' THEN 10 WHEN 'laugh' THEN 5 WHEN 'eyes' THEN 5 ELSE 0 END END"
CLAMP = f"CAST(greatest(0, least(100, 50 + coalesce(sum({PTS}), 0))) AS BIGINT)"


def _prefixes(spark, sf: str) -> DataFrame:
    return d.review_files(spark, sf).join(d.reviews(spark, sf).select("id", "repo"), F.col("review_id") == F.col("id")).select("repo", f.parent_dir(F.col("path")).alias("prefix")).distinct()


def _avg(spark, sf: str) -> DataFrame:
    out = f.avg_quality(d.review_files(spark, sf), d.reviews(spark, sf), d.feedback_events(spark, sf), _prefixes(spark, sf))
    return out.withColumn("avg_score", F.round("avg_score", 6))


def _cache(spark, sf: str) -> DataFrame:
    return d.feedback_events(spark, sf).selectExpr("concat('k', event_id % 500) AS cache_key", "event_id AS findings", "created_at", "event_id AS seq")


def _as_of(spark, sf: str):
    return _cache(spark, sf).agg(F.max("created_at").alias("now"))


def _hits(spark, sf: str, kind: str) -> DataFrame:
    now = _cache(spark, sf).crossJoin(F.broadcast(_as_of(spark, sf)))  # one row
    live = f.fresh(now, F.col("now"), 24).select("cache_key").distinct()
    wanted = spark.range(600).selectExpr("concat('k', id) AS cache_key")
    return wanted.join(live, "cache_key", kind)


CACHE = "cache AS (SELECT 'k' || (event_id % 500) AS cache_key, event_id, created_at FROM fe), live AS (SELECT DISTINCT cache_key FROM cache WHERE created_at >= (SELECT max(created_at) FROM cache) - INTERVAL 24 HOURS), wanted AS (SELECT 'k' || i AS cache_key FROM range(600) t(i))"


def _upserted(spark, sf: str) -> DataFrame:
    rows = d.feedback_events(spark, sf).selectExpr("comment_id", "review_id", "upper(concat(' ', coalesce(reaction_content, 'Bug'), ' ')) AS severity", "concat(repeat('t', CAST(event_id % 300 AS INT)), event_id) AS title", "event_id AS seq")
    severity, title = f.comment_row(F.col("severity"), F.col("title"))
    rows = rows.withColumns({"severity": severity, "title": title})
    return f.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["comment_id"], "seq")


QUERIES = {
    "A1_review_quality": lambda s, p: f.quality(d.feedback_events(s, p), "review_id"),
    "A2_pr_quality": lambda s, p: f.quality(d.feedback_events(s, p), "repo", "pr_number"),
    "A3_avg_quality_by_prefix": _avg,
    "A4_repo_summary": lambda s, p: f.repo_summary(d.feedback_events(s, p)),
    "A5_J1_severity_feedback": lambda s, p: f.severity_feedback(d.feedback_events(s, p), d.review_comments(s, p)),
    "A6_J2_model_feedback": lambda s, p: f.model_feedback(d.feedback_events(s, p), d.reviews(s, p)),
    "A7_J3_K2_labelled_examples": lambda s, p: f.top_examples(f.labelled_comments(d.feedback_events(s, p), d.review_comments(s, p))),
    "J4_A17_reviews_under_prefix": lambda s, p: f.reviews_under(d.review_files(s, p), d.reviews(s, p), _prefixes(s, p)),
    "S24_K5_latest_review": lambda s, p: f.latest(d.feedback_events(s, p).select("repo", "pr_number", "review_id", "created_at", "event_id"), ["repo", "pr_number"], "created_at", "event_id").drop("created_at"),
    "S25_events_of_review": lambda s, p: d.feedback_events(s, p).where("review_id = 101").orderBy("created_at", "event_id").selectExpr("event_id", "event_type", "reaction_content", "command"),
    "S11_event_rows": lambda s, p: d.feedback_events(s, p).drop("created_at"),
    "S12_upsert_comments": _upserted,
    "S13_upsert_cache": lambda s, p: f.latest(_cache(s, p).drop("created_at"), ["cache_key"], "seq"),
    "J5_cache_hits": lambda s, p: _hits(s, p, "left_semi"),
    "J5_cache_misses": lambda s, p: _hits(s, p, "left_anti"),
    "E6_fresh_cache": lambda s, p: f.fresh(_cache(s, p).crossJoin(F.broadcast(_as_of(s, p))), F.col("now"), 24).select("cache_key", "seq"),
    "E4_first_reactions": lambda s, p: f.first_reactions(d.feedback_events(s, p)),
    "F28_normal_reaction": lambda s, p: d.table(s, p, "events").select("event_id", f.normal_reaction(F.expr("CASE event_type WHEN 'view' THEN ' Eyes ' WHEN 'click' THEN 'HEART' WHEN 'error' THEN 'thumbs' ELSE NULL END")).alias("reaction")),
    "T24_feedback_command": lambda s, p: d.table(s, p, "events").select("event_id", f.parsed_command(F.expr("CASE event_id % 5 WHEN 0 THEN 'so /feedback good thanks' WHEN 1 THEN '/Feedback NOT-helpful' WHEN 2 THEN '/feedback maybe' WHEN 3 THEN 'feedback good' ELSE NULL END")).alias("command")),
    "F29_own_comments": lambda s, p: f.own_comments(d.feedback_events(s, p).withColumnRenamed("actor", "user_login"), "u3").select("event_id", "user_login"),
    "T30_J18_prior_by_parent": lambda s, p: d.review_files(s, p).join(d.reviews(s, p).select("id", "repo"), F.col("review_id") == F.col("id")).select("repo", "path", f.parent_dir(F.col("path")).alias("prefix")).join(_avg(s, p).select("repo", "prefix", "avg_score"), ["repo", "prefix"], "left").distinct(),
}
UNDER = "px AS (SELECT DISTINCT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS prefix FROM rf JOIN rv ON review_id = id), un AS (SELECT DISTINCT rv.repo, prefix, id FROM rf JOIN rv ON review_id = id JOIN px ON px.repo = rv.repo WHERE prefix <> '' AND (path = rtrim(prefix, '/') OR path LIKE rtrim(prefix, '/') || '/%'))"
AVG = f"{UNDER}, sc AS (SELECT review_id AS id, {CLAMP} AS score FROM fe GROUP BY 1), av AS (SELECT un.repo, prefix, round(avg(coalesce(score, 50)), 6) AS avg_score, count(*) AS n_reviews FROM un LEFT JOIN sc USING (id) GROUP BY 1, 2)"
REACT = f"SELECT repo, comment_id, count(*) FILTER ({POS}) AS positive, count(*) FILTER ({NEG}) AS negative FROM fe WHERE event_type = 'reaction' AND is_inline GROUP BY 1, 2"
ORACLE = {
    "A1_review_quality": sql("fe", f"SELECT review_id, {CLAMP} AS score FROM fe GROUP BY 1"),
    "A2_pr_quality": sql("fe", f"SELECT repo, pr_number, {CLAMP} AS score FROM fe GROUP BY 1, 2"),
    "A3_avg_quality_by_prefix": sql("fe rv rf", f"{AVG} SELECT * FROM av"),
    "A4_repo_summary": sql("fe", f"x AS (SELECT repo, count(*) FILTER (event_type = 'reaction' AND is_inline AND {POS}) AS inline_positive, count(*) FILTER (event_type = 'reaction' AND is_inline AND {NEG}) AS inline_negative, count(*) FILTER (event_type = 'reaction' AND NOT is_inline AND {POS}) AS summary_positive, count(*) FILTER (event_type = 'reaction' AND NOT is_inline AND {NEG}) AS summary_negative, count(*) FILTER (command = 'helpful') AS helpful_commands, count(*) FILTER (command = 'not_helpful') AS not_helpful_commands FROM fe GROUP BY 1) SELECT *, inline_positive + inline_negative + summary_positive + summary_negative + helpful_commands + not_helpful_commands AS total_events FROM x"),
    "A5_J1_severity_feedback": sql("fe rc", f"x AS (SELECT fe.repo, CASE WHEN lower(severity) IN ('bug','security','warning','suggestion','informational') THEN lower(severity) ELSE 'suggestion' END AS severity, CAST(count(*) FILTER ({POS}) AS BIGINT) AS positive, CAST(count(*) FILTER ({NEG}) AS BIGINT) AS negative FROM fe JOIN rc USING (comment_id) WHERE event_type = 'reaction' AND is_inline GROUP BY 1, 2) SELECT *, positive - negative AS net FROM x WHERE positive + negative >= 3"),
    "A6_J2_model_feedback": sql("fe rv", f"x AS (SELECT candidate_model, count(*) FILTER ({POS}) AS positive, count(*) FILTER ({NEG}) AS negative FROM fe JOIN rv ON review_id = id WHERE event_type = 'reaction' AND is_inline GROUP BY 1) SELECT *, positive - negative AS net FROM x WHERE positive + negative > 0"),
    "A7_J3_K2_labelled_examples": sql("fe rc", f"a AS ({REACT}), l AS (SELECT a.repo, comment_id, severity, title, positive, negative, positive - negative AS net FROM a JOIN rc USING (repo, comment_id) WHERE positive + negative > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY positive + negative DESC, abs(net) DESC, comment_id) AS INTEGER) AS rank FROM l) SELECT * FROM r WHERE rank <= 15"),
    "J4_A17_reviews_under_prefix": sql("fe rv rf", f"{UNDER} SELECT * FROM un"),
    "S24_K5_latest_review": sql("fe", "SELECT repo, pr_number, review_id, event_id FROM fe QUALIFY row_number() OVER (PARTITION BY repo, pr_number ORDER BY created_at DESC, event_id DESC) = 1"),
    "S25_events_of_review": sql("fe", "SELECT event_id, event_type, reaction_content, command FROM fe WHERE review_id = 101"),
    "S11_event_rows": sql("fe", "SELECT * EXCLUDE (created_at) FROM fe"),
    "S12_upsert_comments": sql("fe", "u AS (SELECT comment_id, review_id, CASE WHEN lower(trim(coalesce(reaction_content, 'Bug'))) IN ('bug','security','warning','suggestion','informational') THEN lower(trim(coalesce(reaction_content, 'Bug'))) ELSE 'suggestion' END AS severity, repeat('t', CAST(event_id % 300 AS INT)) || event_id AS title, event_id AS seq FROM fe) SELECT comment_id, review_id, severity, CASE WHEN length(title) > 256 THEN substr(title, 1, 253) || '...' ELSE title END AS title, seq FROM u QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY seq % 2 DESC, seq DESC) = 1"),
    "S13_upsert_cache": sql("fe", "SELECT 'k' || (event_id % 500) AS cache_key, max(event_id) AS findings, max(event_id) AS seq FROM fe GROUP BY 1"),
    "J5_cache_hits": sql("fe", f"{CACHE} SELECT cache_key FROM wanted WHERE cache_key IN (SELECT cache_key FROM live)"),
    "J5_cache_misses": sql("fe", f"{CACHE} SELECT cache_key FROM wanted WHERE cache_key NOT IN (SELECT cache_key FROM live)"),
    "E6_fresh_cache": sql("fe", f"{CACHE} SELECT cache_key, event_id AS seq FROM cache WHERE created_at >= (SELECT max(created_at) FROM cache) - INTERVAL 24 HOURS"),
    "E4_first_reactions": sql("fe", "SELECT comment_id, reaction_content, actor, event_id FROM fe WHERE event_type <> 'reaction' UNION ALL (SELECT comment_id, reaction_content, actor, event_id FROM fe WHERE event_type = 'reaction' QUALIFY row_number() OVER (PARTITION BY comment_id, reaction_content, actor ORDER BY created_at, event_id) = 1)"),
    "F28_normal_reaction": "SELECT event_id, CASE event_type WHEN 'view' THEN 'eyes' WHEN 'click' THEN 'heart' END AS reaction FROM events",
    "T24_feedback_command": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'helpful' WHEN 1 THEN 'not_helpful' END AS command FROM events",
    "F29_own_comments": sql("fe", "SELECT event_id, actor AS user_login FROM fe WHERE actor = 'u3'"),
    "T30_J18_prior_by_parent": sql("fe rv rf", f"{AVG} SELECT DISTINCT rv.repo, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS prefix, avg_score FROM rf JOIN rv ON review_id = id LEFT JOIN av ON av.repo = rv.repo AND av.prefix = regexp_extract(path, '^(.*)/[^/]*$', 1)"),
}
