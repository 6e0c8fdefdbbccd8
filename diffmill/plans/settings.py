"""Queries over capabilities, plans and combined risk."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from diffmill.functions import paths as p
from diffmill.functions import settings as s_
from diffmill.operators import findings as f
from diffmill.plans import derived as d
from diffmill.plans.derived import sql
from diffmill.plans.findings import SEV
from diffmill.plans.routing import SCORED, _scored

MODELS = [("big-model", None), ("O1-mini", None), ("x", json.dumps({"context_window": 99, "supports_reasoning": True})), ("y-thinking", "{broken"), ("z", "{}")]
KNOWN = [("big-model", 200_000, 64_000, True), ("x", 5, 5, True)]
CAPABLE = [("big-model", 200000, 64000, "true", "false"), ("O1-mini", 8192, 2048, "false", "true"), ("x", 99, 2048, "false", "true"), ("y-thinking", 8192, 2048, "false", "true"), ("z", 8192, 2048, "false", "false")]
LEVELS = "element_at(array('low', ' HIGH ', 'balanced', 'odd', NULL), CAST(event_id % 5 AS INT) + 1)"


def _combined(spark, sf):
    """Risk with a folder's average quality and a sensitive name taken in."""
    rows = _scored(spark, sf).withColumn("average", (F.col("doc_id") % 101).cast("double"))
    name = F.when((F.col("kind") == "code") & p.has_sensitive_name(F.array(F.concat(F.lit("f"), F.col("doc_id")), F.when(F.col("doc_id") % 7 == 0, "verify").otherwise("x"))), 15).otherwise(0)
    return rows.select("doc_id", (F.col("risk") + s_.feedback_points(F.col("average")) + name).cast("int").alias("risk"))


QUERIES = {
    "F26_capabilities": lambda s, sf: s_.capabilities(s.createDataFrame(MODELS, "model string, override string"), s.createDataFrame(KNOWN, "model string, context_window int, max_output_tokens int, supports_function_calling boolean")),
    "F27_plans": lambda s, sf: d.table(s, sf, "events").withColumn("level", F.expr(LEVELS)).select("event_id", s_.plan(F.col("level"), "run_critic").alias("run_critic"), s_.plan(F.col("level"), "context_depth").alias("context_depth"), s_.plan(F.col("level"), "enable_agentic").alias("enable_agentic")),
    "F31_skipped_passes": lambda s, sf: s_.skips_wider_pass(d.table(s, sf, "lineitem").selectExpr("l_suppkey AS review_id", "l_returnflag AS path").where("review_id % 3 > 0 OR path = 'A'"), d.table(s, sf, "lineitem").selectExpr("l_suppkey AS review_id").where("review_id % 4 > 0")),
    "T3_combined_risk": _combined,
    "A10_summary_counts": lambda s, sf: d.findings(s, sf).withColumn("severity", f.severity()).groupBy("path").agg(*(F.count_if(F.col("severity") == x).alias(x) for x in f.SEVERITIES)),
}
ORACLE = {
    "F26_capabilities": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {c}, {x}, {y})" for a, b, c, x, y in CAPABLE) + ") t(model, context_window, max_output_tokens, supports_function_calling, supports_reasoning)",
    "F27_plans": "SELECT event_id, event_id % 5 <> 0 AS run_critic, CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS context_depth, event_id % 5 = 1 AS enable_agentic FROM events",
    "F31_skipped_passes": "WITH fn AS (SELECT l_suppkey AS review_id, l_returnflag AS path FROM lineitem WHERE l_suppkey % 3 > 0 OR l_returnflag = 'A') SELECT review_id, review_id % 4 = 0 OR count(DISTINCT path) < 2 AS skipped FROM fn GROUP BY 1",
    "T3_combined_risk": sql("fl", f"{SCORED} SELECT doc_id, CAST(risk + CASE WHEN doc_id % 101 < 35 THEN 10 WHEN doc_id % 101 > 75 THEN -5 ELSE 0 END + CASE WHEN kind = 'code' AND doc_id % 7 = 0 THEN 15 ELSE 0 END AS INTEGER) AS risk FROM v"),
    "A10_summary_counts": sql("fd", "SELECT path, " + ", ".join(f"count(*) FILTER (({SEV}) = '{x}') AS {x}" for x in f.SEVERITIES) + " FROM fd GROUP BY 1"),
}
