"""Queries over sources and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from diffmill.operators import findings as f
from diffmill.plans import derived as d
from diffmill.plans.derived import sql
from diffmill.plans.findings import ORACLE as FINDINGS
from diffmill.plans.findings import _counts
from diffmill.sources import repository as src
from diffmill.streaming import feedback as st
from diffmill.tables import new_folder

HOOKS = [
    ("pull_request", json.dumps({"action": "opened", "pull_request": {"number": 3}, "repository": {"full_name": "a/b"}}), True), ("pull_request", json.dumps({"action": "synchronize", "before": "abc", "repository": {"full_name": "a/b"}}), True),
    ("pull_request", json.dumps({"action": "closed"}), True), ("issue_comment", json.dumps({"action": "created", "comment": {"body": "/feedback yes"}}), True), ("issue_comment", json.dumps({"action": "deleted"}), True),
    ("push", "{}", True), ("pull_request", "{broken", True), ("pull_request", "{}", False),
]
ROUTES = [("review", "a/b", 3, None, None), ("review", "a/b", None, "abc", None), ("sync", None, None, None, None), ("comment", None, None, None, "helpful"), ("ignored", None, None, None, None), ("ignored", None, None, None, None), ("400", None, None, None, None), ("401", None, None, None, None)]


def _stream(spark, sf: str):
    """The events table as a stream of its files, with timestamps that a watermark takes."""
    folder = new_folder(spark, "stream")
    d.feedback_events(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp")).repartition(4).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    return folder, spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


def _first(spark, sf: str):
    folder, events = _stream(spark, sf)
    st.run_available(st.first_reactions(events).select("comment_id", "reaction_content", "actor"), f"{folder}/state", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out")


def _latest(spark, sf: str):
    folder, events = _stream(spark, sf)
    rows = events.select("comment_id", "review_id", "event_id")
    (rows.writeStream.foreachBatch(st.keep_latest(spark, f"{folder}/table", ["comment_id"], "event_id")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination())
    return st.last_version(spark, f"{folder}/table", f"{folder}/state")


def _lit(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"


QUERIES = {
    "E1_E2_E3_routed_hooks": lambda s, sf: st.routed(s.createDataFrame(HOOKS, "event string, body string, signed boolean")).select("route", "repo", "pr_number", "before_sha", "command"),
    "E4_stream_first_reactions": _first,
    "S12_stream_latest_comments": _latest,
    "S3_details": lambda s, sf: src.details(s.createDataFrame([('{"title": "t", "head": {"sha": "x"}}',), ("broken",)], "doc string")),
    "S4_decoded": lambda s, sf: s.createDataFrame([(1, "aGk="), (2, "//4="), (3, "%%%"), (4, None)], "id int, c string").select("id", src.decoded(F.col("c")).alias("text")),
    "S7_file_contents": lambda s, sf: d.table(s, sf, "documents").where("text IS NOT NULL").selectExpr("doc_id", "length(text) AS n"),
    "S8_lockfiles": lambda s, sf: src.with_lockfiles(s.createDataFrame([(1, "web/package.json"), (1, "web/yarn.lock"), (2, "package.json"), (3, "a.py")], "pr_id int, path string")),
    "S10_review_rows": lambda s, sf: d.table(s, sf, "documents").select("doc_id", F.md5(src.review_row(F.repeat(F.coalesce("text", F.lit("")), 20))).alias("body")),
    "S17_commit_status": lambda s, sf: src.commit_status(f.block_policy(_counts(s, sf))).select("review_id", "state", "description"),
}
ORACLE = {
    "E1_E2_E3_routed_hooks": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in ROUTES) + ") t(route, repo, pr_number, before_sha, command)",
    "E4_stream_first_reactions": sql("fe", "SELECT DISTINCT comment_id, reaction_content, actor FROM fe WHERE event_type = 'reaction'"),
    "S12_stream_latest_comments": sql("fe", "SELECT comment_id, arg_max(review_id, event_id) AS review_id, max(event_id) AS event_id FROM fe GROUP BY 1"),
    "S3_details": "SELECT * FROM (VALUES ('t', '', 'x'), ('', '', '')) t(title, body, head_sha)",
    "S4_decoded": "SELECT * FROM (VALUES (1, 'hi'), (2, NULL), (3, NULL), (4, NULL)) t(id, text)",
    "S7_file_contents": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL",
    "S8_lockfiles": "SELECT * FROM (VALUES (1, 'web/package.json'), (1, 'web/yarn.lock'), (1, 'web/package-lock.json'), (2, 'package.json'), (2, 'package-lock.json'), (2, 'yarn.lock'), (3, 'a.py')) t(pr_id, path)",
    "S10_review_rows": "SELECT doc_id, md5(CASE WHEN length(repeat(coalesce(text, ''), 20)) > 65535 THEN substr(repeat(coalesce(text, ''), 20), 1, 65532) || '...' ELSE repeat(coalesce(text, ''), 20) END) AS body FROM documents",
    "S17_commit_status": f"SELECT review_id, CASE WHEN blocked THEN 'failure' ELSE 'success' END AS state, substr(description, 1, 140) AS description FROM ({FINDINGS['A9_block_policy']})",
}
