"""Review relations derived from the driver's tables: the same expressions in DataFrame form and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.tables import spread, table

REACTIONS = {"purchase": "+1", "error": "-1", "view": "eyes", "click": "heart"}


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, comment_id, repo, pr_number, actor, event_type, reaction_content, command, is_inline, created_at, event_id."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "ts AS created_at", "event_type AS kind", "user_id * 10 + event_id % 10 AS review_id")
    e = e.withColumn("comment_id", F.expr("review_id * 3 + (event_id DIV 10) % 3"))
    reaction = F.create_map(*(F.lit(x) for pair in REACTIONS.items() for x in pair))
    return e.select(
        "event_id", "review_id", "comment_id", F.expr("concat('r', review_id % 300)").alias("repo"), F.expr("review_id % 50").alias("pr_number"), F.expr("concat('u', event_id % 7)").alias("actor"),
        F.when(F.col("kind") == "signup", "command").otherwise("reaction").alias("event_type"), F.try_element_at(reaction, F.col("kind")).alias("reaction_content"),
        F.expr("CASE WHEN kind = 'signup' THEN if(event_id % 2 = 0, 'helpful', 'not_helpful') END").alias("command"), F.expr("(event_id DIV 10) % 2 = 0").alias("is_inline"), "created_at",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, repo, pr_number, candidate_model of each review that has an event."""
    ids = feedback_events(spark, sf_dir).select("review_id").distinct()
    return ids.selectExpr("review_id AS id", "concat('r', review_id % 300) AS repo", "review_id % 50 AS pr_number", "concat('m', review_id % 4) AS candidate_model")


def review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, path from the paths of pages."""
    return table(spark, sf_dir, "pages").selectExpr("10 * (page_id % 150) + page_id % 10 AS review_id", r"regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path")


def review_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comment_id, review_id, repo, severity, title."""
    ids = feedback_events(spark, sf_dir).select("comment_id", "review_id", "repo").distinct()
    return ids.selectExpr("comment_id", "review_id", "repo", "element_at(array('bug', 'Security', 'warning', 'suggestion', 'informational', 'nit'), CAST(comment_id % 6 AS INT) + 1) AS severity", "concat('title ', comment_id) AS title")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from lineitem: path is the order, line its line number; seq is the input order."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('f', l_orderkey) AS path", "l_linenumber AS line", "l_partkey * 100000 + l_suppkey AS seq",
        "CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 20 THEN 'medium' WHEN l_quantity > 10 THEN 'low' ELSE 'trivial' END AS impact",
        "CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'likely' ELSE 'speculative' END AS certainty",
        "CASE WHEN l_linestatus = 'F' THEN 'security' ELSE 'correctness' END AS category",
        "concat('t', l_partkey) AS title", "concat('body ', l_suppkey) AS body", "l_tax > 0.06 AS critic_exempt", "l_discount < 0.05 AS post_inline",
    ).withColumn("seq", F.expr("seq * 1000 + line"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code chunks with embeddings: repo_id, path, content_hash, embedding, vec_id."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "concat('r', label % 3) AS repo_id", "concat('p', label) AS path", "sha2(CAST(vec_id AS STRING), 256) AS content_hash", "embedding")


EXTENSIONS = ("py", "js", "go", "yml", "json", "env", "tf", "md", "png", "java", "rb", "")
FOLDERS = ("src", "app/auth", "tests", "api/v1", "docs", "lib/controllers", "web/webhook")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of each document, as a file of a repository."""
    ext = F.array(*(F.lit(f".{x}" if x else "") for x in EXTENSIONS))
    folder = F.array(*(F.lit(x) for x in FOLDERS))
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.concat(F.element_at(folder, (F.col("doc_id") % len(FOLDERS) + 1).cast("int")), F.lit("/"), F.col("source"), F.lit("/f"), F.col("doc_id"), F.element_at(ext, (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def _case(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


CTES = {
    "fe": """fe AS (SELECT event_id, user_id * 10 + event_id % 10 AS review_id, (user_id * 10 + event_id % 10) * 3 + (event_id // 10) % 3 AS comment_id,
      'r' || ((user_id * 10 + event_id % 10) % 300) AS repo, (user_id * 10 + event_id % 10) % 50 AS pr_number, 'u' || (event_id % 7) AS actor,
      CASE WHEN event_type = 'signup' THEN 'command' ELSE 'reaction' END AS event_type,
      CASE event_type WHEN 'purchase' THEN '+1' WHEN 'error' THEN '-1' WHEN 'view' THEN 'eyes' WHEN 'click' THEN 'heart' END AS reaction_content,
      CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'helpful' ELSE 'not_helpful' END END AS command, (event_id // 10) % 2 = 0 AS is_inline, ts AS created_at FROM events)""",
    "rv": "rv AS (SELECT DISTINCT review_id AS id, 'r' || (review_id % 300) AS repo, review_id % 50 AS pr_number, 'm' || (review_id % 4) AS candidate_model FROM fe)",
    "rf": "rf AS (SELECT 10 * (page_id % 150) + page_id % 10 AS review_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)",
    "rc": "rc AS (SELECT DISTINCT comment_id, review_id, repo, CASE comment_id % 6 WHEN 0 THEN 'bug' WHEN 1 THEN 'Security' WHEN 2 THEN 'warning' WHEN 3 THEN 'suggestion' WHEN 4 THEN 'informational' ELSE 'nit' END AS severity, 'title ' || comment_id AS title FROM fe)",
    "fd": """fd AS (SELECT 'f' || l_orderkey AS path, l_linenumber AS line, (l_partkey * 100000 + l_suppkey) * 1000 + l_linenumber AS seq,
      CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 20 THEN 'medium' WHEN l_quantity > 10 THEN 'low' ELSE 'trivial' END AS impact,
      CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'likely' ELSE 'speculative' END AS certainty, CASE WHEN l_linestatus = 'F' THEN 'security' ELSE 'correctness' END AS category,
      't' || l_partkey AS title, 'body ' || l_suppkey AS body, l_tax > 0.06 AS critic_exempt, l_discount < 0.05 AS post_inline FROM lineitem)""",
    "ck": "ck AS (SELECT vec_id, 'r' || (label % 3) AS repo_id, 'p' || label AS path, sha256(CAST(vec_id AS VARCHAR)) AS content_hash, embedding FROM embeddings)",
    "fl": f"fl AS (SELECT doc_id, {_case(f'doc_id % {len(FOLDERS)}', FOLDERS)} || '/' || source || '/f' || doc_id || {_case(f'doc_id % {len(EXTENSIONS)}', tuple(f'.{x}' if x else '' for x in EXTENSIONS))} AS path, coalesce(text, '') AS content FROM documents)",
}
#: What each CTE reads of the others.
NEEDS = {"rv": ("fe",), "rc": ("fe",)}


def sql(names: str, query: str) -> str:
    """The query with the CTEs named before it; further CTEs may stand at its start, before a line of SELECT."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [x for x in (*NEEDS.get(name, ()), name) if x not in wanted]
    head = ",\n".join(CTES[x] for x in wanted)
    body = query.strip()
    return f"WITH {head}{',' if not body.upper().startswith('SELECT') else ''}\n{body}"
