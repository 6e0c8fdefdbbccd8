"""Feedback events as a stream: routing, first reactions, last comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.operators.feedback import latest, parsed_command

PAYLOAD = "struct<action:string,before:string,comment:struct<body:string,id:bigint>,pull_request:struct<number:int>,repository:struct<full_name:string>>"


def routed(raw: DataFrame) -> DataFrame:
    """Webhook rows (event, body, signed) with a route: unsigned and broken bodies are refused, unknown events ignored."""
    rows = raw.withColumn("j", F.from_json("body", PAYLOAD))
    broken = F.expr("try_parse_json(body)").isNull()
    action = F.col("j.action")
    route = (
        F.when(~F.coalesce("signed", F.lit(False)), "401").when(broken, "400")
        .when((F.col("event") == "pull_request") & action.isin("opened", "synchronize", "reopened"), "review").when((F.col("event") == "pull_request") & (action == "closed"), "sync")
        .when((F.col("event") == "issue_comment") & action.isin("created", "edited"), "comment").otherwise("ignored")
    )
    return rows.select("event", F.col("j.repository.full_name").alias("repo"), F.col("j.pull_request.number").alias("pr_number"), F.when((F.col("event") == "pull_request") & (action == "synchronize"), F.col("j.before")).alias("before_sha"), F.when(F.col("event") == "issue_comment", parsed_command(F.col("j.comment.body"))).alias("command"), route.alias("route"))


def first_reactions(events: DataFrame, within: str | None = None) -> DataFrame:
    """The first of equal reactions of an actor to a comment. Without a time its state has every key, and it is exact; with one,
    state is dropped once repeats that far apart need no longer be seen. events has created_at as a timestamp."""
    keys = ["comment_id", "reaction_content", "actor"]
    rows = events.where("event_type = 'reaction'")
    return rows.withWatermark("created_at", within).dropDuplicatesWithinWatermark(keys) if within else rows.dropDuplicates(keys)


def keep_latest(spark: SparkSession, path: str, keys: list[str], *order: str):
    """A foreachBatch function that merges each batch into versions of a table: version n is what batch n left, the last row of
    each key by the order given, in whatever order rows arrive. A batch that runs again writes the same version, so a restart
    repeats nothing."""

    def merge(batch: DataFrame, n: int) -> None:
        rows = latest(batch if n == 0 else spark.read.parquet(f"{path}/v={n - 1}").unionByName(batch), keys, *order)
        rows.write.mode("overwrite").parquet(f"{path}/v={n}")

    return merge


def last_version(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """The table as the last batch that the stream committed left it."""
    jvm = spark._jvm
    commits = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in fs.listStatus(commits) if f.getPath().getName().isdigit()]
    return spark.read.parquet(f"{path}/v={max(done)}")


def run_available(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Appends all that is there to a table, and ends."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
