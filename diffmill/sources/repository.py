"""Sources and sinks around reviews: exported diffs and files, paged listings, golden cases, result tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BODY, PATHS, DESCRIPTION = 65_535, 500, 140
LOCKFILES = ("package-lock.json", "yarn.lock")


def diffs(spark: SparkSession, folder: str) -> DataFrame:
    """pr_id (file name without its ending) and diff_text of exported diffs, a file a row."""
    rows = spark.read.text(folder, wholetext=True).withColumn("file", F.input_file_name())
    return rows.select(F.regexp_extract("file", r"([^/]*)\.diff$", 1).alias("pr_id"), F.col("value").alias("diff_text"))


def details(raw: DataFrame) -> DataFrame:
    """title, body and head_sha of pull requests as JSON (column doc); what is missing is empty."""
    j = raw.select(F.from_json("doc", "struct<title:string,body:string,head:struct<sha:string>>").alias("j"))
    return j.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in (("j.title", "title"), ("j.body", "body"), ("j.head.sha", "head_sha"))))


def decoded(content: Column) -> Column:
    """Text of a file's base64 content; null if it is no base64 or no UTF-8."""
    return F.try_validate_utf8(F.try_to_binary(content, F.lit("base64")).cast("string"))


def with_lockfiles(paths: DataFrame) -> DataFrame:
    """Paths of each review (pr_id, path), and lock files beside a package file that miss."""
    named = paths.where(F.col("path").rlike(r"(?:^|/)package\.json$"))
    wanted = named.select("pr_id", F.explode(F.array(*(F.regexp_replace("path", r"package\.json$", x) for x in LOCKFILES))).alias("path"))
    return paths.unionByName(wanted.join(paths, ["pr_id", "path"], "left_anti"))


def review_row(body: Column) -> Column:
    """A review's body as the store keeps it."""
    return F.when(F.length(body) > BODY, F.concat(F.substring(body, 1, BODY - 3), F.lit("..."))).otherwise(body)


def review_paths(paths: Column) -> Column:
    return F.slice(paths, 1, PATHS)


def commit_status(policy: DataFrame) -> DataFrame:
    """State and clipped description of each review, from its block policy."""
    return policy.select("review_id", F.when(F.col("blocked"), "failure").otherwise("success").alias("state"), F.substring("description", 1, DESCRIPTION).alias("description"))


def golden(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cases, expected) of golden files: JSON with a sibling diff file; category and categories are both taken."""
    schema = "id string, description string, path string, diff_file string, false_positives array<struct<line:int>>, expected array<struct<line_range:array<int>,category:string,categories:array<string>,min_impact:string,must_find:boolean>>"
    raw = spark.read.schema(schema).json(f"{folder}/*.json", multiLine=True)
    text = spark.read.text(f"{folder}/*.diff", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("diff_file"), F.col("value").alias("diff_text"))
    cases = raw.join(text, "diff_file", "left").select("id", "description", "path", "diff_text", F.coalesce(F.col("false_positives.line"), F.array().cast("array<int>")).alias("false_lines"))
    rows = raw.select("id", F.posexplode("expected").alias("n", "e"))
    return cases, rows.select("id", "n", F.col("e.line_range")[0].alias("first"), F.col("e.line_range")[1].alias("last"), F.coalesce("e.categories", F.array("e.category")).alias("categories"), F.coalesce("e.min_impact", F.lit("low")).alias("min_impact"), F.coalesce("e.must_find", F.lit(False)).alias("must_find"))


class _Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class PagedReader(DataSourceReader):
    """Follows the links of one listing; a listing is a partition, as its pages have an order."""

    def __init__(self, schema, options: dict, fetch: Callable):
        self.schema, self.options, self.fetch = schema, options, fetch

    def partitions(self) -> list[InputPartition]:
        return [_Page(u) for u in json.loads(self.options["urls"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        url: str | None = partition.url
        while url:
            items, url = self.fetch(url)
            yield from ((partition.url, json.dumps(x, sort_keys=True)) for x in items)


def paged_source(fetch: Callable, name: str = "paged") -> type[DataSource]:
    """A data source over paged listings. fetch gives (items, next address or None) for an address: the connector's part."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "listing string, item string"

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(schema, dict(self.options), fetch)

    return Paged
