"""Seams to what lies outside: models, embeddings, hosts, tools of an agent, settings, and tables that grow columns.

A seam takes a function that does the call; what is here is how rows go through it."""

from __future__ import annotations

import ast
import os
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from diffmill.functions.paths import LINE_END

TRIES = 5


class Limited(Exception):
    """A call was refused because there were too many: it may be tried again."""


def patiently(call: Callable, *args, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep):
    """What the call gives; a Limited one is tried again after 1, 2, 4, ... seconds, and the last refusal is raised."""
    for n in range(tries):
        try:
            return call(*args)
        except Limited:
            if n == tries - 1:
                raise
            sleep(2**n)


def answered(prompts: DataFrame, call: Callable[[str, str], str | None], system: str = "", prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """prompts with what the model says to each, stripped; an empty string where it says nothing. Calls run in the tasks."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{reply: [(patiently(call, system, p or "") or "").strip() for p in pdf[prompt]]})

    return prompts.mapInPandas(ask, T.StructType([*prompts.schema.fields, T.StructField(reply, T.StringType())]))


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 64) -> DataFrame:
    """texts with an embedding each, in the order of the texts of a call; a call has batch texts at most. A call that gives
    another number of vectors is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list = []
            values = [v or "" for v in pdf[text]]
            for at in range(0, len(values), batch):
                part = embed(values[at : at + batch])
                if len(part) != len(values[at : at + batch]):
                    raise ValueError(f"{len(part)} vectors for {len(values[at : at + batch])} texts")
                found += part
            yield pdf.assign(embedding=found)

    return texts.mapInPandas(run, T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


FUNCTIONS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("text", T.StringType())]))


def python_functions(source: str | None) -> list[tuple] | None:
    """Outermost functions of Python source, classes walked into; null where it does not parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines, out, left = (source or "").split("\n"), [], [tree]
    while left:
        node = left.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            body = lines[node.lineno - 1 : node.end_lineno]
            out.append((node.name, node.lineno, node.end_lineno, "\n".join([body[0][node.col_offset :], *body[1:]])))
        else:
            left += [n for n in ast.iter_child_nodes(node) if isinstance(n, ast.stmt)]
    return sorted(out, key=lambda f: f[1])


@F.pandas_udf(FUNCTIONS)
def functions_of(source: pd.Series) -> pd.Series:
    return source.map(python_functions)


def changed_functions(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Functions (pr_id, path, name, start_line, end_line, text) of Python files (pr_id, path, content) that an added range
    overlaps; other files have none."""
    python = files.where(F.lower("path").rlike(r"\.pyw?$"))
    found = python.select("pr_id", "path", F.explode(functions_of("content")).alias("f")).select("pr_id", "path", "f.*")
    spans = ranges.select("pr_id", "path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    touched = found.join(spans, ["pr_id", "path"]).where("start_line <= b AND end_line >= a")
    return touched.select(*found.columns).distinct()


#: Lines of a file that an agent sees, and what tools say where there is nothing to show.
FILE_LINES = 120
NOT_THERE = "[not found in PR — only changed files in this pull request are available]"


def _head(content: Column, numbered: bool) -> tuple[Column, Column]:
    lines = F.split(F.regexp_replace(content, f"(?:{LINE_END})\\z", ""), LINE_END)
    shown = F.slice(lines, 1, FILE_LINES)
    return F.array_join(F.transform(shown, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit(" | "), x)) if numbered else shown, "\n"), F.size(lines)


def tool_results(calls: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """What an agent's tools say to calls (review_id, call_id, name, arguments): get_file the head of a changed file with numbers,
    get_function the text of a function of a path by name (the first by seq), else the head of the file if it names it.
    Arguments that do not parse name nothing."""
    a = F.from_json("arguments", "struct<path:string,name:string>")
    rows = calls.select("review_id", "call_id", F.col("name").alias("tool"), F.trim(F.coalesce(a["path"], F.lit(""))).alias("path"), F.trim(F.coalesce(a["name"], F.lit(""))).alias("want"))
    rows = rows.join(files.select("review_id", "path", F.coalesce("content", F.lit("")).alias("content")), ["review_id", "path"], "left")
    best = functions.groupBy("review_id", "path", F.col("name").alias("want")).agg(F.min_by("text", "seq").alias("function"), F.lit(True).alias("known"))
    rows = rows.join(best, ["review_id", "path", "want"], "left")
    numbered, n = _head(F.col("content"), True)
    more = F.when(n > FILE_LINES, F.concat(F.lit("\n... ("), (n - FILE_LINES).cast("string"), F.lit(" more lines truncated)"))).otherwise("")
    named = (
        F.when(F.col("want") == "", "[name is required]").when(F.col("known"), F.when(F.coalesce("function", F.lit("")) == "", "[empty function body]").otherwise(F.col("function")))
        .when(F.contains("content", F.col("want")), F.concat(F.lit("[function `"), "want", F.lit("` not isolated by AST; showing file head]\n"), _head(F.col("content"), False)[0]))
        .otherwise(F.concat(F.lit("[function `"), "want", F.lit("` not found in "), "path", F.lit("]")))
    )
    said = (
        F.when(F.col("content").isNull(), NOT_THERE).when(F.col("tool") == "get_file", F.when(F.col("content") == "", "[file is empty or unavailable]").otherwise(F.concat(numbered, more)))
        .when(F.col("tool") == "get_function", named).otherwise(F.concat(F.lit("[unknown tool: "), "tool", F.lit("]")))
    )
    return rows.select("review_id", "call_id", said.alias("result"))


@dataclass(frozen=True)
class Settings:
    """Settings of a run, each from a variable of its name in upper case, by the type of its default."""

    effort: str = "balanced"
    max_concurrent_files: int = 10
    tool_cache_ttl_hours: int = 24
    vector_top_k: int = 5
    embedding_dimension: int = 768
    llm_request_delay: float = 0.5
    oxlint_enabled: bool = True
    npm_audit_enabled: bool = True
    yarn_audit_enabled: bool = True

    @classmethod
    def read(cls, values: Mapping[str, str] | None = None, prefix: str = "") -> Settings:
        """Values that are missing or empty keep their default; a number that is none is an error that names it."""
        values = os.environ if values is None else values
        found = {}
        for f in fields(cls):
            raw = values.get(f"{prefix}{f.name}".upper(), "").strip()
            if not raw:
                continue
            kind = type(f.default)
            try:
                found[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
            except ValueError as e:
                raise ValueError(f"{f.name}: {raw!r} is no {kind.__name__}") from e
        return cls(**found)


def token(exchange: Callable[[], str | None] | None, static: str | None) -> str:
    """A token by exchange if there is one, else the static one; without both an error."""
    found = exchange() if exchange else static
    if not found:
        raise ValueError("no credentials: neither an exchange nor a token gives one")
    return found


def scalar(rows: DataFrame, column: str) -> str:
    """The one value that is needed of a listing, as a head commit or a login; empty is an error."""
    found = rows.select(column).first()
    if not found or not found[0]:
        raise ValueError(f"{column} is empty")
    return found[0]


_PROVIDERS: dict[str, Callable] = {}


def register(name: str, make: Callable) -> None:
    """Makes a provider known by a name; a name is given once."""
    if name in _PROVIDERS:
        raise ValueError(f"{name} is registered already")
    _PROVIDERS[name] = make


def provider(name: str, *args):
    if name not in _PROVIDERS:
        raise KeyError(f"no provider {name!r}; known: {sorted(_PROVIDERS)}")
    return _PROVIDERS[name](*args)


def posting_sink(post: Callable[[dict], None], name: str = "posting") -> type[DataSource]:
    """A sink that gives each row to post, as comments and states of commits go to a host. A task that runs again posts again,
    so rows should carry a key that the host knows."""

    class Writer(DataSourceWriter):
        def write(self, rows) -> WriterCommitMessage:
            for row in rows:
                patiently(post, row.asDict())
            return WriterCommitMessage()

    class Posting(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Writer()

    return Posting


def reactions(raw: DataFrame) -> DataFrame:
    """listing, actor and content of reactions as listed (listing, item)."""
    j = F.from_json("item", "struct<content:string,user:struct<login:string>>")
    return raw.select("listing", j["user"]["login"].alias("actor"), j["content"].alias("content"))


def review_comments(raw: DataFrame) -> DataFrame:
    """listing, comment_id, user_login and body of inline comments as listed; a missing body is empty."""
    j = F.from_json("item", "struct<id:bigint,body:string,user:struct<login:string>>")
    return raw.select("listing", j["id"].alias("comment_id"), j["user"]["login"].alias("user_login"), F.coalesce(j["body"], F.lit("")).alias("body"))


def evolved(stored: DataFrame, schema: T.StructType) -> DataFrame:
    """A table in a newer schema: columns that it lacks are null, others are read as their new type; further ones stay behind."""
    return stored.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in stored.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def vector_table(rows: DataFrame, dimension: int, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector has the table's dimension, with its length: what a search divides by. Others are not stored."""
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.where(F.size(embedding) == dimension).withColumn("norm", norm)


def accepted(requests: DataFrame, key: str | None) -> DataFrame:
    """Status of review requests (authorization, github_token, installation_id): 401 without the bearer of the key, if there is
    one; 400 unless exactly one kind of credentials is given; else 202."""
    given = F.trim(F.regexp_extract(F.trim(F.coalesce("authorization", F.lit(""))), r"(?is)^bearer\s+(.*)$", 1))
    barred = F.lit(False) if not key else given != key
    one = F.col("installation_id").isNotNull() != (F.coalesce("github_token", F.lit("")) != "")
    return requests.withColumn("status", F.when(barred, 401).when(~one, 400).otherwise(202))
