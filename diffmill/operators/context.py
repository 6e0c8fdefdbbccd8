"""Context of a review: ranges, imports, callees, snippets, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that look like calls and are none; order in which blocks are dropped.
KEYWORDS = ("if", "for", "while", "switch", "return", "catch", "function", "def")
DROPPED = ("vectors", "callees", "callers", "semantic", "static_tools")


def overlapping(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Spans (path, start_line, end_line) that overlap a range of their path: a hash join with the overlap left to test."""
    r = ranges.select("path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    s = spans.alias("s")
    return s.join(r.alias("r"), (F.col("s.path") == F.col("r.path")) & (F.col("s.start_line") <= F.col("r.b")) & (F.col("s.end_line") >= F.col("r.a")), "left_semi")


def contained(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Spans that lie within a range of their path."""
    r = ranges.select("path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    s = spans.alias("s")
    return s.join(r.alias("r"), (F.col("s.path") == F.col("r.path")) & (F.col("s.start_line") >= F.col("r.a")) & (F.col("s.end_line") <= F.col("r.b")), "left_semi")


def import_keys(name: Column) -> Column:
    """Forms under which an import may name a file: without extension and index, dots as slashes, last part alone."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^[./]+", ""), r"\.(?:py|js|jsx|ts|tsx|go|java|rb)$", ""), r"/index$", "")
    slashed = F.when(F.contains(bare, F.lit("/")), bare).otherwise(F.replace(bare, F.lit("."), F.lit("/")))
    return F.array_distinct(F.array(bare, slashed, F.regexp_extract(slashed, r"([^/]*)$", 1)))


def callers(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """importer, target, names: imports (pr_id, path, name, names) that name a changed file (pr_id, path) other than the importer.
    Candidate forms are exploded to keys, so this is an equality join and never all imports with all files."""
    i = imports.select("pr_id", F.col("path").alias("importer"), "names", F.explode(import_keys(F.col("name"))).alias("key")).where("key <> ''")
    c = changed.select("pr_id", F.col("path").alias("target"), F.explode(import_keys(F.col("path"))).alias("key"))
    rows = i.join(c, ["pr_id", "key"]).where("importer <> target")
    return rows.select("pr_id", "importer", "target", F.explode_outer("names").alias("n")).groupBy("pr_id", "importer", "target").agg(F.array_sort(F.collect_set("n")).alias("names"))


def call_names(text: Column) -> Column:
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))
    return F.filter(names, lambda n: ~n.isin(*KEYWORDS))


def callees(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions that added lines (path, text) call in another file: the first path of each (caller path, name)."""
    calls = lines.select("path", F.explode(call_names(F.col("text"))).alias("name")).distinct()
    f = functions.select(F.col("path").alias("callee_path"), "name", "seq")
    return calls.join(f, "name").where("path <> callee_path").groupBy("path", "name").agg(F.min_by("callee_path", "seq").alias("callee_path"))


def snippets(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Issues with the text of their line, null out of bounds. Files are cut into lines only where an issue is."""
    text = files.select("path", F.split("content", "\n").alias("lines"))
    return issues.join(text, "path", "left").withColumn("snippet", F.when(F.col("line") > 0, F.trim(F.try_element_at("lines", F.col("line").cast("int"))))).drop("lines")


def windows(ranges: DataFrame, n_lines: str = "n_lines", around: int = 20) -> DataFrame:
    """Ranges widened on both sides, within the file."""
    return ranges.withColumns({"start_line": F.greatest(F.lit(1), F.col("start_line") - around), "end_line": F.least(F.col(n_lines), F.col("end_line") + around)})


def rendered(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """Numbered lines of each range: number to the width of four, a bar, the text."""
    text = files.select("path", F.split("content", "\n").alias("lines"))
    part = F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    said = F.transform(part, lambda x, i: F.concat(F.lpad((F.col("start_line") + i).cast("string"), 4, " "), F.lit(" | "), x))
    return ranges.join(text, "path").select("path", "start_line", "end_line", F.array_join(said, "\n").alias("text"))


def trimmed(blocks: DataFrame, fixed: str, budget: Column) -> DataFrame:
    """Blocks (one column each) dropped in a fixed order until what is left fits: a block stays if it, what is dropped after it,
    and the fixed part are within the budget. Sums of lengths in one row."""
    out = {}
    for i, name in enumerate(DROPPED):
        rest = sum((F.length(F.coalesce(F.col(n), F.lit(""))) for n in DROPPED[i:]), F.length(F.coalesce(F.col(fixed), F.lit(""))))
        out[name] = F.when(rest <= budget, F.col(name)).otherwise("")
    return blocks.select(*(c for c in blocks.columns if c not in DROPPED), *(v.alias(k) for k, v in out.items()))


def first_n(rows: DataFrame, key: list[str], n: int, *order: str) -> DataFrame:
    """The first n of each key; partial limits run before the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def digest(findings: DataFrame, n: int = 20) -> DataFrame:
    """The worst findings of each review as text: by impact, then line."""
    from diffmill.operators.findings import IMPACTS, rank

    rows = first_n(findings.withColumn("r", rank(F.col("impact"), IMPACTS)), ["review_id"], n, "r", "line", "seq")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "line", "seq", "path", "title"))), lambda x: F.concat(F.lit("- "), x["path"], F.lit(":"), x["line"].cast("string"), F.lit(" "), x["title"]))
    return rows.groupBy("review_id").agg(F.array_join(listed, "\n").alias("digest"))
