"""Unified diffs as relations: files, hunks, numbered lines, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"


def by_file(diffs: DataFrame) -> DataFrame:
    """pr_id, part, path, diff of each file: cut before each header line; what stands before the first goes. No shuffle."""
    parts = diffs.select("pr_id", F.posexplode(F.split("diff_text", r"(?m)(?=^diff --git )")).alias("part", "diff"))
    path = F.regexp_extract("diff", r"^diff --git a/.* b/([^\n]*)", 1)
    return parts.where(F.startswith("diff", F.lit("diff --git "))).select("pr_id", "part", F.trim(path).alias("path"), "diff")


def hunk_lines(files: DataFrame) -> DataFrame:
    """pr_id, path, line of all new-side lines that hunk headers span, context included."""
    starts = F.regexp_extract_all("diff", F.lit(HUNK), F.lit(1))
    counts = F.regexp_extract_all("diff", F.lit(HUNK), F.lit(2))
    rows = files.select("pr_id", "path", F.explode(F.arrays_zip(starts.alias("s"), counts.alias("c"))).alias("h"))
    rows = rows.select("pr_id", "path", F.col("h.s").cast("int").alias("s"), F.when(F.col("h.c") == "", 1).otherwise(F.expr("try_cast(h.c AS INT)")).alias("c")).where("c > 0")
    return rows.select("pr_id", "path", F.explode(F.expr("sequence(s, s + c - 1)")).alias("line")).distinct()


def numbered(files: DataFrame) -> DataFrame:
    """pr_id, path, pos, mark, text, line of each line of a hunk's body: added and context lines advance the number on the new
    side. Lines that look like file headers and empty lines neither count nor advance."""
    rows = files.select("pr_id", "part", "path", F.posexplode(F.split("diff", "\n")).alias("pos", "raw"))
    start = F.regexp_extract("raw", "^" + HUNK, 1)
    header = start != ""
    file_header = F.startswith("raw", F.lit("+++")) | F.startswith("raw", F.lit("---"))
    mark = F.when(header | file_header, "").otherwise(F.substring("raw", 1, 1))
    rows = rows.withColumns({"start": F.when(header, start.cast("int")), "mark": mark})
    w = Window.partitionBy("pr_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk", F.count("start").over(w)).withColumn("base", F.last("start", True).over(w))
    steps = Window.partitionBy("pr_id", "part", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", F.col("base") + F.coalesce(F.sum(F.when(F.col("mark").isin("+", " "), 1).otherwise(0)).over(steps), F.lit(0)).cast("int"))
    return rows.where("hunk > 0 AND mark IN ('+', ' ', '-')").select("pr_id", "part", "path", "pos", "mark", F.expr("substring(raw, 2)").alias("text"), "line", "hunk")


def added_ranges(lines: DataFrame) -> DataFrame:
    """pr_id, path, start_line, end_line of runs of consecutive added lines."""
    w = Window.partitionBy("pr_id", "path").orderBy("line")
    added = lines.where("mark = '+'").select("pr_id", "path", "line").distinct().withColumn("island", F.col("line") - F.row_number().over(w))
    return added.groupBy("pr_id", "path", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("island")


def annotated(files: DataFrame) -> DataFrame:
    """Diff text with its number at the end of each added line, as a comment of the file's language."""
    rows = files.select("pr_id", "part", "path", F.posexplode(F.split("diff", "\n")).alias("pos", "raw"))
    note = numbered(files).where("mark = '+'").select("pr_id", "part", "pos", "line")
    rows = rows.join(note, ["pr_id", "part", "pos"], "left")
    comment = F.when(F.endswith("path", F.lit(".py")), "  # [L").otherwise("  // [L")
    said = F.when(F.col("line").isNotNull(), F.concat("raw", comment, F.col("line").cast("string"), F.lit("]"))).otherwise(F.col("raw"))
    return rows.groupBy("pr_id", "part", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("t")))), lambda x: x["t"]), "\n").alias("diff"))


def stats(files: DataFrame) -> DataFrame:
    """added, deleted, new_file of each file, by functions over the lines of one row: no shuffle."""
    lines = F.filter(F.split("diff", r"\r\n|[\n\r]"), lambda x: ~(F.startswith(x, F.lit("+++")) | F.startswith(x, F.lit("---"))))
    count = lambda mark: F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(mark))))
    return files.withColumns({"added": count("+"), "deleted": count("-"), "new_file": F.contains(F.lower(F.substring("diff", 1, 200)), F.lit("new file mode"))})


def diff_key(diff: Column) -> Column:
    return F.sha2(F.regexp_replace(diff, r"^\s+|\s+$", ""), 256)


def first_of_equal(files: DataFrame) -> DataFrame:
    """The first file of equal diffs, with the number of files that share it."""
    return files.groupBy(diff_key(F.col("diff")).alias("diff_key")).agg(F.min(F.struct("pr_id", "part", "path")).alias("m"), F.count(F.lit(1)).alias("n")).select("diff_key", "m.pr_id", "m.part", "m.path", "n")


def new_content(files: DataFrame) -> DataFrame:
    """What a diff's new side says: added and context lines without their marks."""
    lines = F.filter(F.split("diff", "\n"), lambda x: (F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))) | F.startswith(x, F.lit(" ")))
    return files.select("pr_id", "part", "path", F.array_join(F.transform(lines, lambda x: F.substring(x, F.lit(2), F.length(x))), "\n").alias("content"))


def old_lines(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """pr_id, path, start_line, end_line, old: deleted lines that an added line of the range follows. Deleted lines wait for the
    first added line of their hunk; context does not clear them. Each deleted line finds the next added one of its hunk by a
    window, and that line's number its range."""
    later = Window.partitionBy("pr_id", "part", "path", "hunk").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    rows = lines.withColumn("heir", F.first(F.when(F.col("mark") == "+", F.col("line")), True).over(later)).where("mark = '-' AND heir IS NOT NULL")
    spans = ranges.select("pr_id", "path", "start_line", "end_line").distinct()
    held = rows.join(spans, ["pr_id", "path"]).where("heir BETWEEN start_line AND end_line")
    old = held.groupBy("pr_id", "path", "start_line", "end_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "text"))), lambda x: x["text"]), "\n").alias("old"))
    return spans.join(old, ["pr_id", "path", "start_line", "end_line"], "left").select("pr_id", "path", "start_line", "end_line", F.coalesce("old", F.lit("")).alias("old"))
