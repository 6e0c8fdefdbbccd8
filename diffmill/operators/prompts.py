"""Blocks of a prompt: findings, issues, callers, similar code and labelled comments as text, in order, a row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.functions.paths import LINE_END
from diffmill.operators.feedback import clipped
from diffmill.operators.findings import is_placeholder

#: Headings of blocks, what is between them, lines of similar code that are shown, and names of severities.
HEADS = {
    "semgrep": "Semgrep findings for this file (consider in your review):",
    "codeql": "CodeQL findings for this file (consider in your review):",
    "linter": "Linter issues on changed lines (consider in your review):",
    "callers": "Other files in this PR import from changed modules below. Check that usages in this file remain compatible with their modifications:",
    "similar": "Similar code elsewhere in this repo (consider for duplication, consistency, or repeated mistakes):",
    "labelled": "Past inline review comments on this repository (each row: severity, title text, reaction signal; calibrate tone and focus from these, do not copy wording):",
    "semantic": "Semantic before/after of changed functions in this file:",
    "callees": "Callee definitions from other files in this PR:",
}
BETWEEN, SHOWN_LINES, TITLE_CHARS = "\n\n---\n\n", 30, 140


def _text(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.trim(F.coalesce(column.cast("string"), F.lit("")))


def _block(rows: DataFrame, keys: tuple[str, ...], said: Column, head: str, order: str) -> DataFrame:
    """keys and text: the heading, and a line or more for each row in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("t")))), lambda x: x["t"])
    return rows.groupBy(*keys).agg(F.concat(F.lit(HEADS[head] + "\n"), F.array_join(lines, "\n")).alias("text"))


def scanner_block(findings: DataFrame, *keys: str, head: str = "semgrep", order: str = "seq") -> DataFrame:
    """Findings (line, message, severity, check_id, critical_bypass) of a scanner."""
    severity = F.when(_text("severity") == "", "WARNING").otherwise(F.col("severity"))
    wide = F.when(F.coalesce("critical_bypass", F.lit(False)), " [FILE-WIDE]").otherwise("")
    said = F.concat(F.lit("Line "), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit(": ["), F.coalesce("check_id", F.lit("")), F.lit("] "), _text("message"), F.lit(" (severity: "), severity, F.lit(")"), wide)
    return _block(findings, keys, said, head, order)


def linter_block(issues: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """Issues (line, source, rule_id, message, critical_bypass, snippet) of linters."""
    source = F.when(_text("source") == "", "linter").otherwise(F.col("source"))
    rule = F.when(_text("rule_id") != "", F.concat(F.lit(" / "), _text("rule_id"))).otherwise("")
    wide = F.when(F.coalesce("critical_bypass", F.lit(False)), " [FILE-WIDE]").otherwise("")
    code = F.when(_text("snippet") != "", F.concat(F.lit("\n  Code:   "), _text("snippet"))).otherwise("")
    said = F.concat(F.lit("Line "), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit(" ["), source, rule, F.lit("]: "), _text("message"), wide, code)
    return _block(issues, keys, said, "linter", order)


def callers_block(callers: DataFrame, *keys: str, order: str = "target") -> DataFrame:
    """Changed modules (target, names) that a file imports."""
    names = F.array_join(F.transform("names", lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")
    what = F.when(F.size(F.coalesce("names", F.array().cast("array<string>"))) > 0, F.concat(F.lit("modified symbols: "), names)).otherwise("module was modified (verify imports and call compatibility)")
    return _block(callers, keys, F.concat(F.lit("- `"), F.coalesce("target", F.lit("?")), F.lit("` — "), what), "callers", order)


def similar_block(matches: DataFrame, *keys: str, order: str = "rank") -> DataFrame:
    """Similar code (path, start_line, end_line, func_name, chunk_text), long pieces cut."""
    name = F.when(F.coalesce("func_name", F.lit("")) != "", F.concat(F.lit(", function `"), "func_name", F.lit("`"))).otherwise("")
    bare = F.regexp_replace("chunk_text", f"(?:{LINE_END})\\z", "")
    lines = F.split(bare, LINE_END)
    code = F.when(F.size(lines) > SHOWN_LINES, F.concat(F.array_join(F.slice(lines, 1, SHOWN_LINES), "\n"), F.lit("\n... (truncated)"))).otherwise(F.col("chunk_text"))
    said = F.concat(F.lit("- "), "path", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"), name, F.lit("\n```\n"), code, F.lit("\n```"))
    return _block(matches, keys, said, "similar", order)


def labelled_block(rows: DataFrame, *keys: str, order: str = "rank") -> DataFrame:
    """Labelled comments (severity, title, positive, negative, net)."""
    key = F.lower(F.when(_text("severity") == "", "suggestion").otherwise(F.col("severity")))
    raw = _text("title")
    title = F.when(is_placeholder(raw), "(no extractable title; re-sync reactions to refresh)").when(raw == "", "(no title)").otherwise(raw)
    title = clipped(F.replace(title, F.lit("\n"), F.lit(" ")), TITLE_CHARS)
    net = F.when(F.col("net") > 0, F.concat(F.lit("+"), F.col("net").cast("string"))).otherwise(F.col("net").cast("string"))
    said = F.concat(F.lit("- **Severity:** "), F.initcap(key), F.lit(" · **Title:** "), title, F.lit(" · **Reactions:** "), F.col("positive").cast("string"), F.lit(" positive, "), F.col("negative").cast("string"), F.lit(" negative (net "), net, F.lit(")"))
    return _block(rows, keys, said, "labelled", order)


def introduced(path: Column, annotated: Column) -> Column:
    """The block of an annotated diff."""
    legend = "Diff (legend: '-' = old/removed, '+' = new/added). Each added line is annotated with [L<n>] — use that integer as \"line\" in your JSON."
    return F.concat(F.lit("File: "), path, F.lit(f"\n\n{legend}\n\n"), annotated)


def described(title: Column, body: Column) -> Column:
    """The block of a review's title and body; empty without both."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    return F.when((t != "") | (b != ""), F.concat(F.lit("PR title: "), t, F.lit("\n\nPR description: "), b)).otherwise("")


def prompt(*blocks: Column) -> Column:
    """The blocks that say something, in order."""
    return F.array_join(F.filter(F.array(*(F.coalesce(b, F.lit("")) for b in blocks)), lambda b: b != ""), BETWEEN)
