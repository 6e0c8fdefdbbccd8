"""Scores of findings against golden cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.operators.findings import IMPACTS, rank


def matches(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, run, expected_id, seq) of findings that an expected row covers: line in range, category, impact high enough.
    A hash join on the case, with the range as what is left to test."""
    f, e = findings.alias("f"), expected.alias("e")
    test = (F.col("f.case_id") == F.col("e.case_id")) & F.col("f.line").between(F.col("e.first"), F.col("e.last")) & F.array_contains("e.categories", F.col("f.category")) & (rank(F.col("f.impact"), IMPACTS) <= rank(F.col("e.min_impact"), IMPACTS))
    return f.join(e, test).select("f.case_id", "f.run", "e.expected_id", "f.seq")


def scored(findings: DataFrame, expected: DataFrame, false_lines: DataFrame, runs: DataFrame) -> DataFrame:
    """case_id, run, expected, findings, hits, misses, noise, precision, recall, noise_rate for each case and run."""
    m = matches(findings, expected)
    hits = m.groupBy("case_id", "run").agg(F.countDistinct("expected_id").alias("hits"))
    loose = findings.join(m, ["case_id", "run", "seq"], "left_anti").join(false_lines, ["case_id", "line"], "left_anti").groupBy("case_id", "run").agg(F.count(F.lit(1)).alias("noise"))
    said = findings.groupBy("case_id", "run").agg(F.count(F.lit(1)).alias("findings"))
    asked = expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("expected"))
    rows = runs.join(asked, "case_id", "left").join(said, ["case_id", "run"], "left").join(hits, ["case_id", "run"], "left").join(loose, ["case_id", "run"], "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return rows.withColumns({"misses": F.col("expected") - F.col("hits"), "precision": ratio("hits", "findings"), "recall": ratio("hits", "expected"), "noise_rate": ratio("noise", "findings")})


def consistency(scores: DataFrame) -> DataFrame:
    """Mean hits and noise of each case, and the share of runs whose hits are not the mean's rounding (half to even)."""
    mean = scores.groupBy("case_id").agg(F.avg("hits").alias("mean_hits"), F.avg("noise").alias("mean_noise"))
    return scores.join(mean, "case_id").groupBy("case_id", "mean_hits", "mean_noise").agg(F.avg((F.col("hits") != F.bround("mean_hits")).cast("int")).alias("flip_rate"))


def must_find(findings: DataFrame, expected: DataFrame, runs: DataFrame) -> DataFrame:
    """Hit rate of each expected row over all runs of its case, and whether it is 100 %."""
    n = runs.groupBy("case_id").agg(F.countDistinct("run").alias("runs"))
    hit = matches(findings, expected).groupBy("case_id", "expected_id").agg(F.countDistinct("run").alias("found"))
    rows = expected.select("case_id", "expected_id").join(n, "case_id").join(hit, ["case_id", "expected_id"], "left").na.fill(0)
    return rows.select("case_id", "expected_id", (F.col("found") / F.col("runs")).alias("hit_rate"), (F.col("found") == F.col("runs")).alias("passed"))


def rolled_up(scores: DataFrame) -> DataFrame:
    """Precision and noise rate as means of each run's own ratios, recall pooled; one row."""
    return scores.agg(F.avg("precision").alias("precision"), F.avg("noise_rate").alias("noise_rate"), F.coalesce(F.try_divide(F.sum("hits"), F.sum("expected")), F.lit(0.0)).alias("recall"))
