"""Capabilities of models, plans of effort, and whether a wider pass is worth while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults, names of models that reason, plans.
CONTEXT_WINDOW, MAX_OUTPUT = 8192, 2048
REASONING = ("o1", "o3", "thinking", "reasoning", "r1", "claude-opus-4", "claude-3-7")
PLANS = {
    "low": {"run_critic": False, "critic_per_finding": False, "run_holistic": False, "enable_agentic": False, "context_depth": 0, "request_reasoning": False},
    "balanced": {"run_critic": True, "critic_per_finding": False, "run_holistic": True, "enable_agentic": False, "context_depth": 1, "request_reasoning": True},
    "high": {"run_critic": True, "critic_per_finding": True, "run_holistic": True, "enable_agentic": True, "context_depth": 2, "request_reasoning": True},
}
OVERRIDE = "struct<context_window:int,max_output_tokens:int,supports_function_calling:boolean,supports_reasoning:boolean>"


def capabilities(models: DataFrame, known: DataFrame) -> DataFrame:
    """Capability of each model (model, override): an override that parses, else the registry's row, else careful defaults.
    known: model, context_window, max_output_tokens, supports_function_calling."""
    o = F.from_json("override", OVERRIDE)
    valid = F.expr("try_parse_json(override)").isNotNull()
    k = known.select(F.col("model").alias("m"), F.col("context_window").alias("kc"), F.col("max_output_tokens").alias("ko"), F.col("supports_function_calling").alias("kf"))
    rows = models.withColumn("o", F.when(valid, o)).withColumn("valid", valid).join(k, F.col("model") == F.col("m"), "left")
    name = F.lower("model")
    pick = lambda field, other, default: F.when(F.col("valid"), F.coalesce(F.col(f"o.{field}"), F.lit(default))).otherwise(F.coalesce(other, F.lit(default)))
    return rows.select(
        "model", pick("context_window", F.col("kc"), CONTEXT_WINDOW).alias("context_window"), pick("max_output_tokens", F.col("ko"), MAX_OUTPUT).alias("max_output_tokens"),
        pick("supports_function_calling", F.col("kf"), False).alias("supports_function_calling"), pick("supports_reasoning", F.exists(F.array(*(F.lit(x) for x in REASONING)), lambda s: F.contains(name, s)), False).alias("supports_reasoning"),
    )


def plan(level: Column, field: str) -> Column:
    """A field of the plan of a level; unknown levels are balanced."""
    low = F.lower(F.trim(F.coalesce(level, F.lit(""))))
    values = F.create_map(*(x for k, v in PLANS.items() for x in (F.lit(k), F.lit(v[field]))))
    return F.coalesce(F.try_element_at(values, low), F.lit(PLANS["balanced"][field]))


def skips_wider_pass(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """review_id and skipped: without import edges, or with changed functions in fewer than two paths."""
    paths = functions.groupBy("review_id").agg(F.count_distinct("path").alias("paths"))
    linked = edges.groupBy("review_id").agg(F.count(F.lit(1)).alias("edges"))
    return paths.join(linked, "review_id", "left").select("review_id", ((F.coalesce("edges", F.lit(0)) == 0) | (F.col("paths") < 2)).alias("skipped"))


def feedback_points(average: Column) -> Column:
    """What the average quality of a folder adds to a risk."""
    return F.when(average < 35, 10).when(average > 75, -5).otherwise(0)
