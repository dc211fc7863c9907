"""Rubric scores: points per task, means per category and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tasks of each category, and tasks that count as another.
CATEGORIES = {
    "Core Perception Tasks": ["entity_recognition", "event_understanding", "temporal_reasoning", "audio_understanding"],
    "Reasoning Tasks": ["causal_reasoning", "quantitative_reasoning", "compositional_reasoning", "comparative_analysis"],
    "Information Tasks": ["information_retrieval", "summarization", "instruction_extraction", "sentiment_analysis"],
    "Multimodal Tasks": ["multimodal_synthesis", "cross_modal_verification", "audio_visual_alignment"],
}
REMAP = {"motion_analysis": "compositional_reasoning"}


def task_name(task: Column) -> Column:
    known = F.coalesce(task, F.lit("unknown_task"))
    for old, new in REMAP.items():
        known = F.when(known == old, new).otherwise(known)
    return known


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, c) for c, ts in CATEGORIES.items() for t in ts], "task string, category string")


def sample_points(criteria: DataFrame) -> DataFrame:
    """criteria (sample_id, task, weight, is_penalty, criteria_met) to (sample_id, task, obtained, maximum):
    met weights that are no penalty; all positive weights. Nulls: not met, no penalty, weight 0."""
    weight = F.coalesce("weight", F.lit(0.0))
    met = F.coalesce("criteria_met", F.lit(False)) & ~F.coalesce("is_penalty", F.lit(False))
    return criteria.groupBy("sample_id", task_name(F.col("task")).alias("task")).agg(
        F.sum(F.when(met, weight).otherwise(0.0)).alias("obtained"), F.sum(F.when(weight > 0, weight).otherwise(0.0)).alias("maximum")
    )


def task_scores(points: DataFrame) -> DataFrame:
    """(task, accuracy, samples): pooled over the samples, 0 without positive weights."""
    total = points.groupBy("task").agg(F.sum("obtained").alias("_o"), F.sum("maximum").alias("_m"), F.count(F.lit(1)).alias("samples"))
    return total.select("task", F.when(F.col("_m") > 0, F.col("_o") / F.col("_m")).otherwise(0.0).alias("accuracy"), "samples")


def category_scores(tasks: DataFrame, of: DataFrame) -> DataFrame:
    """The mean over the tasks of a category that occur; tasks of no category count in none."""
    return tasks.join(of, "task").groupBy("category").agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("tasks"))


def overall_score(by_category: DataFrame) -> DataFrame:
    return by_category.agg(F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("categories"))


def criteria_met(response: Column) -> Column:
    """The verdict in a judge's response: strict JSON, fenced JSON, the field in any text, or the words
    true or false beside its name; null if it cannot be read."""
    read = lambda c: F.from_json(c, "criteria_met boolean")["criteria_met"]
    text = F.trim(response)
    lower = F.lower(text)
    field = F.lower(F.regexp_extract(text, r'(?i)"criteria_met"\s*:\s*(true|false)', 1))
    loose = F.when(F.contains(lower, F.lit("true")), True).when(F.contains(lower, F.lit("false")), False)
    return F.coalesce(
        F.when(text.startswith("{"), read(text)),
        read(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))),
        F.when(field != "", field == "true"),
        F.when(F.contains(lower, F.lit("criteria_met")), loose),
    )


def report_lines(tasks: DataFrame, of: DataFrame) -> DataFrame:
    """The lines of a text report: categories with their mean, then their tasks, in fixed order."""
    by = category_scores(tasks, of)
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    head = by.select(order.alias("_c"), F.lit("").alias("_t"), F.format_string("%s: %.2f%%", "category", F.col("accuracy") * 100).alias("line"))
    body = tasks.join(of, "task").select(order.alias("_c"), F.col("task").alias("_t"), F.format_string("  %s: %.2f%% (%d samples)", "task", F.col("accuracy") * 100, "samples").alias("line"))
    return head.unionByName(body).orderBy("_c", "_t").select("line")
