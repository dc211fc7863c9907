"""The frontier of a search session: upserts, status, caps and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.ordered import running

CAP = 8


def merge_frontier(existing: DataFrame, new: DataFrame, cap: int | None = CAP) -> DataFrame:
    """existing and new (session, node_id, score, s, recommended_modalities, ord) as one frontier.

    A new item replaces an old one of its node if it scores at least as high; else the old one
    stays and gets the sorted union of the modalities. Then the best `cap` of each session by
    score and start are kept. Ties in order go by age (ord); several new items of one node are
    merged one after the other, so the last of the highest score wins."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = F.struct("score", "_new", "ord")
    key = Window.partitionBy("session", "node_id")
    all_modalities = F.array_sort(F.array_distinct(F.flatten(F.collect_set("recommended_modalities").over(key))))
    rows = rows.withColumn("_best", F.max(best).over(key)).withColumn("_all", all_modalities)
    rows = rows.withColumn("_lower", F.max(F.col("_new")).over(key)).filter(best == F.col("_best"))
    kept_old = (F.col("_new") == 0) & (F.col("_lower") == 1)
    rows = rows.withColumn("recommended_modalities", F.when(kept_old, F.col("_all")).otherwise(F.col("recommended_modalities")))
    rows = rows.drop("_best", "_all", "_lower", "_new")
    if cap is None:
        return rows
    order = Window.partitionBy("session").orderBy(F.desc("score"), F.asc("s"), F.asc("ord"), F.asc("node_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def with_status(frontier: DataFrame, node_id: str | None, status: str) -> DataFrame:
    """frontier with the status of one node set; no node, no change."""
    if not node_id:
        return frontier
    return frontier.withColumn("status", F.when(F.col("node_id") == node_id, status).otherwise(F.col("status")))


def without(frontier: DataFrame, node_id: str | None) -> DataFrame:
    return frontier.filter(F.col("node_id") != node_id) if node_id else frontier


def initial_frontier(found: DataFrame, top_level: DataFrame, cap: int = CAP) -> DataFrame:
    """The best hits of each video; for a video without hits its scenes, with score 0.1, by start."""
    order = Window.partitionBy("video_id").orderBy(F.desc("score"), "s", "node_id")
    best = found.select("video_id", "node_id", "level", "s", "e", "score", F.array("modality").alias("recommended_modalities"))
    none = top_level.join(found.select("video_id").distinct(), "video_id", "left_anti").select(
        "video_id", "node_id", "level", "s", "e", F.lit(0.1).alias("score"), F.array(F.lit("visual"), F.lit("speech")).alias("recommended_modalities")
    )
    return best.unionByName(none).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def topical_index(scenes: DataFrame, n: int = 6, cut: int = 120) -> DataFrame:
    """The beginnings of the first n scene summaries of each video."""
    order = Window.partitionBy("video_id").orderBy("s", "node_id")
    summary = F.when(F.col("visual_summary") != "", F.col("visual_summary")).otherwise(F.col("node_id"))
    rows = scenes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return rows.select("video_id", "rank", F.substring(summary, 1, cut).alias("topic"))


def valid_action(kind: Column, query: Column, modality: Column, node_id: Column, evidence_ids: Column) -> Column:
    """Whether an action has what its kind needs; an unknown kind is not valid."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(kind == "SEARCH", given(query) & given(modality))
        .when(kind == "OPEN", given(node_id) & given(modality))
        .when(kind == "SPLIT", given(node_id))
        .when(kind == "MERGE", F.coalesce(F.size(evidence_ids) > 0, F.lit(False)))
        .when(kind == "STOP", F.lit(True))
        .otherwise(F.lit(False))
    )


def latest_search(actions: DataFrame, question: Column) -> DataFrame:
    """actions (session, step, action_type, query) with the last non-blank search query up to each step,
    the question before the first."""
    query = F.when((F.col("action_type") == "SEARCH") & (F.trim("query") != ""), F.trim("query"))
    rows = running(actions.withColumn("_question", question), "session", ["step"], lasts={"search_query": query})
    return rows.withColumn("search_query", F.coalesce("search_query", "_question")).drop("_question")


def empty_open_stops(steps: DataFrame) -> DataFrame:
    """The step of each session at which two OPENs in a row have found nothing while the ledger holds
    something: (session, step). steps: session, step, action_type, new_evidence."""
    empty = (F.col("action_type") == "OPEN") & (F.col("new_evidence") == 0)
    rows = running(steps.withColumn("_empty", empty), "session", ["step"], sums={"_ledger": F.col("new_evidence")}, previous={"_before": empty})
    return rows.filter(F.col("_empty") & F.col("_before") & (F.col("_ledger") > 0)).groupBy("session").agg(F.min("step").alias("step"))


def budget(steps: DataFrame, max_steps: int) -> DataFrame:
    """steps with the running budget: used, remaining, clips opened, tokens spent."""
    opened = (F.col("action_type") == "OPEN").cast("bigint")
    rows = running(steps, "session", ["step"], sums={"steps_used": F.lit(1).cast("bigint"), "clips_opened": opened, "tokens_spent": F.col("tokens")})
    remaining = F.greatest(F.lit(max_steps) - F.col("steps_used"), F.lit(0))
    return rows.select("session", "step", "steps_used", remaining.alias("steps_remaining"), "clips_opened", "tokens_spent")
