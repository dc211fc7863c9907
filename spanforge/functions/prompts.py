"""Prompts as column expressions, in our own words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chunk lengths that a system prompt lists; of more, only the number of the rest is told.
LISTED_CHUNKS = 100


def judge_prompt(question: Column, answer: Column, criterion: Column) -> Column:
    """Asks whether an answer meets a criterion; the reply is JSON with criteria_met."""
    return F.concat(
        F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\nAnswer: "), F.coalesce(answer, F.lit("")), F.lit("\nCriterion: "), F.coalesce(criterion, F.lit("")),
        F.lit('\nReply with {"criteria_met": true} or {"criteria_met": false} and nothing else.'),
    )


def context_prompt(kind: Column, lengths: Column) -> Column:
    """Tells a model what context it has: type, total length, and the lengths of the chunks."""
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b)
    listed = F.array_join(F.transform(F.slice(lengths, 1, LISTED_CHUNKS), lambda n: n.cast("string")), ", ")
    rest = F.when(F.size(lengths) > LISTED_CHUNKS, F.concat(F.lit(", and "), (F.size(lengths) - LISTED_CHUNKS).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("The context is a "), kind, F.lit(" of "), total.cast("string"), F.lit(" characters in chunks of "), listed, rest, F.lit("."))


def selection_prompt(question: Column, candidates: Column) -> Column:
    """Offers numbered snippets and asks for at most two."""
    lines = F.array_join(F.transform(candidates, lambda c, i: F.concat(F.lit("c"), (i + 1).cast("string"), F.lit(": "), c)), "\n")
    return F.concat(F.lit("Which snippets answer the question? Pick at most two.\nQuestion: "), question, F.lit("\n"), lines, F.lit('\nReply with {"selected_candidate_ids": [...]}.'))


def state_payload(question: Column, frontier: Column, evidence: Column, actions: Column, dialogue: Column, frontier_items: int = 6) -> Column:
    """What a controller sees of its session, as JSON: the best of the frontier, the first evidence, the
    last actions and turns."""
    last = lambda a, n: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))
    return F.to_json(
        F.struct(
            question.alias("question"), F.slice(frontier, 1, frontier_items).alias("frontier"), F.slice(evidence, 1, 6).alias("evidence"),
            last(actions, 6).alias("recent_actions"), last(dialogue, 4).alias("dialogue"),
        )
    )
