"""Retrieval scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.text import FIRST_WORDS, LAST_WORDS, has_any, let, occurrences_of_all, search_tokens, typed_strings

LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 0.7, 0.3


def overlap(query_tokens: Column, doc_tokens: Column) -> Column:
    return F.array_sort(F.array_intersect(query_tokens, doc_tokens))


def lexical_match(query: str, tokens: list[str], text: Column) -> Column:
    """struct<score, terms>: the share of query tokens found, plus their density, plus a bonus for the
    whole phrase, at most 1; and the tokens found, sorted. Nothing found scores 0."""

    def rated(d: Column) -> Column:
        def of(found: Column) -> Column:
            density = occurrences_of_all(d["lower"], found) / F.greatest(F.size(d["tokens"]), F.lit(1))
            phrase = F.when(F.contains(d["lower"], F.lit(query.lower())), 0.25).otherwise(0.0)
            score = F.round(F.least(F.lit(1.0), F.size(found) / max(len(tokens), 1) + density + phrase), 4)
            return F.struct(F.when(F.size(found) > 0, score).otherwise(0.0).alias("score"), found.alias("terms"))

        return let(overlap(typed_strings(tokens), d["tokens"]), of)

    return let(F.struct(F.lower(text).alias("lower"), search_tokens(text).alias("tokens")), rated)


def lexical_of(doc: Column, query: Column, tokens: Column) -> Column:
    """The score of lexical_match where the query is a column too; doc is a struct<lower, tokens>."""

    def of(found: Column) -> Column:
        density = occurrences_of_all(doc["lower"], found) / F.greatest(F.size(doc["tokens"]), F.lit(1))
        phrase = F.when(F.contains(doc["lower"], F.lower(query)), 0.25).otherwise(0.0)
        score = F.round(F.least(F.lit(1.0), F.size(found) / F.greatest(F.size(tokens), F.lit(1)) + density + phrase), 4)
        return F.when(F.size(found) > 0, score).otherwise(0.0)

    return F.coalesce(let(overlap(tokens, doc["tokens"]), of), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, never negative, 0 for a zero vector; vectors of other sizes are an error."""
    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))
    pairs = F.zip_with(a, b, lambda p, q: F.struct(p.cast("double").alias("p"), q.cast("double").alias("q")))
    step = lambda s, x: F.struct((s["ab"] + x["p"] * x["q"]).alias("ab"), (s["aa"] + x["p"] * x["p"]).alias("aa"), (s["bb"] + x["q"] * x["q"]).alias("bb"))
    value = lambda s: F.when(s["aa"] * s["bb"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), s["ab"] / (F.sqrt(s["aa"]) * F.sqrt(s["bb"]))))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("embedding dimensions differ"))).otherwise(F.aggregate(pairs, zero, step, value))


def temporal(query_tokens: Column, start: Column, end: Column, duration: Column) -> Column:
    """Prior for questions about the first or the last; first wins over last."""
    window = F.greatest(duration * 0.35, F.lit(1.0))
    first = F.round(F.greatest(F.lit(0.0), 1.0 - start / window) * 0.3, 4)
    last = F.round(F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), duration - end) / window) * 0.3, 4)
    return (
        F.when(~(F.coalesce(duration, F.lit(0.0)) > 0), 0.0)
        .when(has_any(query_tokens, FIRST_WORDS), first)
        .when(has_any(query_tokens, LAST_WORDS), last)
        .otherwise(0.0)
    )


def combined(lexical_score: Column, semantic_score: Column | None, temporal_score: Column, lexical_weight: float = LEXICAL_WEIGHT,
             semantic_weight: float = SEMANTIC_WEIGHT) -> Column:
    """Without embeddings the lexical score counts whole. The weighted sum is freed of binary noise before it
    is rounded, so that halves go up whatever the machine makes of 0.7 and 0.3."""
    if semantic_score is None:
        return F.round(lexical_score + temporal_score, 4)
    return F.round(F.round(lexical_weight * lexical_score + semantic_weight * semantic_score + temporal_score, 10), 4)


def reason(modality: Column, node_id: Column, found: Column, semantic_score: Column, temporal_score: Column) -> Column:
    """Why a node is a hit, in words; scores with two decimals, halves rounded up."""
    parts = F.array_compact(
        F.array(
            F.when(F.size(found) > 0, F.concat(F.lit("Matched "), modality, F.lit(" terms "), F.array_join(F.slice(found, 1, 4), ", "))),
            F.when(semantic_score > 0, F.format_string("semantic similarity %.2f", F.round(semantic_score, 2))),
            F.when(temporal_score > 0, F.format_string("temporal prior %.2f", F.round(temporal_score, 2))),
        )
    )
    said = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.concat(F.lit("Matched "), modality, F.lit(" content")))
    return F.concat(said, F.lit(" in node "), node_id)


def detail_confidence(detail: Column) -> Column:
    n = F.length(F.trim(detail))
    return F.when(n == 0, 0.1).otherwise(F.round(F.least(F.lit(0.95), 0.45 + n / 500.0), 4))


def speech_confidence(detail: Column, score: Column) -> Column:
    return F.round(F.least(F.lit(0.95), detail_confidence(detail) + F.least(score, F.lit(1.0)) * 0.15), 4)
