"""Reading what speech and vision models return, whatever names they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(v: Column, *paths: str, kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def speech_spans(payload: Column) -> Column:
    """array<struct<text, s, e>> of a recogniser's JSON: a list, or an object with segments or chunks;
    text, content or sentence; start and end, start_time and end_time, or a pair. Incomplete items
    are dropped; a payload with only a text is one span [0, 0]; an unreadable one gives null."""
    v = F.try_parse_json(payload)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.segments", "array<variant>"), F.try_variant_get(v, "$.chunks", "array<variant>"))
    span = lambda x: F.struct(
        F.trim(_first(x, "$.text", "$.content", "$.sentence", kind="string")).alias("text"),
        _first(x, "$.start", "$.start_time", "$.timestamp[0]", kind="double").alias("s"),
        _first(x, "$.end", "$.end_time", "$.timestamp[1]", kind="double").alias("e"),
    )
    found = F.filter(F.transform(items, span), lambda x: (F.coalesce(x["text"], F.lit("")) != "") & x["s"].isNotNull() & x["e"].isNotNull())
    whole = _first(v, "$.text", kind="string")
    alone = F.when(whole.isNotNull(), F.array(F.struct(F.trim(whole).alias("text"), F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))))
    return F.coalesce(found, alone)


def scene_summary(reply: Column) -> Column:
    """struct<summary, tags, entities> of a vision model's reply: JSON, JSON inside a text, else the text."""
    read = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "summary string, tags array<string>, entities array<string>")
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(read["summary"], F.trim(reply)).alias("summary"), F.coalesce(read["tags"], none).alias("tags"), F.coalesce(read["entities"], none).alias("entities"))
