"""Word-level speech into phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import tidy_punctuation
from spanforge.operators.ordered import running

MAX_WORDS, MAX_SECONDS, MAX_GAP = 18, 12.0, 0.9


def word_level(spans: DataFrame) -> DataFrame:
    """(video_id, word_level): at least 8 spans, nine in ten of them of at most three words."""
    short = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) <= 3
    return spans.groupBy("video_id").agg(((F.count(F.lit(1)) >= 8) & (F.avg(short.cast("double")) >= 0.9)).alias("word_level"))


def phrases(words: DataFrame) -> DataFrame:
    """words (video_id, ord, text, span_start, span_end) as phrases (video_id, first_ord, last_ord, text,
    span_start, span_end): a phrase ends at a pause, at the end of a sentence, or when it is full.

    Pauses and sentence ends do not depend on what came before, so they cut a video into islands by
    windows; only the filling up is a fold, over the words of one island, which a pause ends."""
    order = ["ord", "span_start"]
    rows = running(words, "video_id", order, previous={"_before": F.struct("span_end", F.trim("text").alias("text"))})
    pause = F.round(F.col("span_start") - F.col("_before.span_end"), 6) > MAX_GAP
    hard = F.col("_before").isNull() | pause | F.col("_before.text").rlike(r"[.!?]$")
    rows = running(rows.withColumn("_hard", F.coalesce(hard, F.lit(True)).cast("bigint")).drop("_before"), "video_id", order, sums={"_island": F.col("_hard")})
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    word = F.struct("ord", "span_start", "span_end", F.trim("text").alias("text"), n.alias("n"))
    rows = rows.groupBy("video_id", "_island").agg(F.array_sort(F.collect_list(word)).alias("w"))
    first = F.array().cast("array<struct<no:int,start:double,words:int>>")

    def place(acc, w):
        last = F.try_element_at(acc, F.lit(-1))
        full = (last["words"] + w["n"] > MAX_WORDS) | (F.round(w["span_end"] - last["start"], 6) > MAX_SECONDS)
        new = F.struct((F.coalesce(last["no"], F.lit(0)) + 1).cast("int").alias("no"), w["span_start"].alias("start"), w["n"].cast("int").alias("words"))
        more = F.struct(last["no"].alias("no"), last["start"].alias("start"), (last["words"] + w["n"]).cast("int").alias("words"))
        return F.concat(acc, F.array(F.when(last.isNull() | full, new).otherwise(more)))

    placed = F.aggregate("w", first, place)
    rows = rows.select("video_id", "_island", F.inline(F.zip_with("w", placed, lambda w, p: F.struct(w["ord"].alias("ord"), w["span_start"].alias("s"), w["span_end"].alias("e"), w["text"].alias("text"), p["no"].alias("no")))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("ord", "text")))), lambda x: x["text"]), " ")
    return (
        rows.groupBy("video_id", "_island", "no")
        .agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), tidy_punctuation(joined).alias("text"), F.min_by("s", "ord").alias("span_start"), F.max_by("e", "ord").alias("span_end"))
        .drop("_island", "no")
    )
