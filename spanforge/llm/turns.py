"""Problem 5: clean, ordered speaker turns out of speech spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ordered import RANGE, carried, earlier_ranges, inside, into_ranges, so_far
from spanforge.session import durable

#: Distinct speaker names up to which they are broadcast; with more of them they are joined.
MAX_BROADCAST_NAMES = 100_000
#: Spans of a turn whose texts are joined in one row, at most.
PART_SPANS = 500
#: The order of the dialogue. Timing comes before numbering: two spans are ordered by their starts, and by their
#: numbers where the starts are equal or missing. No other constraint can hold against these two.
ORDER = ["span_start", "ord"]

# Hesitation sounds and filler words of the four languages.
HESITATIONS = "uh+|um+|erm+|h+m+|mm+|ähm?|euh|hum|eh"
FILLER_WORDS = "er|like|you know|i mean|este|o sea|pues|also|halt|naja|ben|bah|hein"
NUMBERED = r"^(?:speaker|spkr?|s|sprecher|hablante|locutor|locuteur|intervenant)[\s_#.-]*0*(\d+)$"
NO_SPEAKER = ("", "unk", "unknown", "none", "null", "n/a", "?")

_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
TIME_MARKS = (
    r"\d{1,3}:\d{2}:\d{2}[.,]\d{1,3}(?:\s*-->\s*\d{1,3}:\d{2}:\d{2}[.,]\d{1,3})?"
    rf"|[\[<(]\s*{_CLOCK}\s*[\]>)]|[\[<(]\s*\d+(?:\.\d+)?\s*s\s*[\]>)]|^\s*{_CLOCK}\s+-(?:\s+|$)|\b\d{{1,3}}:\d{{2}}:\d{{2}}\b"
)
_NOTE = r"\(\([^()]*\)\)|\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>|\{[^{}]*\}|♪[^♪]*♪|♪|\*[^*]{1,60}\*"


def speaker_key(label: Column) -> Column:
    """One key for the many spellings of a name or number; null for no usable label."""
    plain = F.lower(F.regexp_replace(label, r"(?i)\((?:cont'd|cont’d|contd|cont\.|off camera|off|o\.?s\.?|v\.?o\.?)\)", ""))
    plain = F.regexp_replace(plain, r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", "")
    plain = F.regexp_replace(plain, r"\s+", " ")
    number = F.regexp_extract(plain, NUMBERED, 1)
    return F.when(number != "", F.concat(F.lit("#"), number)).when(~plain.isin(*NO_SPEAKER), plain)


def _labels(spans: DataFrame) -> DataFrame:
    """The candidates for a label at the start of each text: two bracketed ones, a written one."""
    bare = F.regexp_replace(F.regexp_replace("text", TIME_MARKS, " "), r"[\s​﻿]+", " ")
    df = spans.withColumn("_bare", F.trim(bare)).withColumn("_lead", F.regexp_extract("_bare", rf"^(?:\s*(?:{_NOTE}))+", 0))
    df = df.withColumn("_notes", F.regexp_extract_all("_lead", F.lit(rf"({_NOTE})"), 1))
    df = df.withColumn("_rest", F.ltrim(F.expr("substring(_bare, length(_lead) + 1)")))
    colon = r"^(>>\s*)?([\p{L}\p{N}][^:\[\]<>{}\n]*?)\s*:(?=\s|$)"
    dash = r"^(>>\s*)?([\p{L}\p{N}][^:\n]*?)\s+-(?=\s|$)"
    df = df.withColumn("_by_colon", F.col("_rest").rlike(colon)).withColumn(
        "_label", F.when(F.col("_by_colon"), F.regexp_extract("_rest", colon, 2)).otherwise(F.regexp_extract("_rest", dash, 2))
    )
    marked = F.when(F.col("_rest").rlike(r"^>>"), F.lit(True)).otherwise(F.lit(False))
    return (
        df.withColumn("_marked", marked & (F.col("_label") != ""))
        .withColumn("_k1", speaker_key(F.try_element_at("_notes", F.lit(1))))
        .withColumn("_k2", speaker_key(F.try_element_at("_notes", F.lit(2))))
        .withColumn("_k3", speaker_key(F.col("_label")))
        .withColumn("_k0", speaker_key(F.col("speaker")))
    )


def _known(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """df[key] is kept only if it is a number or one of the names."""
    hit = names.select(F.col("name").alias("_name"), F.lit(True).alias("_hit"))
    joined = df.join(hit, df[key] == hit["_name"], "left")
    return joined.withColumn(key, F.when(F.col("_hit") | F.col(key).startswith("#"), F.col(key))).drop("_name", "_hit")


def with_text(spans: DataFrame) -> DataFrame:
    """The spans with a text; a start that is no number is none."""
    start = F.nanvl("span_start", F.lit(None).cast("double")).alias("span_start")
    rows = spans.select("video_id", F.col("ord").cast("bigint").alias("ord"), start, "span_end", "text", "speaker")
    return rows.filter(F.col("text").isNotNull())


def spoken(spans: DataFrame) -> DataFrame:
    """The spans with a text, repeated rows once. Behind a range partitioning by the same columns, which puts
    repeated rows side by side, this moves nothing."""
    return with_text(spans).dropDuplicates(["video_id", *ORDER])


def speaker_names(spans: DataFrame) -> tuple[DataFrame, bool]:
    """The distinct names of the speaker column, and whether they are few enough to be broadcast."""
    names = spans.select(speaker_key(F.col("speaker")).alias("name")).filter("name is not null and name not like '#%'").distinct()
    names = durable(names)
    return names, names.count() <= MAX_BROADCAST_NAMES


def cleaned(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(video_id, ord, span_start, span_end, speaker_key, text): one row per spoken() span with speech.
    Time marks, sound notes, labels and hesitations are taken out of the text.

    The speaker is that of the column, else the label at the start of the text; labels in the
    text count if they are numbered, marked by >> or one of the names."""
    df = _labels(rows)
    df = _known(_known(df, names, "_k1"), names, "_k2")
    df = df.withColumn("_k3m", F.when(F.col("_marked"), F.col("_k3")))
    df = _known(df, names, "_k3").withColumn("_k3", F.coalesce("_k3", "_k3m"))
    written = r"^(?:>>\s*)?[\p{L}\p{N}][^:\n]*?\s*(?::|\s-)(?=\s|$)"
    body = F.when(F.col("_k3").isNotNull(), F.regexp_replace("_rest", written, "")).otherwise(F.col("_rest"))
    df = df.withColumn("_said", F.trim(F.regexp_replace(F.regexp_replace(body, _NOTE, " "), r"^>>|\s+", " ")))
    fillers = rf"(?iu)(?<![\p{{L}}\p{{N}}'’])(?:{HESITATIONS}|{FILLER_WORDS})(?![\p{{L}}\p{{N}}'’])"
    df = df.filter(F.regexp_replace("_said", fillers, "").rlike(r"[\p{L}\p{N}]"))
    clean = F.regexp_replace("_said", rf"(?iu)(?<![\p{{L}}\p{{N}}'’-])(?:{HESITATIONS})(?![\p{{L}}\p{{N}}'’-])(?:\s*[,…]|\.{{2,}})?", " ")
    clean = F.regexp_replace(clean, r"(?iu)(?<![\p{L}\p{N}'’-])(?:er|like|you know|i mean|este|o sea|pues|halt|naja|ben|bah|hein)\s*,", " ")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\s+", " "), r"\s+([,.;:!?])(?=\s|$)", "$1")
    return df.select(
        "video_id",
        "ord",
        "span_start",
        "span_end",
        F.coalesce("_k0", "_k1", "_k2", "_k3").alias("speaker_key"),
        F.trim(clean).alias("text"),
    )


def turn_spans(spans: DataFrame, ranges: int | None = None, texts: bool = True) -> DataFrame:
    """The spans with speech in the order of the dialogue, with turn, the number of the turn in its video from 1.

    A null start comes first. The precedence of timing over numbering leaves no free choice and
    no cycle, so the topological order is a sort: ranges by (video, start, number), each sorted by
    itself, and the speaker carried over their borders. Raw texts are moved once, behind which
    they are cleaned; without `texts` they stay behind."""
    key = "video_id"
    names, few = speaker_names(spans)
    keep = [key, *ORDER, "span_end", "speaker_key"] + ["text"] * texts
    rows = with_text(spans)

    def clean(parts: DataFrame) -> DataFrame:
        return cleaned(parts.dropDuplicates([key, *ORDER]), F.broadcast(names)).select(*keep)

    if few:  # the joins with the names are broadcast and leave the rows where they are
        rows = into_ranges(rows, key, ORDER, ranges, clean)
    else:
        rows = into_ranges(cleaned(spoken(spans), names).select(*keep), key, ORDER, ranges)
    w = so_far(key, ORDER)
    rows = rows.withColumn("_own", F.last("speaker_key", ignorenulls=True).over(w))
    at = F.struct(*ORDER)
    rows = carried(
        rows, key, {"_last": F.max_by("speaker_key", F.when(F.col("speaker_key").isNotNull(), at)), "_n": F.count(F.lit(1))},
        {"_carry": F.last("_last", ignorenulls=True).over(earlier_ranges(key)), "_earlier": F.sum("_n").over(earlier_ranges(key))},
    )
    rows = rows.withColumn("_who", F.coalesce("_own", "_carry", F.lit("")))
    outside = F.when(F.col("_earlier").isNotNull(), F.coalesce("_carry", F.lit("")))
    rows = rows.withColumn("_prev", F.coalesce(F.lag("_who").over(inside(key, ORDER)), outside))
    rows = rows.withColumn("_opens", (F.col("_prev").isNull() | (F.col("_prev") != F.col("_who"))).cast("bigint"))
    rows = rows.drop("_own", "_carry", "_earlier", "_prev").withColumn("_turn", F.sum("_opens").over(w)).withColumn("_pos", F.row_number().over(inside(key, ORDER)))
    rows = carried(rows, key, {"_opened": F.sum("_opens")}, {"_done": F.sum("_opened").over(earlier_ranges(key))})
    part = F.col(RANGE).cast("bigint") * 1_000_000_000 + F.floor(F.col("_pos") / PART_SPANS)  # ascending, like the ranges
    return rows.select(
        key, (F.col("_turn") + F.coalesce("_done", F.lit(0))).alias("turn"), part.alias("part"), "_pos", "ord",
        "span_start", "span_end", F.col("_who").alias("speaker"), *["text"] * texts,
    )


def turns(spans: DataFrame, ranges: int | None = None) -> DataFrame:
    """(video_id, turn, first_ord, last_ord, speaker, start, end, spans), one row per turn."""
    at = F.struct("part", "_pos")
    return (
        turn_spans(spans, ranges, texts=False)
        .groupBy("video_id", "turn")
        .agg(
            F.min_by("ord", at).alias("first_ord"),
            F.max_by("ord", at).alias("last_ord"),
            F.max("speaker").alias("speaker"),
            F.min("span_start").alias("start"),
            F.max("span_end").alias("end"),
            F.count(F.lit(1)).alias("spans"),
        )
    )


def turn_texts(spans: DataFrame, ranges: int | None = None) -> DataFrame:
    """(video_id, turn, part, first_ord, last_ord, speaker, text): the clean text of each turn. A long
    turn has several rows, in order of part, of at most PART_SPANS spans: no text grows without bound."""
    at = F.struct("_pos", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["text"]), " ")
    return (
        turn_spans(spans, ranges)
        .groupBy("video_id", "turn", "part")
        .agg(
            F.min_by("ord", "_pos").alias("first_ord"),
            F.max_by("ord", "_pos").alias("last_ord"),
            F.max("speaker").alias("speaker"),
            joined.alias("text"),
        )
    )
