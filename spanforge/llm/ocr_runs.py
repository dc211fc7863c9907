"""Problem 2: runs of consecutive readings of the same screen text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.ordered import RANGE, carried, earlier_ranges, inside, into_ranges, later_ranges, so_far

ORDER = ["span_start", "ord"]
#: At most this share of the letters and digits may differ between two readings of one text.
MAX_DIFFERENT = 0.3


def letters(text: Column) -> Column:
    """The letters and digits of a text in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", "")


def numbers(text: Column) -> Column:
    """The numbers of a text, joined: digit groups that touch no letter, not even across an apostrophe."""
    return F.array_join(
        F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{M}\p{N}])(?<!\p{L}['’])(\p{N}+)(?![\p{L}\p{M}\p{N}])(?!['’]\p{L})"), 1), " "
    )


def same_text(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """a, b: letters() of two readings; na, nb: their numbers(). Never null for non-null input.

    The edit distance is only computed where the lengths allow a match."""
    longest = F.greatest(F.length(a), F.length(b))
    allowed = F.floor(longest * F.lit(MAX_DIFFERENT) + F.lit(1e-9))
    near = (F.abs(F.length(a) - F.length(b)) <= allowed) & (F.levenshtein(a, b) <= allowed)  # levenshtein takes a constant bound only
    return (na == nb) & ((a == b) | F.coalesce(near, F.lit(False)))


def readings(ocr: DataFrame) -> DataFrame:
    """The rows with a text; null and blank texts are left out.

    A text of marks only is a reading too; it equals another only in its exact marks."""
    shown = F.regexp_replace("text", r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", "")
    return ocr.select("video_id", F.col("ord").cast("bigint").alias("ord"), "span_start", "span_end", "text").filter(
        F.col("text").isNotNull() & (shown != "")
    )


def normalised(rows: DataFrame) -> DataFrame:
    """readings() with _l and _n, what two readings are compared by."""
    rows = rows.withColumn("_l", letters(F.col("text")))
    return rows.withColumn("_l", F.when(F.col("_l") == "", F.regexp_replace("text", r"\s+", "")).otherwise(F.col("_l"))).withColumn(
        "_n", numbers(F.col("text"))
    )


def runs(ocr: DataFrame, ranges: int | None = None, texts: bool = True) -> DataFrame:
    """(video_id, first_ord, last_ord, readings, start, end, duration, text), one row per run of one or
    more consecutive readings of the same text, in order of span_start and ord; without `texts` no text.

    Only the rows that differ from their predecessor are kept; the next kept row (lead) gives the
    end of the run: its position the count, its predecessor's end the duration. What is compared
    is looked up at once and left behind; only the last reading of each range goes on to the next.
    Defined cases: repeated rows (same video, start and ord) count once; an unordered row (null
    start) comes first; a null video is a video of its own; a run of one reading has readings 1; an empty
    table gives no rows."""
    key, w = "video_id", inside("video_id", ORDER)

    def prepared(parts: DataFrame) -> DataFrame:
        """Behind the ranges: repeated rows lie side by side, so nothing is moved."""
        rows = normalised(parts.dropDuplicates([key, *ORDER]))
        return rows if texts else rows.drop("text")

    rows = into_ranges(readings(ocr), key, ORDER, ranges, prepared)
    lag = lambda c: F.lag(c).over(w)
    here = F.struct("_l", "_n", "ord", "span_end")
    rows = rows.withColumns({"_pos": F.row_number().over(w).cast("bigint"), "_pl": lag("_l"), "_pn": lag("_n"), "_po": lag("ord"), "_pe": lag("span_end")})
    # the last reading and the number of readings of each range, seen from the later ones
    by_range = Window.partitionBy(key).orderBy(RANGE)
    rows = carried(
        rows, key, {"_last": F.max_by(here, F.struct("span_start", "ord")), "_count": F.count(F.lit(1))},
        {"_carry": F.lag("_last").over(by_range), "_offset": F.coalesce(F.sum("_count").over(earlier_ranges(key)), F.lit(0))},
    )
    before = lambda own, field: F.when(F.col("_pos") > 1, F.col(own)).otherwise(F.col("_carry")[field])
    first = (F.col("_pos") == 1) & F.col("_carry").isNull()
    same = same_text(F.col("_l"), F.col("_n"), before("_pl", "_l"), before("_pn", "_n"))
    rows = rows.withColumns({"_opens": first | ~same, "_bo": before("_po", "ord"), "_be": before("_pe", "span_end"), "_at": F.col("_pos") + F.col("_offset")})
    rows = rows.select(key, RANGE, "ord", "span_start", "span_end", *["text"] * texts, "_opens", "_bo", "_be", F.col("_at").alias("_pos"))
    # what a run needs of the row that opens the next one, or of the end of the video
    edge = F.struct(F.col("_pos").alias("pos"), F.col("_bo").alias("ord"), F.col("_be").alias("end"))
    final = F.struct((F.col("_pos") + 1).alias("pos"), F.col("ord").alias("ord"), F.col("span_end").alias("end"))
    rows = rows.withColumn("_edge", edge).withColumn("_final", final)
    at = F.struct("span_start", "ord")
    rows = carried(
        rows, key, {"_first_open": F.min_by("_edge", F.when(F.col("_opens"), at)), "_end": F.max_by("_final", at)},
        {"_next_open": F.first("_first_open", ignorenulls=True).over(later_ranges(key)),
         "_video_end": F.last("_end").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))},
    )
    opened = rows.filter("_opens").withColumn(
        "_next", F.coalesce(F.lead("_edge").over(w), F.col("_next_open"), F.col("_video_end"))
    )
    return opened.select(
        key,
        F.col("ord").alias("first_ord"),
        F.col("_next")["ord"].alias("last_ord"),
        (F.col("_next")["pos"] - F.col("_pos")).alias("readings"),
        F.col("span_start").alias("start"),
        F.col("_next")["end"].alias("end"),
        (F.col("_next")["end"] - F.col("span_start")).alias("duration"),
        *["text"] * texts,
    )
