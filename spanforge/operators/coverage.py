"""Problem 1: continuous covered periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ordered import before, carried, earlier_ranges, into_ranges, so_far


def usable_spans(spans: DataFrame, entity: str = "video_id", start: str = "span_start", end: str = "span_end") -> DataFrame:
    """(entity, s, e) in whole milliseconds; spans with a null, NaN or infinite bound, with end
    before start or without length are left out. A null entity is an entity of its own."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(9e12))
    return (
        spans.filter(finite(start) & finite(end))
        .select(F.col(entity).alias("video_id"), ms(start).alias("s"), ms(end).alias("e"))
        .filter("e > s")
    )


def covered_periods(spans: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per continuous period: (video_id, period, start_ms, end_ms, gap_before_start_ms).

    Overlapping, nested and touching spans make one period. gap_before_start_ms is the end of
    the period before, null for the first. Ties, repeated rows and an empty table need no care:
    equal spans are merged, no span gives no row."""
    rows = into_ranges(usable_spans(spans), "video_id", ["s", "e"], ranges)
    rows = rows.withColumn("_prev", F.max("e").over(before("video_id", ["s", "e"])))
    rows = carried(
        rows, "video_id", {"_max_e": F.max("e")}, {"_carry": F.max("_max_e").over(earlier_ranges("video_id"))}
    )
    rows = rows.withColumn("_reach", F.greatest("_prev", "_carry")).withColumn(
        "_opens", (F.col("_reach").isNull() | (F.col("s") > F.col("_reach"))).cast("bigint")
    )
    rows = rows.drop("_prev", "_carry").withColumn("_island", F.sum("_opens").over(so_far("video_id", ["s", "e"])))
    rows = carried(
        rows, "video_id", {"_n": F.sum("_opens")}, {"_done": F.sum("_n").over(earlier_ranges("video_id"))}
    )
    return (
        rows.withColumn("period", F.col("_island") + F.coalesce("_done", F.lit(0)))
        .groupBy("video_id", "period")
        .agg(
            F.min("s").alias("start_ms"),
            F.max("e").alias("end_ms"),
            F.max(F.when(F.col("_opens") == 1, F.col("_reach"))).alias("gap_before_start_ms"),
        )
    )


def gaps(spans: DataFrame, ranges: int | None = None) -> DataFrame:
    """The uncovered stretches of each entity between its first start and its last end."""
    return (
        covered_periods(spans, ranges)
        .filter("gap_before_start_ms is not null")
        .select("video_id", F.col("gap_before_start_ms").alias("gap_start_ms"), F.col("start_ms").alias("gap_end_ms"))
    )
