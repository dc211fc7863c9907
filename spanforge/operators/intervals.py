"""Time spans: predicates, subdivision, and joins of spans with windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open: spans that only touch do not overlap."""
    return (a_start < b_end) & (b_start < a_end)


def contains(start: Column, end: Column, t: Column) -> Column:
    """Closed at both ends."""
    return t.between(start, end)


def valid(start: Column, end: Column) -> Column:
    return start.isNotNull() & end.isNotNull() & ~F.isnan(start) & ~F.isnan(end) & (end >= start)


def display(start: Column, end: Column) -> Column:
    return F.format_string("%.2f-%.2f", start, end)


def subdivide(start: Column, end: Column, width: float) -> Column:
    """array<struct<i, s, e>>: windows of a width from start on, the last one cut at end, i from 1;
    an empty span has none. A width that is not positive is an error."""
    if width <= 0:
        raise ValueError(f"width must be positive, got {width}")
    count = F.ceil((end - start) / width).cast("int")
    indexes = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        indexes,
        lambda i: F.struct((i + 1).alias("i"), (start + i * width).alias("s"), F.least(start + (i + 1) * width, end).alias("e")),
    )


def sample_times(start: Column, end: Column, n: int) -> Column:
    """n points inside a span, at equal steps."""
    if n <= 0:
        raise ValueError(f"n must be positive, got {n}")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: start + (end - start) / (n + 1) * i)


def shifted_into(chunk_start: Column, chunk_end: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A span measured inside a chunk, on the time line; one without length takes the whole chunk."""
    whole = start == end
    return (
        F.when(whole, chunk_start).otherwise(chunk_start + start),
        F.when(whole, chunk_end).otherwise(F.least(chunk_end, chunk_start + end)),
    )


#: How many buckets of one level make one of the next, and how many levels there are.
FAN, MAX_LEVELS = 32, 12


def _level_of(start: Column, end: Column, width: float) -> Column:
    """The lowest level whose buckets are so wide that a span lies in at most FAN + 1 of them."""
    level = F.ceil(F.log(F.greatest((end - start) / (width * FAN), F.lit(1.0))) / F.log(F.lit(float(FAN))))
    return F.least(level.cast("int"), F.lit(MAX_LEVELS))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float, left_span=("s", "e"), right_span=("s", "e")) -> DataFrame:
    """Pairs of rows of one key whose spans overlap.

    Both sides are cut into time buckets and meet in the buckets they share: an equi-join on
    (key, level, bucket) that a hot key cannot pile up on one task. A long span lies in few wide
    buckets instead of many narrow ones, so one with a wrong end costs no more than another:
    each row stands in the buckets of its own level and, as a guest, in those of the wider
    levels that occur. A pair is given out once, on the level of the longer span, in the
    bucket where the later of the two begins. Null keys and broken spans meet nothing."""
    (ls, le), (rs, re_) = left_span, right_span
    ok = lambda df, s, e: df.filter(valid(F.col(s), F.col(e)) & (F.abs(F.col(s)) < 1e15) & (F.abs(F.col(e)) < 1e15) & F.col(key).isNotNull())
    left, right = ok(left, ls, le), ok(right, rs, re_)
    occurs = left.select(_level_of(F.col(ls), F.col(le), width).alias("l")).union(right.select(_level_of(F.col(rs), F.col(re_), width).alias("l")))
    levels = sorted(r["l"] for r in occurs.distinct().collect())  # at most MAX_LEVELS + 1 numbers

    def bucketed(df: DataFrame, s: str, e: str, mark: str) -> DataFrame:
        none = F.array().cast(f"array<struct<_level{mark}:int,_bucket{mark}:bigint,_own{mark}:boolean>>")

        def slots(level: int) -> Column:
            wide = width * float(FAN) ** level
            numbers = F.sequence(F.floor(F.col(s) / wide), F.floor(F.col(e) / wide))
            slot = lambda n: F.struct(F.lit(level).alias(f"_level{mark}"), n.alias(f"_bucket{mark}"), (F.col("_l") == level).alias(f"_own{mark}"))
            return F.when(F.col("_l") <= level, F.transform(numbers, slot)).otherwise(none)

        return df.withColumn("_l", _level_of(F.col(s), F.col(e), width)).select(*df.columns, F.inline(F.concat(none, *[slots(x) for x in levels])))

    a, b = bucketed(left, ls, le, ""), bucketed(right, rs, re_, "_r")
    names = {c: f"r_{c}" for c in right.columns if c in left.columns and c != key}
    b = b.withColumnsRenamed(names).withColumnRenamed(key, "_key_r")
    rs2, re2 = names.get(rs, rs), names.get(re_, re_)
    met = a.join(b, (a[key] == b["_key_r"]) & (a["_level"] == b["_level_r"]) & (a["_bucket"] == b["_bucket_r"]))
    met = met.filter((F.col("_own") | F.col("_own_r")) & overlaps(F.col(ls), F.col(le), F.col(rs2), F.col(re2)))
    wide = F.lit(width) * F.pow(F.lit(float(FAN)), F.col("_level"))
    met = met.filter(F.col("_bucket") == F.floor(F.greatest(F.col(ls), F.col(rs2)) / wide))
    return met.drop("_bucket", "_bucket_r", "_key_r", "_level", "_level_r", "_own", "_own_r")
