"""Order-dependent scans over entities of any size.

A window over one entity sorts the whole entity in one task. If a third of all rows belong
to one entity that task never ends. Here the rows are range-partitioned by (entity, order),
so that a large entity lies in many ranges of about equal size; windows then run inside
(entity, range), and a small table with one row per entity and range carries the state of
the earlier ranges forward. That table has at most #entities + #ranges rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import durable, shuffle_width

RANGE = "_range"


def into_ranges(df: DataFrame, key: str, order: list[str], ranges: int | None = None, after: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with the column _range: rows of a key are in ascending (order) from range to range.

    The ranges are fixed by a checkpoint: every later reader sees the same ones. Range
    partitioning computes its input twice, once for a sample; `after`, a transformation that
    keeps rows in their partition, therefore does what is expensive behind it, once."""
    n = ranges or shuffle_width(df.sparkSession)
    parts = df.repartitionByRange(n, key, *order)
    return durable((after(parts) if after else parts).withColumn(RANGE, F.spark_partition_id()))


def inside(key: str, order: list[str]):
    """The window over one range of one key."""
    return Window.partitionBy(key, RANGE).orderBy(*order)


def so_far(key: str, order: list[str]):
    return inside(key, order).rowsBetween(Window.unboundedPreceding, 0)


def before(key: str, order: list[str]):
    return inside(key, order).rowsBetween(Window.unboundedPreceding, -1)


def earlier_ranges(key: str):
    return Window.partitionBy(key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def later_ranges(key: str):
    return Window.partitionBy(key).orderBy(RANGE).rowsBetween(1, Window.unboundedFollowing)


def carried(df: DataFrame, key: str, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """df joined with `carry`, window expressions over one row of `summary` per key and range.

    The join is null-safe: rows with a null key form one entity."""
    per_range = df.groupBy(key, RANGE).agg(*[c.alias(n) for n, c in summary.items()])
    state = per_range.select(
        F.col(key).alias("_ck"), F.col(RANGE).alias("_cr"), *[c.alias(n) for n, c in carry.items()]
    )
    return df.join(state, (df[key].eqNullSafe(state["_ck"])) & (df[RANGE] == state["_cr"]), "left").drop("_ck", "_cr")


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
            previous: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """df with running values of each key in an order, for keys of any size: `sums` up to each row, the
    last non-null value of `lasts` up to it, and of `previous` before it (null at the start). `order`
    should tell rows apart; a null key is a key of its own."""
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    rows = into_ranges(df.withColumns({f"_v_{n}": c for part in (sums, lasts, previous) for n, c in part.items()}), key, order, ranges)
    up_to, up_before = so_far(key, order), before(key, order)
    at = F.struct(*order)
    inner = {n: F.sum(f"_v_{n}").over(up_to) for n in sums}
    inner |= {n: F.last(f"_v_{n}", ignorenulls=True).over(up_to) for n in lasts}
    inner |= {n: F.last(f"_v_{n}", ignorenulls=True).over(up_before) for n in previous}
    rows = rows.withColumns({f"_i_{n}": c for n, c in inner.items()})
    summary = {f"_s_{n}": F.sum(f"_v_{n}") for n in sums}
    summary |= {f"_s_{n}": F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)) for n in (*lasts, *previous)}
    earlier = earlier_ranges(key)
    carry = {f"_e_{n}": F.sum(f"_s_{n}").over(earlier) for n in sums} | {f"_e_{n}": F.last(f"_s_{n}", ignorenulls=True).over(earlier) for n in (*lasts, *previous)}
    rows = carried(rows, key, summary, carry)
    out = {n: F.col(f"_i_{n}") + F.coalesce(F.col(f"_e_{n}"), F.lit(0)) for n in sums} | {n: F.coalesce(f"_i_{n}", f"_e_{n}") for n in (*lasts, *previous)}
    return rows.withColumns(out).drop(RANGE, *[f"_{p}_{n}" for p in "vise" for n in (*sums, *lasts, *previous)])
