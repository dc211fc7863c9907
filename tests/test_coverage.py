import random

import pytest

from spanforge.operators.coverage import covered_periods, gaps

SCHEMA = "video_id string, span_start double, span_end double, s string, e int"


def brute(spans):
    by = {}
    for v, a, b, *_ in spans:
        if a is None or b is None or a != a or b != b or abs(a) == float("inf") or abs(b) == float("inf"):
            continue
        a, b = round(a * 1000), round(b * 1000)
        if b > a:
            by.setdefault(v, []).append((a, b))
    out = set()
    for v, xs in by.items():
        reach = None
        for a, b in sorted(xs):
            if reach is not None and a > reach:
                out.add((v, reach, a))
            reach = b if reach is None else max(reach, b)
    return out


def found(spark, spans, ranges=None):
    df = spark.createDataFrame([(v, a, b, "x", 1) for v, a, b in spans], SCHEMA)
    return {tuple(r) for r in gaps(df, ranges).collect()}


@pytest.mark.parametrize(
    "spans",
    [
        [],
        [("v", 0.0, 1.0)],
        [("v", 0.0, 1.0), ("v", 1.0, 2.0)],
        [("v", 0.0, 1.0), ("v", 1.0004, 2.0)],
        [("v", 0.0, 1.0), ("v", 1.001, 2.0)],
        [("v", 0.0, 9.0), ("v", 1.0, 2.0), ("v", 10.0, 11.0)],
        [("v", None, 1.0), ("v", 2.0, None), ("v", 5.0, 4.0), ("v", 3.0, 3.0), ("v", float("nan"), 1.0), ("v", 0.0, float("inf"))],
        [(None, 0.0, 1.0), (None, 5.0, 6.0), ("v", 0.0, 1.0)],
        [("v", 0.0, 1.0)] * 3 + [("v", 4.0, 5.0)] * 2,
    ],
)
def test_gaps_of_small_cases(spark, spans):
    assert found(spark, spans) == brute(spans)


def test_a_long_video_spread_over_ranges_has_the_same_gaps(spark):
    rng = random.Random(1)
    spans = [("live", t := rng.uniform(0, 5000), t + rng.uniform(-1, 8)) for _ in range(900)] + [(f"v{i % 40}", float(i), i + 0.5) for i in range(400)]
    assert found(spark, spans, 7) == brute(spans) == found(spark, spans, 1)


def test_periods_tell_start_and_end(spark, to_rows):
    df = spark.createDataFrame([("v", 0.0, 2.0, "", 0), ("v", 1.0, 3.0, "", 0), ("v", 5.0, 6.0, "", 0)], SCHEMA)
    assert to_rows(covered_periods(df), "video_id", "period", "start_ms", "end_ms") == [("v", 1, 0, 3000), ("v", 2, 5000, 6000)]
