import random

from spanforge.llm.ocr_runs import runs

SCHEMA = "video_id string, ord int, text string, span_start double, span_end double, _range int"


def found(spark, readings, ranges=None):
    rows = [(v, i, t, s, s + 1.0, 9) for i, (v, t, s) in enumerate(readings)]
    return sorted(tuple(r) for r in runs(spark.createDataFrame(rows, SCHEMA).drop("_range"), ranges).select("video_id", "first_ord", "last_ord", "readings").collect())


def texts(*values):
    return [("v", t, float(i)) for i, t in enumerate(values)]


def test_reading_errors_are_the_same_text(spark):
    assert found(spark, texts("Slide 3 olive paste", "SLIDE 3  olive pas1e", "· Slide 3: o1ive paste'", "Slide 4 olive paste")) == [("v", 0, 2, 3), ("v", 3, 3, 1)]


def test_numbers_differ_but_digits_in_words_do_not(spark):
    assert found(spark, texts("Total 28.99", "Total 28.98")) == [("v", 0, 0, 1), ("v", 1, 1, 1)]
    assert found(spark, texts("l'eau fraîche", "1'eau fraîche")) == [("v", 0, 1, 2)]


def test_blank_texts_end_no_run_and_marks_are_a_text(spark):
    assert found(spark, texts("abc", None, "  ", " ", "abc")) == [("v", 0, 4, 2)]
    assert found(spark, texts("***", "***", "+++")) == [("v", 0, 1, 2), ("v", 2, 2, 1)]


def test_repeated_rows_and_ties(spark):
    rows = [("v", 1, "b", 0.0, 1.0), ("v", 1, "b", 0.0, 1.0), ("v", 0, "a", 0.0, 1.0), (None, 0, "a", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "video_id string, ord int, text string, span_start double, span_end double")
    assert sorted((r["video_id"] or "", r["first_ord"], r["readings"]) for r in runs(df).collect()) == [("", 0, 1), ("v", 0, 1), ("v", 1, 1)]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_a_long_video_has_the_same_runs_in_many_ranges(spark):
    rng = random.Random(2)
    base = [f"text number {i // 7} shows" for i in range(700)]
    readings = [("live", b if rng.random() < 0.8 else b.replace("s", "5", 1), float(i)) for i, b in enumerate(base)] + [(f"v{i % 9}", "same", float(i)) for i in range(90)]
    assert found(spark, readings, 9) == found(spark, readings, 1)


def test_duration_and_long_texts(spark):
    long = "word " * 3000
    df = spark.createDataFrame([("v", 0, long, 1.0, 2.0), ("v", 1, long + "x", 5.0, 8.0)], "video_id string, ord int, text string, span_start double, span_end double")
    assert [tuple(r) for r in runs(df).select("readings", "start", "end", "duration").collect()] == [(2, 1.0, 8.0, 7.0)]
