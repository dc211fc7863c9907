import random

from spanforge.llm import turns as module
from spanforge.llm.turns import cleaned, speaker_names, spoken, turn_spans, turn_texts, turns

SCHEMA = "video_id string, ord int, text string, span_start double, span_end double, speaker string, language string"


def frame(spark, spans):
    return spark.createDataFrame([("v", i, t, float(i), i + 1.0, s, "en") for i, (s, t) in enumerate(spans)], SCHEMA)


def found(spark, *spans, ranges=None):
    return sorted((r["first_ord"], r["last_ord"], r["speaker"]) for r in turns(frame(spark, spans), ranges).collect())


def test_spellings_of_one_speaker(spark):
    assert found(spark, ("SPK_01", "a"), ("Speaker #1", "b"), ("spk1", "c"), ("S1", "d"), (None, ">> SPEAKER 1: e"), ("speaker-2:", "f")) == [(0, 4, "#1"), (5, 5, "#2")]
    assert found(spark, ("Host", "a"), ("HOST (cont'd)", "b"), ("[Host]", "c"), (None, "<HOST> d"), ("Host (off camera)", "e"), (None, "HOST - f")) == [(0, 5, "host")]


def test_spans_without_speech_belong_to_no_turn(spark):
    spans = [("A", "hello"), ("B", "[music]"), ("B", "Hmm..."), ("B", "B:"), ("B", None), ("B", " (0:38) "), ("B", "Ähm."), ("A", "again"), ("B", "♪ la ♪"), ("B", "uh, yes")]
    assert found(spark, *spans) == [(0, 7, "a"), (9, 9, "b")]


def test_spans_without_label_continue(spark):
    assert found(spark, (None, "who"), ("A", "x"), ("unknown", "y"), ("", "Note: z"), ("UNK", "[12.5s] w")) == [(0, 0, ""), (1, 4, "a")]


def test_labels_after_times_and_notes(spark):
    assert found(spark, ("Guest", "x"), ("Host", "y"), (None, "00:00:25,848 --> 00:00:27,848 >> GUEST: Really?"), (None, "[crosstalk] (Host) yes")) == [(0, 0, "guest"), (1, 1, "host"), (2, 2, "guest"), (3, 3, "host")]


def test_text_is_cleaned(spark):
    df = frame(spark, [("A", "[00:00:01] A: The um, host [laughs] went uhh home .")])
    got = [r["text"] for r in cleaned(spoken(df), speaker_names(df)[0]).collect()]
    assert got == ["The host went home."]


def test_order_follows_time_then_number(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice(["x", "y z"]), rng.choice([None, float("nan"), 1.0, 2.0, 3.0]), 9.0, rng.choice(["A", "B"]), "en") for i in range(200)]
    rng.shuffle(rows)
    spans = turn_spans(spark.createDataFrame(rows, SCHEMA), 5).collect()
    low = lambda s: float("-inf") if s is None or s != s else s
    for video in "ab":
        got = [r["ord"] for r in sorted((r for r in spans if r["video_id"] == video), key=lambda r: (r["part"], r["_pos"]))]
        assert got == [o for _, o in sorted((low(s), o) for v, o, _, s, *_ in rows if v == video)]


def test_labels_of_any_length(spark):
    name = "The Right Honourable " + "Very " * 30 + "Long Name"
    assert found(spark, (name, "hello"), (None, f"{name}: again"), (None, f">> {name.upper()}: and again"), ("B", "bye")) == [(0, 2, name.lower()), (3, 3, "b")]


def test_long_videos_ties_repeats_and_empty_tables(spark):
    rng = random.Random(5)
    spans = [(rng.choice(["A", "B", None, "unknown"]), rng.choice(["hello", "[music]", "yes"])) for _ in range(400)]
    assert found(spark, *spans, ranges=7) == found(spark, *spans, ranges=1)
    df = frame(spark, [("A", "x"), ("A", "y")])
    assert turns(df.unionAll(df)).count() == 1 and turns(df.filter("false")).count() == 0


def test_turn_texts_join_the_spans(spark):
    rows = turn_texts(frame(spark, [("A", "one"), ("A", "two"), ("B", "three")]), 1).collect()
    assert sorted((r["speaker"], r["text"]) for r in rows) == [("a", "one two"), ("b", "three")]


def test_many_names_are_joined_with_the_same_result(spark, monkeypatch):
    spans = [("Guest", "x"), (None, "[Guest] y"), ("Host", "z"), (None, "Note: w")]
    few = found(spark, *spans)
    monkeypatch.setattr(module, "MAX_BROADCAST_NAMES", 0)
    assert found(spark, *spans) == few == [(0, 1, "guest"), (2, 3, "host")]
