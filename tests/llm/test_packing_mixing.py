import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from spanforge.llm.mixing import Mix, budgets, pass_on
from spanforge.llm.packing import packed, packing_patterns, split_documents
from spanforge.llm.tokens import encoding, TOKENIZERS, VOCABULARY

DOCS = "doc_id bigint, text string, lang string, source string, tokens string"


@settings(max_examples=60, deadline=None)
@given(hs.dictionaries(hs.integers(1, 64), hs.integers(1, 50), max_size=20))
def test_patterns_place_every_length_once(histogram):
    placed = dict.fromkeys(histogram, 0)
    for packs, pattern in packing_patterns(histogram, 64):
        assert packs > 0 and sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            placed[k] += packs * n
    assert placed == histogram


def test_patterns_leave_little_space():
    rng = random.Random(1)
    histogram = {}
    for _ in range(20_000):
        n = min(2048, int(rng.lognormvariate(5.5, 0.8)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    packs = packing_patterns(histogram)
    assert sum(k * n for k, n in histogram.items()) / 2048 / sum(p for p, _ in packs) > 0.99
    assert sorted(packing_patterns({100: 41}, 2048), key=str) == [(1, {100: 1}), (2, {100: 20})]


def docs(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, "clash") for i, t in enumerate(texts)], DOCS)


def test_documents_are_packed_whole_and_long_ones_split(spark):
    texts = ["word " * n for n in (5, 50, 3000, 700, 2047)] + [None, "", "word"] + ["same text"] * 300
    got = packed(docs(spark, texts)).collect()
    fill, pieces = {}, {}
    for r in got:
        fill[r["context"]] = fill.get(r["context"], 0) + r["tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
    assert max(fill.values()) <= 2048
    enc = encoding(TOKENIZERS, VOCABULARY)
    for i, t in enumerate(texts):
        n = len(enc.encode_ordinary(t or ""))
        assert sum(k for _, k in pieces.get(i, [])) == n
        assert len(pieces.get(i, [])) == -(-n // 2048)
    assert [r["doc_id"] for r in split_documents(docs(spark, texts)).collect()] == [2]
    assert packed(docs(spark, [])).count() == 0


def test_shortages_go_to_siblings_before_others():
    sizes = {("asr_a", "en"): 10, ("asr_b", "en"): 1000, ("asr_b", "de"): 1000, ("mail_c", "en"): 1000}
    targets = {"asr_a": (0.25, 2), "asr_b": (0.5, 1), "mail_c": (0.25, 1), "gone": (0.0, 3)}
    out = budgets(sizes, targets, 1000)
    assert out["asr_a", "en"]["tokens"] == 20 and out["asr_a", "en"]["lacks"] == pytest.approx(230)
    assert out["asr_b", "en"]["tokens"] == pytest.approx(250 + 230) and out["asr_b", "de"]["tokens"] == pytest.approx(250)
    assert out["mail_c", "en"]["tokens"] == pytest.approx(250)
    full = budgets({("x", "en"): 10, ("y", "en"): 10}, {"x": (0.5, 1), "y": (0.5, 1)}, 1000)
    assert sum(v["tokens"] for v in full.values()) == 20


def test_mix_reports_and_chooses(spark):
    rows = [(i, "some words of text here", "en", "big", "") for i in range(300)] + [(1000 + i, "some words of text here", None, "small", "") for i in range(5)] + [(2000, None, "xx", None, ""), (2001, "off target", "en", "other", "")]
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 2), ("none", 0.1, 5), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    mix = Mix(spark.createDataFrame(rows, DOCS), targets)
    assert sorted(r["source"] for r in mix.short_sources().collect()) == ["none", "small"]
    chosen = mix.chosen().collect()
    assert {r["repeats"] for r in chosen if r["source"] == "small"} == {2} and max(r["repeats"] for r in chosen if r["source"] == "big") == 1
    total = sum(r["tokens"] * r["repeats"] for r in chosen)
    assert abs(total - mix.total) <= 0.05 * mix.total and {r["source"] for r in chosen} == {"big", "small"}
    assert sorted(r["doc_id"] for r in chosen) == sorted(r["doc_id"] for r in Mix(spark.createDataFrame(rows, DOCS), targets).chosen().collect())
    empty = Mix(spark.createDataFrame([], DOCS), targets)
    assert empty.chosen().count() == 0 and empty.short_sources().count() == 0


def test_report_counts_the_chosen_documents(spark):
    """Few long documents cannot fill their budget: what is reported is what was picked."""
    rows = [(i, "word " * 700, "en", "long", "") for i in range(4)] + [(100 + i, "word " * 5, "en", "fine", "") for i in range(400)]
    rows += [(1000, "word " * 900, "de", "lone", "")]
    targets = spark.createDataFrame([("long", 0.4, 1), ("fine", 0.2, 1), ("lone", 0.1, 1), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix = Mix(spark.createDataFrame(rows, DOCS), targets)
    picked = {}
    for r in mix.chosen().collect():
        picked[r["source"]] = picked.get(r["source"], 0) + r["tokens"] * r["repeats"]
    report = {r["source"]: r for r in mix.report().collect()}
    assert set(report) == {"long", "fine", "lone", "none"}
    for source, r in report.items():
        assert r["tokens"] == picked.get(source, 0) <= r["budget"]
        assert r["actual_share"] == pytest.approx(picked.get(source, 0) / sum(picked.values()))
    assert report["lone"]["budget"] > report["lone"]["tokens"] == 0 and report["long"]["tokens"] < report["long"]["budget"]
    empty = Mix(spark.createDataFrame([], DOCS), targets).report().collect()
    assert len(empty) == 4 and all(r["tokens"] == 0 and r["actual_share"] == 0 for r in empty)


def test_unfilled_rests_go_to_siblings_that_can_use_them():
    leaf = lambda path, capacity, wanted, tokens: {"path": path, "capacity": capacity, "wanted": wanted, "tokens": tokens}
    leaves = {("a", "en"): leaf(("x", "en"), 5000, 100.0, 100.0), ("b", "en"): leaf(("x", "en"), 5000, 100.0, 100.0), ("c", "de"): leaf(("y", "de"), 5000, 100.0, 100.0)}
    assert pass_on(leaves, {("a", "en"): (0, 0), ("b", "en"): (96, 12), ("c", "de"): (98, 49)})
    assert leaves["b", "en"]["tokens"] == pytest.approx(96 + 104) and leaves["a", "en"]["tokens"] == 0 and leaves["c", "de"]["tokens"] == pytest.approx(100)
    assert not pass_on({("a", "en"): leaf(("x", "en"), 100, 100.0, 100.0)}, {("a", "en"): (100, 3)})


def test_skewed_lengths_reach_the_planned_total(spark):
    """Long documents leave gaps; short ones of other leaves close them. Reported and chosen tokens agree."""
    rng = random.Random(4)
    rows = [(i, "word " * rng.choice([3, 10, 40, 900]), rng.choice(["en", "de", None]), s, "") for s, base in (("asr_a", 0), ("asr_b", 1000), ("mail_c", 2000)) for i in range(base, base + 120)]
    targets = spark.createDataFrame([("asr_a", 0.5, 1), ("asr_b", 0.3, 1), ("mail_c", 0.2, 1)], "source string, target_share double, max_repeats int")
    mix = Mix(spark.createDataFrame(rows, DOCS), targets)
    chosen = mix.chosen().collect()
    report = {r["source"]: r for r in mix.report().collect()}
    total = sum(r["tokens"] * r["repeats"] for r in chosen)
    assert total >= 0.995 * mix.total and total == sum(r["tokens"] for r in report.values())
    assert len({r["doc_id"] for r in chosen}) == len(chosen) and all(r["repeats"] == 1 for r in chosen)
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, Mix(spark.createDataFrame(rows, DOCS), targets).chosen().collect()))
