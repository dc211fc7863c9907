import math
import random

from pyspark.sql import functions as F

from spanforge.functions import scores
from spanforge.functions.focus import Question, evidence_focus, speech_focus, window_around
from spanforge.functions.text import code_blocks, final_answer, final_variable, sentences
from spanforge.operators import evidence as ev
from spanforge.operators import intervals as iv
from spanforge.operators import memory as mem
from spanforge.operators import search as se
from spanforge.operators.words import phrases

SPEECH = "video_id string, ord int, text string, span_start double, span_end double, speaker string"
VISUAL = "video_id string, ord int, summary string, span_start double, span_end double, granularity string, tags array<string>, entities array<string>"
OCR = "video_id string, ord int, text string, span_start double, span_end double"


def memory(spark, duration=120.0, w=mem.Windows(60.0, 30.0, 10.0), speech=(), visual=(), ocr=()):
    a = spark.createDataFrame([("v", duration, {"source_video_path": "v.mp4"}), ("v", None, None), ("n", None, None)], "video_id string, duration_seconds double, metadata map<string,string>")
    t = [spark.createDataFrame(list(x), s) for x, s in ((speech, SPEECH), (visual, VISUAL), (ocr, OCR))]
    return a, t, lambda level: mem.level_nodes(a, *t, level, w)


def test_tree_of_two_minutes(spark):
    a, _, _ = memory(spark)
    t = mem.tree(a, mem.Windows(60.0, 30.0, 10.0))
    assert {r["level"]: r["count"] for r in t.groupBy("level").count().collect()} == {"video": 1, "scene": 2, "segment": 4, "clip": 12}
    assert t.filter("node_id = 'v_scene_002_seg_001_clip_003'").first()["s"] == 80.0


def test_subdivide_cuts_the_last_window(spark):
    parts = spark.range(1).select(iv.subdivide(F.lit(0.0), F.lit(100.0), 45.0).alias("w")).first()["w"]
    assert [(w["s"], w["e"]) for w in parts] == [(0.0, 45.0), (45.0, 90.0), (90.0, 100.0)]
    assert spark.range(1).select(iv.subdivide(F.lit(5.0), F.lit(5.0), 45.0).alias("w")).first()["w"] == []


def test_facts_fall_into_the_windows_they_overlap(spark):
    """Against brute force, for widths that do not divide each other."""
    rng = random.Random(4)
    w = mem.Windows(100.0, 45.0, 20.0)
    spans = [("v", i, "t", s := rng.choice([0.0, 45.0, 100.0, 145.0, 390.0, rng.uniform(-5, 400)]), s + rng.choice([0.0, 1.0, 45.0, rng.uniform(0, 90)]), "x") for i in range(120)]
    a, (speech, _, _), _ = memory(spark, 395.0, w, spans)
    for level in mem.LEVELS:
        nodes = [(r["window"], r["s"], r["e"]) for r in mem.tree(a, w).filter(F.col("level") == level).collect()]
        got = {(r["window"], r["ord"]) for r in mem.node_facts(speech, a, level, w).collect()}
        assert got == {(n, o) for n, s, e in nodes for _, o, _, x, y, _ in spans if x < e and s < y}, level


def test_exact_summaries_are_preferred(spark):
    seen = [("v", 1, " exact ", 0.0, 60.0, "scene", ["b", "a"], None), ("v", 2, "near", 1.0, 50.0, "scene", ["c"], ["e"]), ("v", 3, "", 61.0, 70.0, "scene", None, None), ("v", 4, "two", 62.0, 70.0, "scene", ["z", None], ["y"])]
    _, _, level = memory(spark, visual=seen)
    rows = {r["node_id"]: (r["visual_summary"], r["tags"], r["entities"]) for r in level("scene").collect()}
    assert rows == {"v_scene_001": ("exact", ["a", "b"], []), "v_scene_002": ("two", ["z"], ["y"])}


def test_nodes_without_summary_state_their_counts(spark):
    _, _, level = memory(spark, speech=[("v", 1, "b", 1.0, 2.0, "x"), ("v", 0, "a", 3.0, 4.0, "x"), ("v", 2, None, 3.0, 4.0, "x")], ocr=[("v", 0, "o", 70.0, 71.0)])
    rows = {r["node_id"]: (r["visual_summary"], r["speech_text"]) for r in level("scene").collect()}
    assert rows == {"v_scene_001": ("scene node, 3 speech spans", "a b"), "v_scene_002": ("scene node, 1 OCR spans", "")}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lexical_scores(spark):
    from spanforge.functions.text import query_tokens

    text = F.lit("We should revise the project plan after the demo.")
    score = lambda q: value(spark, scores.lexical_match(q, query_tokens(q), text))["score"]
    assert score("demo budget") == 0.6667 and score("project plan") == 1.0 and score("walrus") == 0.0


def test_temporal_prior(spark):
    first = F.array(F.lit("first"), F.lit("demo"))
    at = lambda s: value(spark, scores.temporal(first, F.lit(s), F.lit(s + 5), F.lit(300.0)))
    assert at(0.0) == 0.3 and at(25.0) == 0.2286 and at(200.0) == 0.0
    assert value(spark, scores.temporal(first, F.lit(0.0), F.lit(5.0), F.lit(None).cast("double"))) == 0.0


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert value(spark, scores.cosine(v(1, 0), v(1, 1))) == 1 / math.sqrt(2)
    assert value(spark, scores.cosine(v(1, 0), v(-1, 0))) == 0.0 == value(spark, scores.cosine(v(0, 0), v(1, 0)))


def test_search_ranks_the_first_mention(spark):
    said = [("v", 0, "the demo begins", 10.0, 25.0, "x"), ("v", 1, "the demo ends", 90.0, 95.0, "x")]
    a, _, level = memory(spark, speech=said)
    top = se.top_hits(se.hits(level("clip"), a, "first demo"), 3).collect()
    assert top[0]["s"] == 10.0 and top[0]["temporal"] > 0 and top[0]["modality"] == "speech"
    assert se.hits(level("clip"), a, "the and of").count() == 0


def test_sentences_and_windows(spark):
    s = sentences(F.lit("One. Two two!  Three? Four"))
    assert value(spark, s) == ["One.", "Two two!", "Three?", "Four"]
    assert value(spark, window_around(s, F.lit(1), 1, 2, True)) == "One. Two two! Three? Four"
    assert value(spark, window_around(s, F.lit(1), 1, 2, False, 14)) == "One. Two two!"


def test_focus_takes_the_causal_sentence(spark):
    text = " ".join(f"Filler sentence number {i} goes on." for i in range(40)) + " I was worried to lose it because the clasp was loose. Then we left." + " More filler here." * 30
    focus = value(spark, speech_focus(F.lit(text), Question("Why was the clasp repaired?")))
    assert "worried to lose" in focus and len(focus) <= 900
    assert value(spark, speech_focus(F.lit("Short text."), Question("why?"))) == "Short text."
    assert value(spark, speech_focus(F.lit(""), Question("why?"))) == ""
    assert "worried" in value(spark, evidence_focus(F.lit(text), "what about the clasp", 300))


def test_selected_spans_keep_time_order(spark):
    said = [("v", i, t, i * 5.0, i * 5.0 + 4, "x") for i, t in enumerate(["nothing here", "the kettle boils over", "kettle repair is done", "bye", " "])]
    a, (speech, _, _), _ = memory(spark, speech=said)
    q = Question("who does the kettle repair")
    picked = ev.selected_spans(ev.scored_spans(speech, a, "scene", q, mem.Windows(60.0, 30.0, 10.0)), q).collect()
    assert [r["text"] for r in sorted(picked, key=lambda r: r["position"])] == ["the kettle boils over", "kettle repair is done"]


def test_merge_keeps_the_order_of_the_request(spark):
    led = spark.createDataFrame([("e1", "A", "v", 0.0, 1.0, "n1", 0.5, "x"), ("e2", "B", "v", 2.0, 3.0, "n2", 0.6, "")], "evidence_id string, claim string, video_id string, s double, e double, source_node_id string, confidence double, detail string")
    req = spark.createDataFrame([("r", ["e2", "e9", "e1"]), ("none", ["e9"])], "request_id string, evidence_ids array<string>")
    assert [tuple(r) for r in ev.merge_evidence(led, req).select("request_id", "claim", "detail", "confidence", "source_node_id").collect()] == [("r", "B | A", "x", 0.55, "n2")]


def test_parsing_of_responses(spark):
    text = F.lit("x\n```repl\n a = 1 \n```\ny\n```repl\nb\n```\nFINAL(it is (7))")
    assert value(spark, code_blocks(text)) == ["a = 1", "b"] and value(spark, final_answer(text)) == "it is (7)"
    assert value(spark, final_answer(F.lit("  FINAL_VAR('x')\nFINAL(no)"))) is None and value(spark, final_variable(F.lit(" FINAL_VAR('x')"))) == "x"
    assert value(spark, final_answer(F.lit("say FINAL(no) here"))) is None


def test_words_become_phrases(spark):
    words = [("v", i, t, i * 0.4, i * 0.4 + 0.3) for i, t in enumerate("this is one phrase of eight words .".split())]
    words += [("v", 20, "Next", 9.0, 9.2), ("v", 21, "one", 10.5, 10.6)] + [("w", i, "x", i * 0.5, i * 0.5 + 0.4) for i in range(20)]
    df = spark.createDataFrame(words, "video_id string, ord int, text string, span_start double, span_end double")
    got = sorted((r["video_id"], r["first_ord"], r["last_ord"]) for r in phrases(df).collect())
    assert got == [("v", 0, 7), ("v", 20, 20), ("v", 21, 21), ("w", 0, 17), ("w", 18, 19)]


def test_overlap_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([("v", 0.0, 300.0, 1), ("v", 50.0, 60.0, 2), (None, 0.0, 1.0, 3)], "k string, s double, e double, id int")
    b = spark.createDataFrame([("v", 10.0, 55.0, 7), ("v", 60.0, 70.0, 8), ("v", 299.0, 400.0, 9)], "k string, s double, e double, id int")
    assert sorted((r["id"], r["r_id"]) for r in iv.overlap_join(a, b, "k", 7.0).collect()) == [(1, 7), (1, 8), (1, 9), (2, 7)]


def test_overlap_join_of_spans_of_any_length_against_brute_force(spark):
    rng = random.Random(8)
    spans = lambda n: [("ab"[i % 2], i, s, s + rng.choice([0.0, 1.0, 30.0, 5000.0, 3e6, 2e9])) for i in range(n) for s in [rng.uniform(-500, 20000)]]
    left, right = spans(40), spans(50) + [(None, 99, 0.0, 1.0), ("a", 98, 5.0, 4.0), ("a", 97, float("nan"), 4.0)]
    schema = "k string, i int, s double, e double"
    met = iv.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", 10.0).select("i", "r_i").collect()
    want = sorted((i, j) for k, i, s, e in left for m, j, t, u in right if k == m and u >= t and s < u and t < e)
    assert sorted(map(tuple, met)) == want


def test_repeated_facts_count_once(spark):
    a = spark.createDataFrame([("v", 90.0, None)], "video_id string, duration_seconds double, metadata map<string,string>")
    facts = spark.createDataFrame([("v", 0, "x", 1.0, 2.0), ("v", 0, "x", 1.0, 2.0), ("v", 1, "y", 1.0, 200.0)], "video_id string, ord int, text string, span_start double, span_end double")
    got = sorted((r["level"], r["window"], r["ord"]) for r in mem.level_facts(facts, a).collect())
    assert got == sorted([("scene", 0, 0), ("segment", 0, 0), ("clip", 0, 0), ("scene", 0, 1), ("segment", 0, 1), ("segment", 1, 1)] + [("clip", i, 1) for i in range(6)])
    assert mem.fact_counts(speech=facts).first()["n"] == 2


def test_details_are_refined_by_a_model(spark):
    from spanforge import lm

    text = "The cook opens the kettle. The tripod is broken. He repairs it because the water is cold. Then all go home. It is late."
    rows = spark.createDataFrame([(1, text, "The tripod is broken."), (2, "Short.", "Short."), (3, text, "fails: " + text)], "id int, text string, detail string")
    make = lambda: lm.Scripted({"Which snippets": '{"selected_candidate_ids": ["c2", "c1"]}'}, fail_on="fails:")
    got = {r["id"]: r["detail"] for r in ev.refined(rows, Question("Why does he repair it?"), make).collect()}
    assert got[1].startswith("The tripod is broken. ") and len(got[1]) > len("The tripod is broken. ") and got[2] == "Short." and got[3] == "fails: " + text


def test_many_queries_give_the_same_hits_as_one_at_a_time_on_every_path(spark, monkeypatch):
    a = spark.createDataFrame([("v", 60.0, None)], "video_id string, duration_seconds double, metadata map<string,string>")
    texts = ["the red kettle leaks", "a scarred kettles leak", "red kettle leaks first", "nothing", ""]
    nodes = spark.createDataFrame([("v", f"n{i}", "clip", float(i), i + 1.0, t, "", "kettle" if i == 3 else "", "", [], []) for i, t in enumerate(texts)],
                                  "video_id string, node_id string, level string, s double, e double, speech_text string, visual_summary string, ocr_text string, audio_text string, tags array<string>, entities array<string>")
    asked = {"a": "red kettle leaks", "b": "the first kettle", "c": "of the", "d": None}
    want = sorted((k, r["node_id"], r["modality"], r["score"]) for k, q in asked.items() if q for r in se.hits(nodes, a, q).collect())
    queries = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    for limit in (1000, 1):
        monkeypatch.setattr(se, "MAX_LITERAL_TOKENS", limit)
        monkeypatch.setattr(se, "MAX_BROADCAST_TOKENS", limit)
        assert sorted((r["query_id"], r["node_id"], r["modality"], r["score"]) for r in se.search_many(queries, nodes, a).collect()) == want and len(want) >= 5
