import random

import pytest

from spanforge import lm
from spanforge.loops import Cancelled, Completion, CostLimit, ErrorLimit, Explorer, LimitReached, Limits, Session, TimeLimit, TokenLimit, first_json, run_conversation
from spanforge.operators import scoring as sc
from spanforge.operators import state as st
from spanforge.operators import trajectory as tr
from spanforge.schemas import ITERATION


def iteration(run, n, stderr="", answer=None):
    return (run, n, None, None, "r", [None, ("c", ("", stderr, {}, 0.5, None, None))], answer, None)


def test_error_streaks_in_long_runs(spark):
    rng = random.Random(3)
    failed = {("long", i): rng.random() < 0.8 for i in range(300)} | {("short", i): True for i in range(3)}
    df = spark.createDataFrame([iteration(r, i, "bad" if f else "") for (r, i), f in failed.items()], ITERATION)
    got = {(r["run_id"], r["iteration"]): r["streak"] for r in tr.error_streaks(df).collect()}
    want, streak = {}, 0
    for run in ("long", "short"):
        streak = 0
        for (r, i), f in sorted(failed.items()):
            if r == run:
                streak = streak + 1 if f else 0
                want[r, i] = streak
    assert got == want


def test_running_limits_against_sums(spark):
    calls = [("r", i, i, 0.01, 10, 5, 1.0) for i in range(100)] + [("q", 200, 1, None, None, None, None)]
    df = spark.createDataFrame(calls, "run_id string, completion_id bigint, created_at bigint, total_cost double, total_input_tokens bigint, total_output_tokens bigint, execution_time double")
    got = {r["completion_id"]: r for r in tr.running_limits(df, 0.5, 300, 1000).collect()}
    assert got[49]["cost"] == 0.5 and not got[49]["over_cost"] and got[50]["over_cost"] and got[20]["over_tokens"] and got[200]["tokens"] == 0


def test_context_limits_take_the_longest_part(spark):
    models = spark.createDataFrame([("@x/gpt-4o-mini-2",), ("gpt-4",), ("none",), (None,), ("unknown",)], "root_model string")
    got = {r["root_model"]: r["token_limit"] for r in tr.context_limits(models, tr.limits_table(spark)).collect()}
    assert got == {"@x/gpt-4o-mini-2": 128_000, "gpt-4": 8192, "none": 128_000, None: 128_000, "unknown": 128_000}


def test_rubric_scores(spark):
    rows = [("a", "summarization", 2.0, False, True), ("a", "summarization", 1.0, False, False), ("b", "motion_analysis", 1.0, False, True), ("b", "motion_analysis", -1.0, True, True), ("c", None, None, None, None)]
    df = spark.createDataFrame(rows, "sample_id string, task string, weight double, is_penalty boolean, criteria_met boolean")
    tasks = sc.task_scores(sc.sample_points(df))
    assert {r["task"]: round(r["accuracy"], 4) for r in tasks.collect()} == {"summarization": 0.6667, "compositional_reasoning": 1.0, "unknown_task": 0.0}
    assert round(sc.overall_score(sc.category_scores(tasks, sc.categories(spark))).first()["accuracy"], 4) == 0.8333


def test_published_means_follow_the_rule(spark):
    """Task means of a published run, their category means and the overall mean."""
    means = dict(entity_recognition=19.19, event_understanding=8.10, temporal_reasoning=26.77, audio_understanding=9.09, causal_reasoning=18.18, compositional_reasoning=0.0, comparative_analysis=11.18,
                 information_retrieval=16.55, summarization=24.43, instruction_extraction=8.0, sentiment_analysis=0.0, multimodal_synthesis=14.96, audio_visual_alignment=29.17)
    tasks = spark.createDataFrame(list(means.items()), "task string, accuracy double")
    by = sc.category_scores(tasks, sc.categories(spark))
    assert sorted(round(r["accuracy"], 2) for r in by.collect()) == pytest.approx([9.79, 12.24, 15.79, 22.06], abs=0.011)
    assert sc.overall_score(by).first()["accuracy"] == pytest.approx(14.97, abs=0.01)


def test_verdicts(spark):
    texts = ['{"criteria_met": true}', 'x ```json\n{"criteria_met": false}\n``` y', 'so "criteria_met" : TRUE.', "criteria_met is false", "no verdict", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(sc.criteria_met(df["t"])).collect()] == [True, False, True, False, None, None]


FRONTIER = "session string, node_id string, score double, s double, recommended_modalities array<string>, ord int"


def test_frontier_upserts(spark):
    old = spark.createDataFrame([("x", "a", 0.5, 1.0, ["visual"], 0), ("x", "b", 0.5, 2.0, ["ocr"], 1)], FRONTIER)
    new = spark.createDataFrame([("x", "a", 0.5, 1.0, ["speech"], 0), ("x", "b", 0.4, 2.0, ["audio"], 1), ("x", "c", 0.9, 3.0, ["ocr"], 2)], FRONTIER)
    got = [(r["node_id"], r["score"], r["recommended_modalities"]) for r in st.merge_frontier(old, new).orderBy("rank").collect()]
    assert got == [("c", 0.9, ["ocr"]), ("a", 0.5, ["speech"]), ("b", 0.5, ["audio", "ocr"])]


def test_batches_keep_their_slots(spark):
    req = spark.createDataFrame([("b", i, f"prompt {i}" if i != 3 else None, None) for i in range(50)], "batch_id string, ord int, prompt string, model string").repartition(4)
    got = {r["ord"]: r["response"] for r in lm.query_batches(req, lambda: lm.Scripted(fail_on="prompt 7")).collect()}
    assert len(got) == 50 and got[7].startswith("Error:") and got[3] == "Error: missing prompt" and got[12] == "echo: prompt 12"


def test_tools_and_providers_are_checked(spark):
    assert lm.register_tools(spark, {"twice": lambda x: x * 2}) == ["twice"]
    assert spark.sql("select twice('a')").first()[0] == "aa"
    for bad in ("llm_query", "no name"):
        with pytest.raises(ValueError):
            lm.register_tools(spark, {bad: str})
    with pytest.raises(ValueError):
        lm.provider("nobody")


class Script:
    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def complete(self, prompt, model):
        self.seen.append(prompt)
        return self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]


def test_completion_loop_runs_sql_until_final(spark):
    s = Session(spark)
    assert s.add_context(["one", "two"]) == "context_0" and s.add_context({"a": 1}) == "context_1" and s.add_history([{"role": "user", "content": "x"}]) == "history_0"
    model = Script("```repl\nselect count(*) n from context\n```", "FINAL(two rows)")
    answer, log = Completion(model, s).run("How many?")
    assert answer == "two rows" and log[0]["code_blocks"][0]["stdout"] == '{"n": 2}' and '{"n": 2}' in model.seen[1]
    with pytest.raises(LimitReached):
        Completion(Script("```sql\nselect nothing from nowhere\n```"), s, Limits(errors=2)).run("x")
    assert Completion(Script("deep"), s, Limits(depth=1), depth=1).run("x") == ("deep", [])
    assert Completion(Script("```sql\ncreate temp view answer_v as select 5 x\n```\n", "FINAL_VAR(answer_v)"), s).run("x")[0] == '{"x": 5}'


def test_explorer_opens_and_stops(spark):
    nodes = spark.createDataFrame([("n1", None, 0.0, 9.0)], "node_id string, parent_id string, s double, e double")
    hits = spark.createDataFrame([("n1", 0.0, 9.0, 0.7)], "node_id string, s double, e double, score double")
    item = spark.createDataFrame([("claim", 0.8, 0.0)], "claim string, confidence double, s double")
    model = Script('think {"action_type": "OPEN", "node_id": "n1", "modality": "visual"}', '{"action_type": "STOP", "answer": "done"}')
    answer, trace = Explorer(nodes, lambda q, m: hits, lambda n, m, q: item, model).run("q")
    assert answer == "done" and [t["action"]["action_type"] for t in trace] == ["OPEN", "STOP"] and trace[1]["state"]["frontier"] == []
    none = item.filter("false")
    assert Explorer(nodes, lambda q, m: none, lambda n, m, q: none, Script('{"action_type": "OPEN", "node_id": "n1"}'), steps=2).run("q")[0].startswith("The budget")
    with pytest.raises(ValueError):
        first_json("nothing here")


def test_a_final_variable_is_given_out_whole(spark):
    s = Session(spark)
    answer, log = Completion(Script("```sql\ncreate or replace temp view many as select id from range(25)\n```\n```sql\nselect * from many\n```", "FINAL_VAR(many)"), s).run("x")
    assert answer.split("\n") == [f'{{"id": {i}}}' for i in range(25)]
    assert log[0]["code_blocks"][1]["stdout"].count("\n") == 19  # what is shown on the way is cut
    assert s.value("no_such_view")[0] is None


def test_limits_have_their_own_errors_and_carry_the_last_response(spark):
    s = Session(spark)
    priced = Script("thinking")
    priced.price = 0.5
    for limits, kind in ((Limits(tokens=3), TokenLimit), (Limits(cost=0.1), CostLimit), (Limits(seconds=-1.0), TimeLimit)):
        with pytest.raises(kind) as caught:
            Completion(priced, s, limits).run("a question")
        assert kind is TimeLimit or caught.value.partial == "thinking"
    with pytest.raises(ErrorLimit):
        Completion(Script("```sql\nselect nope from nowhere\n```"), s, Limits(errors=1)).run("x")
    with pytest.raises(Cancelled):
        Completion(priced, s, cancelled=lambda: True).run("x")


def test_messages_are_compacted(spark):
    model = Script("first thoughts " * 20, "the summary", "FINAL(done)")
    answer, _ = Completion(model, Session(spark), Limits(compact_at=0.5, context_tokens=100)).run("q")
    assert answer == "done" and "the summary" in model.seen[2] and "first thoughts" not in model.seen[2] and "Continue from the summary" in model.seen[2]


def test_sub_questions_run_from_blocks_with_what_is_left(spark):
    class Echo:
        price = 0.001

        def complete(self, prompt, model):
            if prompt == "bad":
                raise RuntimeError("broken")
            return f"<{prompt}>" if prompt in ("one", "two") else "FINAL(ok)" if "<one>" in prompt else '```ask\n["one", "bad", "two"]\n```'

    seen, done = [], []

    def hook(q):
        seen.append(q)
        raise RuntimeError("ignored")

    run = Completion(Echo(), Session(spark), Limits(tokens=1000, cost=9.0, seconds=99.0), on_subcall=hook, on_subcall_done=lambda q, a: done.append((q, a)))
    answer, log = run.run("start")
    assert answer == "ok" and log[0]["code_blocks"][0]["stdout"] == "<one>\nError: broken\n<two>"
    assert sorted(seen) == ["bad", "one", "two"] and dict(done)["bad"] == "Error: broken"
    assert [r["answer"] for r in spark.table("answers_0").orderBy("ord").collect()] == ["<one>", "Error: broken", "<two>"]
    left = run._left()
    assert left.tokens == 1000 - run.spent.tokens < 1000 and left.cost < 9.0 and left.seconds < 99.0


def test_explorer_keeps_all_evidence_and_children(spark):
    nodes = spark.createDataFrame([("n", None, 0.0, 99.0)] + [(f"c{i:02d}", "n", float(i), i + 1.0) for i in range(12)], "node_id string, parent_id string, s double, e double")
    hits = spark.createDataFrame([(f"h{i}", float(i), 9.0, i / 10) for i in range(12)], "node_id string, s double, e double, score double")
    items = spark.createDataFrame([(f"claim {i}", 0.8, float(i)) for i in range(11)], "claim string, confidence double, s double")
    model = Script('{"action_type": "OPEN", "node_id": "n"}', '{"action_type": "SPLIT", "node_id": "n"}', '{"action_type": "STOP", "answer": "a"}')
    _, trace = Explorer(nodes, lambda q, m: hits, lambda n, m, q: items, model, cap=4).run("q", [{"role": "user", "content": str(i)} for i in range(6)], "summarization", {"title": "t"})
    assert [t["found"] for t in trace] == [11, 12, 0] and trace[0]["state"]["frontier"] == ["h10", "h11", "h8", "h9"]
    state = trace[1]["state"]
    assert len(state["evidence"]) == 6 and len(state["dialogue"]) == 4 and state["task_type"] == "summarization" and state["budget"]["evidence"] == 11 and state["global_context"] == {"title": "t"}


def test_conversations_run_in_gold_and_candidate_mode():
    turns = [{"role": "system", "content": "s"}, {"role": "user", "content": "q1"}, {"role": "assistant", "content": "gold1"}, {"role": "user", "content": "q2"}, {"role": "assistant", "content": "gold2"}]
    seen = []

    def answer(question, dialogue):
        seen.append([m["content"] for m in dialogue])
        return f"mine to {question}"

    out = run_conversation(turns, answer)
    assert [t.get("candidate_response") for t in out] == [None, None, "mine to q1", None, "mine to q2"] and seen[1] == ["s", "q1", "gold1", "q2"]
    run_conversation(turns, answer, gold=False)
    assert seen[3] == ["s", "q1", "mine to q1", "q2"]
    with pytest.raises(ValueError):
        run_conversation([{"role": "assistant", "content": "x"}], answer)


def test_the_judge_is_asked_up_to_three_times(spark):
    class Judge:  # inside, so that it travels to the workers by value
        """Reads its verdict out of the prompt; the first reply to each is unreadable."""

        def __init__(self):
            self.asked = {}

        def complete(self, prompt, model):
            self.asked[prompt] = self.asked.get(prompt, 0) + 1
            if "never" in prompt or self.asked[prompt] == 1:
                return "hm " * 600
            return '```json\n{"criteria_met": %s}\n```' % ("true" if "good" in prompt else "false")

    rows = spark.createDataFrame([(1, "good"), (2, "poor"), (3, "never"), (4, None)], "id int, prompt string")
    got = {r["id"]: r for r in lm.judged(rows, Judge).collect()}
    assert [(got[i]["criteria_met"], got[i]["attempts"]) for i in (1, 2, 3, 4)] == [(True, 2), (False, 2), (None, 3), (False, 2)]
    assert got[3]["evaluation_error"].startswith("no verdict") and len(got[3]["evaluation_raw"]) == 1000 and got[1]["evaluation_error"] is None
    assert lm.judged(rows.filter("false"), Judge).count() == 0


def test_whole_batches_fail_together(spark):
    req = spark.createDataFrame([("a", 0, "x", None), ("a", 1, "bad", None), ("b", 0, "y", None)], "batch_id string, ord int, prompt string, model string")
    got = {(r["batch_id"], r["ord"]): r["response"] for r in lm.query_batches(req, lambda: lm.Scripted(fail_on="bad"), whole_batch=True).collect()}
    assert got == {("a", 0): "Error: no answer to bad", ("a", 1): "Error: no answer to bad", ("b", 0): "echo: y"}


def test_media_hooks(spark):
    df = spark.createDataFrame([("a.wav", 1.0), ("b.wav", None)], "path string, s double")
    said = lm.with_hook(df, "speech", lambda: lambda p, s: [{"text": p, "span_start": s, "span_end": 2.0, "speaker": None, "language": "en"}] if s else None, "path", "s")
    assert [r["found"] and r["found"][0]["text"] for r in said.orderBy("path").collect()] == ["a.wav", None]
    seen = lm.with_hook(df, "vision", lambda: lambda p: {"summary": p, "tags": ["t"], "entities": []}, "path")
    assert {(r["found"]["summary"], tuple(r["found"]["tags"])) for r in seen.collect()} == {("a.wav", ("t",)), ("b.wav", ("t",))}
    texts = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None)], "id int, t string")
    assert {r["id"]: r["embedding"] for r in lm.embedded(texts, "t", lambda: lambda t: [float(len(t)), 1.0]).collect()} == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: None}
    with pytest.raises(ValueError):
        lm.with_hook(df, "smell", lambda: None, "path")
