import json
import re
from pathlib import Path

import pytest

from spanforge.llm import pair_defects as module
from spanforge.llm.pair_defects import _read, _verdict, clauses, defect_of, defects_of, features, fit, fitted, labelled_pairs, pair_defects, question_of, unwrapped

Q = "Why does the cook put the kettle under the bridge?"
CONTEXT = f"Context:\nThe kettle is heavy.\n---\n{Q}"


@pytest.mark.parametrize(
    "prompt, response, defect",
    [
        (Q, None, "empty"), (Q, " \n", "empty"), (Q, "<think>\nhm, the user asks\n</think>\n", "empty"), (Q, "FINAL()", "empty"), (Q, '{"answer": ""}', "empty"), (Q, "```\n```", "empty"), (Q, "**  **", "empty"), (Q, "...", "empty"),
        (Q, "The cook lifts the kettle. Then she puts it under the", "truncated"), (Q, "The cook lifts the kettle. She moves it to the bri", "truncated"), (Q, '{"answer": "The cook lifts the kettle.", "evid', "truncated"),
        (Q, "The cook lifts it.\n```python\nfor s in spans:\n    if s.start > 3", "truncated"), (Q, "FINAL(The cook lifts the kettle and", "truncated"),
        (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "AS AN ASSISTANT, I WON'T DESCRIBE THIS FOOTAGE. PLEASE TRY A DIFFERENT QUESTION.", "refusal"), (Q, "That is against my guidelines.", "refusal"),
        ("Warum steht der Kessel unter der Brücke?", "Leider darf ich diese Frage nicht beantworten.", "refusal"), ("¿Por qué está la tetera bajo el puente?", "Lo siento, pero no puedo ayudar con esa petición.", "refusal"), ("Pourquoi la bouilloire est sous le pont ?", "Je ne suis pas en mesure de décrire cet extrait.", "refusal"),
        (Q, Q, "copied_question"), (CONTEXT, Q.upper(), "copied_question"), (CONTEXT, CONTEXT, "copied_question"), (json.dumps([{"role": "user", "content": Q}]), f'"{Q}"', "copied_question"),
        (Q, "Der Koch hebt den Kessel, weil er unter der Brücke nicht nass wird.", "other_language"), ("Warum steht der Kessel unter der Brücke?", "The kettle is there because the seal was leaking.", "other_language"),
        (Q, "The cook lifts the kettle because the seal was leaking.", None), (Q, "Kettle", None), (Q, "at 12:07", None), (Q, "no", None), (Q, "- The cook lifts the kettle\n- The potter waits at the harbor market", None),
        (Q, f"You asked: {Q} The seal was leaking, so the cook moved it.", None), (Q, 'The guest says "I\'m sorry, I can\'t help you with that" and walks away. The cook lifts the kettle.', None), (Q, 'The sign reads "Bitte abonnieren für mehr Kupferdraht". The cook waits.', None),
        (Q, "Sorry for the mix-up: The cook lifts the kettle because the seal was leaking.", None), (Q + " Please reply in German.", "Der Koch hebt den Kessel, weil die Dichtung undicht war.", None), (Q, '```json\n{"answer": "The cook lifts the kettle."}\n```', None),
        (Q, "I have to pass on this one.", "refusal"), (Q, "My apologies, but assisting with it isn't possible for me.", "refusal"), (Q, "Behind the fountain, next to a bench", None), (Q, "I can't say for certain, but it looks like the fountain.", None), (Q, "The guest describes the kettle and helps the cook.", None),
        (None, "The cook lifts the kettle.", None), ("", "Der Koch hebt den Kessel.", None),
    ],
)
def test_cases(prompt, response, defect):
    assert defect_of(prompt, response, fitted()) == defect


def test_held_out_clauses_are_labelled_right():
    right = total = 0
    for prompt, response, labels in labelled_pairs(400, 99):
        question, whole = question_of(prompt)
        text, flags = unwrapped(response)
        got = fitted().decode(features(clauses(text), question, whole, flags, text))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.97


def test_defects_of_held_out_frames():
    """Sentences, questions, leads and refusals that the model was not fitted on."""
    true, said, hit = {}, {}, {}
    for prompt, response, labels in labelled_pairs(1500, 7, held_out=True):
        parts, _, flags, text = _read(prompt, response)
        want, got = _verdict(parts, labels, flags, text) or "fine", defect_of(prompt, response, fitted()) or "fine"
        true[want], said[got] = true.get(want, 0) + 1, said.get(got, 0) + 1
        hit[want] = hit.get(want, 0) + (want == got)
    assert set(true) == {"fine", "truncated", "refusal", "copied_question", "other_language"}
    for kind, n in true.items():
        assert hit[kind] / n >= 0.9 and hit[kind] / said[kind] >= 0.9, (kind, hit[kind], n, said[kind])


def test_no_frame_is_a_sentence_of_the_tables():
    pq = pytest.importorskip("pyarrow.parquet")
    path = Path("/root/testdata/sf0.01/completions.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    everything = "\0".join(x.lower() for c in ("prompt", "response") for x in pq.read_table(path, columns=[c])[c].to_pylist() if x)
    frames = [f for t in (module._SENTENCES, module._QUESTIONS, module._POLICY, module._HEDGES, module._SPOTS) for fs in t.values() for f in fs]
    frames += [lead for fs in module._LEADS.values() for lead, asks in fs if not asks]
    parts = [p.strip().lower() for f in frames for p in re.split(r"\{\w\}", f) if len(p.strip()) >= 14]
    assert len(parts) > 80 and [p for p in parts if p in everything] == []


def test_saved_weights_are_those_of_the_fit():
    again, saved = fit(), fitted()
    pairs = list(labelled_pairs(200, 3))
    rows = [_read(p, r)[1] for p, r, _ in pairs]
    assert again.decode_all(rows) == saved.decode_all(rows) == [saved.decode(x) for x in rows]
    assert defects_of([None, "x"], [None, "..."], saved) == ["empty", "empty"] and saved.decode_all([]) == [] and saved.decode_all([[]]) == [[]]


def test_table_with_repeats_long_texts_and_no_rows(spark):
    rows = [(1, Q, None, 0), (1, Q, None, 0), (2, Q, "The kettle is heavy. " * 3000, 0), (3, None, "", 0)]
    df = spark.createDataFrame(rows, "completion_id bigint, prompt string, response string, defect int")
    assert sorted(tuple(r) for r in pair_defects(df).collect()) == [(1, "empty"), (3, "empty")]
    assert pair_defects(df.filter("false")).count() == 0
