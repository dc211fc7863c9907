from pathlib import Path

import numpy as np
import pytest

from spanforge.llm.bilstm import BiLstmCrf
from spanforge.llm import pii
from spanforge.llm.pii import OVERLAP, WINDOW, _joined, find_items, load_model, redacted, tag_texts, windows
from spanforge.llm.pii_texts import _DECOYS, _ITEMS, _PLAIN, _part, frames, literals
from spanforge.llm.train_pii import accuracy

DOCS = "doc_id bigint, text string, pii_type int"
LEXICON = frozenset({"grace", "haldersby", "wiebke", "lindgräber", "rose"})


def found(text):
    return {(k, text[a:b]) for a, b, k in tag_texts([text], LEXICON, load_model())[0]}


def test_gradients_agree_with_differences():
    model, rng = BiLstmCrf.new(20, 4, 5, 6), np.random.default_rng(0)
    ids, lengths = rng.integers(1, 20, (7, 3)), np.array([7, 5, 3])
    for j, n in enumerate(lengths):
        ids[n:, j] = 0
    gold = rng.integers(0, 4, (7, 3))
    _, grads = model.gradients(ids, gold, lengths)
    for name in ("Uf", "Wb", "bf", "out", "trans", "start"):
        at = tuple(s // 2 for s in model.p[name].shape)
        kept, values = model.p[name][at], []
        for step in (1e-2, -1e-2):
            model.p[name][at] = kept + step
            model._tables()
            values.append(model.gradients(ids, gold, lengths)[0])
        model.p[name][at] = kept
        model._tables()
        assert (values[0] - values[1]) / 2e-2 == pytest.approx(float(grads[name][at]), abs=2e-3)


def test_decoding_is_the_best_path():
    import itertools

    model, rng = BiLstmCrf.new(12, 3, 4, 5, seed=9), np.random.default_rng(1)
    model.p["trans"][:] = rng.normal(0, 1, (3, 3))
    ids, lengths = rng.integers(1, 12, (5, 6)), np.array([5, 4, 3, 5, 1, 2])
    for j, n in enumerate(lengths):
        ids[n:, j] = 0
    emit, (tags, _) = model.emissions(ids), model.decode(ids, lengths)
    for j, n in enumerate(lengths):
        score = lambda p: model.p["start"][p[0]] + sum(emit[t, j, p[t]] for t in range(n)) + sum(model.p["trans"][a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert score(tuple(tags[:n, j])) == pytest.approx(max(score(p) for p in itertools.product(range(3), repeat=int(n))), abs=1e-4)


@pytest.mark.parametrize("length", [1, WINDOW, WINDOW + 1, 5000])
def test_windows_cover_the_text(length):
    w = windows(length)
    assert w[0][0] == 0 and w[-1][1] == length and all(b - a <= WINDOW for a, b in w)
    assert all(x[1] - y[0] == OVERLAP for x, y in zip(w, w[1:]))


@pytest.mark.parametrize(
    "text, items",
    [
        ("My name is Grace Haldersby and I appear at 4:12, please blur me.", {("name", "Grace Haldersby")}),
        ("Then Dr. Grace Haldersby's badge lists SSN 956-16-2641 and the phone (617) 555-0140.", {("name", "Grace Haldersby"), ("id_number", "956-16-2641"), ("phone", "(617) 555-0140")}),
        ("Questions go to grace_haldersby69@example.org. Sample 144 of run 20260114-0031 was re-indexed.", {("email", "grace_haldersby69@example.org")}),
        ("Send the raw files to grace underscore haldersby52 at crew dot example dot org when you can.", {("email", "grace underscore haldersby52 at crew dot example dot org")}),
        ("Mit freundlichen Grüßen\nWiebke Lindgräber\nWeidengasse 147\n89222 Nordhaven", {("name", "Wiebke Lindgräber"), ("address", "Weidengasse 147")}),
        ("Se grabó en Calle Mirasol, n.º 74 el segundo día.", {("address", "Calle Mirasol, n.º 74")}),
        ("Autorisation signée par Solène Durandière, passeport n° 41XZ97459.", {("name", "Solène Durandière"), ("id_number", "41XZ97459")}),
        ("Will this clip work in May, or is rose gold too bright at 315:51?", set()),
        ("The Slow Kitchen crew packs the Norvel Kettle 431 after take 7. Follow @slowkitchen, frame 342.", set()),
    ],
)
def test_items_of_texts(text, items):
    assert found(text) == items


#: What is reached on held-out frames and names, without a lexicon; names stay below 0.9 (see the README).
HELD_OUT = {"name": (0.8, 0.55), "email": (0.95, 0.95), "phone": (0.95, 0.95), "id_number": (0.95, 0.95), "address": (0.9, 0.95)}


def test_texts_of_held_out_frames_and_names():
    for kind, (precision, recall, items) in accuracy(load_model(), 200).items():
        assert items > 25 and precision >= HELD_OUT[kind][0] and recall >= HELD_OUT[kind][1], (kind, precision, recall)


def test_texts_of_known_frames_with_a_partial_lexicon():
    for kind, (precision, recall, _) in accuracy(load_model(), 200, 5, False, True).items():
        assert precision > 0.85 and recall > 0.85, (kind, precision, recall)


def test_training_shares_no_sentence_with_the_tables():
    pq = pytest.importorskip("pyarrow.parquet")
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test tables here")
    columns = {"documents": ["text"], "speech_spans": ["text"], "ocr_spans": ["text"], "visual_spans": ["summary"], "completions": ["prompt", "response"]}
    texts = [t.lower() for n, cs in columns.items() for c in cs for t in pq.read_table(folder / f"{n}.parquet", columns=[c])[c].unique().to_pylist() if t]
    everything = "\0".join(texts)
    assert len(frames()) > 400
    assert not [(p, f) for f in frames() for p in literals(f) if p.lower() in everything]


def test_held_out_frames_and_names_are_not_trained_on():
    for table in (_ITEMS, _DECOYS, _PLAIN):
        for trained, held in table.values():
            assert held and not set(trained) & set(held)
    assert not set(_part(list(range(40)), True)) & set(_part(list(range(40)), False))


@pytest.mark.parametrize("n", [30, 200, 900])
def test_items_longer_than_the_overlap_are_whole(n):
    address = "a" * n + "@example.org"
    for shift in (0, 150, 300, 350):
        text = "word " * (shift // 5) + f"Write to {address} today. " + "word " * 40
        assert ("email", address) in found(text)


def test_cut_parts_are_joined_only_without_a_whole_one():
    assert _joined([(1, 0, 300, 384, "address"), (2, 0, 288, 672, "address"), (1, 0, 576, 700, "address")]) == [(1, 0, 288, 700, "address")]
    assert _joined([(1, 0, 300, 384, "name"), (0, -9, 310, 390, "name")]) == [(0, -9, 310, 390, "name")]


def test_long_texts_are_read_whole_and_windows_agree():
    filler = "The borrowed kettle stays in frame until the camera pans to the table. "
    text = filler * 60 + "You can reach Grace Haldersby at grace.haldersby@example.com or call 202-555-0105. " + filler * 3
    for shift in range(0, WINDOW, 37):
        assert ("email", "grace.haldersby@example.com") in found("x" * shift + " " + text)


def test_tables(spark):
    lexicon = spark.createDataFrame([("Grace", "given"), (None, "given"), ("Haldersby", "family")], "name string, kind string")
    text = "Thanks Grace! Send the files to grace.haldersby@example.com. 😀 Only 3 parts were reused."
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (1, text, 0)], DOCS)
    got = find_items(docs, lexicon).collect()
    assert {(r["doc_id"], r["pii_type"], r["pii_text"]) for r in got} == {(1, "name", "Grace"), (1, "email", "grace.haldersby@example.com")} and len(got) == 4
    assert all(text[r["item_start"] : r["item_end"]] == r["pii_text"] for r in got)
    clean = {r["doc_id"]: r["text"] for r in redacted(docs, lexicon).collect()}
    assert clean == {1: "Thanks [NAME]! Send the files to [EMAIL]. 😀 Only 3 parts were reused.", 2: None, 3: ""}
    assert find_items(docs.filter("false"), lexicon.filter("false")).count() == 0


def test_a_large_lexicon_is_joined_with_the_same_result(spark, monkeypatch):
    lexicon = spark.createDataFrame([("Grace", "given"), ("Haldersby", "family"), (None, "x")], "name string, kind string")
    texts = ["Then Dr. Grace Haldersby's badge lists SSN 956-16-2641.", "Thanks Grace!", "", None, "Grace " * 400]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS)
    few = sorted(map(tuple, find_items(docs, lexicon).collect()))
    monkeypatch.setattr(pii, "MAX_LEXICON", 1)
    assert pii.names_of(lexicon) is None and sorted(map(tuple, find_items(docs, lexicon).collect())) == few and few
