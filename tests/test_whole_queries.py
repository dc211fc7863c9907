"""Queries that go over everything: checked level by level, against brute force and beyond the old cuts."""

import math
import random
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest

from spanforge.plans import memory_queries as mq
from spanforge.plans import registry
from spanforge.plans import trajectory_queries as tq

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view \"{p.stem}\" as select * from '{p}'")
    return con


def rows_of(spark, name):
    return registry.all_queries()[name](spark, str(DATA)).collect()


LEVEL_SQL = {"scene": mq._SCENE_NODES, "segment": mq._SEGMENT_NODES, "clip": mq._CLIP_NODES}


@tables
def test_search_goes_over_scenes_segments_and_clips(spark, duck):
    """The SQL of one level, run for each level and put together."""
    sql = registry.all_sql()
    reasons, hits = Counter(), []
    for nodes in LEVEL_SQL.values():
        reasons.update(duck.execute(sql["rt7_reasons"].replace(mq._ALL_NODES, nodes)).fetchall())
        hits += duck.execute(f"{mq._HITS.replace(mq._ALL_NODES, nodes)} select video_id, node_id, modality, round(score, 4), s from hits").fetchall()
    assert Counter((r["node_id"], r["reason"]) for r in rows_of(spark, "rt7_reasons")) == reasons
    assert {"_seg_" in n for n, _ in reasons} == {"_clip_" in n for n, _ in reasons} == {True, False}
    best = {}
    for h in sorted(hits, key=lambda h: (-h[3], h[4], h[1])):
        best.setdefault(h[0], []).append(h)
    want = {(v, h[1], h[2], h[3], i + 1) for v, hs in best.items() for i, h in enumerate(hs[:5])}
    assert {(r["video_id"], r["node_id"], r["modality"], r["score"], r["rank"]) for r in rows_of(spark, "tk1_search")} == want
    frontier = rows_of(spark, "tk3_initial_frontier")
    assert {(r["node_id"], r["rank"]) for r in frontier if r["video_id"] in best} == {(h[1], i + 1) for hs in best.values() for i, h in enumerate(hs[:8])}


@tables
def test_inverted_index_holds_scenes_segments_and_clips(spark, duck):
    want = Counter()
    for nodes in LEVEL_SQL.values():
        for token, modality, n in duck.execute(registry.all_sql()["jn8_inverted_index"].replace(mq._ALL_NODES, nodes)).fetchall():
            want[token, modality] += n
    assert {(r["token"], r["modality"]): r["nodes"] for r in rows_of(spark, "jn8_inverted_index")} == want


def written(spark, folder, **tables):
    """A folder of small tables, given as (rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


COMPLETIONS = "completion_id bigint, run_id string, total_cost double, total_input_tokens bigint, total_output_tokens bigint, execution_time double, created_at timestamp"


def test_running_limits_go_by_time(spark, tmp_path):
    """Ids fall as time goes on; the late second row of call 3 changes nothing."""
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    calls = [(3, "r", 0.03, 10, 1, 1.0, at(1)), (3, "r", 0.03, 10, 1, 1.0, at(9)), (2, "r", 0.015, 10, 1, 1.0, at(2)), (1, "r", 0.02, 10, 1, 58.5, at(3)), (7, "q", None, None, None, None, None)]
    got = {r["completion_id"]: r for r in tq.wn3_running_limits(spark, written(spark, tmp_path, completions=(calls, COMPLETIONS))).collect()}
    assert {k: (r["cost"], r["tokens"], r["seconds"], r["over_cost"], r["over_time"]) for k, r in got.items()} == {
        3: (0.03, 11, 1.0, False, False), 2: (0.045, 22, 2.0, False, False), 1: (0.065, 33, 60.5, True, True), 7: (0.0, 0, 0.0, False, False),
    }


def test_candidates_of_documents_in_any_language(spark, tmp_path):
    """Against brute force over three sentences: the heuristic snippet first, then what the head, the tail and
    the windows around the sentences give, each once. The language changes nothing."""
    text = "The cook opens the kettle. The tripod is broken. He repairs it because the water is cold."
    langs = ["en", "EN", "en-XX", "de", "fr", "und", None]
    docs = [(i, text, lang) for i, lang in enumerate(langs)] + [(90, None, "de"), (91, "", "fr")]
    rows = mq.rt20_candidates(spark, written(spark, tmp_path, documents=(docs, "doc_id bigint, text string, lang string"))).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["candidate"]):
        by.setdefault(r["doc_id"], []).append(r["snippet"])
    assert set(by) == set(range(len(langs))) and all(v == by[0] for v in by.values())
    parts = text.replace(". ", ".|").split("|")
    pieces = {" ".join(parts[a:b]) for a in range(3) for b in range(a + 1, 4)}
    assert len(by[0]) == len(set(by[0])) and set(by[0]) <= pieces and text in by[0]


@pytest.mark.parametrize("block", [2048, 2])
def test_every_query_vector_meets_every_vector(spark, tmp_path, monkeypatch, block):
    """Against brute force, in one block and in several."""
    monkeypatch.setattr(mq, "QUERY_BLOCK", block)
    rng = random.Random(3)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(8)] for i in range(0, 520, 20)} | {7: [0.0] * 8}
    folder = written(spark, tmp_path, embeddings=(list(vectors.items()), "vec_id bigint, embedding array<double>"))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    norm = lambda a, b: math.sqrt(dot(a, a) * dot(b, b))
    want = {(q, v): max(0.0, dot(a, b) / norm(a, b)) if norm(a, b) else 0.0 for q, a in vectors.items() if q % 100 == 0 for v, b in vectors.items()}
    got = mq.rt3_semantic(spark, folder).collect()
    assert len(got) == len(want) == 6 * 27
    assert {(r["query_id"], r["vec_id"]): r["similarity"] for r in got} == pytest.approx(want, abs=1e-4)


RESULT = "struct<stdout:string,stderr:string,locals:map<string,string>>"
ITERATIONS = f"run_id string, iteration int, response string, code_blocks array<struct<code:string,result:{RESULT}>>"


def test_execution_messages_are_whole(spark, tmp_path):
    """All of the code and of a result of up to 20,000 characters; of a longer one the beginning and what is left."""
    code = "x = 1\n" * 500
    blocks = [(code, ("o" * 19_999, None, None)), (code, ("o" * 30_000, None, None)), (code, ("out", "err", {"a": "1", "_b": "2"}))]
    folder = written(spark, tmp_path, iterations=([("r", 1, "said", blocks), ("r", 2, "said", None)], ITERATIONS))
    got = {r["pos"]: r["content"] for r in tq.sc9_execution_messages(spark, folder).collect()}
    head = f"Code executed:\n```python\n{code}\n```\n\nREPL output:\n"
    assert got == {
        1: head + "\n" + "o" * 19_999, 2: head + "\n" + "o" * 19_999 + "... + [10001 chars...]",
        3: head + "\nout\n\n\nerr\n\nREPL variables: ['a']\n",
    }


@tables
def test_execution_messages_agree_with_the_history_of_the_sql(spark, duck):
    want = duck.execute(f"with {tq._HIST} select run_id, iteration, pos, content from h where role = 'user'").fetchall()
    assert max(len(w[3]) for w in want) < 20_000  # the SQL has no cut
    assert Counter(tuple(r) for r in rows_of(spark, "sc9_execution_messages")) == Counter(want)


def test_the_whole_history_of_a_run_is_compacted(spark, tmp_path):
    """Against brute force: a run whose second message is in its second iteration, one that begins later, one of one message."""
    block = ("print(1)", ("1", None, None))
    its = [("a", 1, "a1", None), ("a", 2, "a2", [block]), ("a", 3, "a3", None), ("b", 4, "b4", [block, block]), ("b", 5, "b5", [block]), ("c", 2, "c2", [])]
    folder = written(spark, tmp_path, iterations=(its, ITERATIONS))
    ran = "Code executed:\n```python\nprint(1)\n```\n\nREPL output:\n\n1"
    history = {}
    for run, _, response, blocks in its:
        history.setdefault(run, []).extend([("assistant", response)] + [("user", ran)] * len(blocks or []))
    end = [(2, "assistant", "summary"), (3, "user", "Continue from the summary above.")]
    want = sorted((run, *m) for run, said in history.items() for m in [(i, *x) for i, x in enumerate(said[:2])] + end)
    assert sorted(tuple(r) for r in tq.ct3_compacted(spark, folder).select("run_id", "ord", "role", "content").collect()) == want


def test_filters_keep_every_run_that_matches(spark, tmp_path):
    runs = [(f"r{i:03d}", None if i % 7 == 0 else "b", ("local", "docker", "modal", None)[i % 4]) for i in range(200)]
    folder = written(spark, tmp_path, runs=(runs + runs[:30], "run_id string, backend string, environment_type string"))
    want = [r for r in runs if r[1] and r[2] in ("local", "docker")]
    assert len(want) > 25 and sorted(tuple(r) for r in tq.prj7_filters(spark, folder).collect()) == want
