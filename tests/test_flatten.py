import json

from spanforge.operators.flatten import flat_tables, record_paths, related_json, related_tables
from spanforge.schemas import ITERATION

CALL = {"root_model": "m", "prompt": "p", "response": "r"}


def paths(spark, lines, typed=()):
    log = spark.createDataFrame([(i, "r", line, "clash") for i, line in enumerate(lines)], "line_id bigint, run_id string, line string, record_path string")
    table = spark.createDataFrame(list(typed), ITERATION) if typed else None
    return sorted((r["run_id"], r["iteration"], r["record_path"]) for r in record_paths(table, log).collect())


def line(**fields):
    return json.dumps({"type": "iteration", "iteration": 1} | fields)


def test_shapes_of_prompts_blocks_and_calls(spark):
    got = paths(
        spark,
        [
            line(prompt=[{"role": "user", "content": "a"}, None, {"role": "user", "content": "b"}], code_blocks=[None, {"code": "x", "result": {"rlm_calls": [CALL, None, CALL]}}]),
            json.dumps({"type": "iteration", "iteration": 2, "prompt": "one text", "code_blocks": {"code": "x", "result": json.dumps({"llm_calls": json.dumps(CALL)})}}),
            json.dumps({"type": "iteration", "iteration": 3, "prompt": {"messages": [{"role": "user", "content": "x"}]}, "code_blocks": None}),
            json.dumps({"type": "iteration", "iteration": 4, "prompt": json.dumps([{"role": "user"}, {"role": "user"}])}),
            json.dumps({"type": "iteration", "iteration": 5, "prompt": [], "code_blocks": [{"code": "x", "result": None}]}),
        ],
    )
    assert got == sorted(
        [("r", 1, p) for p in ("m0", "m2", "b1", "b1.c0", "b1.c2")] + [("r", 2, p) for p in ("m0", "b0", "b0.c0")] + [("r", 3, "m0"), ("r", 4, "m0"), ("r", 4, "m1"), ("r", 5, "b0")]
    )


def test_trajectories_in_calls_several_levels_down(spark):
    inner = {"prompt": "q", "code_blocks": [{"code": "y", "result": {"rlm_calls": [CALL]}}]}
    middle = {"prompt": [{"role": "user", "content": "q"}], "code_blocks": [{"code": "y", "result": {"rlm_calls": [CALL | {"metadata": {"iterations": [None, inner]}}]}}]}
    outer = line(prompt=None, code_blocks=[{"code": "x", "result": {"rlm_calls": [CALL | {"metadata": json.dumps({"iterations": middle})}, CALL | {"metadata": {}}, CALL | {"metadata": None}]}}])
    got = [p for _, _, p in paths(spark, [outer, outer])]
    a = "b0.c0/i0."
    b = a + "b0.c0/i1."
    assert got == sorted(["b0", "b0.c0", "b0.c1", "b0.c2", a + "m0", a + "b0", a + "b0.c0", b + "m0", b + "b0", b + "b0.c0"])


def test_unreadable_and_foreign_lines_are_no_records(spark):
    assert paths(spark, [None, "", "  ", "null", "[]", "{", line(prompt="x")[:-4], '{"type": "metadata", "iteration": 1}', '{"type": "iteration"}']) == []


def test_typed_rows_and_empty_tables(spark):
    typed = [("t", 7, None, [("user", "a"), None], None, [None, ("c", ("o", "e", {"k": "v"}, 1.0, [("m", "p", "r", 1.0)], None))], None, None), ("t", 8, None, None, None, None, None, None)]
    assert paths(spark, [], typed) == [("t", 7, "b1"), ("t", 7, "b1.c0"), ("t", 7, "m0")]


def test_every_row_names_its_parent(spark):
    log = spark.createDataFrame([("r", line(prompt="x", code_blocks=[{"code": "x", "result": {"rlm_calls": [CALL]}}]))], "run_id string, line string")
    flat = flat_tables(None, log)
    one = {k: [(r["parent_path"], r["record_path"]) for r in flat[k].collect()] for k in ("iterations", "messages", "blocks", "calls")}
    assert one == {"iterations": [(None, "")], "messages": [("", "m0")], "blocks": [("", "b0")], "calls": [("b0", "b0.c0")]}


def test_tables_of_any_schema(spark):
    schema = "k int, a struct<b:int,c:array<struct<d:string,e:array<int>>>>, f array<array<string>>, g map<string,int>"
    rows = [(1, (5, [("x", [1, None, 3]), None, ("y", [])]), [["p"], None, ["q", "r"]], {"m": 1}), (2, None, None, None), (3, (None, []), [], None)]
    t = related_tables(spark.createDataFrame(rows, schema), ["k"])
    assert sorted(t) == ["", "a_c", "a_c/e", "f", "f/value"]
    assert sorted((r["k"], r["a_b"]) for r in t[""].collect()) == [(1, 5), (2, None), (3, None)]
    assert [(r["k"], r["parent_id"], r["record_id"], r["ordinal"], r["d"]) for r in t["a_c"].orderBy("ordinal").collect()] == [(1, "", "/a_c0", 0, "x"), (1, "", "/a_c2", 2, "y")]
    assert [(r["record_id"], r["value"]) for r in t["a_c/e"].orderBy("ordinal").collect()] == [("/a_c0/e0", 1), ("/a_c0/e2", 3)]
    assert sorted((r["parent_id"], r["ordinal"], r["value"]) for r in t["f/value"].collect()) == [("/f0", 0, "p"), ("/f2", 0, "q"), ("/f2", 1, "r")]


def test_a_schema_is_merged_from_texts(spark):
    lines = ['{"a": 1, "b": [{"c": [1, 2]}, {"c": []}]}', '{"a": 2, "e": {"f": [true]}, "b": [{"d": "x"}]}', "broken", None, ""]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    t = related_json(df, ["id"], "line")
    assert sorted(t) == ["", "b", "b/c", "e_f"]
    assert sorted((r["id"], r["a"]) for r in t[""].collect()) == [(0, 1), (1, 2)]
    assert sorted((r["id"], r["record_id"], r["d"]) for r in t["b"].collect()) == [(0, "/b0", None), (0, "/b1", None), (1, "/b0", "x")]
    assert sorted((r["parent_id"], r["value"]) for r in t["b/c"].collect()) == [("/b0", 1), ("/b0", 2)]
    assert related_json(df.filter("id > 1"), ["id"], "line")[""].count() == 0
