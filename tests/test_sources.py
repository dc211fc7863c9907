import json

from pyspark.sql import functions as F

from spanforge.schemas import KINDS
from spanforge.sources import files as fl
from spanforge.streaming import logs


def test_jsonl_append_and_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, n int")
    assert fl.not_done(df, path, "sample_id").count() == 2
    fl.append_jsonl(df.filter("n = 1"), path)
    assert [r["sample_id"] for r in fl.not_done(df, path, "sample_id").collect()] == ["b"]


def test_unreadable_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    got = fl.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").cache()
    assert sorted(r["a"] for r in got.filter("_corrupt is null").collect()) == [1, 2] and got.filter("_corrupt is not null").count() == 1


def test_artifacts_round_trip_with_a_missing_kind(spark, tmp_path):
    speech = spark.createDataFrame([("v", 0, "hi", 0.0, 1.0, "s", "en")], f"video_id string, ord int, {KINDS['speech']}")
    head = spark.createDataFrame([("v", 9.0, {"k": "x"}), ("w", None, None)], "video_id string, duration_seconds double, metadata map<string,string>")
    fl.save_artifacts({"speech": speech}, head, str(tmp_path))
    got = fl.load_artifacts(spark, str(tmp_path))
    assert got["ocr"].count() == 0 and got["speech"].first()["text"] == "hi"
    assert sorted((r["video_id"], r["speech_count"]) for r in got["manifest"].collect()) == [("v", 1), ("w", 0)]


def test_memory_documents_and_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"video_id": "v", "root_id": "v_video", "nodes": {"v_video": {"level": "video"}, "v_scene_001": {"level": "scene"}}}, indent=2))
    nodes = fl.memory_document(spark, str(tmp_path / "m.json"), "level string")
    assert sorted(r["node_id"] for r in nodes.collect()) == ["v_scene_001", "v_video"]
    fl.save_memory(nodes, str(tmp_path / "t"))
    assert fl.load_memory(spark, str(tmp_path / "t")).filter("video_id = 'v'").count() == 2
    assert fl.load_memory(spark, str(tmp_path / "t"), "v").count() == 2 and fl.load_memory(spark, str(tmp_path / "t"), "w").count() == 0


def test_samples_are_filtered_and_ordered(spark, tmp_path):
    rows = [{"sample_id": f"s{i}", "video_id": f"v{i % 2}", "task": "t" if i < 3 else "u"} for i in (3, 1, 0, 2)]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = fl.load_samples(spark, str(tmp_path / "s.jsonl"), limit=2, tasks=["t"]).collect()
    assert [r["sample_id"] for r in got] == ["s0", "s2"]


def test_logs_files_and_urls(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"type": "metadata"}\nbroken\n{"type": "iteration", "iteration": 1}\n')
    assert {k: v.count() for k, v in fl.read_log(spark, str(tmp_path / "log.jsonl")).items()} == {"metadata": 1, "iterations": 1}
    (tmp_path / "d" / "deep").mkdir(parents=True)
    for p in ("a.mp4", "deep/a.mkv", "deep/b.webm", "c.txt"):
        (tmp_path / "d" / p).write_bytes(b"x")
    got = {r["stem"]: r["path"].split("/d/")[1] for r in fl.find_files(spark, str(tmp_path / "d")).collect()}
    assert got == {"a": "a.mp4", "b": "deep/b.webm"}
    assert spark.range(1).select(fl.data_url(F.lit(b"abc"))).first()[0] == "data:image/jpeg;base64,YWJj"


def test_traces_and_reports(spark, tmp_path):
    steps = spark.createDataFrame([("v", "s1", 0, "{}", "{}", "{}", "{}")], "video_id string, sample_id string, turn int, state string, action string, observation string, next_state string")
    fl.write_trace(steps, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 1
    assert fl.training_examples(steps, str(tmp_path / "e")).columns == ["video_id", "state", "gold_action", "observation", "next_state"]
    fl.write_report(spark.createDataFrame([("a: 1",)], "line string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "a: 1"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"key": k, "at": f"2026-01-01T00:{m:02d}:00"} for k, m in (("a", 0), ("a", 1), ("b", 7), ("a", 50))]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, lines)))
    stream = logs.log_stream(spark, str(tmp_path / "in"), "key string, at timestamp")
    logs.into_ledger(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert run(logs.windowed_counts(stream, "at", "key"), "counts").agg(F.sum("n")).first()[0] == 3
    assert run(logs.first_of_key(stream, "at", "key"), "firsts").count() == 2
    assert run(logs.sessions(stream, "at", "key", "5 minutes", "1 minute"), "sess").count() == 2


def test_step_logs_are_read_again(spark, tmp_path):
    steps = spark.createDataFrame([("v", 1, "OPEN"), ("v", 2, "STOP")], "video_id string, step int, action_type string")
    fl.append_steps(steps.limit(1).select("video_id"), steps, str(tmp_path / "log"))
    got = fl.read_log(spark, str(tmp_path / "log"))
    assert got["metadata"].count() == 1 and fl.read_steps(spark, str(tmp_path / "log")).count() == 2 and got["iterations"].count() == 0
