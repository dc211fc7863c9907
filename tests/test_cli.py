from spanforge.cli import main


def test_commands(spark, tmp_path, capsys):
    main(["queries"])
    assert "tk1_search" in capsys.readouterr().out
    folder = tmp_path / "data"
    spark.createDataFrame([("v", 60.0, None)], "video_id string, duration_seconds double, metadata map<string,string>").write.parquet(f"{folder}/artifacts.parquet")
    spark.createDataFrame([("v", 0, "the red kettle", 1.0, 2.0, None, None)], "video_id string, ord int, text string, span_start double, span_end double, speaker string, language string").write.parquet(f"{folder}/speech_spans.parquet")
    spark.createDataFrame([], "video_id string, ord int, summary string, span_start double, span_end double, granularity string, tags array<string>, entities array<string>").write.parquet(f"{folder}/visual_spans.parquet")
    spark.createDataFrame([], "video_id string, ord int, text string, span_start double, span_end double").write.parquet(f"{folder}/ocr_spans.parquet")
    main(["build-memory", str(folder), str(tmp_path / "memory")], spark)
    assert spark.read.parquet(str(tmp_path / "memory")).count() == 7
    main(["search", str(folder), "kettle", "-k", "2"], spark)
    assert "v_scene_001" in capsys.readouterr().out
    main(["run", "sc2_memory_tree", str(folder), str(tmp_path / "tree")], spark)
    assert spark.read.parquet(str(tmp_path / "tree")).count() == 8
    spark.createDataFrame([("a", "summarization", 2.0, False, True)], "sample_id string, task string, weight double, is_penalty boolean, criteria_met boolean").write.parquet(str(tmp_path / "crit"))
    main(["score", str(tmp_path / "crit"), str(tmp_path / "report")], spark)
    assert "  summarization: 100.00% (1 samples)" in [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()]
