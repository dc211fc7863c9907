"""Command line: spark-submit entry points for building, searching and scoring.

    python -m spanforge.cli queries
    python -m spanforge.cli run tk1_search DATA_FOLDER OUTPUT_FOLDER
    python -m spanforge.cli build-memory DATA_FOLDER OUTPUT_FOLDER [--scene 180 --segment 45 --clip 15]
    python -m spanforge.cli search DATA_FOLDER "a question" [--modality speech] [-k 5]
    python -m spanforge.cli score CRITERIA_FOLDER OUTPUT_FOLDER
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from spanforge.operators import memory as mem
from spanforge.operators import scoring as sc
from spanforge.operators import search as se
from spanforge.plans import registry
from spanforge.sources.files import save_memory, write_report
from spanforge.tables import table


def _nodes(spark: SparkSession, folder: str, w: mem.Windows):
    return mem.nodes(*[table(spark, folder, n) for n in ("artifacts", "speech_spans", "visual_spans", "ocr_spans")], w)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanforge")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries")
    for name, *words in (("run", "query", "folder", "output"), ("build-memory", "folder", "output"), ("search", "folder", "question"), ("score", "folder", "output")):
        s = sub.add_parser(name)
        for w in words:
            s.add_argument(w)
        if name in ("build-memory", "search"):
            for level, width in (("scene", 180.0), ("segment", 45.0), ("clip", 15.0)):
                s.add_argument(f"--{level}", type=float, default=width)
        if name == "search":
            s.add_argument("--modality", choices=se.MODALITIES)
            s.add_argument("-k", type=int, default=5)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "queries":
        print("\n".join(sorted(registry.all_queries())))
        return
    spark = spark or SparkSession.builder.appName("spanforge").getOrCreate()
    if a.command == "run":
        registry.all_queries()[a.query](spark, a.folder).write.mode("overwrite").parquet(a.output)
    elif a.command == "build-memory":
        save_memory(_nodes(spark, a.folder, mem.Windows(a.scene, a.segment, a.clip)), a.output)
    elif a.command == "search":
        nodes = _nodes(spark, a.folder, mem.Windows(a.scene, a.segment, a.clip))
        found = se.hits(nodes, table(spark, a.folder, "artifacts"), a.question, a.modality)
        se.top_hits(found, a.k, per_video=False).show(a.k, truncate=120)
    else:
        tasks = sc.task_scores(sc.sample_points(spark.read.parquet(a.folder)))
        write_report(sc.report_lines(tasks, sc.categories(spark)), a.output)


if __name__ == "__main__":
    main()
