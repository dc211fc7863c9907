"""The actions on a memory: open, split, merge, stop; and the evidence they give."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import scores
from spanforge.functions.focus import Question, chosen_candidates, needs_refinement, refinement_candidates, span_score, speech_focus, why_signal
from spanforge.functions.prompts import selection_prompt
from spanforge.functions.text import one_space
from spanforge.lm import Provider
from spanforge.operators.memory import Windows, child_priority, node_facts, recommended, videos
from spanforge.operators.ordered import running

# How a claim begins.
CLAIMS = {"speech": "Speech evidence", "visual": "Visual evidence", "ocr": "OCR evidence", "audio": "Audio evidence", "cross_modal": "Merged evidence"}
MAX_SPANS = 2


def claim(detail: Column, modality: str) -> Column:
    return F.concat(F.lit(f"{CLAIMS[modality]}: "), F.substring(one_space(detail), 1, 180))


def evidence_id(n: Column) -> Column:
    return F.format_string("evidence_%05d", n)


def open_nodes(nodes: DataFrame, modality: str) -> DataFrame:
    """One evidence row per node with text of the modality (not speech): claim, detail, confidence."""
    detail = F.trim(F.col("visual_summary") if modality == "visual" else F.col(f"{modality}_text"))
    rows = nodes.withColumn("detail", detail).filter(F.col("detail") != "")
    return rows.select(
        "video_id", F.col("node_id").alias("source_node_id"), F.lit(modality).alias("modality"), "s", "e",
        claim(F.col("detail"), modality).alias("claim"), scores.detail_confidence(F.col("detail")).alias("confidence"), "detail",
    )


def split_node(nodes: DataFrame) -> DataFrame:
    """Frontier items for the children of nodes: nodes' own rows, seen from their parents."""
    return nodes.select(
        "video_id", F.col("parent_id").alias("of_node"), "node_id", "level", "s", "e",
        child_priority(F.col("speech_n"), F.col("ocr_n"), F.col("visual_summary")).alias("score"),
        F.concat(F.lit("Child node of "), F.col("parent_id"), F.format_string(" spanning %.2f-%.2f", "s", "e")).alias("why_candidate"),
        recommended(F.col("speech_n"), F.col("visual_summary"), F.col("ocr_n"), F.col("audio_n")).alias("recommended_modalities"),
        F.lit("unopened").alias("status"),
    )


def scored_spans(speech: DataFrame, artifacts: DataFrame, level: str, q: Question, w: Windows = Windows()) -> DataFrame:
    """The speech spans of each window of a level with a text, their number in it and their score."""
    v = videos(artifacts).select(F.col("video_id").alias("_v"), "duration")
    rows = node_facts(speech, artifacts, level, w).filter(F.trim("text") != "")
    rows = rows.join(v, F.col("video_id") == F.col("_v"), "left").drop("_v")
    rows = rows.withColumn("score", span_score(F.col("text"), F.col("span_start"), F.col("span_end"), F.col("duration"), q))
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("video_id", "window").orderBy("ord", "span_start", "text")) - 1)


def selected_spans(scored: DataFrame, q: Question) -> DataFrame:
    """At most two spans of each window: the best, then a neighbour that is nearly as good, gives a
    reason for a "why" or stands on the right side for a "first" or "last", then the next best.

    A window's spans are few (its width bounds them), so they are handled as one array."""
    span = F.struct("index", "score", "span_start", "span_end", "text", why_signal(F.col("text")).alias("why"))
    rows = scored.groupBy("video_id", "window").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    order = F.transform("spans", lambda x: F.struct(x["score"].alias("score"), (-x["span_start"]).alias("a"), (-x["index"]).alias("b")))
    ranked = F.reverse(F.array_sort(order))
    rows = rows.withColumn("_ranked", F.transform(ranked, lambda r: (-r["b"]).cast("int")))
    at = lambda i: F.try_element_at("spans", (i + 1).cast("int"))
    best = F.element_at("_ranked", 1)
    top = at(best)["score"]
    near = [best + 1] if q.first else [best - 1] if q.last else [best - 1, best + 1]

    def close(i: Column) -> Column:
        there = (i >= 0) & (i < F.size("spans"))
        s = F.when(there, at(F.greatest(i, F.lit(0))))
        good = s["score"] >= F.greatest(top * 0.35, F.lit(0.15))
        if q.why:
            good = good | s["why"]
        if q.first or q.last:
            good = good | (s["score"] >= 0.05)
        return F.when(there & good, i)

    neighbour = F.coalesce(*[close(i) for i in near])
    enough = lambda i: (at(i)["score"] >= F.greatest(top * 0.45, F.lit(0.2))) | (at(i)["why"] if q.why else F.lit(False))
    other = F.try_element_at(F.filter(F.slice("_ranked", F.lit(2), F.size("_ranked")), enough), F.lit(1))
    pair = F.array_compact(F.array(best, F.coalesce(neighbour, other)))
    chosen = F.when(top <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(pair))
    picked = F.transform(chosen, lambda i: F.struct(at(i)["span_start"].alias("span_start"), at(i)["index"].alias("index"), at(i)["span_end"].alias("span_end"), F.when(top <= 0, 0.0).otherwise(at(i)["score"]).alias("score"), at(i)["text"].alias("text")))
    rows = rows.withColumn("_picked", F.array_sort(picked)).withColumn("_of", F.size("_picked"))
    return rows.select("video_id", "window", "_of", F.posexplode("_picked").alias("position", "_s")).select("video_id", "window", "_of", "position", "_s.*")


def refined(rows: DataFrame, q: Question, make: Callable[[], Provider], model: str | None = None) -> DataFrame:
    """rows (text, detail) with detail picked by a model among the candidate snippets, where that is worth asking.

    A row is asked about if it has two candidates and the question or the text calls for it. The
    snippets that the model names are joined in the order of the candidates; a reply that names
    none, or fails, leaves the detail as it was. Rows stay in their task."""
    rows = rows.withColumn("_candidates", refinement_candidates(F.col("text"), F.col("detail"), q))
    asked = F.when(needs_refinement(F.col("text"), F.col("_candidates"), q), selection_prompt(F.lit(q.text), F.col("_candidates")))

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()

        def one(prompt: str | None) -> str | None:
            try:
                return provider.complete(prompt, model) if prompt is not None else None
            except Exception:  # the heuristic detail stands
                return None

        for batch in batches:
            yield batch.map(one, na_action="ignore").astype("object")

    ask = reply.asNondeterministic()  # a model is asked once per row, wherever its reply is used
    rows = rows.withColumn("_asked", asked).withColumn("_reply", ask("_asked"))
    chosen = F.array_sort(chosen_candidates(F.coalesce("_reply", F.lit("")), F.col("_candidates")))
    text = one_space(F.array_join(F.transform(chosen, lambda i: F.element_at(F.col("_candidates"), i)), " "))
    return rows.withColumn("detail", F.when(F.size(chosen) > 0, text).otherwise(F.col("detail"))).drop("_candidates", "_asked", "_reply")


def speech_evidence(speech: DataFrame, artifacts: DataFrame, nodes: DataFrame, level: str, question: str, search: str = "", w: Windows = Windows(),
                    make: Callable[[], Provider] | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """The evidence of opening every node of a level for speech: one row per selected span, with the
    span's own times, the focused detail, and a confidence that the score raises. With `make` a
    model refines the details; what `ledger` holds already is left out."""
    q = Question(question, search)
    rows = selected_spans(scored_spans(speech, artifacts, level, q, w), q)
    detail = speech_focus(F.col("text"), q)
    if q.first:
        detail = F.when(F.col("position") > 0, speech_focus(F.col("text"), q, "start")).otherwise(detail)
    elif q.last:
        detail = F.when(F.col("position") < F.col("_of") - 1, speech_focus(F.col("text"), q, "end")).otherwise(detail)
    ids = nodes.filter(F.col("level") == level).select("video_id", "window", F.col("node_id").alias("source_node_id"))
    rows = rows.withColumn("detail", detail)
    if make is not None:
        rows = refined(rows, q, make)
    rows = rows.filter(F.col("detail") != "").join(ids, ["video_id", "window"])
    rows = rows.dropDuplicates(["source_node_id", "span_start", "span_end", "detail"])
    found = rows.select(
        "video_id", "source_node_id", F.lit("speech").alias("modality"), F.col("span_start").alias("s"), F.col("span_end").alias("e"),
        claim(F.col("detail"), "speech").alias("claim"), scores.speech_confidence(F.col("detail"), F.col("score")).alias("confidence"), "detail",
        F.round("score", 4).alias("selection_score"),
    )
    return found if ledger is None else new_evidence(found, ledger)


def new_evidence(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Speech evidence that the ledger does not hold yet: same times to 1/100 s, same words."""
    key = lambda: (F.col("video_id"), F.round("s", 2), F.round("e", 2), F.lower(one_space(F.col("detail"))))
    names = [f"_k{i}" for i in range(4)]
    old = ledger.filter("modality = 'speech'").select(*[c.alias(n) for c, n in zip(key(), names)]).distinct()
    rows = found.withColumns(dict(zip(names, key())))
    return rows.join(old, names, "left_anti").drop(*names)


def merge_evidence(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, evidence_ids): one merged row per request with a known id, in the order
    of the request; unknown ids are left out, a request without known ids gives no row."""
    wanted = requests.select("request_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    rows = wanted.join(ledger, "evidence_id")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("x")))), lambda s: s["x"])
    merged = rows.groupBy("request_id").agg(
        F.array_join(listed("claim"), " | ").alias("claim"),
        F.array_join(F.filter(listed("detail"), lambda d: d != ""), "\n").alias("detail"),
        F.round(F.avg("confidence"), 4).alias("confidence"),
        F.min_by("source_node_id", "pos").alias("source_node_id"),
        F.min_by(F.struct("s", "e"), "pos").alias("_span"),
        F.count(F.lit(1)).alias("merged"),
    )
    return merged.select("request_id", "claim", "detail", "confidence", "source_node_id", F.col("_span.s").alias("s"), F.col("_span.e").alias("e"), F.lit("cross_modal").alias("modality"), "merged")


def cite(ledger: DataFrame, evidence_ids: DataFrame) -> DataFrame:
    """The ledger with used_in_final_answer set on the cited rows."""
    cited = evidence_ids.select("evidence_id").distinct().withColumn("_cited", F.lit(True))
    return ledger.join(cited, "evidence_id", "left").withColumn("used_in_final_answer", F.coalesce("_cited", F.lit(False))).drop("_cited")


def numbered(evidence: DataFrame, by: str = "video_id") -> DataFrame:
    """evidence with ids counted within each video, in order of time and node."""
    rows = running(evidence, by, ["s", "e", "source_node_id", "detail"], sums={"_n": F.lit(1).cast("bigint")})
    return rows.withColumn("evidence_id", evidence_id(F.col("_n"))).drop("_n")


def answer_evidence(evidence: DataFrame, k: int = 4) -> DataFrame:
    """The k rows of each video that an answer is made of: by confidence, then time, node and id."""
    order = Window.partitionBy("video_id").orderBy(F.desc("confidence"), "s", "source_node_id", "evidence_id")
    return evidence.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
