"""The interval memory: a tree of windows over each video, with the facts that fall into them.

Windows are aligned, so the windows a fact overlaps follow from its times by arithmetic: no
range join is needed, the facts are exploded to (video, level, window) and aggregated there. A
long video spreads over its windows. The root of a video would gather all its facts in one row;
it carries their numbers, its facts are the tables themselves."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.intervals import subdivide, valid

LEVELS = ("scene", "segment", "clip")
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Windows:
    """Widths in seconds: scenes in the video, segments in each scene, clips in each segment."""

    scene: float = 180.0
    segment: float = 45.0
    clip: float = 15.0

    def per_scene(self) -> int:
        return -int(-self.scene // self.segment)

    def per_segment(self) -> int:
        return -int(-self.segment // self.clip)


def videos(artifacts: DataFrame) -> DataFrame:
    """(video_id, duration, source): one row per video; a null, zero or negative duration is none."""
    good = F.when((F.col("duration_seconds") > 0) & ~F.isnan("duration_seconds"), F.col("duration_seconds"))
    source = F.try_element_at("metadata", F.lit("source_video_path"))
    return (
        artifacts.filter("video_id is not null")
        .groupBy("video_id")
        .agg(F.max(good).alias("duration"), F.max(F.when(source != "", source)).alias("source"))
    )


def tree(artifacts: DataFrame, w: Windows = Windows()) -> DataFrame:
    """(video_id, node_id, level, window, parent_id, s, e): root, scenes, segments and clips of each
    video with a duration. window is the number of the node in its level of the video, from 0."""
    v = videos(artifacts).filter("duration is not null")
    root_id = F.concat("video_id", F.lit("_video"))
    root = v.select("video_id", root_id.alias("node_id"), F.lit("video").alias("level"), F.lit(0).alias("window"), F.lit(None).cast("string").alias("parent_id"), F.lit(0.0).alias("s"), F.col("duration").alias("e"))
    scene = v.select("video_id", F.inline(subdivide(F.lit(0.0), F.col("duration"), w.scene))).select(
        "video_id", F.format_string("%s_scene_%03d", "video_id", "i").alias("node_id"), F.lit("scene").alias("level"), (F.col("i") - 1).alias("window"),
        root_id.alias("parent_id"), "s", "e",
    )

    def below(parent: DataFrame, level: str, word: str, width: float, per: int) -> DataFrame:
        parts = parent.select("video_id", F.col("node_id").alias("parent_id"), F.col("window").alias("_pw"), F.inline(subdivide(F.col("s"), F.col("e"), width)))
        return parts.select(
            "video_id", F.format_string(f"%s_{word}_%03d", "parent_id", "i").alias("node_id"), F.lit(level).alias("level"),
            (F.col("_pw") * per + F.col("i") - 1).alias("window"), "parent_id", "s", "e",
        )

    segment = below(scene, "segment", "seg", w.segment, w.per_scene())
    clip = below(segment, "clip", "clip", w.clip, w.per_segment())
    return root.unionByName(scene).unionByName(segment).unionByName(clip)


def _window_of(t: Column, level: str, w: Windows, before: bool) -> Column:
    """The number of the window that t lies in; before: of the window that ends at t, if one does."""
    pick = (lambda x: F.ceil(x) - 1) if before else F.floor
    scene = pick(t / w.scene).cast("bigint")
    if level == "scene":
        return scene
    inside = t - scene * w.scene
    segment = F.least(pick(inside / w.segment).cast("bigint"), F.lit(w.per_scene() - 1))
    if level == "segment":
        return scene * w.per_scene() + segment
    clip = F.least(pick((inside - segment * w.segment) / w.clip).cast("bigint"), F.lit(w.per_segment() - 1))
    return (scene * w.per_scene() + segment) * w.per_segment() + clip


def _exists(window: Column, level: str, w: Windows) -> Column:
    """Whether a number is that of a window: where widths do not divide each other, the last segment of
    a scene and the last clip of a segment are short, and the numbers of the rest are not used."""
    per = w.per_segment()
    segment = window if level == "segment" else F.floor(window / per)
    begin = F.pmod(segment, F.lit(w.per_scene())) * w.segment
    if level == "scene":
        return F.lit(True)
    if level == "segment":
        return begin < w.scene
    return begin + F.pmod(window, F.lit(per)) * w.clip < F.least(begin + w.segment, F.lit(w.scene))


def once(facts: DataFrame) -> DataFrame:
    """facts without repeated rows, which have the same key and times and differ at most in when they came in."""
    return facts.dropDuplicates(["video_id", "ord", "span_start", "span_end"])


def level_facts(facts: DataFrame, artifacts: DataFrame, levels: tuple[str, ...] = LEVELS, w: Windows = Windows(), distinct: bool = True) -> DataFrame:
    """facts with level and window, one row per overlapped window of each level (half-open overlap).

    All levels come from one pass over the facts. Repeated rows count once, unless the caller sees to
    that itself (distinct=False) where it gathers the facts anyway; spans that are null,
    broken or outside the video are left out; one of no length at the edge of a window overlaps
    none. A span is cut to its video, so it has no more rows than the video has windows."""
    v = videos(artifacts).filter("duration is not null").select(F.col("video_id").alias("_v"), "duration")
    rows = facts.filter(valid(F.col("span_start"), F.col("span_end")))
    rows = (once(rows) if distinct else rows).join(v, F.col("video_id") == F.col("_v")).drop("_v")
    s, e = F.col("span_start"), F.col("span_end")
    rows = rows.filter((s < F.col("duration")) & (e > 0))

    def at(level: str) -> Column:
        first = _window_of(F.greatest(s, F.lit(0.0)), level, w, before=False).cast("int")
        last = _window_of(F.least(e, F.col("duration")), level, w, before=True).cast("int")
        numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        there = F.filter(numbers, lambda n: _exists(n, level, w))
        return F.transform(there, lambda n: F.struct(F.lit(level).alias("level"), n.alias("window")))

    return rows.select(*facts.columns, F.inline(F.concat(*[at(x) for x in levels])))


def node_facts(facts: DataFrame, artifacts: DataFrame, level: str, w: Windows = Windows()) -> DataFrame:
    """level_facts of one level, without the level."""
    return level_facts(facts, artifacts, (level,), w).drop("level")


def _gathered(text: str) -> Column:
    """The distinct facts of a window in order; a window is as long as its width, whatever the video."""
    fact = F.struct(F.col("ord").alias("o"), F.col(text).alias("t"), F.col("span_start").alias("s"), F.col("span_end").alias("e"))
    return F.array_sort(F.collect_set(fact)).alias("_facts")


def _texts(rows: DataFrame, name: str) -> DataFrame:
    """<name>_text, the texts of the gathered facts joined, and <name>_n, their number."""
    text = F.array_join(F.transform(F.filter("_facts", lambda x: x["t"].isNotNull()), lambda x: x["t"]), " ")
    return rows.select("video_id", "level", "window", text.alias(f"{name}_text"), F.size("_facts").cast("bigint").alias(f"{name}_n"))


def nodes(artifacts: DataFrame, speech: DataFrame, visual: DataFrame, ocr: DataFrame, w: Windows = Windows(), audio: DataFrame | None = None,
          levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The nodes of some levels with speech, visual, OCR and audio text, tags, entities and counts.

    Each kind of fact is read once for all levels and aggregated by (video, level, window), the key
    that the nodes are joined on. Visual summaries of the same granularity are used: those with
    exactly the node's span if there are any, else the overlapping ones; without any, the
    summary states the counts."""
    key = ["video_id", "level", "window"]
    rows = tree(artifacts, w).filter(F.col("level").isin(*levels))
    gather = lambda facts, name, text: _texts(level_facts(facts.select("video_id", "ord", text, "span_start", "span_end"), artifacts, levels, w, False).groupBy(*key).agg(_gathered(text)), name)
    said, read = gather(speech, "speech", "text"), gather(ocr, "ocr", "text")
    visual = visual.filter(F.col("granularity").isin(*levels)).select("video_id", "ord", "summary", "granularity", "tags", "entities", "span_start", "span_end")
    seen = level_facts(visual, artifacts, levels, w).filter(F.col("granularity") == F.col("level"))
    spans = rows.select(*key, F.col("s").alias("_s"), F.col("e").alias("_e"))
    seen = seen.join(spans, key)
    exact = (F.abs(F.col("span_start") - F.col("_s")) <= TOLERANCE) & (F.abs(F.col("span_end") - F.col("_e")) <= TOLERANCE)
    seen = seen.withColumn("_exact", exact)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())))))
    summary = lambda: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("summary") != "", F.struct(F.col("ord").alias("o"), F.trim("summary").alias("t"))))), lambda x: x["t"]), " | "
    )
    by = seen.groupBy(*key, "_exact").agg(summary().alias("_summary"), union("tags").alias("_tags"), union("entities").alias("_entities"))
    best = by.groupBy(*key).agg(F.max_by(F.struct("_summary", "_tags", "_entities"), "_exact").alias("_best"))
    out = rows.join(said, key, "left").join(read, key, "left").join(best, key, "left")
    if audio is not None:
        out = out.join(gather(audio, "audio", "label"), key, "left")
    else:
        out = out.withColumn("audio_text", F.lit("")).withColumn("audio_n", F.lit(0).cast("bigint"))
    for c in ("speech_n", "ocr_n", "audio_n"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    empty = F.array().cast("array<string>")
    return out.select(
        "video_id", "node_id", "level", "window", "parent_id", "s", "e",
        F.coalesce("speech_text", F.lit("")).alias("speech_text"), F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), F.coalesce("audio_text", F.lit("")).alias("audio_text"),
        F.when(F.col("_best").isNull(), counted(F.col("level"), F.col("speech_n"), F.col("ocr_n"))).otherwise(F.col("_best._summary")).alias("visual_summary"),
        F.coalesce("_best._tags", empty).alias("tags"), F.coalesce("_best._entities", empty).alias("entities"), "speech_n", "ocr_n", "audio_n",
    )


def level_nodes(artifacts: DataFrame, speech: DataFrame, visual: DataFrame, ocr: DataFrame, level: str, w: Windows = Windows(),
                audio: DataFrame | None = None) -> DataFrame:
    """The nodes of one level."""
    return nodes(artifacts, speech, visual, ocr, w, audio, (level,))


def counted(level: Column, speech_n: Column, ocr_n: Column) -> Column:
    """What stands in for a summary: the level and the numbers of its facts."""
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(what)))
    return F.concat_ws(", ", F.concat(level, F.lit(" node")), part(speech_n, " speech spans"), part(ocr_n, " OCR spans"))


def granularity(start: Column, end: Column, scene_seconds: float = 20.0) -> Column:
    """What a summary without granularity counts as: a scene from a length on, else a clip."""
    return F.when(end - start >= scene_seconds, "scene").otherwise("clip")


def fact_counts(**facts: DataFrame) -> DataFrame:
    """(video_id, kind, n): the distinct facts of each kind in each video, one pass per kind."""
    parts = [once(df).groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind)) for kind, df in facts.items()]
    return reduce(DataFrame.unionByName, parts)


def clip_pointer(source: Column, s: Column, e: Column) -> Column:
    """Where a span lies in the source file; null without a source."""
    return F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.substring_index(source, "#t=", 1), F.format_string("#t=%.2f,%.2f", s, e)))


def recommended(speech_n: Column, visual_summary: Column, ocr_n: Column, audio_n: Column) -> Column:
    found = F.array_compact(
        F.array(
            F.when(speech_n > 0, F.lit("speech")), F.when(visual_summary != "", F.lit("visual")),
            F.when(ocr_n > 0, F.lit("ocr")), F.when(audio_n > 0, F.lit("audio")),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("visual")))


def child_priority(speech_n: Column, ocr_n: Column, visual_summary: Column) -> Column:
    seen = F.when(visual_summary != "", 0.15).otherwise(0.0)
    return F.round(0.2 + F.least(speech_n * 0.05, F.lit(0.3)) + F.least(ocr_n * 0.03, F.lit(0.2)) + seen, 4)
