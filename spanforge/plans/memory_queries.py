"""Queries of the interval memory, search, evidence and session state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.focus import Question, evidence_focus, refinement_candidates, span_score, speech_focus
from spanforge.functions.text import sentence_windows, sentences
from spanforge.lm import Scripted
from spanforge.operators import evidence as ev
from spanforge.operators import intervals as iv
from spanforge.operators import memory as mem
from spanforge.operators import search as se
from spanforge.operators import state as st
from spanforge.operators.ordered import running
from spanforge.operators.words import phrases, word_level
from spanforge.session import durable
from spanforge.tables import table

QUERY = "Who repairs the first water pump at the harbor market?"
#: Query vectors in one broadcast of the semantic search.
QUERY_BLOCK = 2048
#: Questions that are asked together.
QUESTIONS = {"pump": QUERY, "label": "What does the label on the paper map say?", "last": "Which drone is repaired last?", "lamp": "ring light", "none": "of the and"}
WHY = "Why does the cook repair the tripod and open the kettle?"


def _level(spark: SparkSession, sf: str, level: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return mem.level_nodes(t("artifacts"), t("speech_spans"), t("visual_spans"), t("ocr_spans"), level)


def sc2_memory_tree(spark: SparkSession, sf: str) -> DataFrame:
    return mem.tree(table(spark, sf, "artifacts")).select("video_id", "node_id", "level", "parent_id", "s", "e")


def sc1_windows(spark: SparkSession, sf: str) -> DataFrame:
    v = mem.videos(table(spark, sf, "artifacts")).filter("duration is not null")
    return v.select("video_id", F.inline(iv.subdivide(F.lit(0.0), F.col("duration"), 60.0)))


def sc3_chunk_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans measured in their 60 s chunk, put back on the time line."""
    rows = table(spark, sf, "speech_spans").filter("span_start >= 0 and span_end >= span_start").dropDuplicates(["video_id", "ord"])
    chunk = F.floor(F.col("span_start") / 60) * 60.0
    s, e = iv.shifted_into(chunk, chunk + 60.0, F.col("span_start") - chunk, F.col("span_end") - chunk)
    return rows.select("video_id", "ord", F.round(s, 3).alias("s"), F.round(e, 3).alias("e"))


def sc4_sample_times(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ocr_spans").dropDuplicates(["video_id", "ord"])
    at = F.explode(iv.sample_times(F.col("span_start"), F.col("span_end"), 2))
    return rows.select("video_id", "ord", at.alias("_t")).select("video_id", "ord", F.round("_t", 3).alias("t"))


def prj1_valid_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "visual_spans").filter(iv.valid(F.col("span_start"), F.col("span_end")))
    return rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("spans"), F.round(F.max(F.col("span_end") - F.col("span_start")), 3).alias("longest"))


def prj4_display(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ocr_spans").dropDuplicates(["video_id", "ord"])
    return rows.select("video_id", "ord", iv.display(F.round("span_start", 0), F.round("span_end", 0)).alias("shown"))


def prj3_contains(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "speech_spans").filter(iv.contains(F.col("span_start"), F.col("span_end"), F.lit(60.0)))
    return rows.select("video_id", "ord").distinct()


def jn1_speech_in_clips(spark: SparkSession, sf: str) -> DataFrame:
    facts = mem.node_facts(table(spark, sf, "speech_spans"), table(spark, sf, "artifacts"), "clip")
    return facts.groupBy("video_id", "window").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def jn1_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Screen texts shown while a scene summary holds."""
    scenes = table(spark, sf, "visual_spans").filter("granularity = 'scene'").select("video_id", F.col("ord").alias("scene"), F.col("span_start").alias("s"), F.col("span_end").alias("e")).distinct()
    ocr = table(spark, sf, "ocr_spans").select("video_id", F.col("ord").alias("reading"), F.col("span_start").alias("s"), F.col("span_end").alias("e")).distinct()
    return iv.overlap_join(scenes, ocr, "video_id", 120.0, right_span=("s", "e")).select("video_id", "scene", "reading")


def jn2_scene_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = _level(spark, sf, "scene")
    return n.select("video_id", "node_id", "s", "e", "visual_summary", F.array_join("tags", ",").alias("tags"), F.array_join("entities", ",").alias("entities"), "speech_n", "ocr_n")


def prj10_node_text(spark: SparkSession, sf: str) -> DataFrame:
    return _level(spark, sf, "segment").select("node_id", "speech_text", "ocr_text")


def prj12_clip_pointers(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "artifacts")
    v = mem.videos(a).select(F.col("video_id").alias("_v"), F.coalesce("source", F.concat(F.lit("media/"), "video_id", F.lit(".mp4#t=0.00,1.00"))).alias("src"))
    t = mem.tree(a).filter("level = 'scene'").join(v, F.col("video_id") == F.col("_v"))
    return t.select("node_id", mem.clip_pointer(F.col("src"), F.col("s"), F.round("e", 0)).alias("clip_path"))


def jn3_children(spark: SparkSession, sf: str) -> DataFrame:
    t = mem.tree(table(spark, sf, "artifacts"))
    kids = t.groupBy("video_id", "parent_id").agg(F.count(F.lit(1)).alias("children"), F.min("node_id").alias("first_child"))
    parents = t.select("video_id", F.col("node_id").alias("parent_id"), "level")
    return parents.join(kids, ["video_id", "parent_id"]).select("parent_id", "level", "children", "first_child")


def prj15_split(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.split_node(_level(spark, sf, "segment"))
    return s.select("of_node", "node_id", "score", F.array_join("recommended_modalities", ",").alias("modalities"))


def prj6_level_filter(spark: SparkSession, sf: str) -> DataFrame:
    return mem.tree(table(spark, sf, "artifacts")).filter(F.col("level").isin("scene", "clip")).groupBy("video_id", "level").agg(F.count(F.lit(1)).alias("n"))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes, segments and clips: what a search goes over unless it is given levels."""
    t = lambda n: table(spark, sf, n)
    return mem.nodes(t("artifacts"), t("speech_spans"), t("visual_spans"), t("ocr_spans"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return se.hits(_nodes(spark, sf), table(spark, sf, "artifacts"), QUERY)


def tk1_search(spark: SparkSession, sf: str) -> DataFrame:
    return se.top_hits(_hits(spark, sf), 5).select("video_id", "node_id", "modality", "score", F.array_join("matched_terms", ",").alias("terms"), "rank")


def rt7_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("node_id", "reason")


def rt3_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """Every query vector (each id divisible by 100) against every vector, in broadcasts of about QUERY_BLOCK queries."""
    from spanforge.functions.scores import cosine

    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    pairs = [e.crossJoin(F.broadcast(q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i))) for i in range(blocks)]
    scored = [p.select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 4).alias("similarity")) for p in pairs]
    return reduce(DataFrame.unionByName, scored)


def jn8_inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return se.inverted_index(_nodes(spark, sf)).groupBy("token", "modality").agg(F.count(F.lit(1)).alias("nodes"))


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS.items()), "query_id string, query string")


def jn8_search_many(spark: SparkSession, sf: str) -> DataFrame:
    """The three best hits of each question in each video, over the inverted index of a memory that is built once."""
    found = se.search_many(_questions(spark), durable(_nodes(spark, sf)), table(spark, sf, "artifacts"))
    order = Window.partitionBy("query_id", "video_id").orderBy(F.desc("score"), "s", "node_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter("rank <= 3")
    return best.select("query_id", "video_id", "node_id", "modality", "score", F.array_join("matched_terms", ",").alias("terms"), "rank")


def rt5_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that have a vector against questions with vectors: every vector whose id is divisible by 100 is
    one, its words a question by turns."""
    e = table(spark, sf, "embeddings")
    names = F.array(*[F.lit(q) for q in QUESTIONS.values()])
    turn = (F.pmod(F.col("vec_id") / 100, F.lit(len(QUESTIONS))) + 1).cast("int")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.element_at(names, turn).alias("query"), "embedding")
    items = table(spark, sf, "documents").join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id").select(F.col("doc_id").alias("item_id"), "text", "embedding")
    return se.hybrid_many(queries, items, QUERY_BLOCK)


def tk3_initial_frontier(spark: SparkSession, sf: str) -> DataFrame:
    scenes = mem.tree(table(spark, sf, "artifacts")).filter("level = 'scene'")
    f = st.initial_frontier(_hits(spark, sf), scenes)
    return f.select("video_id", "node_id", "score", F.array_join("recommended_modalities", ",").alias("modalities"), "rank")


def tk8_topical_index(spark: SparkSession, sf: str) -> DataFrame:
    return st.topical_index(_level(spark, sf, "scene"))


def rt10_open_visual(spark: SparkSession, sf: str) -> DataFrame:
    return ev.open_nodes(_level(spark, sf, "segment"), "visual").select("source_node_id", "modality", "claim", "confidence")


def rt11_open_ocr(spark: SparkSession, sf: str) -> DataFrame:
    return ev.open_nodes(_level(spark, sf, "segment"), "ocr").select("source_node_id", "claim", "confidence")


def rt13_span_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "speech_spans").filter("text is not null").dropDuplicates(["video_id", "ord"])
    score = span_score(F.col("text"), F.col("span_start"), F.col("span_end"), F.lit(None).cast("double"), Question(WHY))
    return rows.select("video_id", "ord", score.alias("score"))


def rt22_speech_evidence(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    found = ev.speech_evidence(t("speech_spans"), t("artifacts"), mem.tree(t("artifacts")), "segment", WHY, "kettle tripod repair")
    return ev.numbered(found).select("evidence_id", "video_id", "source_node_id", "s", "e", "claim", "confidence", "selection_score")


def rt22_refined(spark: SparkSession, sf: str) -> DataFrame:
    """The same with details that a scripted model refines, without what a first opening of the clips has found."""
    t = lambda n: table(spark, sf, n)
    tree = mem.tree(t("artifacts"))
    known = ev.speech_evidence(t("speech_spans"), t("artifacts"), tree, "clip", WHY, "kettle tripod repair")
    make = lambda: Scripted({"kettle": '{"selected_candidate_ids": ["c2", "c1"]}'})
    found = ev.speech_evidence(t("speech_spans"), t("artifacts"), tree, "segment", WHY, "kettle tripod repair", make=make, ledger=known)
    return found.select("video_id", "source_node_id", "s", "e", "claim", "confidence", "detail")


def rt18_document_focus(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", speech_focus(F.col("text"), Question(WHY)).alias("focus"))


def rt20_candidates(spark: SparkSession, sf: str) -> DataFrame:
    q = Question(WHY)
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(refinement_candidates(F.col("text"), speech_focus(F.col("text"), q), q)).alias("candidate", "snippet"))


def rt21_evidence_focus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", evidence_focus(F.col("text"), "What did they say about the lost clasp?").alias("excerpt"))


def rt15_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("sentence")).alias("longest"))


def wn7_sentence_windows(spark: SparkSession, sf: str) -> DataFrame:
    """One sentence before, two after, of each sentence."""
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", F.explode(sentence_windows(F.col("text"))).alias("w")).groupBy("doc_id").agg(F.max(F.length("w")).alias("widest"), F.count(F.lit(1)).alias("windows"))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of opening every scene for what is seen and read, numbered by video."""
    n = _level(spark, sf, "scene")
    return ev.numbered(ev.open_nodes(n, "visual").unionByName(ev.open_nodes(n, "ocr"))).withColumn("evidence_id", F.concat_ws("/", "video_id", "evidence_id"))


def ag8_merge(spark: SparkSession, sf: str) -> DataFrame:
    led = _ledger(spark, sf)
    req = mem.videos(table(spark, sf, "artifacts")).select(F.col("video_id").alias("request_id"), F.array(*[F.concat("video_id", F.lit(f"/evidence_0000{i}")) for i in (2, 1, 9)]).alias("evidence_ids"))
    return ev.merge_evidence(led, req).select("request_id", "claim", "detail", "confidence", "source_node_id", "s", "e", "merged")


def st4_cite(spark: SparkSession, sf: str) -> DataFrame:
    led = _ledger(spark, sf)
    cited = led.filter("evidence_id like '%00001'").select("evidence_id")
    return ev.cite(led, cited).groupBy("video_id", "used_in_final_answer").agg(F.count(F.lit(1)).alias("n"))


def tk4_answer_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return ev.answer_evidence(_ledger(spark, sf)).select("video_id", "rank", "evidence_id", "claim", "confidence")


def jn9_new_evidence(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "speech_spans").filter("text is not null").dropDuplicates(["video_id", "ord"])
    rows = s.select("video_id", "ord", F.lit("speech").alias("modality"), F.col("span_start").alias("s"), F.col("span_end").alias("e"), F.col("text").alias("detail"))
    return ev.new_evidence(rows, rows.filter("ord % 2 = 0").withColumn("detail", F.regexp_replace("detail", " ", "  "))).select("video_id", "ord")


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """The event log read as sessions of actions."""
    e = table(spark, sf, "events")
    kinds = [F.when(F.pmod(F.col("event_id"), F.lit(5)) == i, k) for i, k in enumerate(("SEARCH", "OPEN", "OPEN", "SPLIT", "STOP"))]
    e = running(e, "user_id", ["ts", "event_id"], sums={"_step": F.lit(1).cast("bigint")})
    step = F.col("_step")
    return e.select(
        F.col("user_id").alias("session"), step.alias("step"), F.coalesce(*kinds).alias("action_type"), F.col("event_type").alias("query"),
        F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, 1).otherwise(0).alias("new_evidence"), F.length("props").cast("bigint").alias("tokens"),
    )


def wn5_latest_search(spark: SparkSession, sf: str) -> DataFrame:
    return st.latest_search(_steps(spark, sf), F.lit("the question")).select("session", "step", "search_query")


def wn2_empty_open_stops(spark: SparkSession, sf: str) -> DataFrame:
    return st.empty_open_stops(_steps(spark, sf))


def wn3_step_budget(spark: SparkSession, sf: str) -> DataFrame:
    return st.budget(_steps(spark, sf), 20)


def prj5_valid_actions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _steps(spark, sf)
    ok = st.valid_action(F.col("action_type"), F.col("query"), F.when(F.col("step") % 2 == 0, F.lit("speech")), F.when(F.col("step") % 3 > 0, F.lit("n")), F.array().cast("array<string>"))
    return rows.groupBy("action_type", ok.alias("ok")).agg(F.count(F.lit(1)).alias("n"))


def st1_merge_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """The second lines of orders merged into the first ones, as two frontiers per month of shipping."""
    li = table(spark, sf, "lineitem").filter("l_linenumber <= 2")
    rows = li.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("session"), F.col("l_suppkey").cast("string").alias("node_id"), "l_linenumber").agg(
        F.round(F.max("l_discount"), 2).alias("score"), F.min("l_orderkey").cast("double").alias("s"), F.min(F.when(F.col("l_returnflag") == "R", "speech").otherwise("visual")).alias("m"), F.min("l_orderkey").alias("ord")
    )
    rows = rows.withColumn("recommended_modalities", F.array("m"))
    part = lambda n: rows.filter(F.col("l_linenumber") == n).drop("l_linenumber", "m")
    merged = st.merge_frontier(part(1), part(2))
    return merged.select("session", "node_id", "score", "s", F.array_join("recommended_modalities", ",").alias("modalities"), "rank")


def st2_status(spark: SparkSession, sf: str) -> DataFrame:
    """A frontier of scenes in which one was split and one opened."""
    scenes = mem.tree(table(spark, sf, "artifacts")).filter("level = 'scene'").select("video_id", "node_id", F.lit("unopened").alias("status"))
    first, second = "vid_0000000_scene_001", "vid_0000000_scene_002"
    return st.without(st.with_status(scenes, first, "expanded"), second).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def st7_visual_sets(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "visual_spans")
    part = lambda g: v.filter(F.col("granularity") == g).select("video_id", "ord", "granularity")
    return part("scene").unionAll(part("clip")).groupBy("granularity").agg(F.count(F.lit(1)).alias("n"))


def prj21_granularity(spark: SparkSession, sf: str) -> DataFrame:
    v = mem.once(table(spark, sf, "visual_spans")).filter(iv.valid(F.col("span_start"), F.col("span_end")))
    return v.groupBy(mem.granularity(F.col("span_start"), F.col("span_end")).alias("granularity")).agg(F.count(F.lit(1)).alias("n"))


def sc5_word_level(spark: SparkSession, sf: str) -> DataFrame:
    return word_level(table(spark, sf, "speech_spans").filter("text is not null"))


def wn9_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Speech spans taken as words."""
    w = table(spark, sf, "speech_spans").filter("text is not null and span_end >= span_start").dropDuplicates(["video_id", "ord"])
    return phrases(w.select("video_id", "ord", "text", "span_start", "span_end"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_V = """v as (select video_id, max(case when duration_seconds > 0 and not isnan(duration_seconds) then duration_seconds end) d from artifacts where video_id is not null group by 1 having d is not null)"""
_SCENE = "scenes as (select video_id, i, i * 180.0 s, least((i + 1) * 180.0, d) e, d from v, lateral (select unnest(range(cast(ceil(d / 180.0) as bigint))) i))"
_SEGMENT = "segments as (select video_id, i, j, i * 4 + j w, s + j * 45.0 s, least(s + (j + 1) * 45.0, e) e, d from scenes, lateral (select unnest(range(cast(ceil((e - s) / 45.0) as bigint))) j))"
_CLIP = "clips as (select video_id, i, j, k, w * 3 + k w, s + k * 15.0 s, least(s + (k + 1) * 15.0, e) e, d from segments, lateral (select unnest(range(cast(ceil((e - s) / 15.0) as bigint))) k))"
_FACTS = """speech as (select distinct video_id, ord, text, span_start, span_end from speech_spans), readings as (select distinct video_id, ord, text, span_start, span_end from ocr_spans),
  views as (select distinct on (video_id, ord, span_start, span_end) video_id, ord, summary, granularity, tags, entities, span_start, span_end from visual_spans)"""
_TREE = f"with {_V}, {_SCENE}, {_SEGMENT}, {_CLIP}, {_FACTS}"
_NAMES = """
named as (
  select video_id, video_id || '_video' node_id, 'video' level, cast(null as varchar) parent_id, 0.0 s, d e from v
  union all select video_id, printf('%s_scene_%03d', video_id, i + 1), 'scene', video_id || '_video', s, e from scenes
  union all select video_id, printf('%s_scene_%03d_seg_%03d', video_id, i + 1, j + 1), 'segment', printf('%s_scene_%03d', video_id, i + 1), s, e from segments
  union all select video_id, printf('%s_scene_%03d_seg_%03d_clip_%03d', video_id, i + 1, j + 1, k + 1), 'clip', printf('%s_scene_%03d_seg_%03d', video_id, i + 1, j + 1), s, e from clips)
"""
_OK = "{0}.span_start is not null and {0}.span_end is not null and not isnan({0}.span_start) and not isnan({0}.span_end) and {0}.span_end >= {0}.span_start and {0}.span_start < {1}.e and {1}.s < {0}.span_end"


def _visual(level: str, nodes: str) -> str:
    ok = _OK.format("x", "n")
    return f"""
seen as (select n.video_id, n.w, x.ord, x.summary, x.tags, x.entities, abs(x.span_start - n.s) <= 1e-6 and abs(x.span_end - n.e) <= 1e-6 exact
         from {nodes} n join views x on n.video_id = x.video_id and x.granularity = '{level}' and {ok}),
best as (select * from (select *, max(exact::int) over (partition by video_id, w) any_exact from seen) where exact::int = any_exact),
visual as (select video_id, w, coalesce(string_agg(case when summary <> '' then trim(summary) end, ' | ' order by ord, trim(summary)), '') summary from best group by 1, 2),
tagged as (select video_id, w, string_agg(distinct t, ',' order by t) tags from (select video_id, w, unnest(tags) t from best) where t is not null group by 1, 2),
named_e as (select video_id, w, string_agg(distinct t, ',' order by t) entities from (select video_id, w, unnest(entities) t from best) where t is not null group by 1, 2),
said as (select n.video_id, n.w, count(*) c, coalesce(string_agg(x.text, ' ' order by x.ord, x.text), '') t from {nodes} n join speech x on n.video_id = x.video_id and {ok} group by 1, 2),
shown as (select n.video_id, n.w, count(*) c, coalesce(string_agg(x.text, ' ' order by x.ord, x.text), '') t from {nodes} n join readings x on n.video_id = x.video_id and {ok} group by 1, 2),
nodes as (select n.*, coalesce(sp.c, 0) speech_n, coalesce(oc.c, 0) ocr_n, coalesce(sp.t, '') speech_text, coalesce(oc.t, '') ocr_text, coalesce(tg.tags, '') tags, coalesce(en.entities, '') entities,
   case when vi.video_id is not null then vi.summary else '{level} node' || case when coalesce(sp.c, 0) > 0 then ', ' || sp.c || ' speech spans' else '' end
        || case when coalesce(oc.c, 0) > 0 then ', ' || oc.c || ' OCR spans' else '' end end visual_summary
   from {nodes} n left join said sp using (video_id, w) left join shown oc using (video_id, w) left join visual vi using (video_id, w)
   left join tagged tg using (video_id, w) left join named_e en using (video_id, w))
"""


_SCENE_W = "scenes_w as (select video_id, s, e, d, i w, printf('%s_scene_%03d', video_id, i + 1) node_id, video_id || '_video' parent_id, 'scene' level from scenes)"
_SEGMENT_W = "segments_w as (select video_id, s, e, d, w, printf('%s_scene_%03d_seg_%03d', video_id, i + 1, j + 1) node_id, printf('%s_scene_%03d', video_id, i + 1) parent_id, 'segment' level from segments)"
_CLIP_W = "clips_w as (select video_id, s, e, d, w, printf('%s_scene_%03d_seg_%03d_clip_%03d', video_id, i + 1, j + 1, k + 1) node_id, printf('%s_scene_%03d_seg_%03d', video_id, i + 1, j + 1) parent_id, 'clip' level from clips)"
_SCENE_NODES = f"{_TREE}, {_SCENE_W}, {_visual('scene', 'scenes_w')}"
_SEGMENT_NODES = f"{_TREE}, {_SEGMENT_W}, {_visual('segment', 'segments_w')}"
_CLIP_NODES = f"{_TREE}, {_CLIP_W}, {_visual('clip', 'clips_w')}"
_ALL_NODES = "with nodes as (" + " union all ".join(f"select * from ({n} select * from nodes)" for n in (_SCENE_NODES, _SEGMENT_NODES, _CLIP_NODES)) + ")"

_STOP = "', '".join(__import__("spanforge.functions.text", fromlist=["x"]).STOPWORDS)
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 and w not in ('" + _STOP + "')))"
_Q = QUERY.replace("'", "''")
def _hits_sql(queries: dict[str, str]) -> str:
    """The best modality of each node for each query."""
    quoted = {k: q.replace("'", "''") for k, q in queries.items()}
    asked = " union all ".join(f"select '{k}' query_id, lower('{q}') ql, {_TOKENS.format(chr(39) + q + chr(39))} qt" for k, q in quoted.items())
    return f"""{_ALL_NODES},
q as ({asked}),
docs as (
  select video_id, node_id, s, e, d, 0 r, 'speech' modality, speech_text t from nodes
  union all select video_id, node_id, s, e, d, 1, 'visual', concat_ws(' ', nullif(visual_summary, ''), nullif(replace(tags, ',', ' '), ''), nullif(replace(entities, ',', ' '), '')) from nodes
  union all select video_id, node_id, s, e, d, 2, 'ocr', ocr_text from nodes),
cut as (select *, {_TOKENS.format("t")} dt from docs),
toks as (select cut.*, query_id, ql, qt from cut, q),
lap as (select *, list_sort(list_filter(qt, lambda w: list_contains(dt, w))) ov from toks),
lexed as (select *, round(least(1.0, length(ov) / length(qt)
     + list_sum(list_transform(ov, lambda w: cast((length(lower(t)) - length(replace(lower(t), w, ''))) / length(w) as bigint))) / greatest(length(dt), 1)
     + case when contains(lower(t), ql) then 0.25 else 0.0 end), 4) lex,
     case when list_has_any(qt, ['first', 'beginning', 'earliest', 'initial']) then round(greatest(0.0, 1.0 - s / greatest(d * 0.35, 1.0)) * 0.3, 4)
          when list_has_any(qt, ['last', 'final', 'ending', 'end']) then round(greatest(0.0, 1.0 - greatest(0.0, d - e) / greatest(d * 0.35, 1.0)) * 0.3, 4) else 0.0 end temporal
   from lap where length(ov) > 0),
scored as (select *, round(lex + temporal, 4) score from lexed),
hits as (select * from (select *, row_number() over (partition by query_id, node_id order by score desc, r) best from scored) where best = 1)
"""


_HITS = _hits_sql({"q": QUERY})
_STEPS = """steps as (select user_id as session, row_number() over (partition by user_id order by ts, event_id) as step,
   case event_id % 5 when 0 then 'SEARCH' when 1 then 'OPEN' when 2 then 'OPEN' when 3 then 'SPLIT' else 'STOP' end as action_type, event_type as query,
   case when event_id % 3 = 0 then 1 else 0 end as new_evidence, length(props) as tokens from events)"""
_LEDGER = f"""{_SCENE_NODES},
opened as (select video_id, node_id source_node_id, 'visual' modality, s, e, trim(visual_summary) detail from nodes where trim(visual_summary) <> ''
  union all select video_id, node_id, 'ocr', s, e, trim(ocr_text) from nodes where trim(ocr_text) <> ''),
claimed as (select *, case modality when 'visual' then 'Visual evidence: ' else 'OCR evidence: ' end || substr(trim(regexp_replace(detail, '\\s+', ' ', 'g')), 1, 180) claim,
  round(least(0.95, 0.45 + length(detail) / 500.0), 4) confidence from opened),
ledger as (select *, video_id || '/' || printf('evidence_%05d', row_number() over (partition by video_id order by s, e, source_node_id, detail)) evidence_id from claimed)
"""
_WHY_TOKENS = "', '".join(Question(WHY).query)
_EV_TOKENS = (
    "list_distinct(list_transform(list_filter(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 1 and (w not in ('" + _STOP + "') or w in ('why','first','beginning','earliest','initial','last','final','ending','end'))), "
    "lambda w: case w " + " ".join(f"when '{a}' then '{b}'" for a, b in __import__("spanforge.functions.text", fromlist=["x"]).LEMMAS.items()) + " else w end))"
)
_hit = lambda words, tok=True: " + ".join(f"(case when contains(lt, '{w}'){f' or list_contains(dt, {chr(39)}{w}{chr(39)})' if tok else ''} then 1 else 0 end)" for w in words)

ORACLE = {
    "sc2_memory_tree": f"{_TREE}, {_NAMES} select * from named",
    "sc1_windows": f"with {_V} select video_id, cast(i + 1 as int) as i, i * 60.0 as s, least((i + 1) * 60.0, d) as e from v, lateral (select unnest(range(cast(ceil(d / 60.0) as bigint))) i)",
    "sc3_chunk_spans": """with r as (select distinct video_id, ord, span_start a, span_end b, floor(span_start / 60) * 60.0 c from speech_spans where span_start >= 0 and span_end >= span_start)
        select video_id, ord, round(case when a = b then c else c + (a - c) end, 3) as s, round(case when a = b then c + 60.0 else least(c + 60.0, c + (b - c)) end, 3) as e from r""",
    "sc4_sample_times": "with r as (select distinct video_id, ord, span_start a, span_end b from ocr_spans) select video_id, ord, round(a + (b - a) / 3 * k, 3) as t from r, (values (1), (2)) x(k)",
    "prj1_valid_spans": "select video_id, count(*) as spans, round(max(span_end - span_start), 3) as longest from visual_spans where span_end >= span_start and not isnan(span_start) and not isnan(span_end) group by 1",
    "prj4_display": "select distinct video_id, ord, printf('%.2f-%.2f', round(span_start, 0), round(span_end, 0)) as shown from ocr_spans",
    "prj3_contains": "select distinct video_id, ord from speech_spans where 60.0 between span_start and span_end",
    "jn1_speech_in_clips": f"{_TREE} select n.video_id, n.w as \"window\", count(*) as n, min(x.ord) as first_ord, max(x.ord) as last_ord from clips n join speech x on n.video_id = x.video_id and {_OK.format('x', 'n')} group by 1, 2",
    "jn1_overlap_join": """with a as (select distinct video_id, ord scene, span_start s, span_end e from visual_spans where granularity = 'scene' and span_end >= span_start and not isnan(span_start) and not isnan(span_end)),
        b as (select distinct video_id, ord reading, span_start s, span_end e from ocr_spans where span_end >= span_start)
        select a.video_id, scene, reading from a join b on a.video_id = b.video_id and a.s < b.e and b.s < a.e""",
    "jn2_scene_nodes": f"{_SCENE_NODES} select video_id, node_id, s, e, visual_summary, tags, entities, speech_n, ocr_n from nodes",
    "prj10_node_text": f"{_SEGMENT_NODES} select node_id, speech_text, ocr_text from nodes",
    "prj12_clip_pointers": f"""{_TREE}, src as (select video_id, max(case when metadata['source_video_path'] <> '' then metadata['source_video_path'] end) p from artifacts group by 1)
        select printf('%s_scene_%03d', s.video_id, i + 1) as node_id, split_part(coalesce(p, 'media/' || s.video_id || '.mp4'), '#t=', 1) || printf('#t=%.2f,%.2f', s, round(e, 0)) as clip_path from scenes s join src using (video_id)""",
    "jn3_children": f"{_TREE}, {_NAMES} select p.node_id as parent_id, p.level, count(*) as children, min(c.node_id) as first_child from named p join named c on c.parent_id = p.node_id group by 1, 2",
    "prj15_split": f"""{_SEGMENT_NODES} select parent_id as of_node, node_id, round(0.2 + least(speech_n * 0.05, 0.3) + least(ocr_n * 0.03, 0.2) + case when visual_summary <> '' then 0.15 else 0 end, 4) as score,
        case when speech_n = 0 and visual_summary = '' and ocr_n = 0 then 'visual' else concat_ws(',', case when speech_n > 0 then 'speech' end, case when visual_summary <> '' then 'visual' end, case when ocr_n > 0 then 'ocr' end) end as modalities from nodes""",
    "prj6_level_filter": f"{_TREE}, {_NAMES} select video_id, level, count(*) as n from named where level in ('scene', 'clip') group by 1, 2",
    "tk1_search": f"{_HITS} select * from (select video_id, node_id, modality, score, array_to_string(ov, ',') as terms, row_number() over (partition by video_id order by score desc, s, node_id) as rank from hits) where rank <= 5",
    "rt7_reasons": f"""{_HITS} select node_id, 'Matched ' || modality || ' terms ' || array_to_string(ov[1:4], ', ') || case when temporal > 0 then printf('; temporal prior %.2f', round(temporal, 2)) else '' end || ' in node ' || node_id as reason from hits""",
    "rt3_semantic": "select b.vec_id as query_id, a.vec_id, round(greatest(0.0, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))), 4) as similarity from embeddings a, embeddings b where b.vec_id % 100 = 0",
    "jn8_inverted_index": f"""{_ALL_NODES}, docs as (select node_id, 'speech' modality, speech_text t from nodes union all select node_id, 'visual', concat_ws(' ', nullif(visual_summary, ''), nullif(replace(tags, ',', ' '), ''), nullif(replace(entities, ',', ' '), '')) from nodes
        union all select node_id, 'ocr', ocr_text from nodes) select token, modality, count(*) as nodes from (select modality, unnest({_TOKENS.format('t')}) token from docs) group by 1, 2""",
    "jn8_search_many": f"""{_hits_sql(QUESTIONS)} select * from (select query_id, video_id, node_id, modality, score, array_to_string(ov, ',') as terms, row_number() over (partition by query_id, video_id order by score desc, s, node_id) as rank from hits) where rank <= 3""",
    "rt5_hybrid": f"""with q as (select vec_id query_id, (['{"', '".join(QUESTIONS.values())}'])[(vec_id // 100) % {len(QUESTIONS)} + 1] query, cast(embedding as double[]) v from embeddings where vec_id % 100 = 0),
        qt as (select *, lower(query) ql, {_TOKENS.format('query')} qt from q), d as (select doc_id item_id, text t, cast(embedding as double[]) e, {_TOKENS.format("coalesce(text, '')")} dt from documents join embeddings on doc_id = vec_id),
        p as (select *, list_filter(qt, lambda w: list_contains(dt, w)) ov from qt, d),
        l as (select query_id, item_id, case when length(ov) > 0 then round(least(1.0, length(ov) / length(qt) + list_sum(list_transform(ov, lambda w: cast((length(lower(t)) - length(replace(lower(t), w, ''))) / length(w) as bigint))) / greatest(length(dt), 1)
          + case when contains(lower(t), ql) then 0.25 else 0.0 end), 4) else 0.0 end lexical, round(greatest(0.0, list_cosine_similarity(e, v)), 4) semantic from p)
        select *, ((cast(round(lexical * 10000) as bigint) * 7 + cast(round(semantic * 10000) as bigint) * 3 + 5) // 10) / 10000 as score from l where lexical > 0 or semantic > 0""",
    "tk3_initial_frontier": f"""{_HITS}, f as (select video_id, node_id, s, score, modality as modalities from hits
        union all select video_id, node_id, s, 0.1, 'visual,speech' from nodes where level = 'scene' and video_id not in (select video_id from hits))
        select * from (select video_id, node_id, score, modalities, row_number() over (partition by video_id order by score desc, s, node_id) as rank from f) where rank <= 8""",
    "tk8_topical_index": f"{_SCENE_NODES} select * from (select video_id, row_number() over (partition by video_id order by s, node_id) as rank, substr(case when visual_summary <> '' then visual_summary else node_id end, 1, 120) as topic from nodes) where rank <= 6",
    "rt10_open_visual": f"""{_SEGMENT_NODES} select node_id as source_node_id, 'visual' as modality, 'Visual evidence: ' || substr(trim(regexp_replace(trim(visual_summary), '\\s+', ' ', 'g')), 1, 180) as claim,
        round(least(0.95, 0.45 + length(trim(visual_summary)) / 500.0), 4) as confidence from nodes where trim(visual_summary) <> ''""",
    "rt11_open_ocr": f"""{_SEGMENT_NODES} select node_id as source_node_id, 'OCR evidence: ' || substr(trim(regexp_replace(trim(ocr_text), '\\s+', ' ', 'g')), 1, 180) as claim,
        round(least(0.95, 0.45 + length(trim(ocr_text)) / 500.0), 4) as confidence from nodes where trim(ocr_text) <> ''""",
    "rt13_span_scores": f"""with r as (select distinct video_id, ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) t from speech_spans where text is not null), k as (select *, lower(t) lt, {_EV_TOKENS} dt from r),
        o as (select *, list_filter(['{_WHY_TOKENS}'], lambda w: list_contains(dt, w)) ov, {_hit(["worried", "lose", "fix", "repair", "open", "clasp"])} causal, {_hit(["wear", "love", "bracelet", "cartier", "clash", "perfect"])} support,
          {_hit(["other bracelet", "another bracelet", "last but not the least", "last but not least"], False)} shift from k)
        select video_id, ord, case when length(dt) = 0 then 0.0 else round(length(ov) / {len(Question(WHY).query)}.0
          + coalesce(list_sum(list_transform(ov, lambda w: cast((length(lt) - length(replace(lt, w, ''))) / length(w) as bigint))), 0) / greatest(length(dt), 1)
          + causal * 0.35 + support * 0.08 - case when contains(lt, 'because') and causal = 0 and length(ov) < 2 then 0.2 else 0 end - shift * 0.25, 4) end as score from o""",
    "rt15_sentences": r"""with s as (select doc_id, unnest(list_filter(string_split_regex(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) s from documents)
        select doc_id, count(*) as n, max(length(s)) as longest from s group by 1""",
    "wn7_sentence_windows": r"""with s as (select doc_id, list_filter(string_split_regex(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') s from documents)
        select doc_id, list_max(list_transform(range(1, length(s) + 1), lambda i: length(array_to_string(s[greatest(i - 1, 1):i + 2], ' ')))) as widest, length(s) as windows from s where length(s) > 0""",
    "ag8_merge": f"""{_LEDGER}, w as (select video_id request_id, pos, l.* from (select distinct video_id vid from artifacts), (values (1, '2'), (2, '1'), (3, '9')) x(pos, k) join ledger l on l.evidence_id = vid || '/evidence_0000' || k)
        select request_id, round(avg(confidence), 4) as confidence, string_agg(claim, ' | ' order by pos) as claim, string_agg(detail, chr(10) order by pos) as detail, arg_min(source_node_id, pos) as source_node_id, arg_min(s, pos) as s, arg_min(e, pos) as e, count(*) as merged from w group by 1""",
    "st4_cite": f"{_LEDGER} select video_id, evidence_id like '%00001' as used_in_final_answer, count(*) as n from ledger group by 1, 2",
    "tk4_answer_evidence": f"{_LEDGER} select * from (select video_id, row_number() over (partition by video_id order by confidence desc, s, source_node_id, evidence_id) as rank, evidence_id, claim, confidence from ledger) where rank <= 4",
    "jn9_new_evidence": r"""with r as (select distinct video_id, ord, round(span_start, 2) s, round(span_end, 2) e, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) d from speech_spans where text is not null)
        select video_id, ord from r a where not exists (select 1 from r b where b.ord % 2 = 0 and a.video_id = b.video_id and a.s = b.s and a.e = b.e and a.d = b.d)""",
    "wn5_latest_search": f"with {_STEPS} select session, step, coalesce(last_value(case when action_type = 'SEARCH' and trim(query) <> '' then trim(query) end ignore nulls) over (partition by session order by step rows unbounded preceding), 'the question') as search_query from steps",
    "wn2_empty_open_stops": f"""with {_STEPS}, e as (select *, action_type = 'OPEN' and new_evidence = 0 empty, lag(action_type = 'OPEN' and new_evidence = 0) over w before, sum(new_evidence) over (partition by session order by step rows unbounded preceding) ledger from steps window w as (partition by session order by step))
        select session, min(step) as step from e where empty and before and ledger > 0 group by 1""",
    "wn3_step_budget": f"""with {_STEPS} select session, step, step as steps_used, greatest(20 - step, 0) as steps_remaining, sum(case when action_type = 'OPEN' then 1 else 0 end) over w as clips_opened, sum(tokens) over w as tokens_spent from steps
        window w as (partition by session order by step rows unbounded preceding)""",
    "prj5_valid_actions": f"""with {_STEPS} select action_type, case action_type when 'SEARCH' then query <> '' and step % 2 = 0 when 'OPEN' then step % 3 > 0 and step % 2 = 0 when 'SPLIT' then step % 3 > 0 else true end as ok, count(*) as n from steps group by 1, 2""",
    "st1_merge_frontier": """with r as (select strftime(l_shipdate, '%Y-%m') as session, cast(l_suppkey as varchar) node_id, l_linenumber n, round(max(l_discount), 2) score, cast(min(l_orderkey) as double) s, min(case when l_returnflag = 'R' then 'speech' else 'visual' end) m, min(l_orderkey) ord
          from lineitem where l_linenumber <= 2 group by 1, 2, 3),
        a as (select * from r where n = 1), b as (select * from r where n = 2),
        f as (select session, node_id, case when b.score >= a.score or a.score is null then b.score else a.score end score, case when b.score >= a.score or a.score is null then b.s else a.s end s,
          case when b.score >= a.score or a.score is null then b.ord else a.ord end ord, case when b.score >= a.score or a.score is null then b.m when b.m is null or b.m = a.m then a.m else 'speech,visual' end modalities from a full join b using (session, node_id))
        select * exclude (ord) from (select *, row_number() over (partition by session order by score desc, s, ord, node_id) as rank from f) where rank <= 8""",
    "st2_status": f"{_TREE}, x as (select printf('%s_scene_%03d', video_id, i + 1) node_id from scenes) select case when node_id = 'vid_0000000_scene_001' then 'expanded' else 'unopened' end as status, count(*) as n from x where node_id <> 'vid_0000000_scene_002' group by 1",
    "st7_visual_sets": "select granularity, count(*) as n from visual_spans where granularity in ('scene', 'clip') group by 1",
    "prj21_granularity": "select case when span_end - span_start >= 20 then 'scene' else 'clip' end as granularity, count(*) as n from (select distinct video_id, ord, span_start, span_end from visual_spans) where span_end >= span_start and not isnan(span_start) and not isnan(span_end) group by 1",
    "sc5_word_level": "select video_id, count(*) >= 8 and avg(case when length(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 3 then 1.0 else 0.0 end) >= 0.9 as word_level from speech_spans where text is not null group by 1",
}
