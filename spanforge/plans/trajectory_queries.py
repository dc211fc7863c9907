"""Queries over runs, iterations, completions, logs, scores and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import lm
from spanforge.functions import payloads, prompts
from spanforge.functions import text as tx
from spanforge.functions.focus import chosen_candidates
from spanforge.operators import memory as mem
from spanforge.operators import scoring as sc
from spanforge.operators import trajectory as tr
from spanforge.operators.ordered import running
from spanforge.sources.files import is_audio_path
from spanforge.tables import table

LIMITS = {"tessel": 32_000, "tessel-large": 200, "quill": 64_000, "quill-vl-8b": 90, "orla": 16_000}


def _once(spark: SparkSession, sf: str, name: str, *key: str) -> DataFrame:
    return table(spark, sf, name).dropDuplicates(list(key))


def ag1_usage_by_model(spark: SparkSession, sf: str) -> DataFrame:
    u = tr.usage_by_model(_once(spark, sf, "completions", "completion_id"))
    return u.withColumn("cost", F.round("cost", 4))


def ag2_usage_total(spark: SparkSession, sf: str) -> DataFrame:
    return tr.usage_total(tr.usage_by_model(_once(spark, sf, "completions", "completion_id"))).withColumn("cost", F.round("cost", 3))


def ag3_merged_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage of a model by source, in which the later source replaces the earlier one."""
    c = _once(spark, sf, "completions", "completion_id").filter("root_model is not null")
    part = F.pmod(F.col("completion_id"), F.lit(3))
    parts = c.groupBy(F.col("root_model").alias("model"), part.alias("priority")).agg(F.count(F.lit(1)).alias("calls"), F.sum("total_input_tokens").alias("input_tokens"))
    return tr.merged_usage(parts)


def jn10_client_routing(spark: SparkSession, sf: str) -> DataFrame:
    c = _once(spark, sf, "completions", "completion_id").select("completion_id", F.col("root_model").alias("model"), F.pmod("completion_id", F.lit(3)).alias("depth"))
    known = spark.createDataFrame([("tessel-mini",), ("orla-7b",)], "model string")
    return tr.client_for(c, known, "default-model", "second-model").groupBy("served_by", "depth").agg(F.count(F.lit(1)).alias("n"))


def jn11_context_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Each run's own model, and a public one by turns, in the table of public limits and the site's own."""
    runs = _once(spark, sf, "runs", "run_id").select("run_id", "root_model", _public_model().alias("public_model"))
    limits = tr.limits_table(spark, tr.CONTEXT_LIMITS | LIMITS)
    own = tr.context_limits(runs, limits)
    return tr.context_limits(own.withColumnRenamed("token_limit", "own_limit"), limits, "public_model")


def _public_model():
    """A name that holds one of the public names, by the length and the limit of the run."""
    names = list(tr.CONTEXT_LIMITS)
    turn = F.pmod(F.coalesce("max_iterations", F.lit(0)) * 7 + F.coalesce("max_depth", F.lit(0)) * 3 + F.coalesce(F.length("root_model"), F.lit(0)), F.lit(len(names))) + 1
    return F.concat(F.lit("vendor/"), F.element_at(F.array(*[F.lit(n) for n in names]), turn.cast("int")), F.lit("-2025"))


def ag10_prompt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "iterations", "run_id", "iteration").select("run_id", "iteration", tr.prompt_tokens(F.col("prompt")).alias("tokens"))


def ag11_compaction(spark: SparkSession, sf: str) -> DataFrame:
    return tr.compaction(_once(spark, sf, "iterations", "run_id", "iteration"), table(spark, sf, "runs"), tr.limits_table(spark, tr.CONTEXT_LIMITS | LIMITS))


def wn1_error_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return tr.error_streaks(table(spark, sf, "iterations"), 2)


def wn3_running_limits(spark: SparkSession, sf: str) -> DataFrame:
    """In the order of time; a repeated call counts once, at its earliest time."""
    c = table(spark, sf, "completions")
    earliest = F.min(F.struct(F.col("created_at").isNull().alias("_late"), "created_at", *[x for x in c.columns if x not in ("completion_id", "created_at")])).alias("_c")
    return tr.running_limits(c.groupBy("completion_id").agg(earliest).select("completion_id", "_c.*"), 0.05, 20_000, 60.0)


def wn10_history(spark: SparkSession, sf: str) -> DataFrame:
    return tr.history(table(spark, sf, "iterations")).groupBy("run_id", "iteration", "role").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("content")).alias("characters"))


def sc9_execution_messages(spark: SparkSession, sf: str) -> DataFrame:
    h = tr.history(table(spark, sf, "iterations").filter("code_blocks is not null")).filter("role = 'user'")
    return h.select("run_id", "iteration", "pos", "content")


def ct3_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The history of each run over all its iterations, compacted."""
    h = running(tr.history(table(spark, sf, "iterations")), "run_id", ["iteration", "pos"], sums={"_n": F.lit(1).cast("bigint")})
    return tr.compacted(h.select("run_id", (F.col("_n") - 1).alias("ord"), "role", "content"), F.lit("summary")).select("run_id", "ord", "role", "content")


def ag5_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tr.run_summary(table(spark, sf, "iterations"))


def prj16_prompt_shape(spark: SparkSession, sf: str) -> DataFrame:
    rows = _once(spark, sf, "iterations", "run_id", "iteration").withColumn("_p", tr.prompt_shape(F.col("prompt")))
    return rows.select("run_id", "iteration", "_p.chunks", "_p.total")


def sc18_first_question(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "iterations", "run_id", "iteration").select("run_id", "iteration", tr.first_question(F.col("prompt")).alias("question"))


def jn7_question_of_answer(spark: SparkSession, sf: str) -> DataFrame:
    it = _once(spark, sf, "iterations", "run_id", "iteration").filter("prompt is not null")
    turns = it.select(F.concat_ws("#", "run_id", F.col("iteration").cast("string")).alias("conv_id"), F.posexplode("prompt").alias("turn", "_m")).select("conv_id", "turn", F.col("_m.role").alias("role"), F.col("_m.content").alias("text"))
    return tr.as_of_questions(turns)


def prj17_contents(spark: SparkSession, sf: str) -> DataFrame:
    it = _once(spark, sf, "iterations", "run_id", "iteration").filter("prompt is not null")
    return it.select("run_id", "iteration", F.array_join(tx.contents(F.col("prompt")), "|").alias("contents"))


def sc15_roles(spark: SparkSession, sf: str) -> DataFrame:
    """System messages apart from the others, the assistant called model."""
    it = _once(spark, sf, "iterations", "run_id", "iteration").filter("prompt is not null")
    parts = it.select("run_id", "iteration", tx.split_system(F.col("prompt"), "model").alias("_p"))
    return parts.select("run_id", "iteration", "_p.system", F.array_join(F.transform("_p.messages", lambda m: m["role"]), ",").alias("roles"))


def sc7_code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of the iterations written as fenced text and found again."""
    it = _once(spark, sf, "iterations", "run_id", "iteration").filter("code_blocks is not null")
    fenced = F.array_join(F.transform(F.filter("code_blocks", lambda b: b.isNotNull()), lambda b: F.concat(F.lit("```repl\n"), F.coalesce(b["code"], F.lit("x")), F.lit("\n```"))), "\ntext\n")
    return it.select("run_id", "iteration", F.size(tx.code_blocks(fenced)).alias("blocks"), F.length(F.array_join(tx.code_blocks(fenced), "")).alias("characters"))


def sc8_final_answers(spark: SparkSession, sf: str) -> DataFrame:
    c = _once(spark, sf, "completions", "completion_id").filter("response is not null")
    return c.select("completion_id", tx.final_answer(F.col("response")).alias("answer")).filter("answer is not null")


def sc14_without_thinking(spark: SparkSession, sf: str) -> DataFrame:
    c = _once(spark, sf, "completions", "completion_id").filter("response like '%<think>%'")
    return c.select("completion_id", F.length(tx.without_thinking(F.col("response"))).alias("characters"))


def src7_log_kinds(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "iteration_log").select("run_id", F.try_parse_json("line").alias("v")).filter("v is not null")
    kind = F.try_variant_get("v", "$.type", "string")
    return log.groupBy("run_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("lines")).filter("kind is not null")


def snk4_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """Iterations numbered anew within their run."""
    return tr.numbered_iterations(table(spark, sf, "iterations").select("run_id", "iteration"))


def jn6_not_done(spark: SparkSession, sf: str) -> DataFrame:
    runs = _once(spark, sf, "runs", "run_id").select("run_id")
    return runs.join(table(spark, sf, "iterations").select("run_id").distinct(), "run_id", "left_anti")


def prj7_filters(spark: SparkSession, sf: str) -> DataFrame:
    r = _once(spark, sf, "runs", "run_id").filter(F.col("backend").isNotNull() & F.col("environment_type").isin("local", "docker"))
    return r.select("run_id", "backend", "environment_type")


def ag9_counts(spark: SparkSession, sf: str) -> DataFrame:
    return mem.fact_counts(speech=table(spark, sf, "speech_spans"), visual=table(spark, sf, "visual_spans"), ocr=table(spark, sf, "ocr_spans"))


def prj8_safe_metadata(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "artifacts").filter("metadata is not null").dropDuplicates(["video_id"])
    secret = F.map_concat("metadata", F.create_map(F.lit("my_API_key"), F.lit("x")))
    return a.select("video_id", F.size(tx.safe_keys(secret)).alias("kept"))


def prj20_audio_paths(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".WAV"), F.lit(".mp4"), F.lit(".webm")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")))
    return d.groupBy(is_audio_path(path).alias("audio")).agg(F.count(F.lit(1)).alias("n"))


def src17_folder_names(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "runs").filter("root_model is not null")
    return r.select(tx.folder_name(F.concat(F.lit("org/"), "root_model", F.lit(" v1"))).alias("folder")).distinct()


def rt1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", F.size(tx.search_tokens(F.col("text"))).alias("tokens"))


def rt9_evidence_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "speech_spans").filter("text is not null").dropDuplicates(["video_id", "ord"])
    return d.select("video_id", "ord", F.size(tx.evidence_tokens(F.col("text"))).alias("tokens"))


def sc6_tidy(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "speech_spans").filter("text is not null").dropDuplicates(["video_id", "ord"])
    loose = F.regexp_replace("text", r"([,.!?])", " $1")
    return d.select("video_id", "ord", tx.tidy_punctuation(loose).alias("text"))


def sc9_clipped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.clipped(F.col("text"), 300).alias("text"))


def sc11_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", sc.criteria_met(F.col("text")).alias("criteria_met"))


def sc10_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The answers of responses that are JSON."""
    c = _once(spark, sf, "completions", "completion_id")
    return c.select("completion_id", tx.first_json(F.col("response"))["answer"].alias("answer")).filter("answer is not null")


def ud4_batched_queries(spark: SparkSession, sf: str) -> DataFrame:
    c = _once(spark, sf, "completions", "completion_id")
    requests = c.select(F.col("run_id").alias("batch_id"), F.col("completion_id").alias("ord"), "prompt", F.col("root_model").alias("model"))
    return lm.query_batches(requests, lambda: lm.Scripted(fail_on="kettle")).select("batch_id", "ord", "response", "error", "input_tokens")


def rt8_distinct_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct text once, with the number of places it goes back to: what an embedding cache computes."""
    o = table(spark, sf, "ocr_spans").filter("text is not null")
    return o.groupBy("text").agg(F.count(F.lit(1)).alias("uses"))


def _criteria(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines read as rubric criteria."""
    tasks = [t for ts in sc.CATEGORIES.values() for t in ts] + ["motion_analysis", "juggling"]
    li = table(spark, sf, "lineitem")
    task = F.element_at(F.array(*[F.lit(t) for t in tasks]), (F.pmod("l_orderkey", F.lit(len(tasks))) + 1).cast("int"))
    return li.select(F.col("l_orderkey").alias("sample_id"), task.alias("task"), (F.col("l_linenumber") - 2).cast("double").alias("weight"), (F.col("l_returnflag") == "R").alias("is_penalty"), (F.col("l_linestatus") == "O").alias("criteria_met"))


def bm2_sample_points(spark: SparkSession, sf: str) -> DataFrame:
    return sc.sample_points(_criteria(spark, sf))


def bm3_task_scores(spark: SparkSession, sf: str) -> DataFrame:
    return sc.task_scores(sc.sample_points(_criteria(spark, sf))).withColumn("accuracy", F.round("accuracy", 6))


def bm4_category_scores(spark: SparkSession, sf: str) -> DataFrame:
    return sc.category_scores(sc.task_scores(sc.sample_points(_criteria(spark, sf))), sc.categories(spark)).withColumn("accuracy", F.round("accuracy", 6))


def bm5_overall(spark: SparkSession, sf: str) -> DataFrame:
    by = sc.category_scores(sc.task_scores(sc.sample_points(_criteria(spark, sf))), sc.categories(spark))
    return sc.overall_score(by).withColumn("accuracy", F.round("accuracy", 6))


def snk8_report(spark: SparkSession, sf: str) -> DataFrame:
    return sc.report_lines(sc.task_scores(sc.sample_points(_criteria(spark, sf))), sc.categories(spark))


def ag14_trace_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Per user of the event log: sessions without STOP, repeated OPENs, searches without hits."""
    e = table(spark, sf, "events")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("SEARCH", "OPEN", "MERGE", "SPLIT", "STOP")]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    return tr.trace_statistics(e.select(F.col("user_id").alias("session"), kinds.alias("action_type"), F.col("event_type").alias("node_id"), F.when(F.pmod("event_id", F.lit(3)) == 0, 1).otherwise(0).alias("hits")))


def sc13_judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    c = _once(spark, sf, "completions", "completion_id")
    return c.select("completion_id", prompts.judge_prompt(F.col("prompt"), F.col("response"), F.lit("names an object")).alias("prompt"))


def sc13_context_prompts(spark: SparkSession, sf: str) -> DataFrame:
    it = _once(spark, sf, "iterations", "run_id", "iteration").filter("prompt is not null")
    lengths = F.transform("prompt", lambda m: F.coalesce(F.length(m["content"]), F.lit(0)).cast("bigint"))
    return it.select("run_id", "iteration", prompts.context_prompt(F.lit("list"), lengths).alias("prompt"))


def bm1_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Each completion judged on whether it names the kettle, by a scripted judge."""
    c = _once(spark, sf, "completions", "completion_id")
    rows = c.select("completion_id", prompts.judge_prompt(F.col("prompt"), F.col("response"), F.lit("names an object")).alias("prompt"))
    judge = lambda: lm.Scripted({"kettle": '{"criteria_met": true}', "tripod": "no idea"}, fail_on="violin")
    return lm.judged(rows, judge).select("completion_id", "criteria_met", "evaluation_error", "attempts")


def prj19_state_payload(spark: SparkSession, sf: str) -> DataFrame:
    it = _once(spark, sf, "iterations", "run_id", "iteration").filter("prompt is not null")
    said = F.transform("prompt", lambda m: m["content"])
    none = F.array().cast("array<string>")
    return it.select("run_id", "iteration", prompts.state_payload(F.col("response"), none, none, none, said).alias("payload"))


def sc17_speech_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Spans written the way recognisers do, three ways by turns, and read again."""
    s = table(spark, sf, "speech_spans").filter("trim(text) <> ''").dropDuplicates(["video_id", "ord"])
    a, b, t = F.col("span_start"), F.col("span_end"), F.col("text")
    ways = [F.struct(t.alias("text"), a.alias("start"), b.alias("end")), F.struct(t.alias("content"), a.alias("start_time"), b.alias("end_time")), F.struct(t.alias("sentence"), F.array(a, b).alias("timestamp"))]
    item = F.when(F.col("ord") % 3 == 0, F.to_json(ways[0])).when(F.col("ord") % 3 == 1, F.to_json(ways[1])).otherwise(F.to_json(ways[2]))
    payload = F.concat(F.lit('{"segments": ['), item, F.lit(', {"text": "no times"}]}'))
    return s.select("video_id", "ord", F.inline(payloads.speech_spans(payload)))


def src11_scene_replies(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "visual_spans").filter("summary is not null").dropDuplicates(["video_id", "ord"])
    reply = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("Here it is: "), F.to_json(F.struct("summary")))).otherwise(F.col("summary"))
    return v.select("video_id", "ord", payloads.scene_summary(reply)["summary"].alias("summary"))


def sc12_chosen_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = _once(spark, sf, "completions", "completion_id").select("completion_id")
    n = F.pmod("completion_id", F.lit(5)).cast("string")
    reply = F.when(F.col("completion_id") % 2 == 0, F.concat(F.lit('{"selected_candidate_ids": ["c'), n, F.lit('", "c1", "c9"]}'))).otherwise(F.concat(F.lit("I pick C2 and c"), n, F.lit(".")))
    offered = F.array(*[F.lit(x) for x in "abc"])
    return c.select("completion_id", F.array_join(F.transform(chosen_candidates(reply, offered), lambda x: x.cast("string")), ",").alias("chosen"))


def prj9_serialized(spark: SparkSession, sf: str) -> DataFrame:
    """The values of a result's variables as one text."""
    it = _once(spark, sf, "iterations", "run_id", "iteration").filter("code_blocks is not null")
    rows = it.select("run_id", "iteration", F.posexplode("code_blocks").alias("block", "b")).filter("b.result.locals is not null")
    return rows.select("run_id", "iteration", "block", tx.joined_map(F.col("b.result.locals")).alias("locals"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_C = "c as (select distinct on (completion_id) * from completions)"
_I = "i as (select distinct on (run_id, iteration) * from iterations)"
_R = "r as (select distinct on (run_id) * from runs)"
_LIMITS = "l(part, token_limit) as (values " + ", ".join(f"('{k}', {v})" for k, v in (tr.CONTEXT_LIMITS | LIMITS).items()) + ")"
_TASKS = [t for ts in sc.CATEGORIES.values() for t in ts] + ["motion_analysis", "juggling"]
_CRITERIA = f"""crit as (select l_orderkey sample_id, (['{"', '".join(_TASKS)}'])[l_orderkey % {len(_TASKS)} + 1] task0, cast(l_linenumber - 2 as double) weight, l_returnflag = 'R' pen, l_linestatus = 'O' met from lineitem),
 points as (select sample_id, case task0 when 'motion_analysis' then 'compositional_reasoning' else task0 end task, sum(case when met and not pen then weight else 0 end) obtained, sum(case when weight > 0 then weight else 0 end) maximum from crit group by 1, 2),
 tasks as (select task, case when sum(maximum) > 0 then sum(obtained) / sum(maximum) else 0.0 end accuracy, count(*) samples from points group by 1),
 cats(task, category) as (values {", ".join(f"('{t}', '{c}')" for c, ts in sc.CATEGORIES.items() for t in ts)}),
 by_cat as (select category, avg(accuracy) accuracy, count(*) tasks from tasks join cats using (task) group by 1)"""
_STOP = "', '".join(tx.STOPWORDS)
_CONTROL = "', '".join(tx.CONTROL_WORDS)
_LEMMA = "case w " + " ".join(f"when '{a}' then '{b}'" for a, b in tx.LEMMAS.items()) + " else w end"
_ERR = "coalesce(list_bool_or(list_transform(code_blocks, lambda b: coalesce(b.result.stderr <> '', false))), false)"
_BLOCKS = "list_filter(coalesce(code_blocks, []), lambda b: b is not null)"
_MSG = r"""case when b.result.stdout <> '' then chr(10) || b.result.stdout end, case when b.result.stderr <> '' then chr(10) || b.result.stderr end,
   case when length(list_filter(map_keys(b.result.locals), lambda k: k not like '\_%' escape '\')) > 0 then 'REPL variables: [''' || array_to_string(list_filter(map_keys(b.result.locals), lambda k: k not like '\_%' escape '\'), ''', ''') || ''']' || chr(10) end"""
_SHOWN = f"coalesce(nullif(concat_ws(chr(10) || chr(10), {_MSG}), ''), 'No output')"
_HIST = f"""{_I}, h as (select run_id, iteration, 0 pos, 'assistant' role, coalesce(response, '') content from i
   union all select run_id, iteration, k, 'user', 'Code executed:' || chr(10) || '```python' || chr(10) || coalesce(b.code, '') || chr(10) || '```' || chr(10) || chr(10) || 'REPL output:' || chr(10)
     || case when length({_SHOWN}) > {tr.MAX_RESULT} then substr({_SHOWN}, 1, {tr.MAX_RESULT}) || '... + [' || (length({_SHOWN}) - {tr.MAX_RESULT}) || ' chars...]' else {_SHOWN} end from (select run_id, iteration, unnest({_BLOCKS}) b, unnest(range(1, length({_BLOCKS}) + 1)) k from i))"""
_NOUN = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, ' ,', ','), ' .', '.'), ' !', '!'), ' ?', '?'), ' ;', ';'), ' :', ':'), ' n''t', 'n''t'), ' ''m', '''m'), ' ''re', '''re'), ' ''ve', '''ve'), ' ''ll', '''ll'), ' ''d', '''d'), ' )', ')'), '( ', '(')"

ORACLE = {
    "ag1_usage_by_model": f"with {_C} select root_model, count(*) as calls, coalesce(sum(total_input_tokens), 0) as input_tokens, coalesce(sum(total_output_tokens), 0) as output_tokens, round(sum(case when total_cost > 0 then total_cost end), 4) as cost from c group by 1",
    "ag2_usage_total": f"with {_C} select count(*) as calls, sum(total_input_tokens) as input_tokens, sum(total_output_tokens) as output_tokens, round(sum(case when total_cost > 0 then total_cost end), 3) as cost from c",
    "ag3_merged_usage": f"with {_C}, p as (select root_model as model, completion_id % 3 as k, count(*) as calls, sum(total_input_tokens) as input_tokens from c where root_model is not null group by 1, 2) select model, arg_max(calls, k) as calls, arg_max(input_tokens, k) as input_tokens from p group by 1",
    "jn10_client_routing": f"with {_C} select case when root_model in ('tessel-mini', 'orla-7b') then root_model when completion_id % 3 = 1 then 'second-model' else 'default-model' end as served_by, completion_id % 3 as depth, count(*) as n from c group by 1, 2",
    "jn11_context_limits": f"""with {_R}, {_LIMITS}, p as (select run_id, root_model, 'vendor/' || (['{"', '".join(tr.CONTEXT_LIMITS)}'])[(coalesce(max_iterations, 0) * 7 + coalesce(max_depth, 0) * 3 + coalesce(length(root_model), 0)) % {len(tr.CONTEXT_LIMITS)} + 1] || '-2025' public_model from r)
        select *, coalesce((select arg_max(token_limit, (case when part = root_model then 1000 else 0 end) + length(part)) from l where contains(root_model, part)), 128000) as own_limit,
          coalesce((select arg_max(token_limit, (case when part = public_model then 1000 else 0 end) + length(part)) from l where contains(public_model, part)), 128000) as token_limit from p""",
    "ag10_prompt_tokens": f"with {_I} select run_id, iteration, cast(ceil(coalesce(list_sum(list_transform(prompt, lambda m: coalesce(length(m.content), 0))), 0) / 4.0) as bigint) as tokens from i",
    "ag11_compaction": f"""with {_I}, m as (select run_id, max(root_model) root_model from runs group by 1), {_LIMITS},
        t as (select run_id, iteration, cast(ceil(coalesce(list_sum(list_transform(prompt, lambda m: coalesce(length(m.content), 0))), 0) / 4.0) as bigint) tokens,
          coalesce((select arg_max(token_limit, (case when part = root_model then 1000 else 0 end) + length(part)) from l where contains(root_model, part)), 128000) token_limit from i left join m using (run_id))
        select run_id, iteration, tokens, cast(floor(token_limit * 0.85) as bigint) as threshold, token_limit, tokens >= cast(floor(token_limit * 0.85) as bigint) as compact from t""",
    "wn1_error_streaks": f"""with e as (select run_id, cast(iteration as bigint) iteration, bool_or({_ERR}) failed from iterations group by 1, 2), g as (select *, sum(case when failed then 0 else 1 end) over (partition by run_id order by iteration rows unbounded preceding) island from e),
        s as (select *, case when failed then row_number() over (partition by run_id, island order by iteration) - case when island > 0 then 1 else 0 end else 0 end streak from g) select run_id, iteration, failed, streak, streak >= 2 as tripped from s""",
    "wn3_running_limits": f"""with c as (select completion_id, any_value(run_id) run_id, any_value(total_cost) total_cost, any_value(total_input_tokens) total_input_tokens, any_value(total_output_tokens) total_output_tokens,
          any_value(execution_time) execution_time, min(created_at) made from completions group by 1), s as (select run_id, completion_id, sum(cast(trunc(coalesce(total_cost, 0) * 1e9) as bigint)) over w xc, sum(coalesce(total_input_tokens, 0) + coalesce(total_output_tokens, 0)) over w xt, sum(cast(trunc(coalesce(execution_time, 0) * 1e6) as bigint)) over w xs from c window w as (partition by run_id order by made nulls first, completion_id rows unbounded preceding))
        select run_id, completion_id, round(xc / 1e9, 6) as cost, xt as tokens, round(xs / 1e6, 4) as "seconds", xc > 50000000 as over_cost, xt > 20000 as over_tokens, xs > 60000000 as over_time from s""",
    "wn10_history": f"with {_HIST} select run_id, iteration, role, count(*) as messages, sum(length(content)) as characters from h group by 1, 2, 3",
    "sc9_execution_messages": f"with {_HIST} select run_id, iteration, pos, content from h where role = 'user'",
    "ct3_compacted": f"""with {_HIST}, n as (select run_id, row_number() over (partition by run_id order by iteration, pos) - 1 as ord, role, content from h), r as (select distinct run_id from h)
        select * from n where ord < 2 union all select run_id, 2, 'assistant', 'summary' from r union all select run_id, 3, 'user', 'Continue from the summary above.' from r""",
    "ag5_run_summary": f"""with {_I}, p as (select run_id, iteration, final_answer, {_BLOCKS} b, {_ERR} e, iteration_time from i),
        q as (select run_id, iteration, final_answer, length(b) n, e, coalesce(list_sum(list_transform(b, lambda x: length(list_filter(coalesce(x.result.rlm_calls, []), lambda y: y is not null)))), 0) k, coalesce(iteration_time, list_sum(list_transform(b, lambda x: coalesce(x.result.execution_time, 0.0))), 0.0) t from p)
        select run_id, count(*) as iterations, sum(n) as blocks, sum(k) as calls, round(sum(cast(round(t * 10000) as bigint)) / 10000, 4) as seconds, bool_or(e) as errors, arg_max(final_answer, iteration) filter (where final_answer <> '') as final_answer from q group by 1""",
    "prj16_prompt_shape": f"with {_I} select run_id, iteration, coalesce(length(prompt), 0) as chunks, coalesce(list_sum(list_transform(prompt, lambda m: coalesce(length(m.content), 0))), 0) as total from i",
    "sc18_first_question": f"with {_I} select run_id, iteration, substr(list_filter(prompt, lambda m: m.role = 'user' and length(m.content) between 51 and 499)[1].content, 1, 200) as question from i",
    "jn7_question_of_answer": f"""with {_I}, t as (select run_id || '#' || iteration conv_id, unnest(range(length(prompt))) turn, unnest(prompt) m from i where prompt is not null),
        u as (select conv_id, turn, m.role r, m.content t, last_value(case when m.role in ('user', 'assistant') then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) p from t)
        select a.conv_id, a.turn, case when b.r = 'user' then b.t end as question, a.t as answer, coalesce(b.r = 'user', false) as pending from u a left join u b on a.conv_id = b.conv_id and a.p = b.turn where a.r = 'assistant'""",
    "prj17_contents": f"with {_I} select run_id, iteration, array_to_string(list_transform(prompt, lambda m: coalesce(m.content, '')), '|') as contents from i where prompt is not null",
    "sc15_roles": f"""with {_I} select run_id, iteration, coalesce(array_to_string(list_transform(list_filter(prompt, lambda m: m.role = 'system'), lambda m: m.content), chr(10)), '') as system,
        coalesce(array_to_string(list_transform(list_filter(prompt, lambda m: m.role <> 'system'), lambda m: case m.role when 'assistant' then 'model' else m.role end), ','), '') as roles from i where prompt is not null""",
    "sc7_code_blocks": f"with {_I} select run_id, iteration, length({_BLOCKS}) as blocks, coalesce(list_sum(list_transform({_BLOCKS}, lambda b: length(trim(coalesce(b.code, 'x'), ' ' || chr(10) || chr(9))))), 0) as characters from i where code_blocks is not null",
    "sc8_final_answers": rf"with {_C} select completion_id, regexp_replace(regexp_extract(response, '(?ms)^\s*FINAL\((.*)\)\s*$', 1), '^\s+|\s+$', '', 'g') as answer from c where regexp_matches(response, '(?ms)^\s*FINAL\((.*)\)\s*$') and not regexp_matches(response, '(?m)^\s*FINAL_VAR\(')",
    "sc14_without_thinking": rf"with {_C} select completion_id, length(trim(regexp_replace(response, '(?s)<think>.*?</think>\s*', '', 'g'))) as characters from c where response like '%<think>%'",
    "src7_log_kinds": "select run_id, json_extract_string(try_cast(line as json), '$.type') as kind, count(*) as lines from iteration_log where json_valid(line) and json_extract_string(try_cast(line as json), '$.type') is not null group by 1, 2",
    "snk4_numbering": f"with {_I} select run_id, iteration, row_number() over (partition by run_id order by iteration) as number from i",
    "jn6_not_done": "select distinct run_id from runs where run_id not in (select run_id from iterations)",
    "prj7_filters": f"with {_R} select run_id, backend, environment_type from r where backend is not null and environment_type in ('local', 'docker')",
    "ag9_counts": "select video_id, 'speech' as kind, count(distinct ord) as n from speech_spans group by 1 union all select video_id, 'visual', count(distinct ord) from visual_spans group by 1 union all select video_id, 'ocr', count(distinct ord) from ocr_spans group by 1",
    "prj8_safe_metadata": "select distinct video_id, length(list_filter(map_keys(metadata), lambda k: not (contains(lower(k), 'api') and contains(lower(k), 'key')))) as kept from artifacts where metadata is not null",
    "prj20_audio_paths": "select doc_id % 3 <> 1 as audio, count(*) as n from documents group by 1",
    "src17_folder_names": "select distinct regexp_replace('org/' || root_model || ' v1', '[^A-Za-z0-9._-]+', '__', 'g') as folder from runs where root_model is not null",
    "rt1_token_counts": rf"select doc_id, length(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 and w not in ('{_STOP}')))) as tokens from documents where text is not null",
    "rt9_evidence_tokens": rf"select distinct video_id, ord, length(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 and (w not in ('{_STOP}') or w in ('{_CONTROL}'))), lambda w: {_LEMMA}))) as tokens from speech_spans where text is not null",
    "sc6_tidy": rf"select distinct video_id, ord, trim({_NOUN.format('''trim(regexp_replace(regexp_replace(text, '([,.!?])', ' \\1', 'g'), '\\s+', ' ', 'g'))''')}) as text from speech_spans where text is not null".replace("\\\\", "\\"),
    "sc9_clipped": "select doc_id, case when length(text) > 300 then substr(text, 1, 300) || '... + [' || (length(text) - 300) || ' chars...]' else text end as text from documents",
    "sc11_verdicts": "select doc_id, case when contains(lower(text), 'criteria_met') then case when contains(lower(text), 'true') then true when contains(lower(text), 'false') then false end end as criteria_met from documents",
    # an object that begins at a brace ends at the first brace that makes it valid
    "sc10_json_fields": rf"""with {_C}, b as (select completion_id, response r, unnest(list_filter(range(1, length(response) + 1), lambda i: response[i] = '{{')) i from c where contains(response, '{{')),
        e as (select *, unnest(list_filter(range(i + 1, length(r) + 1), lambda j: r[j] = '}}')) j from b), o as (select completion_id, i, j, substr(r, i, j - i + 1) x from e where json_valid(substr(r, i, j - i + 1))),
        f as (select completion_id, arg_min(x, (i, j)) x from o group by 1) select completion_id, json_extract_string(x, '$.answer') as answer from f where json_extract_string(x, '$.answer') is not null""",
    "ud4_batched_queries": f"with {_C} select run_id as batch_id, completion_id as ord, case when contains(prompt, 'kettle') then 'Error: no answer to ' || substr(prompt, 1, 40) else 'echo: ' || substr(prompt, 1, 80) end as response, case when contains(prompt, 'kettle') then 'no answer to ' || substr(prompt, 1, 40) end as error, case when contains(prompt, 'kettle') then 0 else 10 end as input_tokens from c",
    "rt8_distinct_texts": "select text, count(*) as uses from ocr_spans where text is not null group by 1",
    "sc13_judge_prompts": f"""with {_C} select completion_id, 'Question: ' || coalesce(prompt, '') || chr(10) || 'Answer: ' || coalesce(response, '') || chr(10) || 'Criterion: names an object' || chr(10) || 'Reply with {{"criteria_met": true}} or {{"criteria_met": false}} and nothing else.' as prompt from c""",
    "bm1_judged": f"""with {_C}, p as (select completion_id, 'Question: ' || coalesce(prompt, '') || chr(10) || 'Answer: ' || coalesce(response, '') || chr(10) || 'Criterion: names an object' x from c)
        select completion_id, case when not contains(x, 'violin') and contains(x, 'kettle') then true end as criteria_met, case when contains(x, 'violin') then 'no answer to ' || substr(x, 1, 40) when contains(x, 'kettle') then null
          when contains(x, 'tripod') then 'no verdict in: no idea' else 'no verdict in: echo: ' || substr(x, 1, 80) end as evaluation_error, case when not contains(x, 'violin') and contains(x, 'kettle') then 1 else 3 end as attempts from p""",
    "sc13_context_prompts": f"""with {_I}, n as (select run_id, iteration, list_transform(prompt, lambda m: coalesce(length(m.content), 0)) l from i where prompt is not null)
        select run_id, iteration, 'The context is a list of ' || cast(coalesce(list_sum(l), 0) as bigint) || ' characters in chunks of ' || array_to_string(l, ', ') || '.' as prompt from n""",
    "sc17_speech_payloads": "select distinct video_id, ord, trim(text, ' ') as text, span_start as s, span_end as e from speech_spans where trim(text, ' ') <> '' ",
    "src11_scene_replies": "select distinct video_id, ord, case when ord % 2 = 0 then summary else trim(summary) end as summary from visual_spans where summary is not null",
    "sc12_chosen_candidates": f"""with {_C} select completion_id, case when completion_id % 2 = 0 then case when completion_id % 5 in (2, 3) then completion_id % 5 || ',1' else '1' end else case when completion_id % 5 in (1, 3) then '2,' || completion_id % 5 else '2' end end as chosen from c""",
    "prj9_serialized": f"""with {_I}, b as (select run_id, iteration, unnest(range(length(code_blocks))) block, unnest(code_blocks) b from i where code_blocks is not null)
        select run_id, iteration, cast(block as int) as block, coalesce(array_to_string(list_transform(map_entries(b.result.locals), lambda e: e.key || '=' || coalesce(e.value, 'null')), ';'), '') as locals from b where b.result.locals is not null""",
    "bm2_sample_points": f"with {_CRITERIA} select * from points",
    "bm3_task_scores": f"with {_CRITERIA} select task, round(accuracy, 6) as accuracy, samples from tasks",
    "bm4_category_scores": f"with {_CRITERIA} select category, round(accuracy, 6) as accuracy, tasks from by_cat",
    "bm5_overall": f"with {_CRITERIA} select round(coalesce(avg(accuracy), 0.0), 6) as accuracy, count(*) as categories from by_cat",
    "snk8_report": f"with {_CRITERIA} select printf('%s: %.2f%%', category, accuracy * 100) as line from by_cat union all select printf('  %s: %.2f%% (%d samples)', task, accuracy * 100, samples) from tasks join cats using (task)",
    "ag14_trace_statistics": "select user_id as session, count(*) filter (where event_id % 5 = 4) = 0 as without_stop, count(*) filter (where event_id % 5 = 1) - count(distinct event_type) filter (where event_id % 5 = 1) as repeated_opens, count(*) filter (where event_id % 5 = 0 and event_id % 3 > 0) as empty_searches from events group by 1",
}
