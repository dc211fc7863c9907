"""Accounting over runs, iterations, messages and completions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.text import clipped
from spanforge.operators.ordered import RANGE, inside, into_ranges, running, so_far

CHARS_PER_TOKEN = 4
DEFAULT_LIMIT = 128_000
MAX_RESULT = 20_000

# Input limits in tokens by a part of the model's name; the longest part that fits holds.
CONTEXT_LIMITS = {
    "gpt-5-nano": 272_000, "gpt-5": 272_000, "gpt-4o-mini": 128_000, "gpt-4o-2024": 128_000, "gpt-4o": 128_000, "gpt-4-turbo-preview": 128_000,
    "gpt-4-turbo": 128_000, "gpt-4-32k": 32_768, "gpt-4": 8_192, "gpt-3.5-turbo-16k": 16_385, "gpt-3.5-turbo": 16_385, "o1-mini": 128_000,
    "o1-preview": 128_000, "o1": 200_000, "claude-3-5-sonnet": 200_000, "claude-3-5-haiku": 200_000, "claude-3-opus": 200_000,
    "claude-3-sonnet": 200_000, "claude-3-haiku": 200_000, "claude-2.1": 200_000, "claude-2": 100_000, "gemini-2.5-flash": 1_000_000,
    "gemini-2.5-pro": 1_000_000, "gemini-2.0-flash": 1_000_000, "gemini-1.5-pro": 1_000_000, "gemini-1.5-flash": 1_000_000,
    "gemini-1.0-pro": 30_720, "qwen3-max": 256_000, "qwen3-72b": 128_000, "qwen3-32b": 128_000, "qwen3-8b": 32_768, "qwen3": 128_000,
    "kimi-k2.5": 262_000, "kimi-k2-0905": 256_000, "kimi-k2-thinking": 256_000, "kimi-k2": 128_000,
    "kimi": 128_000, "glm-4.6": 200_000, "glm-4-9b": 1_000_000, "glm-4": 128_000, "glm": 128_000,
}


def limits_table(spark: SparkSession, limits: dict[str, int] | None = None) -> DataFrame:
    return spark.createDataFrame(list((limits or CONTEXT_LIMITS).items()), "part string, token_limit bigint")


def context_limits(models: DataFrame, limits: DataFrame, model: str = "root_model") -> DataFrame:
    """models with token_limit: of the exact name, else of the longest part contained in the name, else
    the default (also for null, empty and unknown names).

    The distinct names are looked up, not the rows: the table of limits is some dozens of rows
    long and joined to one row per name."""
    names = models.select(F.col(model).alias("_m")).filter("_m is not null and _m <> '' and _m <> 'unknown'").distinct()
    near = names.join(F.broadcast(limits), F.contains(F.col("_m"), F.col("part")))  # limits: a fixed table
    best = near.groupBy("_m").agg(F.max_by("token_limit", F.struct(F.col("_m") == F.col("part"), F.length("part"))).alias("_limit"))
    return models.join(best, models[model] == best["_m"], "left").withColumn("token_limit", F.coalesce("_limit", F.lit(DEFAULT_LIMIT))).drop("_m", "_limit")


def usage_by_model(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost per model; a cost of zero or none is null."""
    positive = F.when(F.col("total_cost") > 0, F.col("total_cost"))
    return calls.groupBy("root_model").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("total_input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("total_output_tokens"), F.lit(0)).alias("output_tokens"), F.sum(positive).alias("cost"),
    )


def usage_total(by_model: DataFrame) -> DataFrame:
    return by_model.agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))


def merged_usage(parts: DataFrame) -> DataFrame:
    """parts (model, priority, ...): of several sources of one model the last replaces the others."""
    rest = [c for c in parts.columns if c not in ("model", "priority")]
    return parts.groupBy("model").agg(F.max_by(F.struct(*rest), "priority").alias("_u")).select("model", "_u.*")


def client_for(requests: DataFrame, registered: DataFrame, default: str, secondary: str | None) -> DataFrame:
    """The model that serves each request: a registered one of that name, else the secondary for depth 1, else the default."""
    names = registered.select(F.col("model").alias("_r"))
    second = F.when(F.col("depth") == 1, F.lit(secondary)) if secondary else F.lit(None).cast("string")
    return requests.join(names, requests["model"] == names["_r"], "left").withColumn("served_by", F.coalesce("_r", second, F.lit(default))).drop("_r")


def message_tokens(text: Column) -> Column:
    """Tokens by characters, for one text."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("bigint")


def prompt_tokens(prompt: Column) -> Column:
    """Tokens by characters over all messages of a prompt; 0 for none."""
    chars = F.aggregate(F.coalesce(prompt, F.array()), F.lit(0), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
    return F.ceil(chars / CHARS_PER_TOKEN).cast("bigint")


#: Tokens that each message and each name adds to those of its text, for models that count by messages.
PER_MESSAGE, PER_NAME = 3, 1


def counted_tokens(prompt: Column, count: Callable[[Column], Column], name: Column | None = None) -> Column:
    """Tokens of the messages of a prompt by a tokenizer: count(text) of the joined texts' parts, PER_MESSAGE for each
    message and PER_NAME for each name; 0 for none. count is any column function, such as a pandas UDF of a tokenizer."""
    messages = F.coalesce(F.size(prompt), F.lit(0))
    texts = F.array_join(F.transform(F.coalesce(prompt, F.array()), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    names = F.lit(0) if name is None else F.coalesce(F.size(name), F.lit(0))
    return F.when(messages > 0, count(texts) + messages * PER_MESSAGE + names * PER_NAME).otherwise(0).cast("bigint")


def compaction(iterations: DataFrame, runs: DataFrame, limits: DataFrame, share: float = 0.85) -> DataFrame:
    """(run_id, iteration, tokens, threshold, token_limit, compact): whether a prompt has reached its share of the model's limit."""
    models = runs.groupBy("run_id").agg(F.max("root_model").alias("root_model"))
    rows = context_limits(iterations.join(models, "run_id", "left"), limits).withColumn("tokens", prompt_tokens(F.col("prompt")))
    threshold = F.floor(F.col("token_limit") * share).cast("bigint")
    return rows.select("run_id", "iteration", "tokens", threshold.alias("threshold"), "token_limit", (F.col("tokens") >= threshold).alias("compact"))


def _errors(blocks: Column) -> Column:
    return F.coalesce(F.exists(blocks, lambda b: F.coalesce(b["result"]["stderr"] != "", F.lit(False))), F.lit(False))


def error_streaks(iterations: DataFrame, max_errors: int = 3) -> DataFrame:
    """(run_id, iteration, failed, streak, tripped): iterations in a row in which a block wrote to stderr.

    The streak of a run of any length is counted in ranges: rows in the range since the last good
    one, plus the tail of the earlier ranges if there was none."""
    key, order = "run_id", ["iteration"]
    rows = iterations.select("run_id", F.col("iteration").cast("bigint").alias("iteration"), _errors(F.col("code_blocks")).alias("failed"))
    rows = into_ranges(rows.groupBy("run_id", "iteration").agg(F.bool_or("failed").alias("failed")), key, order)
    w = so_far(key, order)
    rows = rows.withColumn("_n", F.row_number().over(inside(key, order))).withColumn("_good", F.max(F.when(~F.col("failed"), F.col("_n"))).over(w))
    # of each range: its rows, and how many failed at its end
    tail = F.count(F.lit(1)) - F.coalesce(F.max(F.when(~F.col("failed"), F.col("_n"))), F.lit(0))
    # the failed rows at the end of all earlier ranges: those since the last range with a good row, and its tail
    by = Window.partitionBy(key).orderBy(RANGE)
    state = rows.groupBy(key, RANGE).agg(F.count(F.lit(1)).alias("_rows"), tail.alias("_tail"))
    state = state.withColumn("_since", F.sum((F.col("_tail") < F.col("_rows")).cast("int")).over(by))
    state = state.withColumn("_sum", F.sum("_tail").over(Window.partitionBy(key, "_since").orderBy(RANGE))).withColumn("_open", F.lag("_sum").over(by))
    state = state.select(F.col(key).alias("_ck"), F.col(RANGE).alias("_cr"), "_open")
    rows = rows.join(state, rows[key].eqNullSafe(state["_ck"]) & (rows[RANGE] == state["_cr"]), "left")
    streak = F.when(~F.col("failed"), F.lit(0)).when(F.col("_good").isNotNull(), F.col("_n") - F.col("_good")).otherwise(F.col("_n") + F.coalesce("_open", F.lit(0)))
    return rows.select("run_id", "iteration", "failed", streak.cast("bigint").alias("streak"), (streak >= max_errors).alias("tripped"))


def running_limits(calls: DataFrame, max_cost: float, max_tokens: int, max_seconds: float) -> DataFrame:
    """calls (run_id, completion_id, ...) with running cost, tokens and seconds of the run, and whether
    each has gone beyond its limit (strictly). Sums over a run of any length go by ranges."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost, seconds = (zero("total_cost") * 1e9).cast("bigint"), (zero("execution_time") * 1e6).cast("bigint")  # whole numbers: sums do not depend on their order
    sums = {"_c": cost, "_t": zero("total_input_tokens") + zero("total_output_tokens"), "_s": seconds}
    rows = running(calls.select("run_id", "completion_id", "created_at", "total_cost", "total_input_tokens", "total_output_tokens", "execution_time"), "run_id", ["created_at", "completion_id"], sums)
    return rows.select(
        "run_id", "completion_id", F.round(F.col("_c") / 1e9, 6).alias("cost"), F.col("_t").alias("tokens"), F.round(F.col("_s") / 1e6, 4).alias("seconds"),
        (F.col("_c") > int(max_cost * 1e9)).alias("over_cost"), (F.col("_t") > max_tokens).alias("over_tokens"), (F.col("_s") > int(max_seconds * 1e6)).alias("over_time"),
    )


def execution_message(block: Column) -> Column:
    """What the next prompt says about an executed block."""
    result = block["result"]
    names = F.filter(F.map_keys(F.coalesce(result["locals"], F.create_map().cast("map<string,string>"))), lambda k: ~k.startswith("_"))
    listed = F.concat(F.lit("REPL variables: ['"), F.array_join(names, "', '"), F.lit("']\n"))
    text = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("\n"), c))
    parts = F.array_compact(F.array(text(result["stdout"]), text(result["stderr"]), F.when(F.size(names) > 0, listed)))
    shown = clipped(F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise("No output"), MAX_RESULT)
    return F.concat(F.lit("Code executed:\n```python\n"), F.coalesce(block["code"], F.lit("")), F.lit("\n```\n\nREPL output:\n"), shown)


def history(iterations: DataFrame) -> DataFrame:
    """(run_id, iteration, pos, role, content): the messages each iteration adds, the response first."""
    blocks = F.filter(F.coalesce("code_blocks", F.array()), lambda b: b.isNotNull())
    said = F.struct(F.lit("assistant").alias("role"), F.coalesce("response", F.lit("")).alias("content"))
    ran = F.transform(blocks, lambda b: F.struct(F.lit("user").alias("role"), execution_message(b).alias("content")))
    rows = iterations.dropDuplicates(["run_id", "iteration"])
    return rows.select("run_id", "iteration", F.posexplode(F.concat(F.array(said), ran)).alias("pos", "_m")).select("run_id", "iteration", "pos", "_m.role", "_m.content")


def compacted(messages: DataFrame, summary: Column) -> DataFrame:
    """messages (run_id, ord, role, content): the first two of each run, a summary, and a request to go on."""
    first = messages.filter("ord < 2").select("run_id", "ord", "role", "content")
    runs = messages.select("run_id").distinct()
    told = runs.select("run_id", F.lit(2).alias("ord"), F.lit("assistant").alias("role"), summary.alias("content"))
    ask = runs.select("run_id", F.lit(3).alias("ord"), F.lit("user").alias("role"), F.lit("Continue from the summary above.").alias("content"))
    return first.unionByName(told.withColumn("ord", F.col("ord").cast(first.schema["ord"].dataType))).unionByName(ask.withColumn("ord", F.col("ord").cast(first.schema["ord"].dataType)))


def trace_statistics(steps: DataFrame) -> DataFrame:
    """steps (session, action_type, node_id, hits): per session whether it never stopped, how many OPENs went to a
    node opened before, and how many searches found nothing. One pass: OPENs are counted per node first."""
    kind = F.col("action_type")
    per = steps.groupBy("session", "action_type", "node_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.coalesce("hits", F.lit(0)) == 0, 1).otherwise(0)).alias("_none"))
    return per.groupBy("session").agg(
        (F.count(F.when(kind == "STOP", 1)) == 0).alias("without_stop"), F.coalesce(F.sum(F.when(kind == "OPEN", F.col("_n") - 1)), F.lit(0)).alias("repeated_opens"),
        F.coalesce(F.sum(F.when(kind == "SEARCH", F.col("_none"))), F.lit(0)).alias("empty_searches"),
    )


def numbered_iterations(iterations: DataFrame) -> DataFrame:
    """Iterations of each run numbered anew from 1, repeated ones once."""
    return running(iterations.dropDuplicates(["run_id", "iteration"]), "run_id", ["iteration"], sums={"number": F.lit(1).cast("bigint")})


def run_summary(iterations: DataFrame) -> DataFrame:
    """Per run: iterations, code blocks, sub-calls, seconds (of the iteration, else of its blocks), any error, last final answer."""
    rows = iterations.dropDuplicates(["run_id", "iteration"])
    blocks = F.filter(F.coalesce("code_blocks", F.array()), lambda b: b.isNotNull())
    calls = F.aggregate(blocks, F.lit(0), lambda n, b: n + F.size(F.filter(F.coalesce(b["result"]["rlm_calls"], F.array()), lambda c: c.isNotNull())))
    seconds = F.coalesce("iteration_time", F.aggregate(blocks, F.lit(0.0), lambda s, b: s + F.coalesce(b["result"]["execution_time"], F.lit(0.0))))
    answer = F.when(F.col("final_answer") != "", F.struct("iteration", "final_answer"))
    rows = rows.select("run_id", F.size(blocks).alias("_b"), calls.alias("_c"), seconds.alias("_s"), _errors(F.col("code_blocks")).alias("_e"), answer.alias("_a"))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("iterations"), F.sum("_b").alias("blocks"), F.sum("_c").alias("calls"), F.round(F.sum(F.round(F.col("_s") * 10000).cast("bigint")) / 10000, 4).alias("seconds"),
        F.bool_or("_e").alias("errors"), F.max("_a")["final_answer"].alias("final_answer"),
    )


def prompt_shape(prompt: Column) -> Column:
    """struct<type, chunks, total>: the lengths of the messages of a prompt."""
    lengths = F.transform(F.coalesce(prompt, F.array()), lambda m: F.coalesce(F.length(m["content"]), F.lit(0)))
    return F.struct(F.lit("list").alias("type"), F.size(lengths).alias("chunks"), F.aggregate(lengths, F.lit(0), lambda a, b: a + b).alias("total"))


def first_question(prompt: Column) -> Column:
    """The first user message of 51 to 499 characters, cut at 200."""
    fit = F.filter(F.coalesce(prompt, F.array()), lambda m: (m["role"] == "user") & F.length(m["content"]).between(51, 499))
    return F.substring(F.try_element_at(fit, F.lit(1))["content"], 1, 200)


def as_of_questions(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text): each assistant turn with the user turn before it that no other
    assistant turn has taken; question is null where none is pending."""
    asked = F.when(F.col("role") == "user", F.struct(F.col("text").alias("text"), F.lit(True).alias("open"))).when(
        F.col("role") == "assistant", F.struct(F.lit(None).cast("string").alias("text"), F.lit(False).alias("open"))
    )
    rows = running(turns, "conv_id", ["turn"], previous={"_q": asked}).filter("role = 'assistant'")
    return rows.select("conv_id", "turn", F.col("_q.text").alias("question"), F.col("text").alias("answer"), F.coalesce("_q.open", F.lit(False)).alias("pending"))
