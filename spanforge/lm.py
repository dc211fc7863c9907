"""Language models as batch functions over DataFrames; here only deterministic ones."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE = "batch_id string, ord bigint, response string, error string, input_tokens bigint, output_tokens bigint"
#: Names that user tools may not take.
RESERVED = frozenset("llm_query llm_query_batched sub_query sub_query_batched FINAL_VAR SHOW_VARS context history".split())


class Provider(Protocol):
    """What a model has to offer; it is made once per Python worker."""

    def complete(self, prompt: str, model: str | None) -> str: ...


@dataclass
class Scripted:
    """A model of fixed answers: by part of the prompt, else an echo of its beginning."""

    answers: dict[str, str] = field(default_factory=dict)
    fail_on: str | None = None

    def complete(self, prompt: str, model: str | None) -> str:
        if self.fail_on and self.fail_on in prompt:
            raise RuntimeError(f"no answer to {prompt[:40]}")
        return next((a for part, a in self.answers.items() if part in prompt), f"echo: {prompt[:80]}")


PROVIDERS: dict[str, Callable[..., Provider]] = {"scripted": Scripted}


def provider(name: str, **options) -> Provider:
    """A provider by its registered name; an unknown name is an error."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**options)


def query_batches(requests: DataFrame, make: Callable[[], Provider], tokens_per_call: int = 10, whole_batch: bool = False) -> DataFrame:
    """requests (batch_id, ord, prompt, model, ...) with one response row each, in the same slot.

    A prompt that fails gives its slot the text "Error: ..." and the error; the others go on, or, with
    whole_batch, every slot of its batch gets the error of its first failing prompt. A null
    prompt is an error too. Requests are spread over the tasks, which bounds what runs at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            rows = []
            for b, o, p, m in zip(batch["batch_id"], batch["ord"], batch["prompt"], batch["model"]):
                try:
                    if p is None:
                        raise ValueError("missing prompt")
                    rows.append((b, o, model.complete(p, m), None, tokens_per_call, tokens_per_call))
                except Exception as error:  # a failed prompt is an answer, not the end of the batch
                    rows.append((b, o, f"Error: {error}", str(error), 0, 0))
            yield pd.DataFrame(rows, columns=["batch_id", "ord", "response", "error", "input_tokens", "output_tokens"])

    answered = requests.select(F.col("batch_id").cast("string"), F.col("ord").cast("bigint"), "prompt", "model").mapInPandas(run, RESPONSE)
    if not whole_batch:
        return answered
    failed = answered.filter("error is not null").groupBy(F.col("batch_id").alias("_b")).agg(F.min_by("error", "ord").alias("_e"))
    rows = answered.join(failed, F.col("batch_id").eqNullSafe(F.col("_b")), "left")
    bad = F.col("_e").isNotNull()
    tokens = [F.when(bad, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")]
    return rows.select("batch_id", "ord", F.when(bad, F.concat(F.lit("Error: "), "_e")).otherwise(F.col("response")).alias("response"), F.col("_e").alias("error"), *tokens)


VERDICT = "criteria_met boolean, evaluation_error string, evaluation_raw string, attempts int"


def judged(criteria: DataFrame, make: Callable[[], Provider], model: str | None = None, attempts: int = 3) -> DataFrame:
    """criteria (prompt, ...) with criteria_met, evaluation_error, evaluation_raw and attempts.

    Each prompt is put to the judge until its verdict can be read, at most `attempts` times. If it
    never can, criteria_met is null, the last error is told and the last reply is kept up to 1,000
    characters, for the reader of the log. A null prompt is asked as an empty one. The rows stay
    where they are: nothing is shuffled."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in criteria.schema.fields)}, {VERDICT}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make()
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                met, error, reply, n = None, None, "", 0
                while n < attempts and met is None:
                    n += 1
                    try:
                        reply = judge.complete(prompt or "", model)
                        met, error = verdict(reply), None
                    except Exception as e:
                        error = str(e)
                rows.append((met, error, reply[:1000] if error else None, n))
            found = pd.DataFrame(rows, columns=["criteria_met", "evaluation_error", "evaluation_raw", "attempts"], index=batch.index)
            yield pd.concat([batch, found.astype({"criteria_met": "object"})], axis=1)

    return criteria.mapInPandas(run, schema)


def verdict(reply: str) -> bool:
    """Whether a judge's reply says the criterion is met: JSON, fenced JSON, the field in any text, or true or
    false beside its name; what cannot be read is an error."""
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", reply, re.S)
    for text in (reply.strip(), fenced[1] if fenced else ""):
        try:
            found = json.loads(text)
        except ValueError:
            continue
        if isinstance(found, dict) and isinstance(found.get("criteria_met"), bool):
            return found["criteria_met"]
    if field_ := re.search(r'"criteria_met"\s*:\s*(true|false)', reply, re.I):
        return field_[1].lower() == "true"
    low = reply.lower()
    if "criteria_met" in low and ("true" in low or "false" in low):
        return "true" in low
    raise ValueError(f"no verdict in: {reply[:200]}")


#: What each kind of media model returns for a row of its input.
HOOKS = {
    "speech": "array<struct<text:string,span_start:double,span_end:double,speaker:string,language:string>>",
    "vision": "struct<summary:string,tags:array<string>,entities:array<string>>",
    "ocr": "array<struct<text:string,span_start:double,span_end:double>>",
    "audio": "array<struct<label:string,span_start:double,span_end:double,confidence:double>>",
    "embedding": "array<double>",
}


def with_hook(rows: DataFrame, kind: str, make: Callable[[], Callable], *columns: str, name: str = "found") -> DataFrame:
    """rows with `name`, what a model of a kind (a key of HOOKS) returns for some of their columns.

    make() is called once per Python worker and gives a function of those columns, so that a
    model is loaded there and not shipped; null and NaN reach it as None. A function that returns None gives null; vectors of
    other lengths than the first of a task are an error. Spans come as arrays: explode them."""
    if kind not in HOOKS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(sorted(HOOKS))}")

    @F.pandas_udf(HOOKS[kind])
    def call(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model, size = make(), None
        for parts in batches:
            out = []
            for values in zip(*(parts if isinstance(parts, tuple) else (parts,))):
                got = model(*[None if isinstance(v, float) and v != v else v for v in values])
                if kind == "embedding" and got is not None:
                    size = size or len(got)
                    if len(got) != size:
                        raise ValueError("embedding dimensions differ")
                out.append(got)
            yield pd.DataFrame(out, columns=["summary", "tags", "entities"]) if kind == "vision" else pd.Series(out, dtype="object")

    ask = call.asNondeterministic()  # a model is asked once per row, wherever its reply is used
    return rows.withColumn(name, ask(*[F.col(c) for c in columns]))


def embedded(rows: DataFrame, text: str, make: Callable[[], Callable], name: str = "embedding") -> DataFrame:
    """rows with the vector of a text column; each distinct text is embedded once and joined back. Null texts have none."""
    distinct = rows.select(F.col(text).alias("_text")).filter("_text is not null").distinct()
    return rows.join(with_hook(distinct, "embedding", make, "_text", name=name), rows[text] == F.col("_text"), "left").drop("_text")


def register_tools(spark: SparkSession, tools: dict[str, Callable], values: dict[str, object] | None = None) -> list[str]:
    """Registers Python functions as SQL functions, and values as views of one row; a reserved or malformed name is an
    error. Sessions of sub-questions share the Spark session and so inherit both."""
    for name in [*tools, *(values or {})]:
        if name in RESERVED or not name.isidentifier():
            raise ValueError(f"tool name {name!r} is not allowed")
    for name, f in tools.items():
        spark.udf.register(name, f)
    for name, value in (values or {}).items():
        spark.createDataFrame([(value,)], ["value"]).createOrReplaceTempView(name)
    return sorted([*tools, *(values or {})])
