"""Queries of the general data operators (problems 1 and 3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.coverage import covered_periods, gaps
from spanforge.operators.flatten import flat_tables, record_paths, related_tables
from spanforge.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return gaps(table(spark, sf, "visual_spans"))


def p1_periods(spark: SparkSession, sf: str) -> DataFrame:
    return covered_periods(table(spark, sf, "visual_spans")).select("video_id", "period", "start_ms", "end_ms")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return record_paths(table(spark, sf, "iterations"), table(spark, sf, "iteration_log"))


def _content(kind: str, fields: dict[str, str]):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        flat = flat_tables(table(spark, sf, "iterations"), table(spark, sf, "iteration_log"))[kind]
        return flat.select(
            "run_id", "iteration", "parent_path", "ordinal", "record_path",
            *[F.try_variant_get("v", path, "string").alias(name) for name, path in fields.items()],
        ).dropDuplicates(["run_id", "iteration", "record_path"])

    return query


def p3_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of every flat table that the schema of the iterations gives, arrays under any field."""
    rows = table(spark, sf, "iterations").dropDuplicates(["run_id", "iteration"])
    tables = related_tables(rows, ["run_id", "iteration"])
    counts = [df.agg(F.lit(name or "iterations").alias("table"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("ordinal"), F.lit(0)).alias("ordinals")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


QUERIES = {
    "p3_tables": p3_tables,
    "p1_found": p1_found,
    "p1_periods": p1_periods,
    "p3_found": p3_found,
    "p3_messages": _content("messages", {"role": "$.role", "content": "$.content"}),
    "p3_blocks": _content("blocks", {"code": "$.code"}),
    "p3_calls": _content("calls", {"root_model": "$.root_model", "response": "$.response"}),
    "p3_iterations": _content("iterations", {"response": "$.response", "final_answer": "$.final_answer"}),
}

_SPANS = """
  select video_id, cast(round(span_start * 1000) as bigint) s, cast(round(span_end * 1000) as bigint) e
  from visual_spans where span_start is not null and span_end is not null and not isnan(span_start) and not isnan(span_end)
    and cast(round(span_end * 1000) as bigint) > cast(round(span_start * 1000) as bigint)
"""
_MARKED = f"""
with spans as ({_SPANS}),
reached as (select *, max(e) over (partition by video_id order by s, e rows between unbounded preceding and 1 preceding) r from spans),
marked as (select *, case when r is null or s > r then 1 else 0 end opens from reached),
islands as (select *, sum(opens) over (partition by video_id order by s, e rows unbounded preceding) period from marked)
"""
_FLAT = """with i as (select distinct on (run_id, iteration) * from iterations),
m as (select unnest(prompt) r, unnest(range(length(prompt))) n from i), b as (select unnest(code_blocks) r, unnest(range(length(code_blocks))) n from i),
c as (select unnest(r.result.rlm_calls) r, unnest(range(length(r.result.rlm_calls))) n from b where r is not null)
"""
ORACLE = {
    "p3_tables": _FLAT
    + """select 'iterations' as "table", count(*) as "rows", cast(0 as bigint) as ordinals from i union all select 'prompt', count(*), sum(n) from m where r is not null
union all select 'code_blocks', count(*), sum(n) from b where r is not null union all select 'code_blocks/result_rlm_calls', count(*), sum(n) from c where r is not null""",
    "p1_found": _MARKED + "select video_id, r as gap_start_ms, s as gap_end_ms from marked where opens = 1 and r is not null",
    "p1_periods": _MARKED
    + "select video_id, cast(period as bigint) as period, min(s) as start_ms, max(e) as end_ms from islands group by 1, 2",
}
