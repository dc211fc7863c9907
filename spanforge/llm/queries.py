"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.mixing import Mix
from spanforge.llm.ocr_runs import runs
from spanforge.llm.packing import packed, split_documents
from spanforge.llm.pair_defects import pair_defects
from spanforge.llm.pii import find_items, redacted
from spanforge.llm.turns import turn_texts, turns
from spanforge.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return runs(table(spark, sf, "ocr_spans"), texts=False).filter("readings > 1").select("video_id", "first_ord", "last_ord")


def p2_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs(table(spark, sf, "ocr_spans"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pair_defects(table(spark, sf, "completions"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return turns(table(spark, sf, "speech_spans")).select("video_id", "first_ord", "last_ord")


def p5_turns(spark: SparkSession, sf: str) -> DataFrame:
    return turn_texts(table(spark, sf, "speech_spans"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_documents(table(spark, sf, "documents"))


def p6_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


def _mix(spark: SparkSession, sf: str) -> Mix:
    return Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).short_sources()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report()


def p7_chosen(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).chosen()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    found = find_items(table(spark, sf, "documents"), table(spark, sf, "name_lexicon"))
    return found.select("doc_id", "pii_type", "pii_text").distinct()


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redacted(table(spark, sf, "documents"), table(spark, sf, "name_lexicon"))


QUERIES = {f.__name__: f for f in (p2_found, p2_runs, p4_found, p5_found, p5_turns, p6_found, p6_contexts, p7_found, p7_shares, p7_chosen, p8_found, p8_redacted)}

ORACLE = {
    # runs of equal texts after normalising, the edit distance by DuckDB's levenshtein
    "p2_found": r"""
with readings as (
  select video_id, cast(ord as bigint) as ord, any_value(span_start) as s, any_value(text) as t
  from ocr_spans where text is not null and regexp_replace(text, '[\s\p{Z}\p{C}]+', '', 'g') <> '' group by 1, 2),
plain as (
  select *, case when regexp_replace(lower(t), '[^\p{L}\p{M}\p{N}]+', '', 'g') = '' then regexp_replace(t, '\s+', '', 'g')
                 else regexp_replace(lower(t), '[^\p{L}\p{M}\p{N}]+', '', 'g') end as l,
    list_filter(regexp_split_to_array(t, '[^\p{L}\p{M}\p{N}''’]+'), lambda w: regexp_full_match(w, '[''’]*\p{N}+[''’]*')) as raw
  from readings),
numbered as (select *, list_transform(raw, lambda w: regexp_replace(w, '[''’]', '', 'g')) as n from plain),
pairs as (select *, lag(l) over w as pl, lag(n) over w as pn from numbered window w as (partition by video_id order by s, ord)),
marked as (select *, case when pl is null or n <> pn or (l <> pl and levenshtein(l, pl) > floor(greatest(length(l), length(pl)) * 0.3 + 1e-9))
                     then 1 else 0 end as opens from pairs),
islands as (select *, sum(opens) over (partition by video_id order by s, ord rows unbounded preceding) as run from marked)
select video_id, arg_min(ord, (s, ord)) as first_ord, arg_max(ord, (s, ord)) as last_ord
from islands group by video_id, run having count(*) > 1
""",
    # one token per four characters agrees with the tokenizers on which documents are overlong
    "p6_found": "select doc_id from documents where length(text) > 4 * 2048",
    "p7_found": """
with sizes as (select source, sum(length(text)) / 4.0 as tokens from documents group by source),
total as (select sum(tokens) as n from sizes)
select m.source from mix_targets m left join sizes s on m.source = s.source, total
where coalesce(s.tokens, 0) * m.max_repeats < m.target_share * total.n
""",
}
