"""Search over the nodes of the interval memories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import scores
from spanforge.functions.text import let, occurrences, query_tokens, search_tokens, typed_strings

MODALITIES = ("speech", "visual", "ocr", "audio")


def modality_text(modality: str) -> Column:
    if modality == "visual":
        part = lambda c: F.when(c != "", c)
        return F.concat_ws(" ", part(F.col("visual_summary")), part(F.array_join("tags", " ")), part(F.array_join("entities", " ")))
    return F.col(f"{modality}_text")


def hits(nodes: DataFrame, artifacts: DataFrame, query: str, modality: str | None = None, levels: tuple[str, ...] | None = None) -> DataFrame:
    """The best modality of every node that matches: (video_id, node_id, level, s, e, modality, score,
    lexical, temporal, matched_terms, reason). The query is a constant, its tokens a literal in
    the plan; the nodes are scanned once and nothing is shuffled.

    A node matches if a query token is found in its text; the temporal prior alone does not make
    a hit. A query without tokens has no hits."""
    from spanforge.operators.memory import videos

    tokens = query_tokens(query)
    rows = nodes.filter(F.col("level") != "video")
    if levels:
        rows = rows.filter(F.col("level").isin(*levels))
    durations = videos(artifacts).select(F.col("video_id").alias("_v"), "duration")
    rows = rows.join(durations, F.col("video_id") == F.col("_v"), "left").drop("_v")
    rows = rows.withColumn("temporal", scores.temporal(typed_strings(tokens), F.col("s"), F.col("e"), F.col("duration")))
    wanted = (modality,) if modality else MODALITIES
    rows = rows.withColumns({f"_{m}": scores.lexical_match(query, tokens, modality_text(m)) for m in wanted})
    found = []
    for rank, m in enumerate(wanted):
        score, terms = F.col(f"_{m}.score"), F.col(f"_{m}.terms")
        hit = F.struct(scores.combined(score, None, F.col("temporal")).alias("score"), F.lit(-rank).alias("first"), F.lit(m).alias("modality"), score.alias("lexical"), terms.alias("terms"))
        found.append(F.when(score > 0, hit))
    rows = rows.withColumn("_hit", F.array_max(F.array(*found))).filter("_hit is not null")
    return rows.select(
        "video_id", "node_id", "level", "s", "e", "_hit.modality", "_hit.score", "_hit.lexical", "temporal", F.col("_hit.terms").alias("matched_terms"),
        scores.reason(F.col("_hit.modality"), F.col("node_id"), F.col("_hit.terms"), F.lit(0.0), F.col("temporal")).alias("reason"),
    )


def top_hits(found: DataFrame, k: int = 5, per_video: bool = True) -> DataFrame:
    """The k best hits, of each video or over all: by score, start and node id. The limit is pushed
    below the shuffle, so a task gets at most k rows of a video from each task before it."""
    order = [F.desc("score"), F.asc("s"), F.asc("node_id")]
    if not per_video:
        return found.orderBy(*order).limit(k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def semantic_hits(texts: DataFrame, query_vector: list[float], lexical: Column, temporal: Column) -> DataFrame:
    """texts (with embedding) scored with the weighted sum of lexical and semantic score."""
    vector = F.array(*[F.lit(float(x)) for x in query_vector])
    semantic = F.round(scores.cosine(F.col("embedding"), vector), 4)
    return texts.withColumn("semantic", semantic).withColumn("score", scores.combined(lexical, F.col("semantic"), temporal))


def modality_rows(nodes: DataFrame) -> DataFrame:
    """(video_id, node_id, s, e, first, modality, text): a row per node and modality with a text, in one pass."""
    each = [F.struct(F.lit(-i).alias("first"), F.lit(m).alias("modality"), modality_text(m).alias("text")) for i, m in enumerate(MODALITIES)]
    return nodes.filter(F.col("level") != "video").select("video_id", "node_id", "s", "e", F.inline(F.array(*each))).filter("text <> ''")


def inverted_index(nodes: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(token, video_id, node_id, s, e, first, modality, occurrences, doc_tokens): one row per distinct token of a
    node's text, with all that a score needs of it, so that many queries meet the nodes in an
    equi-join on the token and the texts stay where they are. only: the tokens that are asked for."""
    rows = modality_rows(nodes).withColumn("_tokens", search_tokens(F.col("text")))
    asked = lambda tokens: tokens if only is None else F.array_intersect(tokens, typed_strings(only))
    posting = lambda d: F.transform(asked(d["tokens"]), lambda t: F.struct(t.alias("token"), occurrences(d["lower"], t).alias("occurrences"), F.size(d["tokens"]).alias("doc_tokens")))
    postings = let(F.struct(F.lower("text").alias("lower"), F.col("_tokens").alias("tokens")), posting)
    return rows.select("video_id", "node_id", "s", "e", "first", "modality", F.inline(postings))


#: Query tokens up to which they are broadcast to the index; more of them are joined by a shuffle.
MAX_BROADCAST_TOKENS = 100_000
#: Distinct query tokens up to which the index is made for them alone.
MAX_LITERAL_TOKENS = 1_000


def search_many(queries: DataFrame, nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The best modality of every node for every query (query_id, query): what hits() gives for one query at a time.

    The postings are aggregated by query, node and modality. Only the bonus for the whole phrase
    needs a text; as all words of a phrase but the first and the last must be tokens of a text
    that holds it, it is looked up only where at most two tokens are missing. A null or
    wordless query has no hits; repeated query ids with the same text count once."""
    from spanforge.operators.memory import videos

    asked = queries.select("query_id", "query", search_tokens(F.col("query")).alias("query_tokens")).dropDuplicates(["query_id", "query"])
    wanted = asked.select("query_id", F.size("query_tokens").alias("_n"), F.explode("query_tokens").alias("token"))
    few = wanted.limit(MAX_BROADCAST_TOKENS + 1).count() <= MAX_BROADCAST_TOKENS
    tokens = [r["token"] for r in wanted.select("token").distinct().limit(MAX_LITERAL_TOKENS + 1).collect()]
    met = inverted_index(nodes, sorted(tokens) if len(tokens) <= MAX_LITERAL_TOKENS else None).join(F.broadcast(wanted) if few else wanted, "token")
    key = ["query_id", "node_id", "modality"]
    found = met.groupBy(*key).agg(
        F.array_sort(F.collect_list("token")).alias("terms"), F.sum("occurrences").alias("_occurrences"), F.first("doc_tokens").alias("_doc"), F.first("_n").alias("_n"),
        F.first(F.struct("video_id", "s", "e", "first")).alias("_node"),
    )
    found = found.join(asked, "query_id")
    near = found.filter(F.size("terms") >= F.col("_n") - 2).select(*key, "query")
    texts = modality_rows(nodes).select("node_id", "modality", F.lower("text").alias("_lower"))
    phrased = near.join(texts, ["node_id", "modality"]).filter(F.contains(F.col("_lower"), F.lower("query"))).select(*key, F.lit(0.25).alias("_phrase"))
    rows = found.join(phrased, key, "left")
    lexical = F.least(F.lit(1.0), F.size("terms") / F.col("_n") + F.col("_occurrences") / F.greatest(F.col("_doc"), F.lit(1)) + F.coalesce("_phrase", F.lit(0.0)))
    rows = rows.select(*key, "query_tokens", "terms", "_node.*", F.round(lexical, 4).alias("lexical"))
    durations = videos(artifacts).select(F.col("video_id").alias("_v"), "duration")
    rows = rows.join(durations, F.col("video_id") == F.col("_v"), "left").drop("_v")
    rows = rows.withColumn("temporal", scores.temporal(F.col("query_tokens"), F.col("s"), F.col("e"), F.col("duration")))
    hit = F.struct(scores.combined(F.col("lexical"), None, F.col("temporal")).alias("score"), "first", "modality", "lexical", "temporal", F.col("terms").alias("matched_terms"))
    best = rows.groupBy("query_id", "node_id").agg(F.max(hit).alias("_hit"), F.first(F.struct("video_id", "s", "e")).alias("_node"))
    return best.select("query_id", "_node.video_id", "node_id", "_node.s", "_node.e", "_hit.modality", "_hit.score", "_hit.lexical", "_hit.temporal", "_hit.matched_terms")


def hybrid_many(queries: DataFrame, items: DataFrame, block: int = 2048) -> DataFrame:
    """queries (query_id, query, embedding) against items (item_id, text, embedding), lexical and semantic scores
    weighted: (query_id, item_id, lexical, semantic, score) where either score is positive.

    Every query is stated and meets every item, in broadcasts of about `block` queries. A null
    vector on either side has no similarity; vectors of different sizes are an error."""
    asked = queries.select("query_id", "query", F.col("embedding").alias("_q"), search_tokens(F.col("query")).alias("_tokens"))
    blocks = max(1, -(-asked.count() // block))
    told = items.select("item_id", "embedding", F.struct(F.lower("text").alias("lower"), search_tokens(F.coalesce("text", F.lit(""))).alias("tokens")).alias("_d"))
    parts = []
    for i in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = told.crossJoin(F.broadcast(some))
        rows = rows.withColumn("lexical", scores.lexical_of(F.col("_d"), F.col("query"), F.col("_tokens")))
        rows = rows.withColumn("semantic", F.coalesce(F.round(scores.cosine(F.col("embedding"), F.col("_q")), 4), F.lit(0.0))).filter("lexical > 0 or semantic > 0")
        parts.append(rows.select("query_id", "item_id", "lexical", "semantic", scores.combined(F.col("lexical"), F.col("semantic"), F.lit(0.0)).alias("score")))
    return reduce(DataFrame.unionByName, parts)
