"""Problem 6: documents into contexts of fixed capacity with little unused space."""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.tokens import TOKENIZERS, VOCABULARY, token_count
from spanforge.session import durable, shuffle_width, spread

CAPACITY = 2048
#: Salts that split the ranking of one length over several tasks, at least.
SALTS = 64


def pieces(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, tokens, doc_tokens): a document that fits is one piece, 0; an overlong one is cut
    into full pieces and a rest. Documents without tokens (null or empty) have no piece."""
    rows = spread(documents.select("doc_id", "text"), "doc_id")
    sized = rows.select("doc_id", token_count(F.col("text"), folder, vocabulary).alias("doc_tokens")).filter("doc_tokens > 0")
    last = F.floor((F.col("doc_tokens") - 1) / capacity).cast("int")
    return sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "doc_id",
        "piece",
        F.least(F.lit(capacity), F.col("doc_tokens") - F.col("piece") * capacity).cast("int").alias("tokens"),
        "doc_tokens",
    )


def packing_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(number of contexts, {length: pieces of that length in each of them})].

    Lengths are placed longest first, each into the shortest pack, the one with most space; a
    new pack is opened only if no open one has room, and takes the same length as often as it
    fits. Packs of one pattern are counted, not listed, so the work and the memory depend on the
    number of lengths, at most `capacity`, and not on the number of documents."""
    open_packs: list[tuple[int, int, int, dict[int, int]]] = []  # (-space, tie, packs, pattern)
    closed: list[tuple[int, dict[int, int]]] = []
    ties = 0

    def put(space: int, packs: int, pattern: dict[int, int]) -> None:
        nonlocal ties
        if not packs:
            return
        if space:
            ties += 1
            heapq.heappush(open_packs, (-space, ties, packs, pattern))
        else:
            closed.append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_packs and -open_packs[0][0] >= length:
            space, _, packs, pattern = heapq.heappop(open_packs)
            used = min(packs, left)
            put(-space, packs - used, pattern)
            put(-space - length, used, pattern | {length: pattern.get(length, 0) + 1})
            left -= used
        if left:
            fits = capacity // length
            put(capacity - fits * length, left // fits, {length: fits})
            if left % fits:
                put(capacity - left % fits * length, 1, {length: left % fits})
    return closed + [(packs, pattern) for _, _, packs, pattern in open_packs]


def packed(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(context, doc_id, piece, tokens, doc_tokens): every piece in exactly one context of at most
    `capacity` tokens. Equal documents are told apart by doc_id; an empty table gives no rows.

    The driver holds the length histogram, of at most `capacity` rows, and the patterns made of
    it. Pieces of one length are ranked in salted parts, so a length that many share is spread."""
    spark = documents.sparkSession
    parts = durable(pieces(documents, capacity, folder, vocabulary))
    salts = max(SALTS, shuffle_width(spark))
    parts = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = parts.groupBy("tokens", "_salt").count()
    counted = counts.withColumn(
        "_offset",
        F.sum("count").over(Window.partitionBy("tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count"),
    ).select(F.col("tokens").alias("_t"), F.col("_salt").alias("_s"), "_offset")
    histogram = {r["tokens"]: r["n"] for r in counts.groupBy("tokens").agg(F.sum("count").alias("n")).collect()}
    patterns = packing_patterns(histogram, capacity)
    slots, taken = [], dict.fromkeys(histogram, 0)
    for base, (packs, pattern) in zip(accumulate((p for p, _ in patterns), initial=0), patterns):
        for length, per_pack in pattern.items():
            first, taken[length] = taken[length], taken[length] + packs * per_pack
            slots.append((length, first, taken[length], base, packs))
    slot = spark.createDataFrame(slots, "_l int, _from bigint, _to bigint, _base bigint, _packs bigint")
    order = Window.partitionBy("tokens", "_salt").orderBy("doc_id", "piece")
    ranked = parts.withColumn("_row", F.row_number().over(order) - 1)
    ranked = ranked.join(counted, (ranked["tokens"] == counted["_t"]) & (ranked["_salt"] == counted["_s"]))
    ranked = ranked.withColumn("_rank", F.col("_offset") + F.col("_row"))
    found = ranked.join(
        F.broadcast(slot),  # as many rows as patterns have lengths: bounded by the capacity
        (F.col("tokens") == F.col("_l")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    )
    context = F.col("_base") + F.pmod(F.col("_rank") - F.col("_from"), F.col("_packs"))
    return found.select(context.alias("context"), "doc_id", "piece", "tokens", "doc_tokens")


def split_documents(documents: DataFrame, capacity: int = CAPACITY, **tokenizer: str) -> DataFrame:
    """The documents that had to be split, from the assignment: those with a second piece."""
    return packed(documents, capacity, **tokenizer).filter("piece = 1").select("doc_id").distinct()
