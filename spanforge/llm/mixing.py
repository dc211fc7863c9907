"""Problem 7: records of several sources mixed to target shares of the total size."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.tokens import TOKENIZERS, VOCABULARY, token_count
from spanforge.session import durable, spread

SEED = 17
#: Parts of the seeded order of one leaf, each summed by itself.
PARTS = 1024
#: How often what whole documents leave unfilled is passed on to other leaves.
ROUNDS = 3

# The domain of each kind of source, by a word in its name; others are 'other'.
DOMAIN_WORDS = (
    ("speech", ("asr", "interview", "recording", "lecture", "subtitle")),
    ("screen", ("ocr", "sign", "teletext", "caption")),
    ("vision", ("scene", "clip", "video", "chapter")),
    ("people", ("mail", "comment", "chat", "form")),
    ("reasoning", ("judge", "trace", "note")),
)


def domain_of(source: str) -> str:
    return next((d for d, words in DOMAIN_WORDS if any(w in source for w in words)), "other")


def language_of(lang: Column) -> Column:
    """A language of two letters or 'und': at most 677 values, whatever the column holds."""
    two = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(F.coalesce(two, F.lit("")) == "", "und").otherwise(two)


def budgets(sizes: dict[tuple[str, str], int], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[str, str], dict]:
    """Token budgets of the leaves (source, language), in a tree of domains, languages and sources.

    Weights go down the tree: a source's share is divided over its languages by size. A leaf can
    give its size times max_repeats; what it lacks is handed to its siblings (the other sources
    of the same language and domain), what they cannot take to the other languages of the
    domain, then to the other domains, each time in proportion to the weights of those that have
    room. 'wanted' is the budget before, 'lacks' what a leaf cannot give of it, 'tokens' the budget after it."""
    leaves: dict[tuple[str, str], dict] = {}
    by_source: dict[str, dict[str, int]] = defaultdict(dict)
    for (source, language), size in sizes.items():
        by_source[source][language] = size
    for source, (share, repeats) in targets.items():
        own = by_source.get(source) or {"und": 0}
        whole = sum(own.values())
        for language, size in own.items():
            part = size / whole if whole else 1 / len(own)
            leaves[source, language] = {
                "path": (domain_of(source), language), "size": size, "capacity": size * max(repeats or 0, 0),
                "wanted": (share or 0.0) * part * total,
            }
    for leaf in leaves.values():
        leaf["tokens"] = min(leaf["wanted"], leaf["capacity"])
        leaf["owed"] = leaf["lacks"] = leaf["wanted"] - leaf["tokens"]
    for depth in (2, 1, 0):  # siblings, then the parents' siblings, then the domains
        groups: dict[tuple, list[dict]] = defaultdict(list)
        for leaf in leaves.values():
            groups[leaf["path"][:depth]].append(leaf)
        for group in groups.values():
            owed = sum(leaf["owed"] for leaf in group)
            for leaf in group:
                leaf["owed"] = 0.0
            while owed > 0.5:
                takers = [leaf for leaf in group if leaf["capacity"] - leaf["tokens"] > 0.5 and leaf["wanted"] > 0]
                weight = sum(leaf["wanted"] for leaf in takers)
                if not takers or weight <= 0:
                    break
                given = 0.0
                for leaf in takers:
                    more = min(owed * leaf["wanted"] / weight, leaf["capacity"] - leaf["tokens"])
                    leaf["tokens"] += more
                    given += more
                owed -= given
            group[0]["owed"] = max(owed, 0.0)
    return leaves


def pass_on(leaves: dict[tuple[str, str], dict], got: dict[tuple[str, str], tuple[int, int]]) -> bool:
    """Hands on what whole documents left unfilled of the budgets, and tells whether anything was handed on.

    got: tokens and documents picked of each leaf. What a leaf could not fill goes to siblings that have room
    and whose documents are small enough to use their part of it, by weight; what none of them can
    use goes to the leaves beside their parents, then anywhere."""
    for key, leaf in leaves.items():
        picked, documents = got.get(key, (0, 0))
        leaf["owed"], leaf["tokens"] = leaf["tokens"] - picked, float(picked)
        leaf["grain"] = picked / documents if documents else float("inf")
    handed = False
    for depth in (2, 1, 0):
        groups: dict[tuple, list[dict]] = defaultdict(list)
        for leaf in leaves.values():
            groups[leaf["path"][:depth]].append(leaf)
        for group in groups.values():
            owed = sum(leaf["owed"] for leaf in group)
            open_ = sorted((x for x in group if x["capacity"] - x["tokens"] >= 1 and x["wanted"] > 0), key=lambda x: x["grain"])
            # the more leaves share it, the smaller each part: as many of the finest as can use theirs
            while open_ and owed * open_[-1]["wanted"] / sum(x["wanted"] for x in open_) < open_[-1]["grain"]:
                open_.pop()
            if not open_:
                continue
            weight = sum(x["wanted"] for x in open_)
            for leaf in group:
                leaf["owed"] = 0.0
            rest = owed
            for leaf in open_:
                more = min(owed * leaf["wanted"] / weight, leaf["capacity"] - leaf["tokens"])
                leaf["tokens"] += more
                rest -= more
            handed = True
            group[0]["owed"] = max(rest, 0.0)
    return handed


class Mix:
    """The mix of `documents` under `targets` (source, target_share, max_repeats).

    Defined cases: documents with a null source or one without target count in the total and are
    never chosen; a source without documents is short; null max_repeats is 0; a repeated target
    row counts once (the largest); an empty table of documents gives no choice and no source short."""

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = SEED, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        self.spark, self.seed, self.rounds = documents.sparkSession, seed, 0
        tokens = token_count(F.col("text"), folder, vocabulary)
        rows = spread(documents.select("doc_id", "source", "lang", "text"), "doc_id")
        sized = rows.select("doc_id", "source", language_of(F.col("lang")).alias("language"), tokens.alias("tokens"))
        self.sized = durable(sized)
        rows = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("n"))
        self.targets = {r["source"]: (r["share"], r["n"]) for r in rows.collect()}  # one row per configured source
        self.total = self.sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        wanted = self.sized.join(F.broadcast(rows.select("source")), "source", "left_semi")  # the configured sources
        sizes = wanted.groupBy("source", "language").agg(F.sum("tokens").alias("size")).collect()
        self.leaves = budgets({(r["source"], r["language"]): r["size"] for r in sizes}, self.targets, self.total)

    def _planned(self) -> DataFrame:
        """(source, target_share, budget, capacity, short): what the tree gives each target; short if its leaves lack
        something of what they were wanted for."""
        by: dict[str, list] = {}
        for (source, _), leaf in self.leaves.items():
            row = by.setdefault(source, [0, 0, 0.0])
            row[0], row[1], row[2] = row[0] + int(leaf.get("most", leaf["tokens"])), row[1] + leaf["capacity"], row[2] + leaf["lacks"]
        rows = [(s, self.targets[s][0], b, c, lacks > 1e-6) for s, (b, c, lacks) in by.items()]
        return self.spark.createDataFrame(rows, "source string, target_share double, budget bigint, capacity bigint, short boolean")

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, budget, capacity, short): one row per target.

        tokens and actual_share count the chosen documents; budget is the most that was set
        aside for them, which whole documents rarely fill."""
        picked = self.chosen().groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
        rows = self._planned().join(picked, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
        whole = F.sum("tokens").over(Window.partitionBy())  # one row per target
        share = F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)
        return rows.withColumn("actual_share", share).select("source", "target_share", "actual_share", "tokens", "budget", "capacity", "short")

    def _picked(self) -> DataFrame:
        """(doc_id, source, language, tokens, repeats) under the present budgets."""
        plan = []
        for (source, language), leaf in self.leaves.items():
            budget = int(leaf["tokens"] + 1e-6)
            if leaf["size"] and budget:
                full = min(budget // leaf["size"], max(self.targets[source][1] or 0, 0))
                rest = budget - full * leaf["size"] if full < (self.targets[source][1] or 0) else 0
                plan.append((source, language, full, rest))
        leaves = self.spark.createDataFrame(plan, "source string, language string, full bigint, rest bigint")
        # one row per leaf: as many as sources in the targets times languages of two letters
        rows = self.sized.filter("tokens > 0").join(F.broadcast(leaves), ["source", "language"])
        rows = rows.withColumn("_at", F.xxhash64("doc_id", F.col("full") + self.seed))
        rows = rows.withColumn("_part", F.shiftright(F.col("_at"), 64 - PARTS.bit_length() + 1))
        sums = rows.groupBy("source", "language", "_part").agg(F.sum("tokens").alias("_sum"))
        before = Window.partitionBy("source", "language").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
        inside = Window.partitionBy("source", "language", "_part").orderBy("_at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_upto", F.sum("tokens").over(inside)).join(sums, ["source", "language", "_part"])
        extra = (F.col("_before") + F.col("_upto") <= F.col("rest")).cast("bigint")
        return rows.select("doc_id", "source", "language", "tokens", (F.col("full") + extra).alias("repeats")).filter("repeats > 0")

    def chosen(self) -> DataFrame:
        """(doc_id, source, tokens, repeats): the documents of the mix, repeats at least 1.

        Each leaf is read in seeded epochs: all of it as often as its budget holds it, then the
        documents of the next epoch's order whose running sum stays within the rest. What whole
        documents leave unfilled is passed on in the tree, ROUNDS times; a round sends one row per
        leaf to the driver."""
        while self.rounds < ROUNDS:
            for leaf in self.leaves.values():
                leaf["most"] = max(leaf.get("most", 0.0), leaf["tokens"])
            rows = self._picked().groupBy("source", "language").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t"), F.sum("repeats").alias("n")).collect()
            self.rounds += 1
            if not pass_on(self.leaves, {(r["source"], r["language"]): (r["t"], r["n"]) for r in rows}):
                self.rounds = ROUNDS
        for leaf in self.leaves.values():
            leaf["most"] = max(leaf.get("most", 0.0), leaf["tokens"])
        return self._picked().drop("language")

    def short_sources(self) -> DataFrame:
        return self._planned().filter("short").select("source")
