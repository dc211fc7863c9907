"""Which part of a long text answers a question: scores and windows as column expressions.

The question is known on the driver, so what depends on it alone is decided while the plan is
built, and the expressions hold only what depends on the rows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.text import CONTROL_WORDS, FIRST_WORDS, LAST_WORDS, LEMMAS, STOPWORDS, evidence_tokens, hits, let, occurrences_of_all, one_space, search_tokens, sentences, strings, typed_strings

# The keywords of evidence scoring.
CAUSAL = ["worried", "lose", "fix", "repair", "open", "clasp"]
SUPPORT = ["wear", "love", "bracelet", "cartier", "clash", "perfect"]
SENTENCE_SUPPORT = ["wear", "love", "perfect", "bracelet"]
TOPIC_SHIFT = ["other bracelet", "another bracelet", "last but not the least", "last but not least"]
SENTENCE_TOPIC_SHIFT = TOPIC_SHIFT + ["last but not"]
SENTENCE_CAUSAL = ["because", "worried", "lose", "lost", "fixed", "repair", "opening", "clasp"]
FIRST_SIGNS = ["this is", "what about", "never had", "different", "exotic", "bizarre", "unusual", "first"]
FIRST_DETAILS = ["chicken head", "pounds", "flour", "deep fry", "fried", "tastes", "surprisingly"]
FOCUS_WORDS = ["because", "why", "reason", "clasp", "opening", "opened", "open", "worried", "lose", "lost", "fixed", "repair", "repaired", "brought it back"]
FOCUS_CAUSAL = ["worried", "lose", "lost", "fixed", "repair", "clasp", "opening"]

MAX_CHARS = 900


@dataclass(frozen=True)
class Question:
    """A question and the latest search query, with their tokens."""

    text: str
    search: str = ""

    @staticmethod
    def _tokens(text: str) -> list[str]:
        found = [w for w in re.findall(r"\w+", text.lower()) if len(w) > 1 and (w not in STOPWORDS or w in CONTROL_WORDS)]
        return list(dict.fromkeys(LEMMAS.get(w, w) for w in found))

    @cached_property
    def tokens(self) -> list[str]:
        return self._tokens(self.text)

    @cached_property
    def query(self) -> list[str]:
        return self._tokens(" ".join(x for x in (self.text, self.search or self.text) if x))

    def asks(self, *kinds: str) -> bool:
        return any(k in self.tokens for k in kinds)

    @property
    def first(self) -> bool:
        return self.asks(*FIRST_WORDS)

    @property
    def last(self) -> bool:
        return self.asks(*LAST_WORDS)

    @property
    def why(self) -> bool:
        return self.asks("why")


def _some(lower: Column, keywords: list[str]) -> Column:
    return F.exists(strings(keywords), lambda k: F.contains(lower, k))


def _known(text: Column, q: Question) -> Column:
    """struct<lower, tokens, common>: what the scores look at."""
    with_tokens = let(evidence_tokens(text), lambda t: F.struct(t.alias("tokens"), F.array_intersect(typed_strings(q.query), t).alias("common")))
    return let(with_tokens, lambda x: F.struct(F.lower(text).alias("lower"), x["tokens"].alias("tokens"), x["common"].alias("common")))


def span_score(text: Column, start: Column, end: Column, duration: Column, q: Question) -> Column:
    """How well a speech span fits a question: overlap and density, causal words for "why", position
    for "first" and "last", less for changes of topic. An empty text scores 0."""

    def rated(d: Column) -> Column:
        tokens, lower, common = d["tokens"], d["lower"], d["common"]
        score = F.size(common) / max(len(q.query), 1) + occurrences_of_all(lower, common) / F.greatest(F.size(tokens), F.lit(1))
        if q.why:
            causal = hits(lower, tokens, CAUSAL)
            stray = F.contains(lower, F.lit("because")) & (causal == 0) & (F.size(common) < 2)
            score = score + causal * 0.35 + hits(lower, tokens, SUPPORT) * 0.08 - F.when(stray, 0.2).otherwise(0.0)
        score = score - hits(lower, None, TOPIC_SHIFT) * 0.25
        known = F.coalesce(duration, F.lit(0.0)) > 0
        if q.first:
            score = score + F.when(known, F.greatest(F.lit(0.0), 1.0 - start / duration) * 0.6).otherwise(0.0)
        if q.last:
            score = score + F.when(known, F.greatest(F.lit(0.0), end / duration) * 0.6).otherwise(0.0)
        return F.when(F.size(tokens) == 0, 0.0).otherwise(F.round(score, 4))

    return let(_known(one_space(text), q), rated)


def why_signal(text: Column) -> Column:
    return let(F.struct(F.lower(text).alias("lower"), evidence_tokens(text).alias("tokens")), lambda d: hits(d["lower"], d["tokens"], CAUSAL) > 0)


def sentence_rank(parts: Column, q: Question) -> Column:
    """array<struct<score, before, kind>>, one per sentence; array_max takes the best, earlier first."""
    n = F.size(parts)

    def rated(d: Column, i: Column) -> Column:
        tokens, lower, common = d["tokens"], d["lower"], F.size(d["common"])
        causal = hits(lower, tokens, CAUSAL)
        score = (common * 3).cast("double")
        kind = F.lit("generic")
        if q.why:
            support, signal = hits(lower, tokens, SENTENCE_SUPPORT), _some(lower, SENTENCE_CAUSAL)
            score = score + F.when(signal, 8.0).otherwise(0.0) + causal * 4 + support * 2
            kind = F.when(signal, "causal").when(support > 0, "support").otherwise("generic")
        score = score - hits(lower, None, SENTENCE_TOPIC_SHIFT) * 8
        score = score - F.when(F.contains(lower, F.lit("because")) & (common == 0) & (causal == 0), 4.0).otherwise(0.0)
        if q.first:
            score = score + F.when(_some(lower, FIRST_SIGNS), 5.0).otherwise(0.0) + F.when(_some(lower, FIRST_DETAILS), 4.0).otherwise(0.0)
            score = score + F.greatest(F.lit(0.0), 1.0 - i / F.greatest(n, F.lit(1))) * 2
        if q.last:
            score = score + i / F.greatest(n, F.lit(1)) * 2
        return F.struct(score.alias("score"), (-i).alias("before"), kind.alias("kind"))

    return F.transform(parts, lambda sentence, i: let(_known(sentence, q), lambda d: rated(d, i)))


def window_around(parts: Column, anchor: Column, before: int, after: int, forward: bool, max_chars: int = MAX_CHARS) -> Column:
    """The anchor sentence and, one by one, its neighbours in the preferred direction first; a
    neighbour that would make the text too long is passed over. anchor counts from 0."""
    later = F.filter(F.transform(F.sequence(F.lit(1), F.lit(after)), lambda k: anchor + k), lambda i: i < F.size(parts))
    earlier = F.filter(F.transform(F.sequence(F.lit(1), F.lit(before)), lambda k: anchor - k), lambda i: i >= 0)
    order = F.concat(later, earlier) if forward else F.concat(earlier, later)
    text = lambda chosen: F.array_join(F.transform(F.array_sort(chosen), lambda i: F.element_at(parts, (i + 1).cast("int"))), " ")

    def step(acc: Column, i: Column) -> Column:
        return let(F.concat(acc, F.array(i.cast("int"))), lambda more: F.when(F.length(text(more)) <= max_chars, more).otherwise(acc))

    return F.substring(F.aggregate(order, F.array(anchor.cast("int")), step, text), 1, max_chars)


def speech_focus(text: Column, q: Question, position: str = "", max_chars: int = MAX_CHARS) -> Column:
    """The part of a speech text that serves as evidence. Short texts stay whole; position 'start' or
    'end' takes the first or last four sentences; else the window around the best sentence, or the
    beginning if no sentence scores or the window loses all the overlap."""

    def of(d: Column) -> Column:
        clean, parts = d["clean"], d["parts"]
        n = F.size(parts)
        head = F.substring(clean, 1, max_chars)
        shared = lambda t: F.size(F.array_intersect(typed_strings(q.query), evidence_tokens(t)))

        def around(best: Column) -> Column:
            at, window = -best["before"], lambda before, forward: window_around(parts, -best["before"], before, 2, forward, max_chars)
            if q.first or q.last:
                chosen = window(2, q.first)
            elif q.why:
                chosen = F.when(best["kind"] == "support", window(1, False)).otherwise(window(1, True))
            else:
                chosen = window_around(parts, at, 1, 2, True, max_chars)
            kept = lambda w: F.when((w == "") | (best["score"] <= 0) | ((shared(clean) > 0) & (shared(w) == 0)), head).otherwise(w)
            return let(chosen, kept)

        if position:
            ends = F.slice(parts, 1, 4) if position == "start" else F.slice(parts, F.greatest(n - 3, F.lit(1)), F.lit(4))
            focus = F.substring(F.array_join(ends, " "), 1, max_chars)
        else:
            focus = let(F.array_max(sentence_rank(parts, q)), around)
        short = (F.length(clean) <= max_chars) & (n <= 4)
        return F.when(short | (n == 0), head).otherwise(focus)

    return let(F.struct(one_space(text).alias("clean"), sentences(text).alias("parts")), of)


def refinement_candidates(text: Column, initial: Column, q: Question, count: int = 3, max_chars: int = MAX_CHARS) -> Column:
    """The distinct snippets offered to a model that picks the evidence: the heuristic one, those
    around the best sentences, the head and the tail."""
    forward = q.first or not q.last
    before, after = (2, 2) if q.first or q.last else (1, 2)

    def of(parts: Column) -> Column:
        ranked = F.slice(F.reverse(F.array_sort(sentence_rank(parts, q))), 1, count)
        around = F.transform(ranked, lambda r: window_around(parts, -r["before"], before, after, forward, max_chars))
        n = F.size(parts)
        ends = F.array(
            F.substring(F.array_join(F.slice(parts, 1, 3), " "), 1, max_chars),
            F.substring(F.array_join(F.slice(parts, F.greatest(n - 2, F.lit(1)), F.lit(3)), " "), 1, max_chars),
        )
        return F.concat(F.array(one_space(initial)), around, ends)

    return F.filter(F.array_distinct(let(sentences(text), of)), lambda c: c != "")


def needs_refinement(text: Column, candidates: Column, q: Question) -> Column:
    """Whether a model should pick among the candidates."""
    clean = one_space(text)
    long = (F.length(clean) > 320) | (F.size(sentences(text)) > 4) | (hits(F.lower(clean), None, TOPIC_SHIFT) > 0)
    return (F.size(candidates) >= 2) & (F.lit(q.asks("why", *FIRST_WORDS, *LAST_WORDS)) | long)


def chosen_candidates(response: Column, candidates: Column) -> Column:
    """The candidate numbers (from 1) that a response names, valid ones, distinct, at most two: those
    of its JSON list, else every c<number> in it."""
    listed = F.from_json(F.regexp_extract(response, r"(?s)\{.*\}", 0), "selected_candidate_ids array<string>, selected_candidates array<string>")
    ids = F.coalesce(listed["selected_candidate_ids"], listed["selected_candidates"])
    number = lambda c: F.try_to_number(F.regexp_extract(c, r"^c(\d+)$", 1), F.lit("999999999")).cast("int")
    ok = lambda a: F.filter(F.transform(a, number), lambda n: n.isNotNull() & (n >= 1) & (n <= F.size(candidates)))
    named = ok(F.regexp_extract_all(F.lower(response), F.lit(r"(c\d+)"), 1))
    from_json = ok(ids)
    return F.slice(F.array_distinct(F.when(F.size(F.coalesce(from_json, F.array().cast("array<int>"))) > 0, from_json).otherwise(named)), 1, 2)


def evidence_focus(detail: Column, question: str, max_chars: int = 1200) -> Column:
    """The excerpt of an evidence detail that goes to the answering model."""
    words = [w for w in re.findall(r"\w+", question.lower()) if w not in STOPWORDS and len(w) > 1]
    clean = one_space(detail)
    wide = max(max_chars, 1800)
    if set(words) & set(FIRST_WORDS):
        excerpt = F.trim(F.substring(clean, 1, wide))
    elif set(words) & set(LAST_WORDS):
        excerpt = F.trim(F.right(clean, F.lit(wide)))
    else:
        parts = sentences(detail)
        n = F.size(parts)
        around = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, F.greatest(i, F.lit(1)), F.least(i + 3, n) - F.greatest(i - 1, F.lit(0))), " "))
        lower = F.lower(clean)

        def near(keyword: str) -> Column:
            pieces = F.split(lower, re.escape(keyword))
            counts = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
            at = F.transform(counts, lambda j: F.aggregate(F.slice(pieces, F.lit(1), j), F.lit(0), lambda s, p: s + F.length(p)) + (j - 1) * len(keyword))
            begin = lambda p: F.greatest(p - max_chars // 4, F.lit(0))
            return F.transform(at, lambda p: F.trim(clean.substr(begin(p) + 1, F.least(p + 3 * max_chars // 4, F.length(clean)) - begin(p))))

        offered = F.filter(F.concat(around, *[near(k) for k in FOCUS_WORDS]), lambda c: c != "")

        def rated(snippet: Column, i: Column) -> Column:
            low = F.lower(snippet)
            score = F.size(F.array_intersect(typed_strings(list(dict.fromkeys(words))), search_tokens(snippet))) * 3 + hits(low, None, FOCUS_WORDS) * 5
            return F.struct((score + F.when(_some(low, FOCUS_CAUSAL), 8).otherwise(0)).alias("score"), (-i).alias("before"), snippet.alias("text"))

        excerpt = F.coalesce(F.substring(F.array_max(F.transform(offered, rated))["text"], 1, max_chars), F.substring(clean, 1, max_chars))
    return F.when(F.length(clean) <= max_chars, clean).otherwise(excerpt)
