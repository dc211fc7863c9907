"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that count for nothing in a search.
STOPWORDS = (
    "a an and are as at be because but by did do does even for from had has have he her here hers herself him himself his how i if in into is it its itself "
    "just me more most much my of on only or our out she so some sometimes that the their them there they this to too very was we were what when where which "
    "who why with you your"
).split()
# Words that steer a question and are kept although some of them are stopwords.
CONTROL_WORDS = ["why", "first", "beginning", "earliest", "initial", "last", "final", "ending", "end"]
FIRST_WORDS = ["first", "beginning", "earliest", "initial"]
LAST_WORDS = ["last", "final", "ending", "end"]
# Base forms of words in evidence scoring.
LEMMAS = {
    "wears": "wear", "wearing": "wear", "wore": "wear", "worn": "wear", "loves": "love", "loved": "love", "loving": "love", "opening": "open",
    "opened": "open", "opens": "open", "fixed": "fix", "fixing": "fix", "repaired": "repair", "repairs": "repair", "losing": "lose", "lost": "lose",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, wherever use names it: inside an expression there is no
    other way to keep a common part from being computed again at each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def query_tokens(query: str) -> list[str]:
    """search_tokens of a query, on the driver: the plan then holds them as constants."""
    found = [w for w in re.findall(r"\w+", query.lower()) if len(w) > 1 and w not in STOPWORDS]
    return list(dict.fromkeys(found))


def typed_strings(values: list[str]) -> Column:
    return strings(values) if values else F.array().cast("array<string>")


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(text: Column) -> Column:
    """All words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def search_tokens(text: Column) -> Column:
    """The set of words that a search compares: at least two letters, no stopwords."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)))


def evidence_tokens(text: Column) -> Column:
    """Like search_tokens, but with the control words, and in base form."""
    kept = F.filter(words(text), lambda w: (F.length(w) > 1) & (~w.isin(STOPWORDS) | w.isin(CONTROL_WORDS)))
    pairs = F.create_map(*[F.lit(x) for kv in LEMMAS.items() for x in kv])
    return F.array_distinct(F.transform(kept, lambda w: F.coalesce(F.try_element_at(pairs, w), w)))


def has_any(tokens: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tokens, strings(wanted))


def occurrences(text: Column, term: Column) -> Column:
    """How often term occurs in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def occurrences_of_all(text: Column, terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0), lambda n, t: n + occurrences(text, t))


def one_space(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.split(one_space(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def hits(lower_text: Column, tokens: Column | None, keywords: list[str]) -> Column:
    """The number of keywords that occur as a token or anywhere in the text."""
    found = [F.contains(lower_text, F.lit(k)) if tokens is None else F.contains(lower_text, F.lit(k)) | F.array_contains(tokens, k) for k in keywords]
    return sum((f.cast("int") for f in found), F.lit(0))


def tidy_punctuation(text: Column) -> Column:
    """Joined words read as a sentence: no space before punctuation and contractions."""
    out = one_space(text)
    for mark in (",", ".", "!", "?", ";", ":", "n't", "'m", "'re", "'ve", "'ll", "'d", ")"):
        out = F.replace(out, F.lit(" " + mark), F.lit(mark))
    return F.trim(F.replace(out, F.lit("( "), F.lit("(")))


def code_blocks(text: Column) -> Column:
    """The contents of the fenced repl blocks, trimmed, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```repl\s*\n(.*?)\n```"), 1)
    return F.transform(found, lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))


def final_variable(text: Column) -> Column:
    """The variable that a response names as its final answer; null if none."""
    name = F.regexp_extract(text, r"(?ms)^\s*FINAL_VAR\((.*?)\)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r'^"+|"+$', ""), r"^'+|'+$", "")
    return F.when(text.rlike(r"(?ms)^\s*FINAL_VAR\((.*?)\)"), bare)


def final_answer(text: Column) -> Column:
    """The final answer written in a response; null if there is none or if a variable holds it."""
    direct = F.when(text.rlike(r"(?ms)^\s*FINAL\((.*)\)\s*$"), F.regexp_extract(text, r"(?ms)^\s*FINAL\((.*)\)\s*$", 1))
    return F.when(final_variable(text).isNotNull(), F.lit(None)).otherwise(F.regexp_replace(direct, r"^\s+|\s+$", ""))


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""))


def clipped(text: Column, limit: int) -> Column:
    """A text beyond the limit is cut, and the cut says how much is missing."""
    rest = F.concat(F.lit("... + ["), (F.length(text) - limit).cast("string"), F.lit(" chars...]"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), rest)).otherwise(text)


def folder_name(repo: Column) -> Column:
    """A model's name as a folder name."""
    return F.regexp_replace(repo, r"[^A-Za-z0-9._-]+", "__")


def safe_keys(config: Column) -> Column:
    """A map without the entries whose key names an API key."""
    return F.map_filter(config, lambda k, _: ~(F.contains(F.lower(k), F.lit("api")) & F.contains(F.lower(k), F.lit("key"))))


def first_json(text: Column) -> Column:
    """map<string,string> of the first JSON object that can be read, at whatever brace it begins; texts behind it do
    not matter, inner values stay JSON. Null without one. Braces are tried in order until one can be read."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(1)) == "{")
    none = F.lit(None).cast("map<string,string>")
    return F.aggregate(at, none, lambda found, i: F.coalesce(found, F.from_json(F.substr(text, i), "map<string,string>")))


def contents(prompt: Column) -> Column:
    """The texts of a list of messages, in order; a null one is empty."""
    return F.transform(F.coalesce(prompt, F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.coalesce(m["content"], F.lit("")))


def split_system(prompt: Column, assistant: str = "assistant") -> Column:
    """struct<system, messages>: the system messages joined by line breaks, apart from the others, in which the
    assistant bears the name that a provider knows it by."""
    system = F.array_join(F.transform(F.filter(prompt, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n")
    named = lambda m: F.struct(F.when(m["role"] == "assistant", assistant).otherwise(m["role"]).alias("role"), m["content"].alias("content"))
    return F.struct(system.alias("system"), F.transform(F.filter(prompt, lambda m: m["role"] != "system"), named).alias("messages"))


def as_messages(text: Column) -> Column:
    """A plain text as one user message."""
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))


def joined_map(values: Column) -> Column:
    """The entries of a map as one text; a null value is written null."""
    return F.array_join(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")


def sentence_windows(text: Column, before: int = 1, after: int = 2) -> Column:
    """One text per sentence: it with so many sentences before and after it."""
    parts = sentences(text)

    def around(i: Column) -> Column:
        first = F.greatest(i - before, F.lit(0))
        return F.array_join(F.slice(parts, first + 1, F.least(i + after + 1, F.size(parts)) - first), " ")

    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), F.size(parts) - 1), around)).otherwise(F.array().cast("array<string>"))


def context_variable(code: Column) -> Column:
    """The first text assigned to the name context in a block of code; null if none."""
    found = F.regexp_extract(code, r"""(?s)\bcontext\s*=\s*(?:\"{3}(.*?)\"{3}|"([^"\n]*)"|'([^'\n]*)')""", 0)
    return F.when(found != "", F.regexp_replace(F.regexp_replace(found, r"^context\s*=\s*", ""), r"""^["']+|["']+$""", ""))


def answer_of(final: Column) -> Column:
    """A final answer that was logged as a pair: its second part; other answers as they are."""
    pair = F.regexp_extract(final, r"""(?s)^\(\s*['"].*?['"]\s*,\s*['"](.*)['"]\s*\)$""", 1)
    return F.when(F.coalesce(pair, F.lit("")) != "", pair).otherwise(final)
