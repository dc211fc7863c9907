"""Problem 8: personal items in free text, found by a character BiLSTM-CRF and replaced by placeholders."""

from __future__ import annotations

import functools
import io
import re
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bilstm import BiLstmCrf
from spanforge.session import spread

TYPES = ["name", "email", "phone", "id_number", "address"]
TAGS = ["O"] + [f"{p}-{t}" for t in TYPES for p in "BI"]
MODEL = Path(__file__).with_name("pii_model.npz")
#: Characters of a window and of what it shares with the next one.
WINDOW, OVERLAP = 384, 96
#: Windows decoded at a time.
BATCH = 512
#: Names up to which a lexicon goes along with every task; the words of a larger one are joined to the documents.
MAX_LEXICON = 1_000_000

_KNOWN = " \n\t" + "".join(map(chr, range(33, 127))) + "áàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿßÁÀÂÄÇÉÈÊËÍÎÏÑÓÔÖØŒÚÙÛÜ“”„‘’«»–—…º°·•¿¡€£№"
_CLASSES = {"Lu": 1, "Ll": 2, "Lt": 1, "Lo": 2, "Lm": 2, "Mn": 3, "Mc": 3, "Nd": 4, "No": 4, "Nl": 4, "Zs": 5, "Cf": 6, "Cc": 6}
_N = len(_KNOWN) + 8
IDS = 2 * _N + 1


@functools.cache
def _char_table() -> np.ndarray:
    known = {c: i + 8 for i, c in enumerate(_KNOWN)}
    return np.array([known.get(chr(i), _CLASSES.get(unicodedata.category(chr(i)), 7)) for i in range(0x10000)], np.int32)


def char_ids(text: str, listed: list[tuple[int, int]]) -> np.ndarray:
    """One id per character: what it is, and whether its word is in the lexicon; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = 1 + 2 * np.where(points < 0x10000, _char_table()[np.minimum(points, 0xFFFF)], 7).astype(np.int32)
    for a, b in listed:
        ids[a:b] += 1
    return ids


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def lexicon_words(text: str) -> set[str]:
    """What of a text is looked up in a lexicon: its words in lower case, also without a possessive ending."""
    found = {m[0].lower() for m in _WORD.finditer(text)}
    return found | {w[:-2] for w in found if w[-2:] in ("'s", "’s")}


def listed_words(text: str, lexicon: frozenset[str]) -> list[tuple[int, int]]:
    """The words of a text that the lexicon lists, without regard to case; a possessive ending is not part of one."""
    found = []
    for m in _WORD.finditer(text):
        word = m[0].lower()
        if word in lexicon:
            found.append(m.span())
        elif word[-2:] in ("'s", "’s") and word[:-2] in lexicon:
            found.append((m.start(), m.end() - 2))
    return found


@functools.cache
def load_model(path: str = str(MODEL)) -> BiLstmCrf:
    with np.load(io.BytesIO(Path(path).read_bytes())) as f:
        return BiLstmCrf({k: f[k].astype(np.float32) for k in f.files})


def windows(length: int) -> list[tuple[int, int]]:
    """The windows over a text of this length; each begins OVERLAP before the end of the one before."""
    if length <= WINDOW:
        return [(0, length)]
    step = WINDOW - OVERLAP
    starts = list(range(0, length - OVERLAP, step))
    return [(s, min(s + WINDOW, length)) for s in starts]


def _spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, type number) of the runs of tags in one window."""
    found, t, n = [], 0, len(tags)
    while t < n:
        tag = tags[t]
        if tag:
            kind, end = (tag - 1) // 2, t + 1
            while end < n and tags[end] == 2 * kind + 2:
                end += 1
            found.append((t, end, kind))
            t = end
        else:
            t += 1
    return found


def tag_texts(texts: list[str], lexicon: frozenset[str] | list[frozenset[str]], model: BiLstmCrf) -> list[list[tuple[int, int, str]]]:
    """The items of each text as (start, end, type), in order and without overlap. lexicon: the listed names, or
    for each text those that it holds.

    All windows of all texts are decoded in batches of like length. Where windows overlap, an
    item is taken from the window that sees most of its surroundings; one that a window's edge
    cuts loses against a whole one of the neighbour. Items longer than the overlap are cut in every
    window: their parts are joined."""
    names = lexicon if isinstance(lexicon, list) else [lexicon] * len(texts)
    coded = [char_ids(t, listed_words(t, n)) for t, n in zip(texts, names)]
    jobs = [(i, a, b) for i, ids in enumerate(coded) for a, b in windows(len(ids)) if b > a]
    jobs.sort(key=lambda j: j[1] - j[2])  # the longest first, so that the model passes over the padding
    found: list[list[tuple]] = [[] for _ in texts]
    for at in range(0, len(jobs), BATCH):
        part = jobs[at : at + BATCH]
        lengths = np.array([b - a for _, a, b in part])
        ids = np.zeros((lengths.max(), len(part)), np.int32)
        for j, (i, a, b) in enumerate(part):
            ids[: b - a, j] = coded[i][a:b]
        tags, _ = model.decode(ids, lengths)
        for j in np.flatnonzero(tags.any(axis=0)):
            i, a, b = part[j]
            for s, e, kind in _spans(tags[: lengths[j], j]):
                cut = (s == 0 and a > 0) + (e == b - a and b < len(coded[i]))
                room = min(s if a else 1 << 20, (b - a - e) if b < len(coded[i]) else 1 << 20)
                found[i].append((cut, -room, a + s, a + e, TYPES[kind]))
    return [_reconciled(text, spans) for text, spans in zip(texts, found)]


def _joined(spans: list[tuple]) -> list[tuple]:
    """spans with the cut parts of one item joined where no window shows it whole."""
    whole = [s for s in spans if not s[0]]
    cut = sorted((s for s in spans if s[0] and all(s[3] <= w[2] or s[2] >= w[3] for w in whole)), key=lambda s: (s[4], s[2]))
    out: list[tuple] = []
    for s in cut:
        if out and out[-1][4] == s[4] and s[2] <= out[-1][3]:
            out[-1] = (1, 0, out[-1][2], max(out[-1][3], s[3]), s[4])
        else:
            out.append(s)
    return whole + out


def _reconciled(text: str, spans: list[tuple]) -> list[tuple[int, int, str]]:
    chosen: list[tuple[int, int, str]] = []
    for _, _, s, e, kind in sorted(_joined(spans)):
        if all(e <= a or s >= b for a, b, _ in chosen):
            chosen.append((s, e, kind))
    checked = [x for x in (_checked(text, *span) for span in sorted(chosen)) if x]
    out: list[tuple[int, int, str]] = []
    for item in sorted(checked, key=lambda x: (x[2] != "email", x[0])):  # a name inside an email address is no name
        if all(item[1] <= a or item[0] >= b for a, b, _ in out):
            out.append(item)
    return sorted(out)


_TITLE = re.compile(r"(?:(?:dr|prof|mr|mrs|ms|herrn?|frau|sr|sra|dra|mme|mlle|don|doña|señora?|madame|monsieur)\b\.?\s+|m\.\s+(?=[^\W\d_]{3,}\s))", re.I)
_PART = r"(?:dot|underscore|plus|dash|punkt|unterstrich|punto|guion\s+bajo|point|tiret\s+bas)"
_LOCAL = rf"[\w.+-]*\w(?:\s{_PART}\s[\w+-]+)*"
_EMAILS = (  # written with a sign, then spelt out
    re.compile(rf"{_LOCAL}(?:\s?@\s?|\s?[(\[]at[)\]]\s?)[\w-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?|\s(?:dot|punkt|punto|point)\s)[\w-]+)+", re.I),
    re.compile(rf"{_LOCAL}\s(?:at|arroba|arobase)\s[\w-]+(?:(?:\s?[(\[]dot[)\]]\s?|\s(?:dot|punkt|punto|point)\s)[\w-]+)+", re.I),
    re.compile(rf"{_LOCAL}\s(?:at|arroba|arobase)\s[\w-]+(?:\.[\w-]+)+(?![\w@])", re.I),
)
_ID_WORDS = re.compile(r"^(?:[^\W\d_]{3,}\b\.?:?\s+|n[ro°º]\.?\s*|:\s*)+(?=\S*\d)", re.I)


def _checked(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """The exact check after the model: whole words, no title, no possessive, and what the type needs."""
    while start > 0 and end > start and text[start - 1].isalnum() and text[start].isalnum() and text[max(0, start - 2) : start] != "\\n":
        start -= 1
    while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    item = text[start:end]
    left = len(item) - len(item.lstrip(" \n\t,;:.|<>\"'“”„«»-/"))
    start, item = start + left, re.split(r"\n|\\n", item[left:])[0]
    if kind == "name":
        if m := _TITLE.match(item):
            start, item = start + m.end(), item[m.end() :]
        item = re.sub(r"['’]s$", "", item.rstrip(" \n\t,;:|<>\"“”„«»()!?-/"))
        item = item.rstrip(" ,")
        if (m := re.match(r"(.*?), ([^\W\d_].*)", item)) and m[2].islower() and not m[1].islower():  # words after a greeting
            item = m[1]
        if item.endswith(".") and not re.search(r"(?:^|[\s.-])[^\W\d_]\.$", item):
            item = item.rstrip(".")
        ok = len(re.findall(r"[^\W\d_]", item)) >= 2 and not re.search(r"[@\d_(]", item) and text[start + len(item) : start + len(item) + 1] != "@"
    elif kind == "email":
        reach, whole = 80, None
        while True:  # as far as the address goes
            base, stop = max(0, start - reach), min(len(text), end + reach)
            near = text[base:stop]
            whole = next((m for r in _EMAILS for m in r.finditer(near) if base + m.start() < end and base + m.end() > start), None)
            if not whole or not (whole.start() == 0 and base > 0 or whole.end() == len(near) and stop < len(text)):
                break
            reach *= 4
        if whole:
            start, item = base + whole.start(), whole[0]
        ok = whole is not None
    elif kind == "phone":
        item = re.sub(r"[^\w]+$", "", item)
        if start and text[start - 1] in "(+" and item[:1].isdigit():
            start, item = start - 1, text[start - 1] + item
        digits = len(re.findall(r"\d", item))
        # a number written in one piece has an area code; letters stand only before an extension
        ok = len(item.split()) >= 7 if not digits else digits >= (9 if item.isdigit() else 6) and not re.search(r"\d[a-wyz]|[a-f]\d", item, re.I)
    elif kind == "id_number":
        item = item.rstrip(" \n\t,;:.|<>\"“”„«»)!?-")
        if m := _ID_WORDS.match(item):
            start, item = start + m.end(), item[m.end() :]
        ok = len(re.findall(r"\d", item)) >= 5
    else:
        item = item.rstrip(" \n\t,;:|<>\"“”„«»)!?-")
        if item.endswith(".") and not re.search(r"\b(?:st|rd|ave|str|dr|ln|ct|av|bd|avda)\.$", item, re.I):
            item = item.rstrip(".")
        ok = len(re.findall(r"[^\W\d_]", item)) >= 4 and " " in item
    return (start, start + len(item), kind) if ok else None


def names_of(lexicon: DataFrame) -> frozenset[str] | None:
    """The lexicon's names in lower case, or None if they are more than MAX_LEXICON."""
    rows = lexicon.filter("name is not null").select(F.lower("name").alias("name")).distinct().limit(MAX_LEXICON + 1).collect()
    return None if len(rows) > MAX_LEXICON else frozenset(r["name"] for r in rows)


def _with_listed(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """documents with _listed, the words of each text that the lexicon lists: an equi-join on the distinct words."""

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(lexicon_words(t)) if t else [])

    rows = documents.select("doc_id", F.explode(words("text")).alias("_word")).distinct()
    names = lexicon.filter("name is not null").select(F.lower("name").alias("_word")).distinct()
    listed = rows.join(names, "_word").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("_word").alias("_listed"))
    return documents.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")


def _tagged(documents: DataFrame, lexicon: DataFrame, model_path: str, answer: Callable, schema: str) -> DataFrame:
    """answer(ids, texts, items of each text) for every batch of documents; null and empty texts have no items.

    Each text is worked on by itself, whole, in windows: nothing is shuffled but to spread a
    small table, and a copy counts as a document of its own."""
    rows, names = documents.select("doc_id", "text"), names_of(lexicon)
    rows = spread(rows, "doc_id")
    if names is None:
        rows = _with_listed(rows, lexicon)
    shared = documents.sparkSession.sparkContext.broadcast(names)  # at most MAX_LEXICON names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model(model_path)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            own = shared.value
            if own is None:
                own = [frozenset(x) if x is not None else frozenset() for x in batch["_listed"]]
            yield answer(batch["doc_id"], texts, tag_texts([t or "" for t in texts], own, model))

    return rows.mapInPandas(run, schema)


def find_items(documents: DataFrame, lexicon: DataFrame, model_path: str = str(MODEL)) -> DataFrame:
    """(doc_id, item_start, item_end, pii_type, pii_text), offsets in characters, one row per occurrence."""

    def rows(ids, texts, found) -> pd.DataFrame:
        listed = [(doc, s, e, k, text[s:e]) for doc, text, items in zip(ids, texts, found) for s, e, k in items]
        return pd.DataFrame(listed, columns=["doc_id", "item_start", "item_end", "pii_type", "pii_text"])

    return _tagged(documents, lexicon, model_path, rows, "doc_id bigint, item_start int, item_end int, pii_type string, pii_text string")


def redacted(documents: DataFrame, lexicon: DataFrame, model_path: str = str(MODEL)) -> DataFrame:
    """(doc_id, text): each item replaced by [TYPE], everything else unchanged; null stays null."""

    def rows(ids, texts, found) -> pd.DataFrame:
        out = []
        for text, items in zip(texts, found):
            for s, e, kind in reversed(items):
                text = f"{text[:s]}[{kind.upper()}]{text[e:]}"
            out.append(text)
        return pd.DataFrame({"doc_id": ids, "text": out})

    return _tagged(documents, lexicon, model_path, rows, "doc_id bigint, text string")
