"""Problem 4: defective prompt and response pairs, by a CRF over the clauses of the response."""

from __future__ import annotations

import functools
import json
import random
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.crf import LinearChain
from spanforge.session import spread

LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
#: Labelled pairs that the CRF is fitted on; they are written by `labelled_pairs`, not taken from a table.
TRAINING_PAIRS = 8000
MODEL = Path(__file__).with_name("pair_model.npz")

# Frequent function words of the languages.
FUNCTION_WORDS = {
    "en": "the a an of and to in is are was were that it for on with as at by from this these which who what when how why does do did not but or if then there we you can be been after before until again so no yes its each between one she he they his her their has have had two nobody someone will".split(),
    "de": "der die das den dem des ein eine einen einem einer und zu in im ist sind war waren dass es für auf mit als an am von vom aus dieser diese welche wer was wann wie warum nicht aber oder wenn dann wir man kann noch nach vor bis wieder so nein ja sich etwas während weil da damit jedes nur hat wurde wurden unter hinter neben sie er es ihr wird werden zwei keiner niemand um schon auch sehr".split(),
    "es": "el la los las un una unos unas de del y a al en es son era que se lo por para con como desde este esta cuál quién qué cuándo cómo cuánto cuántas no pero o si entonces su sus hay más hasta otra vez sí ya mientras porque después luego cada sobre bajo sigue todo solo algo ella ellos ese esa esto eso también muy está han ha sin donde nadie dos".split(),
    "fr": "le la les l un une des de du d et à au aux en dans est sont était que qu se il elle on ce cette qui quoi quand comment combien pourquoi ne pas mais ou si alors nous vous plus jusqu encore oui non car pour par sur sous avec puis après personne quelque chose tout reste pendant parce lors cela ça leur leurs son sa ses ils elles aussi très où dont deux".split(),
}
# How a prompt asks for an answer in another language.
ASKED = {
    "en": r"(?:in|into|auf|ins?|en|al|au)\s+(?:english|englisch\w*|inglés|anglais)",
    "de": r"(?:in|into|auf|ins?|en|al)\s+(?:german|deutsch\w*|alemán|allemand)",
    "es": r"(?:in|into|auf|ins?|en|al)\s+(?:spanish|spanisch\w*|español|castellano|espagnol)",
    "fr": r"(?:in|into|auf|ins?|en|al)\s+(?:french|französisch\w*|francés|français)",
}
# The signs of a model that declines, by kind.
REFUSAL_SIGNS = {
    "decline": r"\bi(?:\s+am|'m|’m|\s+have to|\s+must|\s+will have to)?\s+(?:can(?:no|')?t|can’t|cannot|won['’]t|will not|must decline|do(?:n['’]t| not) feel|(?:a?m )?(?:unable|not (?:able|allowed|permitted|in a position|comfortable|going to|willing))|unable|not (?:able|allowed|permitted|comfortable|going to|willing)|refuse|decline|pass on|say no|(?:would|'d|’d) (?:rather not|prefer not)|prefer not|have to (?:decline|refuse|pass|say no)|could not possibly|couldn['’]t possibly)|\bi['’]d (?:rather|prefer) not|\bi['’]ll have to (?:pass|decline|refuse)"
    r"|\b(?:is|be|are)(?:n['’]t| not) (?:possible|permitted|allowed|something)\b.*\b(?:me|i|us)\b|\b(?:beyond|outside) (?:what|anything) i\b|\b(?:can|could|may) ?not be (?:answered|described|shared|discussed) by me\b|\boff[- ]limits\b"
    r"|\b(?:kann|darf|möchte|werde|will) ich\b.*\b(?:nicht|kein\w*)\b|\bich (?:kann|darf|möchte|werde|will|muss|bin)\b.*\b(?:nicht (?:helfen|beantworten|sagen|machen|beschreiben|befugt|berechtigt|bereit|möglich|weiter\w*|behilflich|in der lage)|kein\w*|ablehnen|passen)\b|\bich (?:lehne\b.*\bab|verzichte|weigere|passe)\b|\bist (?:es )?mir nicht (?:möglich|erlaubt|gestattet)|\bnicht in der lage\b|\bkommt für mich nicht\b"
    r"|\bno (?:puedo|debo|quiero|voy a|me está permitido|me es posible|estoy (?:autorizad\w|en condiciones)|me permiten|me corresponde|podré)\b|\bprefiero no\b|\b(?:debo|tengo que) (?:rechazar|declinar|pasar|negarme)|\bme (?:niego|abstengo)\b|\b(?:rechazo|declino)\b"
    r"|\bje (?:ne (?:peux|puis|dois|veux|souhaite|suis|saurais|vais) pas|préfère ne pas|refuse|décline|passe|m['’]abstiens|dois (?:refuser|décliner|passer))|\bn['’]est pas permis|\b(?:ne m['’]est pas (?:permis|possible)|m['’]est impossible)\b|\bpas en mesure\b|\bhors de question\b",
    "hedge": r"\b(?:can(?:no|')?t|can’t|cannot|couldn['’]t|hard to) (?:say|tell|be|see) (?:for )?(?:sure|certain|exactly|precisely|fully)|\bnot (?:entirely |quite |completely )?(?:sure|certain)\b|\bnicht (?:genau|sicher|ganz) (?:sagen|erkennen|sicher)|\bno (?:puedo|sabría) (?:decir|asegurar)\w* con (?:certeza|seguridad|exactitud)|\bno estoy (?:del todo )?segur\w|\bne (?:peux|saurais) (?:pas )?(?:dire|l['’]affirmer) (?:avec certitude|exactement)|\bpas (?:tout à fait )?(?:sûre?|certaine?)\b",
    "sorry": r"\b(?:sorry|apologi[sz]e|apologies|unfortunately|regret|afraid|lamentablemente|desafortunadamente|leider|tut mir leid|entschuldigung|bedau[re]\w*|lo siento|lamento|perdón|disculp\w+|désolée?|navrée?|malheureusement|regrette|pardon|excuse\w*)\b",
    "role": r"\bas an? (?:ai|assistant|language model)|\bals (?:ki|assistent\w*|sprachmodell)|\bcomo (?:asistente|ia|modelo)|\ben tant qu",
    "policy": r"\b(?:against|outside|violates?|breaks?)\b.*\b(?:guidelines?|polic(?:y|ies)|rules?|principles)\b|\b(?:would|might|may) be (?:inappropriate|improper|wrong)\b|\bno comment\b|\bnot something (?:that )?i\b|\bask (?:me )?(?:about|for) something else\b"
    r"|\bverstößt\b|\bgegen (?:meine|die|unsere) (?:richtlinien|regeln|grundsätze)\b|\bdar(?:über|auf) (?:spreche|rede|antworte) ich nicht\b|\bkein kommentar\b|\bwäre (?:unangemessen|unpassend)\b"
    r"|\b(?:contra|en contra de|incumple)\b.*\b(?:normas|directrices|políticas?|reglas|principios)\b|\bde eso no (?:voy a hablar|hablo|quiero hablar)\b|\bsin comentarios\b|\bsería (?:inapropiado|inadecuado)\b"
    r"|\b(?:contraire à|à l['’]encontre de) (?:mes|nos|les) (?:consignes|règles|directives|principes)\b|\benfreint\b|\bje ne parle pas de\b|\b(?:pas de|sans) commentaire\b|\bserait (?:inapproprié|déplacé)\b",
    "task": r"\b(?:help|assist|answer|describe|comment|share|discuss|request|provide|handle|respond|helfen|beantworten|beschreiben|auskunft|kommentieren|weitergeben|antworten|ayudar|responder|describir|comentar|compartir|petición|contestar|aider|répondre|décrire|commenter|traiter|partager|demande)\w*",
    "tail": r"\b(?:different|another|other) question|may be sensitive|something else|andere frage|etwas anderes|könnte(?:n)? (?:heikel|sensibel|vertraulich)|otra (?:pregunta|cosa)|puede ser (?:delicado|sensible)|autre (?:question|chose)|peut être sensible|sensib|vertraulich|heikel|delicad",
}
# Words with which no clause ends.
DANGLING = frozenset(
    "the a an of and to in with for at by from that which who but or if because so as then than into between under his her its their our my your not "
    "der die das den dem des ein eine einen einem einer und zu mit für auf als von aus dass aber oder wenn weil sodass damit im am vom zum zur sein ihr "
    "el la los las un de del y a al en con por para que como pero o si porque su sus muy "
    "le les l une des du d et à au aux dans avec pour par sur que qu qui mais ou si car parce son sa ses leur très".split()
)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
# Words that begin a place or time.
PLACES = frozenset(
    "behind near next under on in at beside between after before during inside above below around toward towards opposite along through outside hinter neben unter auf im am bei vor nach zwischen über gegenüber "
    "detrás junto debajo sobre en cerca tras entre al dentro frente derrière près sous sur dans devant entre après à chez vers".split()
)
_SIGNS = {k: re.compile(v, re.I) for k, v in REFUSAL_SIGNS.items()}
_WORD_SIGNS = ("sorry", "task")  # those of single words


@functools.lru_cache(100_000)
def _word_signs(word: str) -> tuple[str, ...]:
    """The signs that a single word is; most words are met again and again."""
    return tuple(k for k in _WORD_SIGNS if _SIGNS[k].search(word))


_ASKED = {k: re.compile(v, re.I) for k, v in ASKED.items()}
_FUNCTION = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES = tuple(FUNCTION_WORDS)
_OF = {w: tuple(i for i, k in enumerate(_LANGUAGES) if w in _FUNCTION[k]) for v in FUNCTION_WORDS.values() for w in v}
_QUOTES = re.compile(r'"[^"\n]{2,}"|“[^”\n]{2,}”|„[^“”\n]{2,}[“”]|«[^»\n]{2,}»')


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def question_of(prompt: str | None) -> tuple[str, str]:
    """(question, whole text): out of a plain text or JSON of one message or a message list."""
    text = prompt or ""
    try:
        found = json.loads(text) if text.lstrip()[:1] in ("{", "[") else None
    except ValueError:
        found = None
    if isinstance(found, dict):
        found = found.get("messages", [found])
    if isinstance(found, list):
        said = [m.get("content") for m in found if isinstance(m, dict) and m.get("role", "user") == "user" and m.get("content")]
        said = [s if isinstance(s, str) else " ".join(str(p.get("text", "")) for p in s if isinstance(p, dict)) for s in said]
        text = said[-1] if said else text
    parts = re.split(r"\n\s*-{3,}\s*\n|\n\s*(?:Question|Frage|Pregunta)\s*:\s*", text)
    return parts[-1].strip(), text.strip()


def language(words: list[str]) -> tuple[str | None, int]:
    """The language with most function words and its lead; None if two lead or none is found."""
    found = [0] * len(_LANGUAGES)
    for w in words:
        for part in (w,) if w.isalnum() else re.split(r"['’]", w):
            for i in _OF.get(part, ()):
                found[i] += 1
    top = max(found)
    lead = top - sorted(found)[-2]
    return (_LANGUAGES[found.index(top)] if lead else None), lead


def unwrapped(response: str | None) -> tuple[str, set[str]]:
    """The answer without thinking, wrappers and marks, and which of them were left open."""
    text, flags = response or "", set()
    text = re.sub(r"<think(?:ing)?>.*?</think(?:ing)?>", " ", text, flags=re.S | re.I)
    if re.search(r"<think(?:ing)?>", text, re.I):
        text = re.sub(r"<think(?:ing)?>.*", " ", text, flags=re.S | re.I)
        if not text.strip():
            flags.add("open_thinking")
    text = text.replace("​", "").replace("﻿", "").strip()
    for _ in range(4):
        before = text
        if m := re.fullmatch(r"```[\w-]*\s*\n?(.*?)\n?```", text, re.S):
            text = m[1].strip()
        elif text.count("```") % 2:
            flags.add("open_fence")
            text = re.sub(r"^```[\w-]*", "", text).strip() if text.startswith("```") else text
        if m := re.fullmatch(r"(?:FINAL(?:_ANSWER|_VAR)?|ANSWER)\s*\((.*)\)", text, re.S):
            text = m[1].strip()
        elif m := re.match(r"(?:FINAL(?:_ANSWER|_VAR)?)\s*\((.*)", text, re.S):
            flags.add("open_final")
            text = m[1].strip()
        if text[:1] in ("{", "["):
            try:
                value = json.loads(text)
            except ValueError:
                if re.match(r'[{\[]\s*["{\[]', text):
                    flags.add("open_json")
                    text = re.sub(r'^[{\[\s"]*(?:answer|response|text|final_answer)?["\s:]*', "", text)
            else:
                if isinstance(value, dict):
                    value = next((value[k] for k in ("answer", "response", "final_answer", "text", "content") if k in value), next((v for v in value.values() if isinstance(v, str)), ""))
                text = " ".join(map(str, value)) if isinstance(value, list) else "" if value is None else str(value)
        if re.fullmatch(r'"[^"]*"|“[^”]*”|„[^“”]*[“”]|«[^»]*»', text, re.S):
            text = text[1:-1].strip()
        if text == before:
            break
    return text, flags


def clauses(text: str) -> list[tuple[str, bool]]:
    """(clause, of a list) in order; quoted text stays in its clause."""
    held: list[str] = []
    masked = _QUOTES.sub(lambda m: held.append(m[0]) or f"\ue000{len(held) - 1}\ue001", text)
    out = []
    for line in re.split(r"\n+", masked):
        bullet = bool(re.match(r"\s*(?:[-*•]|\d{1,2}[.)])\s+", line))
        line = re.sub(r"^\s*(?:[-*•>]|\d{1,2}[.)])\s+", "", line)
        for part in re.split(r"(?<=[.!?…])\s+|(?<=[^\d\s]):\s+(?=\S)|(?<=\w)\s+:\s+(?=\S)|\s+[-–]\s+(?=[A-ZÀ-Þ¿¡])", line):
            part = re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])], part).strip()
            if re.search(r"\w", part):
                out.append((part, bullet))
    return out


def features(parts: list[tuple[str, bool]], question: str, prompt: str, flags: set[str], whole: str) -> list[list[str]]:
    """Binary features of each clause. Words enter only through classes, so that the model does not
    learn the subjects of its training sentences."""
    asked = next((k for k, r in _ASKED.items() if r.search(question)), None)
    q_words, p_words = tokens(question), tokens(prompt)
    expected = asked or language(q_words)[0] or language(p_words)[0]
    q_set, p_set = set(q_words), set(p_words)
    q_flat, p_flat = " ".join(q_words), " ".join(p_words)
    said = [w for part, _ in parts for w in tokens(part)]
    known: dict[str, int] = {}
    for w in said:
        known[w] = known.get(w, 0) + 1
    all_found, all_lead = language(tokens(_QUOTES.sub(" ", whole)))
    rows, n = [], len(parts)
    for i, (part, bullet) in enumerate(parts):
        bare = _QUOTES.sub(" ", part)
        words, own = tokens(part), tokens(bare)
        f = ["bias"]
        last = i == n - 1
        f += [f"first={i == 0}", f"last={last}", f"only={n == 1}"]
        found, lead = language(own)
        if found and expected:
            f.append(f"lang={'same' if found == expected else 'other'}{min(lead, 3)}")
        if all_found and expected:
            f.append(f"all_lang={'same' if all_found == expected else 'other'}{min(all_lead, 4)}")
        inside = sum(w in q_set for w in words) / max(len(words), 1)
        back = len(q_set & set(words)) / max(len(q_set), 1)
        flat = " ".join(words)
        copied = len(words) >= 3 and (flat in q_flat or flat in p_flat)
        f += [f"in_q={int(inside * 5)}", f"q_in={int(back * 5)}", f"copied={copied}"]
        f.append(f"same_as_q={flat == q_flat}")
        f.append(f"in_p={len(words) >= 3 and sum(w in p_set for w in words) == len(words)}")
        f.append(f"asks={part.rstrip(' \"»”*').endswith('?')}")
        of_words = {k for w in own for k in _word_signs(w)} | ({"sorry"} if "leid" in own and _SIGNS["sorry"].search(bare) else set())
        of_words |= {"sorry"} if "lo" in own and "siento" in own else set()
        signs = [k for k, r in _SIGNS.items() if (k in of_words if k in _WORD_SIGNS else r.search(bare))]
        f += [f"sign={s}" for s in signs]
        f.append(f"signs={'+'.join(sorted(signs))}")
        f.append(f"quoted={len(own) < len(words)}")
        if last:
            body = part.rstrip(" *_\"'»”)`")
            ended = bool(re.search(r"[.!?…。]$", body)) or bool(re.search(r"[.!?…]$", part.rstrip()))
            tail = words[-1] if words else ""
            dangles = tail in DANGLING and not ended
            f.append(f"end={'stop' if ended else 'comma' if re.search(r'[,;:(–-]$', part.rstrip()) else 'none'}")
            f.append(f"dangling={dangles and len(words) > 1}")
            new = known.get(tail, 0) < 2 and tail not in p_set
            f.append(f"cut={not ended and len(words) > 4 and not bullet and not copied}")
            f.append(f"list={bullet},new={new and not ended},dangling={dangles}")
            comma = bool(re.search(r"[,;:(–-]$", part.rstrip()))
            f.append(f"short={len(words) <= 4 and n == 1 and not dangles and not comma}")
            f.append(f"place={n == 1 and not dangles and not comma and not ended and bool(words) and words[0] in PLACES}{min(len(words) // 5, 3)}")
            f.append(f"whole_item={bullet and not ended and not dangles and not comma}")
            f += [f"flag={x}" for x in flags]
        rows.append(f)
    return rows


def _read(prompt: str | None, response: str | None) -> tuple[list, list, set, str]:
    """(clauses, their features, flags, text) of a pair; no clauses where the response says nothing."""
    question, whole_prompt = question_of(prompt)
    text, flags = unwrapped(response)
    parts = clauses(text)
    return parts, features(parts, question, whole_prompt, flags, text) if parts else [], flags, text


def _verdict(parts: list, labels: list[str], flags: set[str], text: str) -> str | None:
    """The defect of a pair, from the share of its response that each label covers; None if it has none.

    Two exact checks stand beside the labels: a response without any word is empty, and a
    clause that ends in a full stop is not broken off."""
    if not parts:
        return "truncated" if flags & {"open_json", "open_fence"} and re.search(r"\w", text) else "empty"
    cover = dict.fromkeys(LABELS, 0)
    for (part, _), label in zip(parts, labels):
        cover[label] += len(part)
    total = sum(cover.values())
    stopped = re.search(r"[.!?…][\s*_\"'»”)`]*$", parts[-1][0])
    if labels[-1] == "unfinished" and (flags or not stopped):
        return "truncated"
    if cover["refusal"] >= 0.5 * total:
        return "refusal"
    if cover["echo"] >= 0.9 * total:
        return "copied_question"
    if cover["foreign"] >= 0.5 * total:
        return "other_language"
    return None


def defects_of(prompts: list, responses: list, model: LinearChain) -> list[str | None]:
    """The defects of a batch of pairs, whose clauses are labelled together."""
    read = [_read(p, r) for p, r in zip(prompts, responses)]
    labels = model.decode_all([rows for _, rows, _, _ in read])
    return [_verdict(parts, found, flags, text) for (parts, _, flags, text), found in zip(read, labels)]


def defect_of(prompt: str | None, response: str | None, model: LinearChain) -> str | None:
    return defects_of([prompt], [response], model)[0]


# What the CRF is fitted on: sentences, questions and refusals of our own, put together at random. Every fourth
# of each list is held out: it is never fitted on and serves to measure the model.
_SENTENCES = {
    "en": ["The {a} {n} is near the {m}.", "Someone moves the {n} before the {m} is shown.", "After the break the {n} stands beside the {a} {m}.", "There are {k} items in the box, and nobody opens it.", "You can see the {n} at {t} because the {m} was moved.", "The speaker says that the {m} will be ready in {k} days.", "It was {k} minutes late, so the {n} had to wait.",
           "They carry the {n} across the street and sit down.", "A {m} falls from the shelf at {t}.", "Nobody knows who bought the {a} {n}.", "Two people argue about the price of the {m}.", "First the {n}, later the {m} and at last {k} small ones.", "A man describes the {n} to his daughter.", "Her comment on the {m} is short.", "The guide helps to lift the {n} and shares the {m}.", "A clerk answers the phone and provides a {n}."],
    "de": ["Der {n} steht neben dem {m}.", "Niemand hat den {n} vor {t} gesehen, weil das Bild dunkel war.", "Danach wird der {m} noch einmal gezeigt.", "In der Kiste sind {k} Teile, und keiner macht sie auf.", "Man kann den {n} ab {t} sehen, da der {m} verschoben wurde.", "Die Frau sagt, dass es {k} Tage dauert.",
           "Sie tragen den {n} über die Straße und setzen sich.", "Um {t} fällt ein {m} vom Regal.", "Keiner weiß, wer den {n} gekauft hat.", "Zwei Leute streiten über den Preis.", "Ein Mann beschreibt den {n} am Telefon.", "Ihr Kommentar ist kurz.", "Kinder helfen beim Tragen, jemand antwortet."],
    "es": ["El {n} está al lado de la {m}.", "Nadie ha visto el {n} antes de las {t}, porque la imagen era oscura.", "Luego se muestra otra vez la {m}.", "En la caja hay {k} piezas y nadie la abre.", "Se puede ver el {n} desde el {t}, ya que se movió la {m}.", "La mujer dice que tarda {k} días.",
           "Llevan el {n} al otro lado de la calle y se sientan.", "A las {t} cae una {m} del estante.", "Nadie sabe quién compró el {n}.", "Dos personas discuten por el precio.", "Un hombre describe el {n} a su hija.", "Su comentario sobre la {m} es breve.", "El guía ayuda a llevar el {n} y responde."],
    "fr": ["Le {n} est à côté de la {m}.", "Personne n'a vu le {n} avant {t}, parce que l'image était sombre.", "Ensuite on montre encore une fois la {m}.", "Dans la boîte il y a {k} pièces et personne ne l'ouvre.", "On peut voir le {n} dès {t}, car la {m} a été déplacée.", "La femme dit que cela prend {k} jours.",
           "Ils portent le {n} de l'autre côté de la rue et s'assoient.", "À {t}, une {m} tombe de l'étagère.", "On ne sait pas qui a acheté le {n}.", "Deux personnes se disputent sur le prix.", "Un homme décrit le {n} à sa fille.", "Son commentaire est bref.", "Le guide aide à porter la {m} et répond."],
}
_NOUNS = {
    "en": "ladder bucket lamp basket anchor radio bench carpet mirror cable statue barrel".split(),
    "de": "Eimer Korb Anker Teppich Spiegel Schrank Hammer Besen Koffer Balkon".split(),
    "es": "cubo cesto ancla alfombra espejo armario martillo escoba maleta balcón".split(),
    "fr": "seau panier ancre tapis miroir placard marteau balai valise balcon".split(),
}
_QUESTIONS = {
    "en": ["What is shown beside the {n}?", "Why does the speaker move the {n} after {t}?", "How often can we see the {m}?", "Who carries the {a} {n}?", "Can you explain what happens from {t} until the end?", "When did they sell the {m}?", "Is the {n} bigger than the {m}?", "Tell me where the {a} {m} ends up."],
    "de": ["Was sieht man neben dem {n}?", "Warum bewegt der Sprecher den {n} nach {t}?", "Wie oft sieht man den {m}?", "Kannst du erklären, was ab {t} geschieht?", "Wann wurde der {m} verkauft?", "Ist der {n} größer als der {m}?"],
    "es": ["¿Qué se ve al lado del {n}?", "¿Por qué mueve el orador el {n} después del {t}?", "¿Cuántas veces se ve la {m}?", "¿Puedes explicar lo que pasa desde el {t}?", "¿Cuándo vendieron la {m}?", "¿Es el {n} más grande que la {m}?"],
    "fr": ["Que voit-on à côté du {n} ?", "Pourquoi l'orateur déplace le {n} après {t} ?", "Combien de fois voit-on la {m} ?", "Peux-tu expliquer ce qui arrive dès {t} ?", "Quand a-t-on vendu la {m} ?", "Est-ce que le {n} est plus grand que la {m} ?"],
}
#: Lead, what is not done, what of, what comes after.
_REFUSALS = {
    "en": (["I'm sorry, but", "Sorry -", "Unfortunately,", "As an assistant,", "Having seen the question,", "I regret that", "", "My apologies, but", "I'm afraid", "Well,"],
           ["I can't", "I cannot", "I am not able to", "I'm unable to", "I won't", "I must decline to", "I'd rather not", "I am not allowed to", "I am not willing to", "I refuse to", "I'm not comfortable enough to", "I have to decline to"],
           ["help with this.", "answer this question.", "describe the people in it.", "comment on that request.", "share details of it.", "respond to that.", "handle such a task.", "discuss this any further."],
           ["Please ask a different question.", "It may be sensitive.", "", "", "Perhaps something else?"]),
    "de": (["Es tut mir leid, aber", "Leider", "Als Assistent", "", "Entschuldigung,", "Bedauerlicherweise"], ["kann ich", "darf ich", "möchte ich", "werde ich"],
           ["dabei nicht helfen.", "diese Frage nicht beantworten.", "dazu keine Auskunft geben.", "das nicht beschreiben.", "darauf nicht antworten.", "so etwas nicht machen."],
           ["Bitte stelle eine andere Frage.", "Der Inhalt könnte heikel sein.", "", ""]),
    "es": (["Lo siento, pero", "Como asistente,", "Lamento decir que", "", "Disculpa,", "Desafortunadamente"], ["no puedo", "no debo", "prefiero no", "no me está permitido", "no quiero", "me niego a"],
           ["ayudar con esto.", "responder a esa pregunta.", "describir a esas personas.", "comentar la petición.", "compartir ese dato.", "contestar a eso."],
           ["Prueba con otra pregunta.", "El contenido puede ser delicado.", "", ""]),
    "fr": (["Désolé, mais", "En tant qu'assistant,", "Malheureusement", "", "Navrée,", "Je regrette, mais"], ["je ne peux pas", "je ne suis pas en mesure de", "je préfère ne pas", "il ne m'est pas permis de", "je refuse de", "je ne souhaite pas"],
           ["vous aider.", "répondre à cette question.", "décrire ces personnes.", "commenter cette demande.", "partager cela.", "traiter ce sujet."],
           ["Essayez une autre question.", "Le contenu peut être sensible.", "", ""]),
}
#: Refusals in other words.
_POLICY = {
    "en": ["What you ask runs against my guidelines.", "That is against our policy.", "This violates the rules I follow.", "It would be inappropriate to answer.", "That is not something I talk about.", "No comment on that, ask me about something else.", "I will have to pass on that.", "Helping with that isn't possible for me.", "That topic is off-limits.", "I have to say no here.", "This is beyond what I can do.", "That breaks my principles."],
    "de": ["Diese Anfrage verstößt gegen meine Richtlinien.", "Das ist gegen die Regeln.", "Darauf antworte ich nicht.", "Kein Kommentar dazu.", "Da muss ich passen.", "Das ist mir nicht möglich.", "Ich lehne diese Bitte ab.", "Dazu bin ich nicht in der Lage.", "Das kommt für mich nicht infrage."],
    "es": ["Esta petición va en contra de mis normas.", "Eso incumple las reglas.", "De eso no hablo.", "Sin comentarios.", "Tengo que pasar.", "No me es posible.", "Rechazo esta solicitud.", "No estoy en condiciones de hacerlo.", "Eso no me corresponde a mí, no me corresponde decirlo."],
    "fr": ["Cette demande est contraire à mes consignes.", "Cela enfreint les règles.", "Je ne parle pas de cela.", "Sans commentaire.", "Là, je passe.", "Cela m'est impossible.", "Je décline cette requête.", "Je m'abstiens de tout avis.", "C'est hors de question."],
}
_LEADS = {  # (lead, whether the question follows it)
    "en": [("You asked:", True), ("The question was:", True), ("Sorry I took so long:", False), ("Sorry about the typo:", False), ("My apologies for the wait:", False), ("Asked again:", True), ("Unfortunately a little late:", False), ("In short:", False)],
    "de": [("Die Frage war:", True), ("Du fragst:", True), ("Entschuldige die Wartezeit:", False), ("Leider etwas spät:", False), ("Kurz gesagt:", False), ("Gefragt war:", True)],
    "es": [("La pregunta era:", True), ("Preguntas:", True), ("Perdón por tardar:", False), ("Disculpa la espera:", False), ("En resumen:", False), ("Se preguntó:", True)],
    "fr": [("La question était :", True), ("Tu demandes :", True), ("Désolé pour l'attente :", False), ("Pardon pour la faute :", False), ("En bref :", False), ("On demandait :", True)],
}
_HEDGES = {
    "en": ["I can't say for sure, but", "I am not entirely certain, but", "It is hard to tell exactly, though", "I cannot be certain, yet"], "de": ["Ich bin nicht sicher, aber", "Das kann ich nicht genau sagen, aber", "Ganz sicher bin ich nicht, doch"],
    "es": ["No puedo decirlo con certeza, pero", "No estoy del todo seguro, pero", "No sabría decir con exactitud, pero"], "fr": ["Je ne suis pas sûr, mais", "Je ne peux pas dire exactement, mais", "Je ne suis pas tout à fait certain, mais"],
}
_SPOTS = {
    "en": ["behind the {n}", "next to the {a} {n}, under the {m}", "near a {m} on the left", "between the {n} and the {m}", "after {t}", "on top of the {m} by the {n}"], "de": ["hinter dem {n}", "neben dem {n} unter dem {m}", "zwischen dem {n} und dem {m}", "nach {t}", "auf dem {m} bei dem {n}"],
    "es": ["detrás del {n}", "junto al {n}, debajo de la {m}", "entre el {n} y la {m}", "en la {m} del fondo", "cerca del {n}"], "fr": ["derrière le {n}", "près du {n}, sous la {m}", "entre le {n} et la {m}", "dans le {n} du fond", "devant la {m}"],
}
_QUOTED = {
    "en": ['The guest says "{q}" and goes on.', 'On the wall it says "{q}".', '"{q}" is what the {n} seller shouts.'], "de": ["Der Gast sagt „{q}“ und geht weiter.", "An der Wand steht „{q}“.", "„{q}“, ruft der Verkäufer."],
    "es": ["El invitado dice «{q}» y sigue.", "En la pared pone «{q}».", "«{q}», grita el vendedor."], "fr": ["L'invité dit « {q} » et continue.", "Au mur on lit « {q} ».", "« {q} », crie le vendeur."],
}
_IN = {
    "en": {"de": "Please reply in German.", "es": "Please reply in Spanish.", "fr": "Please reply in French."},
    "de": {"en": "Antworte bitte auf Englisch.", "es": "Antworte auf Spanisch.", "fr": "Antworte auf Französisch."},
    "es": {"en": "Responde en inglés.", "de": "Responde en alemán.", "fr": "Responde en francés."},
    "fr": {"en": "Réponds en anglais.", "de": "Réponds en allemand.", "es": "Réponds en espagnol."},
}
_KINDS = ["plain"] * 5 + ["list", "list", "short", "short", "spot", "hedge", "quoted", "lead", "asked", "refusal", "refusal", "echo", "echo_all", "foreign", "foreign", "cut", "cut", "cut_list", "cut_code", "cut_json"]
_CODE = ["\n```python\nfor row in rows:\n    if row.end > 3", '\n```json\n{"answer": ["a', "\n```sql\nselect x from y where"]


class _Writer:
    """Writes pairs whose clause labels are known."""

    def __init__(self, seed: int, held_out: bool = False):
        self.rng, self.held = random.Random(seed), held_out

    def pick(self, values: list):
        """One of the values to fit on, or of those held out: every fourth."""
        return self.rng.choice([v for i, v in enumerate(values) if (i % 4 == 1) == self.held])

    def fill(self, template: str, lang: str) -> str:
        rng = self.rng
        clock = f"{rng.randint(0, 59)}:{rng.randint(0, 59):02d}"
        return template.format(n=rng.choice(_NOUNS[lang]), m=rng.choice(_NOUNS[lang]), a=rng.choice(["old", "green", "heavy", "tall"]), k=rng.randint(2, 90), t=clock)

    def sentences(self, lang: str, k: int) -> list[str]:
        return [self.fill(self.pick(_SENTENCES[lang]), lang) for _ in range(k)]

    def refusal(self, lang: str) -> list[str]:
        lead, can, what, tail = (self.pick(x) for x in _REFUSALS[lang])
        text = " ".join(x for x in (lead, can, what) if x)
        if self.rng.random() < 0.3:
            text = self.pick(_POLICY[lang])
        return [text[:1].upper() + text[1:]] + ([tail] if tail else [])

    def broken(self, lang: str) -> str:
        rng = self.rng
        words = self.sentences(lang, 1)[0].rstrip(".").split()
        words = words[: rng.randint(2, len(words))]
        how = rng.random()
        if how < 0.4 and len(words[-1]) > 3:
            words[-1] = words[-1][: rng.randint(1, len(words[-1]) - 1)]
        elif how < 0.8:
            words.append(rng.choice([w for w in sorted(DANGLING) if w in _FUNCTION[lang]]))
        elif how < 0.9:
            words[-1] += rng.choice([",", ":", " (", ";"])
        return " ".join(words)

    def pair(self) -> tuple[str, str, list[str]] | None:
        """(prompt, response, labels), or None where the clauses come out otherwise than written."""
        rng = self.rng
        lang = rng.choice(["en", "en", "de", "es", "fr"])
        question, kind, joint = self.fill(self.pick(_QUESTIONS[lang]), lang), rng.choice(_KINDS), " "
        prompt = question if rng.random() < 0.4 else f"Context:\n{' '.join(self.sentences(lang, rng.randint(1, 3)))}\n---\n{question}"
        parts = [(s, "answer") for s in self.sentences(lang, rng.randint(1, 4))]
        if kind == "list" or kind == "cut_list":
            joint = "\n- "
            parts = [("", "answer")] + [(s.rstrip("."), "answer") for s, _ in parts]
            if kind == "cut_list":
                words = self.sentences(lang, 1)[0].rstrip(".").split()[:3]
                parts.append((" ".join([*words, rng.choice([w for w in sorted(DANGLING) if w in _FUNCTION[lang]])]), "unfinished"))
        elif kind == "short":
            parts = [(rng.choice([*_NOUNS[lang], "4:12", "at 3:40", "7", "yes", "Nein", "sí", "oui", "no"]) + rng.choice(["", "."]), "answer")]
        elif kind == "spot":
            spot = self.fill(self.pick(_SPOTS[lang]), lang)
            parts = [(rng.choice([spot, spot[0].upper() + spot[1:]]) + rng.choice(["", "", "."]), "answer")]
        elif kind == "hedge":
            told = self.sentences(lang, 1)[0]
            parts = [(f"{self.pick(_HEDGES[lang])} {told[0].lower()}{told[1:]}", "answer"), *parts[: rng.randint(0, 2)]]
        elif kind == "quoted":
            said = " ".join(self.refusal(lang)) if rng.random() < 0.6 else self.sentences(rng.choice(list(_NOUNS)), 1)[0]
            parts.insert(rng.randint(0, len(parts)), (self.fill(self.pick(_QUOTED[lang]).replace('{q}', said.rstrip('.').replace('{', '').replace('}', '')), lang), "answer"))
        elif kind == "lead":
            lead, asks = self.pick(_LEADS[lang])
            parts = [(lead, "answer")] + [(question, "echo")] * asks + parts
        elif kind == "asked":
            to = rng.choice(list(_IN[lang]))
            prompt = f"{prompt} {_IN[lang][to]}"
            parts = [(s, "answer") for s in self.sentences(to, rng.randint(1, 3))]
        elif kind == "refusal":
            parts = [(s, "refusal") for s in self.refusal(lang)]
        elif kind == "echo":
            parts = [(rng.choice([question, question.upper(), question.rstrip("? "), question.lower()]), "echo")]
        elif kind == "echo_all":
            parts = [(prompt, "echo")]
        elif kind == "foreign":
            parts = [(s, "foreign") for s in self.sentences(rng.choice([x for x in _NOUNS if x != lang]), rng.randint(1, 3))]
        elif kind == "cut":
            cut = self.broken(lang)
            parts = parts[: rng.randint(0 if len(cut.split()) > 5 else 1, 3)] + [(cut, "unfinished")]
        elif kind == "cut_json":
            stop = rng.choice(['", "sou', '", "source": ["a', '", "', '"', ""])
            words = self.sentences(lang, 1)[0].split()
            parts = parts[: rng.randint(1, 3)] if stop else parts[:1] + [(" ".join(words[: len(words) // 2]), "answer")]
        elif kind == "cut_code":
            parts.append((rng.choice(_CODE), "unfinished"))
        change = {0: str.upper, 1: str.lower}.get(rng.randrange(12)) if kind != "echo_all" else None
        if change:
            parts = [(change(s), x) for s, x in parts]
        response = joint.join(s for s, _ in parts).strip()
        if kind == "cut" and rng.random() < 0.15:
            response = "FINAL(" + response
        elif not kind.startswith("cut") and rng.random() < 0.15:
            response = f"FINAL({response})"
        elif kind == "cut_json":
            response = '{"answer": "' + response + stop
        labels = [x for s, x in parts for _ in clauses(s)]
        got = len(clauses(unwrapped(response)[0]))
        if kind in ("cut_code", "cut_json"):
            labels = (labels + ["unfinished"] * (got - len(labels)))[: got - 1] + ["unfinished"]
        return (prompt, response, labels) if labels and got == len(labels) else None


def labelled_pairs(n: int = TRAINING_PAIRS, seed: int = 11, held_out: bool = False) -> Iterator[tuple[str, str, list[str]]]:
    """n pairs as (prompt, response, label of each clause of the response)."""
    writer = _Writer(seed, held_out)
    pairs = filter(None, iter(writer.pair, ()))
    return (next(pairs) for _ in range(n))


def fit(pairs: int = TRAINING_PAIRS) -> LinearChain:
    """The CRF, fitted on pairs that this module writes: python -m spanforge.llm.pair_defects saves its weights."""
    sequences, tags = [], []
    for prompt, response, labels in labelled_pairs(pairs):
        sequences.append(_read(prompt, response)[1])
        tags.append(labels)
    return LinearChain.fit(sequences, tags, LABELS)


@functools.cache
def fitted(path: str = str(MODEL)) -> LinearChain:
    """The CRF with its saved weights, read once per process."""
    return LinearChain.load(path)


def pair_defects(completions: DataFrame, model_path: str = str(MODEL)) -> DataFrame:
    """(completion_id, defect) of the defective pairs, each completion once.

    defect: empty (also for a null response), truncated, refusal, copied_question, other_language.
    A null prompt is an empty question: nothing is copied and no language expected. Texts are read
    whole; an empty table gives no rows. The weights, some KB, are read by each worker."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fitted(model_path)
        for batch in batches:
            out = pd.DataFrame({"completion_id": batch["completion_id"], "defect": defects_of(batch["prompt"].tolist(), batch["response"].tolist(), model)})
            yield out[out["defect"].notna()]

    rows = spread(completions.select("completion_id", "prompt", "response"), "completion_id")
    return rows.mapInPandas(judge, "completion_id bigint, defect string").groupBy("completion_id").agg(F.min("defect").alias("defect"))


if __name__ == "__main__":
    fit().save(MODEL)
