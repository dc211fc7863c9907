"""Trains the personal-information model: python -m spanforge.llm.train_pii FOLDER [steps] [processes] [--new].

Items, names and their surroundings are written by pii_texts, which shares no sentence with the
documents that the model reads. FOLDER holds tables whose texts name no persons (speech, screen
and scene texts); NEUTRAL rows of each serve as neutral text."""

from __future__ import annotations

import os

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import multiprocessing as mp  # noqa: E402
import sys  # noqa: E402
import time  # noqa: E402

import numpy as np  # noqa: E402

from spanforge.llm.bilstm import Adam, BiLstmCrf  # noqa: E402
from spanforge.llm.pii import IDS, MODEL, TAGS, TYPES, char_ids, tag_texts  # noqa: E402
from spanforge.llm.pii_texts import Writer  # noqa: E402

LENGTH, COLUMNS, HIDDEN = 160, 48, 64
#: The learning rate, which falls to a twentieth of it; three quarters of it where training goes on.
RATE = 4e-3
#: Rows of each table that serve as neutral text.
NEUTRAL = 12_000
_state: dict = {}


def batch(writer: Writer, columns: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, gold = np.zeros((length, columns), np.int32), np.zeros((length, columns), np.int64)
    for j in range(columns):
        text, spans, listed = writer.window(length)
        ids[:, j] = char_ids(text, listed)
        for a, b, kind in spans:
            tag = 2 * TYPES.index(kind) + 1
            gold[a:b, j] = tag + 1
            gold[a, j] = tag
    return ids, gold, np.full(columns, length)


def neutral_texts(folder: str, rows: int = NEUTRAL) -> list[str]:
    import pyarrow.dataset as ds

    out = []
    for table, column in (("speech_spans", "text"), ("ocr_spans", "text"), ("visual_spans", "summary")):
        texts = ds.dataset(f"{folder}/{table}.parquet").head(rows * 2, columns=[column])[column].to_pylist()
        out += [t for t in texts if t and len(t) > 8][:rows]
    return out


def _begin(number, neutral) -> None:
    with number.get_lock():
        number.value += 1
        _state["writer"] = Writer(1000 + number.value, neutral)


def _work(params: dict) -> tuple[float, dict]:
    return BiLstmCrf(params).gradients(*batch(_state["writer"], COLUMNS))


def save(model: BiLstmCrf, path=MODEL) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in model.p.items()})


def labelled_texts(texts: int, seed: int = 5, held_out: bool = True) -> list[tuple[str, list[tuple[int, int, str]], frozenset[str]]]:
    """Texts of some sentences, their items and the words of a lexicon that lists part of the names; by default
    all frames, names, syllables and streets are held out."""
    w, out = Writer(seed, held_out=held_out), []
    for _ in range(texts):
        lang, text, spans, names = w.r.choice(["en", "en", "en", "de", "es", "fr"]), "", [], set()
        while len(text) < 300:
            s, sp, listed = w.sentence(lang, w.r.choices(["plain", "decoy", "item", "clause", "told"], [2, 2, 3, 2, 2])[0])
            text += w.r.choice([" ", " ", "\n"])
            spans += [(a + len(text), b + len(text), k) for a, b, k in sp]
            text += s
            names |= {s[a:b].lower() for a, b in listed}
        out.append((text, spans, frozenset(names)))
    return out


def accuracy(model: BiLstmCrf, texts: int = 300, seed: int = 5, held_out: bool = True, lexicon: bool = False) -> dict[str, tuple[float, float, int]]:
    """(precision, recall, items) per type on labelled texts, of whole items with exact bounds, with or without a partial lexicon."""
    labelled = labelled_texts(texts, seed, held_out)
    hit, said, true = (dict.fromkeys(TYPES, 0) for _ in range(3))
    names = [n if lexicon else frozenset() for _, _, n in labelled]
    for (_, gold, _), found in zip(labelled, tag_texts([t for t, _, _ in labelled], names, model)):
        for _, _, k in gold:
            true[k] += 1
        for item in found:
            said[item[2]] += 1
            hit[item[2]] += item in gold
    return {t: (round(hit[t] / max(said[t], 1), 3), round(hit[t] / max(true[t], 1), 3), true[t]) for t in TYPES}


def main(folder: str, steps: int = 2500, processes: int = 6) -> None:
    model = BiLstmCrf(dict(BiLstmCrf.new(IDS, len(TAGS), hidden=HIDDEN).p)) if not MODEL.exists() or "--new" in sys.argv else __import__("spanforge.llm.pii", fromlist=["x"]).load_model()
    adam, began = Adam(model), time.time()
    number = mp.Value("i", int(time.time()) % 100_000)
    with mp.Pool(processes, _begin, (number, neutral_texts(folder))) as pool:
        for n in range(1, steps + 1):
            adam.rate = (RATE if "--new" in sys.argv else 0.75 * RATE) * min(1.0, n / 50) * (0.05 ** (n / steps))
            found = pool.map(_work, [model.p] * processes, chunksize=1)
            adam.step({k: np.mean([g[k] for _, g in found], axis=0) for k in model.p})
            if n % 100 == 0:
                print(n, round(time.time() - began), round(float(np.mean([x for x, _ in found])), 3), accuracy(model) if n % 500 == 0 else "", flush=True)
                save(model)
    save(model)


if __name__ == "__main__":
    main(sys.argv[1], *[int(x) for x in sys.argv[2:] if x.isdigit()])
