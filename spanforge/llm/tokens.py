"""Token counts with the public tokenizers; their folder is a parameter."""

from __future__ import annotations

import base64
import functools
import importlib.util

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"


@functools.cache
def encoding(folder: str, vocabulary: str):
    """The byte-level BPE of a rank file; loaded once per Python worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_public_tokenizers", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a whole text as bigint; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(folder, vocabulary)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)
