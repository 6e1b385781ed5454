"""Token counts of a public tokenizer, by its vocabulary file."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("KELPGRAPH_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the vocabulary's texts are cut into words before merging; fixed with the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII only, where the standard library's faster engine can say it.
_BLANK = r" \t\n\x0b\x0c\r"
ASCII_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{_BLANK}A-Za-z0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
MEMO = 200_000


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The encoding of a vocabulary file of ranks; one per worker process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("kelpgraph", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class _Lengths(dict):
    """Token counts of words, remembered up to MEMO words."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word))
        if len(self) < MEMO:
            self[word] = n
        return n


@lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[str], int]:
    encode = encoding(path).encode_ordinary
    length = _Lengths(encode).__getitem__

    def count(text: str) -> int:
        if text.isascii():
            return sum(map(length, ASCII_WORDS.findall(text)))
        return len(encode(text))

    return count


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """The number of tokens of a text; 0 for null."""
    return _counter(path)(text) if text else 0


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Column of token counts (int); null counts 0. The words are merged one by one, so equal words are looked up."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        count = _counter(path)
        return pd.Series([count(t) if t else 0 for t in texts], dtype="int32")

    return run(text)
