"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("WATCHBILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PIECE = 100_000  # letters given to the tokenizer at once, or more where there is no border of words


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file of ranks."""
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def border(text: str, most: int) -> int:
    """A place near `most` at which the tokenizer cuts the text into words anyway, len(text) if there is none.

    A single blank between two other characters goes with what follows. Texts without one up to there are read word by
    word, as the tokenizer does.
    """
    at = text.rfind(" ", 1, most)
    while at > 0:
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at = text.rfind(" ", 1, at)
    import regex

    for m in regex.finditer(PATTERN, text):
        # blanks at the end of a text are cut differently from those within
        if m.end() >= most and not text[m.end() - 1].isspace():
            return m.end()
    return len(text)


def count(encoding, text: str) -> int:
    """Tokens of a whole text; very long ones are cut where the tokenizer cuts them into words, which no token spans."""
    total = 0
    while len(text) > PIECE:
        at = border(text, PIECE)
        total += len(encoding.encode_ordinary(text[:at]))
        text = text[at:]
    return total + len(encoding.encode_ordinary(text)) if text else total


def n_tokens(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for null and empty texts. Special tokens' names in a text are ordinary text."""

    @F.pandas_udf("long")
    def sizes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = encoder(folder, vocabulary)
        for s in parts:
            yield pd.Series([count(encoding, t) if t else 0 for t in s], dtype="int64")

    return sizes(text)
