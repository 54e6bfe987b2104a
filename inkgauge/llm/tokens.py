"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import with_struct

#: Where the vocabulary files lie, and which is used; both are parameters of the operators.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pattern by which byte-level BPE vocabularies of this family cut texts.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoding of a vocabulary file of ranks; loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = PATTERN
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str) -> int:
    return len(encoding(path).encode_ordinary(text)) if text else 0


def with_tokens(df: DataFrame, text: str = "text", into: str = "n_tokens", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the number of tokens of the column ``text``; null and empty texts have 0."""
    path = os.path.join(folder, vocabulary)
    return with_struct(df, text, into, T.LongType(), lambda t: count(t, path))
