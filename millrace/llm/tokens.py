"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship

#: Byte-level BPE; ranks file of the installed public tokenizers. MILLRACE_TOKENIZER names another one.
DEFAULT = "byte_bpe_50k.tiktoken"


def tokenizer_path() -> str:
    if named := os.environ.get("MILLRACE_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


_loaded: dict = {}


def encoder(path: str):
    """One encoding per worker process."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(text: str | Column, path: str | None = None) -> Column:
    """Tokens of the whole text; 0 for null and empty texts. Strings of special tokens are ordinary text."""
    path = path or tokenizer_path()
    ship(SparkSession.active())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(F.col(text) if isinstance(text, str) else text)


def sized(documents: DataFrame, *also: str, path: str | None = None) -> DataFrame:
    """(doc_id, also..., tokens): the text goes to the tokenizer and no further."""
    return documents.select("doc_id", *also, token_count("text", path).alias("tokens"))
