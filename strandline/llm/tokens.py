"""Sizes of texts in tokens of public tokenizers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES = "bytes"


def token_count(text: Column, tokenizer: str = BYTES) -> Column:
    """Tokens of a whole text as a long, without special tokens; a null text has 0.

    ``tokenizer`` is "bytes" (one token per UTF-8 byte, counted in the JVM) or the path of a vocabulary file that
    every executor can read: ``.json`` (tokenizers) or ``.model`` (sentencepiece). Strings that look like special
    tokens count as ordinary text.
    """
    if tokenizer == BYTES:
        return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if tokenizer.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer)
            t.encode_special_tokens = True
            size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
        elif tokenizer.endswith(".model"):
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            size = lambda x: len(t.encode(x))
        else:
            raise ValueError(f"unknown kind of vocabulary file: {tokenizer}")
        for texts in parts:
            yield texts.map(lambda x: size(x) if x else 0).astype("int64")

    return count(text)
