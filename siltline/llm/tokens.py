"""Sizes of texts in tokens of a public tokenizer, whose files lie outside the repository."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from siltline.session import widened

TOKENIZER = os.environ.get("SILTLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published word pattern of that byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of the whole text; null and empty texts have none."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keep) + ", tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            yield b[keep].assign(tokens=[len(encode(t)) if t else 0 for t in b[text]])

    return widened(df.select(*keep, text)).mapInPandas(run, schema)
