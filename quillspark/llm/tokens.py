"""Sizes of texts in tokens of a public tokenizer, and in words and marks."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the rank file of the byte-level vocabulary lies; a parameter of every operator that counts tokens.
DEFAULT_RANKS = os.environ.get("QUILLSPARK_TOKEN_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the splitting pattern that belongs to this public vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A token for piece sizes: a run of letters, digits and underscores, or another single character.
WORD_OR_MARK = re.compile(r"\w+|[^\w\s]")


@cache
def encoder(ranks: str):  # noqa: ANN201
    """The tokenizer of a rank file that was given to the executors, loaded once per Python worker."""
    import tiktoken

    with open(SparkFiles.get(os.path.basename(ranks)), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


def token_sizes(docs: DataFrame, keys: list[str], text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(keys, size): tokens of each text; a null text has none. Strings of special tokens count as plain text.

    ranks is a path of the driver; the file is sent to the executors once.
    """
    docs.sparkSession.sparkContext.addFile(ranks)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks).encode_ordinary
        for part in parts:
            out = part[keys].copy()
            out["size"] = [len(encode(t)) if t else 0 for t in part[text]]
            yield out

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", size long"
    return docs.select(*[F.col(k) for k in keys], F.col(text)).mapInPandas(run, schema)
