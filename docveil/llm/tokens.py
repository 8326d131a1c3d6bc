"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files are, unless the session's setting below names another folder.
FOLDER, SETTING = "/opt/tokenizers", "docveil.tokenizers"
#: Vocabulary used by default: byte pairs for many languages.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-pair vocabularies of this family cut text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@cache
def encoding(folder: str, name: str):
    import tiktoken

    ranks = {}
    for line in Path(folder, name).read_bytes().splitlines():
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(folder: str, name: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        enc = encoding(folder, name)
        for batch in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(n, pa.int64())], [*keep, "tokens"])

    return run


def token_counts(docs: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep..., tokens BIGINT`` for each row; a null or empty text has 0 tokens. Only the columns named are read."""
    folder = docs.sparkSession.conf.get(SETTING, FOLDER)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "tokens long"])
    return docs.select(*keep, "text").mapInArrow(_counter(folder, vocabulary, list(keep)), schema)
