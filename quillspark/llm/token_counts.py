"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's tokenizer parts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a rank file; a worker process builds it once."""
    known = tiktoken.__dict__.setdefault("_quillspark_encodings", {})
    if path not in known:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        known[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return known[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            *kept, texts = batch.columns
            total, prompt = [], []
            for text in texts.to_pylist():
                total.append(len(encode(text)))
                head, line, _ = text.partition("\n")
                prompt.append(min(total[-1], len(encode(head + line))) if line else 0)
            yield pa.record_batch([*kept, pa.array(total, pa.int32()), pa.array(prompt, pa.int32())], names=[*batch.schema.names[:-1], "tokens", "prompt"])

    return run


def count_tokens(df: DataFrame, text: str = "text", keep: list[Column] | None = None, path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` with ``tokens`` and ``prompt`` (tokens of the first of several lines).

    Whole texts are counted; null and empty texts have no row.
    """
    cut = df.where(F.length(text) > 0).select(*(keep or []), F.col(text).alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:-1]]
    return cut.mapInArrow(_count(path), ", ".join([*kept, "tokens int", "prompt int"]))
