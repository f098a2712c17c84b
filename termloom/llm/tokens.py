"""Sizes of texts in tokens of a public byte-pair tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file, which every executor must have at this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenization pattern of that vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer, read once in each Python process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_sizes(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """(key, *keep, n_tokens) for each row. A null text has 0 tokens; texts are read whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = np.fromiter((len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(batch.num_columns - 1))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], names=[*batch.schema.names[:-1], "n_tokens"])

    rows = docs.select(F.col(key), *keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, f"{kinds}, n_tokens long")
